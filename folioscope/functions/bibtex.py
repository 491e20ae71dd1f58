"""BibTeX keys and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.display import clean_title
from folioscope.functions.text import fold_accents


def protect_capitals(title: Column) -> Column:
    """Braces around capitals after the first character; capitals of acronyms get them twice."""
    # Both patterns, as the entries must match.
    rest = F.regexp_replace(F.regexp_replace(F.substr(title, F.lit(2)), "([A-Z]{2,})", "{$1}"), "([A-Z])", "{$1}")
    return F.concat(F.substring(title, 1, 1), rest)


def citation_key(authors: Column, year: Column, published: bool) -> Column:
    """Last words of the authors' names without accents and marks, the year, and x for preprints."""
    last = F.array_join(F.transform(authors, lambda a: F.substring_index(F.trim(a), " ", -1)), "\u0001")
    joined = F.regexp_replace(fold_accents(last), r"[^\p{L}\p{N}]", "")
    return F.concat(F.when(F.size(authors) > 0, joined).otherwise("arxiv"), year.cast("string"), F.lit("" if published else "x"))


def search_key(text: Column) -> Column:
    """struct(key, year) of a citation key, bare or in an entry, in lower case; null where it is none."""
    entry = F.regexp_extract(F.trim(text), r"^@\w+\s*\{\s*([^,\s]+)", 1)
    key = F.when(entry != "", entry).otherwise(F.trim(text))
    author = F.regexp_extract(key, r"^([A-Za-z0-9]+?)([12][0-9]{3})(x?)$", 1)
    year = F.regexp_extract(key, r"^([A-Za-z0-9]+?)([12][0-9]{3})(x?)$", 2)
    return F.when(F.length(author) >= 2, F.struct(F.lower(key).alias("key"), year.cast("int").alias("year")))


def entry(kind: str, key: Column, fields: list[tuple[str, Column]]) -> Column:
    """An entry with its fields in order; null and empty fields are left out, no comma after the last."""
    lines = F.array(*(F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), value, F.lit("}"))) for name, value in fields))
    return F.concat(F.lit(f"@{kind}{{"), key, F.lit(",\n"), F.array_join(F.array_compact(lines), ",\n"), F.lit("\n}"))


#: Fields that come first, in this order.
FIELD_ORDER = ["author", "title", "year", "journal", "volume", "number", "pages", "publisher", "doi", "url", "issn", "isbn", "month"]
#: What the scanner is in: before a name, before a value, in braces, in quotes, in a bare value, behind the entry.
NAME, VALUE, BRACED, QUOTED, BARE, DONE = range(6)
_STATE = "struct<mode:int,depth:int,name:string,text:string,fields:array<struct<name:string,value:string>>>"


def entry_fields(raw: Column) -> Column:
    """array<struct<name, value>> of an entry: names in lower case, values without their outer braces or quotes.

    The signs that matter and the text between them are folded with the depth of braces as state, so braces nest to any
    depth, a quote inside braces is text, and a missing comma ends no value too late: a bare value ends where the next name
    begins. Of repeated names the last value stays, at the first one's place. A value that is never closed is no field.
    """
    body = F.regexp_extract(raw, r"(?s)@\w+\s*\{\s*[^,{}=]*,(.*)$", 1)
    tokens = F.regexp_extract_all(body, F.lit(r'[{}",=]|[^{}",=]+'), F.lit(0))
    lastword = lambda text: F.lower(F.regexp_extract(text, r"([\w-]+)\s*$", 1))

    def step(s, t):
        text, depth, mode = s["text"], s["depth"], s["mode"]

        def to(mode, depth=F.lit(0), name=s["name"], text=F.lit(""), fields=s["fields"]):
            return F.struct(F.lit(mode).alias("mode"), depth.cast("int").alias("depth"), name.alias("name"), text.alias("text"), fields.alias("fields")).cast(_STATE)

        field = lambda value: F.array_append(s["fields"], F.struct(s["name"].alias("name"), F.trim(F.regexp_replace(value, r"\s+", " ")).alias("value")))
        before_next = F.regexp_replace(text, r"[\w-]+\s*$", "")
        more = F.concat(text, t)
        deeper = F.when(t == "{", depth + 1).when(t == "}", depth - 1).otherwise(depth)
        return (
            F.when(mode == DONE, s)
            .when(mode == NAME, F.when(t == "=", to(VALUE, name=lastword(text))).when(t == ",", to(NAME)).when(t == "}", to(DONE)).otherwise(to(NAME, text=more)))
            .when(mode == VALUE, F.when(t == "{", to(BRACED, F.lit(1))).when(t == '"', to(QUOTED)).when(t == ",", to(NAME)).when(t == "}", to(DONE)).when(F.trim(F.regexp_replace(t, r"\s+", " ")) == "", s).otherwise(to(BARE, text=t)))
            .when(mode == BRACED, F.when((t == "}") & (depth == 1), to(NAME, fields=field(text))).otherwise(to(BRACED, deeper, text=more)))
            .when(mode == QUOTED, F.when((t == '"') & (depth == 0), to(NAME, fields=field(text))).otherwise(to(QUOTED, deeper, text=more)))
            .otherwise(F.when(t == ",", to(NAME, fields=field(text))).when(t == "}", to(DONE, fields=field(text))).when(t == "=", to(VALUE, name=lastword(text), fields=field(before_next))).otherwise(to(BARE, text=more)))
        )

    begin = F.expr(f"CAST(named_struct('mode', {NAME}, 'depth', 0, 'name', '', 'text', '', 'fields', array()) AS {_STATE})")
    found = F.filter(F.aggregate(tokens, begin, step)["fields"], lambda f: f["name"] != "")

    def once(found):
        names = F.array_distinct(F.transform(found, lambda f: f["name"]))
        return F.transform(names, lambda n: F.element_at(F.filter(found, lambda f: f["name"] == n), -1))

    return F.element_at(F.transform(F.array(found), once), 1)


def reformat(entries: DataFrame, raw: str = "raw", name: str = "bibtex") -> DataFrame:
    """Adds name, the entry in raw in the house style: a new key of surnames and year, fields in order, capitals of the title protected.

    Names are "Family, Given" or "Given Family". Without authors or a year the entry's own key stays, else doi and the year. Empty fields
    go. What is no entry becomes an article without fields; null stays null. Other columns stay.
    """
    held, fields = entries.drop("_fields").withColumn("_fields", entry_fields(F.col(raw))), F.col("_fields")
    value = lambda wanted: F.coalesce(F.get(F.filter(fields, lambda f: f["name"] == wanted), F.lit(0))["value"], F.lit(""))
    people = F.filter(F.split(value("author"), r"\s+and\s+"), lambda a: F.trim(a) != "")
    surnames = F.transform(people, lambda a: F.trim(F.when(a.contains(","), F.substring_index(a, ",", 1)).otherwise(F.substring_index(F.trim(a), " ", -1))))
    own = F.regexp_extract(raw, r"@\w+\s*\{\s*([^,\s{}=]+)\s*,", 1)
    key = F.when((F.size(people) > 0) & (value("year") != ""), citation_key(surnames, value("year"), True)).when(own != "", own).otherwise(F.concat(F.lit("doi"), value("year")))
    kind = F.lower(F.regexp_extract(raw, r"@(\w+)\s*\{", 1))
    shown = lambda f: F.when(f["name"] == "title", protect_capitals(clean_title(f["value"]))).otherwise(f["value"])
    listed = F.array(*map(F.lit, FIELD_ORDER))
    place = lambda f: F.when(f["name"].isin(FIELD_ORDER), F.array_position(listed, f["name"])).otherwise(len(FIELD_ORDER) + 1).cast("int")
    ordered = F.array_sort(F.transform(F.filter(fields, lambda f: f["value"] != ""), lambda f, i: F.struct(place(f).alias("place"), i.alias("at"), f["name"].alias("name"), shown(f).alias("value"))))
    lines = F.transform(ordered, lambda f: F.concat(F.lit("  "), f["name"], F.lit(" = {"), f["value"], F.lit("}")))
    head = F.concat(F.lit("@"), F.when(kind != "", kind).otherwise("article"), F.lit("{"), key)
    whole = F.concat(head, F.when(F.size(lines) > 0, F.concat(F.lit(",\n"), F.array_join(lines, ",\n"))).otherwise(""), F.lit("\n}"))
    return held.withColumn(name, F.when(F.col(raw).isNotNull(), whole)).drop("_fields")
