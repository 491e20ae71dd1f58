"""Keyword mining, tagging and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.bibtex import citation_key, entry, protect_capitals, reformat
from folioscope.functions.text import LATEX_RULES, SINGULARS, STOPWORDS, WORD, line_ngrams, ngrams, slugify, useful_line, words
from folioscope.operators.attach import ordered_list
from folioscope.operators.tagging import document_frequency, phrase_links
from folioscope.plans.registry import Registry
from folioscope.plans.relations import authors, paper_authors, papers, table, texts, with_ctes

registry = Registry()
query = registry.query


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_words(text: str) -> str:
    """SQL for the words of a text, from the same fixed values as the functions."""
    for pattern, by in LATEX_RULES:
        options = "gs" if pattern.startswith("(?s)") else "g"
        text = f"regexp_replace({text}, {_quoted(pattern.removeprefix('(?s)'))}, {_quoted(by.replace('$1', chr(92) + '1'))}, '{options}')"
    plain = f"regexp_replace(strip_accents({text}), '[^\\x00-\\x7F]', '', 'g')"
    table = "map {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in SINGULARS.items()) + "}"
    stop = "[" + ", ".join(map(_quoted, STOPWORDS)) + "]"
    singular = (
        f"CASE WHEN {table}[w] IS NOT NULL THEN {table}[w] WHEN list_contains({stop}, w) OR regexp_matches(w, '(less|ness|ous|ss|is)$') THEN w "
        "WHEN regexp_matches(w, '[a-z]{2}ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(s|x|z|ch|sh)es$') THEN regexp_replace(w, 'es$', '') "
        "WHEN regexp_matches(w, '[a-z]{2}[^us]s$') THEN regexp_replace(w, 's$', '') ELSE w END"
    )
    return f"list_transform(regexp_extract_all(lower({plain}), '{WORD}'), lambda w: {singular})"


def _sql_grams(tokens: str, most: int) -> str:
    return " || ".join(f"list_transform(range(1, greatest(len({tokens}) - {n - 2}, 1)), lambda i: array_to_string({tokens}[i : i + {n - 1}], ' '))" for n in range(1, most + 1))


_WORDS = f"w AS (SELECT doc_id, {_sql_words('text')} AS toks FROM documents), g AS (SELECT doc_id, list_distinct({_sql_grams('toks', 3)}) AS grams FROM w)"
_STOP = "[" + ", ".join(map(_quoted, STOPWORDS)) + "]"


def _grams(spark, sf_dir, most):
    return texts(spark, sf_dir).select(F.col("doc_id").alias("id"), words(F.col("text")).alias("toks")).select("id", ngrams(F.col("toks"), most).alias("grams"))


@query(f"WITH {_WORDS}" + f""" SELECT phrase, count(*) AS paper_count, cast(len(string_split(phrase, ' ')) AS BIGINT) AS word_count FROM (SELECT unnest(grams) AS phrase FROM g)
WHERE len(list_filter(string_split(phrase, ' '), lambda x: length(x) <= 1 OR list_contains({_STOP}, x))) = 0 GROUP BY phrase HAVING count(*) >= 5""")  # fmt: skip
def doc_frequency_ngrams(spark, sf_dir):
    """Keyword candidates: useful phrases of up to three words in at least five documents."""
    return _candidates(spark, sf_dir, 3)


def _candidates(spark, sf_dir, most):
    lines = texts(spark, sf_dir).select(useful_line(words(F.col("text"))).alias("line"))
    docs = lines.select(line_ngrams(F.col("line"), most).alias("grams"))
    return document_frequency(docs, 5).select("phrase", "paper_count", F.size(F.split("phrase", " ")).cast("long").alias("word_count"))


_WORDS4 = f"w AS (SELECT doc_id, {_sql_words('text')} AS toks FROM documents), g AS (SELECT doc_id, list_distinct({_sql_grams('toks', 4)}) AS grams FROM w)"


@query(f"WITH {_WORDS4}" + f""" SELECT phrase, count(*) AS paper_count, cast(len(string_split(phrase, ' ')) AS BIGINT) AS word_count FROM (SELECT unnest(grams) AS phrase FROM g)
WHERE len(list_filter(string_split(phrase, ' '), lambda x: length(x) <= 1 OR list_contains({_STOP}, x))) = 0 GROUP BY phrase HAVING count(*) >= 5""")  # fmt: skip
def doc_frequency_ngrams_four(spark, sf_dir):
    """Keyword candidates of up to four words, as the original mines them; doc_frequency_ngrams has up to three."""
    return _candidates(spark, sf_dir, 4)


_DICTIONARY = "d AS (SELECT array_to_string(toks[1:2], ' ') AS phrase, max(item_id) AS keyword_id FROM (SELECT item_id, " + _sql_words("text") + " AS toks FROM benchmark) WHERE len(toks) >= 2 GROUP BY 1)"


@query(f"WITH {_WORDS}, {_DICTIONARY}" + " SELECT keyword_id, doc_id AS id FROM (SELECT doc_id, unnest(grams) AS phrase FROM g) JOIN d USING (phrase)")
def phrase_tagging(spark, sf_dir):
    """Documents tagged by dictionary phrases (first two words of the benchmark items)."""
    toks = words(F.col("text"))
    items = table(spark, sf_dir, "benchmark").select("item_id", toks.alias("toks")).where(F.size("toks") >= 2)
    known = items.groupBy(F.array_join(F.slice("toks", 1, 2), " ").alias("phrase")).agg(F.max("item_id").alias("keyword_id"))
    return phrase_links(_grams(spark, sf_dir, 2), known).select("keyword_id", "id")


@query("""SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9\\s-]', '', 'g'), ' ' || chr(10) || chr(9) || chr(13)), '\\s+', '-', 'g'), '-+', '-', 'g') AS slug FROM documents""")
def slugs_whole(spark, sf_dir):
    """Slugs of whole texts."""
    return texts(spark, sf_dir).select("doc_id", slugify(F.col("text")).alias("slug"))


_LISTS = "lists AS (SELECT paper_id, string_agg(split_part(name, '#', 1) || 'A' || author_id, '' ORDER BY author_order, author_id) AS names FROM paper_authors JOIN authors USING (author_id) GROUP BY paper_id)"


def _lists(spark, sf_dir, only=None):
    """Author lists, of the papers (paper_id) in only or of all."""
    named = F.concat(F.substring_index("name", "#", 1), F.lit(" A"), F.col("author_id"))
    links = paper_authors(spark, sf_dir) if only is None else paper_authors(spark, sf_dir).join(only, "paper_id", "left_semi")
    links = links.join(authors(spark, sf_dir), "author_id").withColumn("full", named)
    return ordered_list(links, "paper_id", F.struct("author_order", "author_id"), F.col("full"), "authors")


@query(with_ctes("papers", "paper_authors", "authors", more="lists AS (SELECT paper_id, string_agg('A' || author_id, '' ORDER BY author_order, author_id) AS names FROM paper_authors JOIN authors USING (author_id) GROUP BY paper_id)") + """
SELECT id, names || '1998' AS key FROM papers JOIN lists ON paper_id = id WHERE published_date >= DATE '1998-01-01' AND published_date < DATE '1999-01-01' AND lower(names || '1998') LIKE 'a1%'""")  # fmt: skip
def bibtex_key_lookup(spark, sf_dir):
    """Keys of one year's papers, to be matched with a searched key: the year is a range on the date."""
    year = papers(spark, sf_dir).where("published_date >= DATE '1998-01-01' AND published_date < DATE '1999-01-01'").select("id")
    keyed = year.join(_lists(spark, sf_dir, year.select(F.col("id").alias("paper_id"))), F.col("id") == F.col("paper_id")).select("id", citation_key(F.col("authors"), F.lit(1998), True).alias("key"))
    return keyed.where(F.lower("key").startswith("a1"))


def _entries(p):
    doi = F.when(F.col("status") == "F", F.concat(F.lit("10.1000/"), "id"))
    fields = [("title", protect_capitals(F.col("category"))), ("year", F.year("published_date").cast("string")), ("doi", doi)]
    return p.select("id", entry("article", F.concat(F.lit("P"), "id"), fields).alias("bibtex"))


@query(with_ctes("papers") + """SELECT id, '@article{P' || id || ',' || chr(10) || '  title = {' || substr(category, 1, 1) || regexp_replace(regexp_replace(substr(category, 2), '([A-Z]{2,})', '{\\1}', 'g'), '([A-Z])', '{\\1}', 'g') || '},' || chr(10) || '  year = {' || year(published_date) || '}'
|| CASE WHEN status = 'F' THEN ',' || chr(10) || '  doi = {10.1000/' || id || '}' ELSE '' END || chr(10) || '}' AS bibtex FROM papers""")  # fmt: skip
def bibtex_entries_whole(spark, sf_dir):
    """Entries of all papers."""
    return _entries(papers(spark, sf_dir))


@query(with_ctes("papers") + """SELECT id, '@article{F' || user_id || 'Li' || year(published_date) || ',' || chr(10) || '  author = {F' || user_id || ', Jo and Ann Li},' || chr(10) || '  title = {On {deep ' || lower(category) || '}},' || chr(10) || '  year = {' || year(published_date) || '},' || chr(10)
|| '  journal = {J. {of {S}}},' || chr(10) || CASE WHEN status = 'F' THEN '  doi = {10.1/' || id || '},' || chr(10) ELSE '' END || '  month = {jan},' || chr(10) || '  note = {x = {y, "z"}}' || chr(10) || '}' AS bibtex FROM papers""")  # fmt: skip
def bibtex_reformatted(spark, sf_dir):
    """Entries with nested braces, quotes, bare values and missing commas, in the house style."""
    p, text = papers(spark, sf_dir), F.lit
    raw = F.concat(
        text("@Article{Old_"), "id", text(",\n note = {x = {y, \"z\"}}, Title={On {{deep} "), F.lower("category"), text("}},\n author = \"F"), "user_id", text(", Jo and\n Ann Li\" year = "), F.year("published_date").cast("string"),
        text("\n journal = {J. {of {S}}}, month = jan, DOI = {"), F.when(F.col("status") == "F", F.concat(text("10.1/"), "id")).otherwise(""), text("}\n}"),
    )
    return reformat(p.select("id", raw.alias("raw"))).select("id", "bibtex")


registry.also("slugs", "slugs_whole")
registry.also("bibtex_entries", "bibtex_entries_whole")
