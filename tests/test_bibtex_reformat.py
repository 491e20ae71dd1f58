"""Entries read by brace depth and written in the house style."""

import random

from pyspark.sql import functions as F

from folioscope.functions.bibtex import FIELD_ORDER, entry_fields, reformat

RAW = r"""@Article{Old_2019,
  Title = {On {{SU}(2)} and {Nested {Deep {Braces}}}, part 2},
  author="Müller, Jörg and Anna {de la} Cruz and van der Berg, K.", year = 2019
  journal = {J. Comb.} , DOI={10.1/x}, pages = "1--{"}2", month = jan, note = {a = b}, url={}, Year = {2020}, broken = {never {closed
}"""


def test_one_entry(spark):
    table = spark.createDataFrame([(1, RAW), (2, None), (3, "no entry"), (4, "@misc{k1, title={X}}"), (5, "@book{,year=1999,author={Li Wu}}"), (6, "")], "id long, raw string")
    read = {r.id: [(f.name, f.value) for f in r.f] if r.f is not None else None for r in table.select("id", entry_fields(F.col("raw")).alias("f")).collect()}
    assert read[1] == [
        ("title", "On {{SU}(2)} and {Nested {Deep {Braces}}}, part 2"), ("author", "Müller, Jörg and Anna {de la} Cruz and van der Berg, K."), ("year", "2020"), ("journal", "J. Comb."),
        ("doi", "10.1/x"), ("pages", '1--{"}2'), ("month", "jan"), ("note", "a = b"), ("url", ""),
    ]
    assert read[3] == read[6] == []
    got = {r.id: r.bibtex for r in reformat(table).collect()}
    assert got[2] is None
    assert got[3] == got[6] == "@article{doi\n}"
    assert got[4] == "@misc{k1,\n  title = {X}\n}"
    assert got[5] == "@book{Wu1999,\n  author = {Li Wu},\n  year = {1999}\n}"
    lines = got[1].split("\n")
    assert lines[0] == "@article{MullerCruzBerg2020," and lines[-2:] == ["  note = {a = b}", "}"]
    assert [line.split(" = ")[0].strip() for line in lines[1:-1]] == ["author", "title", "year", "journal", "pages", "doi", "month", "note"]


def scan(raw):
    """Character by character."""
    start = raw.index(",") + 1
    fields, i, n = {}, start, len(raw)
    while i < n and raw[i] != "}":
        name = ""
        while i < n and raw[i] not in "=}":
            name, i = ("" if raw[i] == "," else name + raw[i]), i + 1
        if i >= n or raw[i] == "}":
            break
        i += 1
        while raw[i] in " \n":
            i += 1
        close, depth, value = {"{": "}", '"': '"'}[raw[i]], 0, ""
        i += 1
        while i < n and not (raw[i] == close and depth == 0):
            depth += {"{": 1, "}": -1}.get(raw[i], 0)
            value, i = value + raw[i], i + 1
        if i >= n:
            break
        fields[name.split()[-1].lower()] = " ".join(value.split())
        i += 1
    return list(fields.items())


def test_random_entries(spark):
    r = random.Random(3)

    def inner(depth, quoted):
        parts = [r.choice(["a", "B c", ", ", " = ", "é", "\n", "" if quoted else '"']) for _ in range(r.randrange(4))]
        if depth and r.random() < 0.8:
            parts.insert(r.randrange(len(parts) + 1), "{" + inner(depth - 1, False) + "}")
        return "".join(parts)

    def field():
        value = inner(4, True)
        return f"{r.choice([*FIELD_ORDER, 'note', 'X-y'])}{r.choice(['=', ' = '])}" + (f'"{value}"' if r.random() < 0.5 else "{" + value + "}")

    raws = ["@article{key" + "".join(("\n" if i and r.random() < 0.3 else ",") + field() for i in range(r.randrange(1, 8))) + r.choice(["}", ",}", "\n}"]) for _ in range(150)]
    got = spark.createDataFrame(list(enumerate(raws)), "id int, raw string").select("id", entry_fields(F.col("raw")).alias("f")).collect()
    for x in got:
        assert [(f.name, f.value) for f in x.f] == scan(raws[x.id]), raws[x.id]
