"""Fill-in-the-middle: texts cut at two places and their middle moved to the end.

An Arrow-batched pandas UDF finds where the units of a text end (code points, or whatever ``unit`` matches) with
the regex library: one match holds many units, and all their ends are read from its repeated group into a
compact array. The two cut places are then two look-ups in that array. Seeds come from a SHA-256 of the row's
key, so the result depends on the row alone: a task that runs again gives the same text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "(?s:.)"
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"
UNITS_A_MATCH = 512
PART_CHARS = 4_000_000  # of texts returned at a time, unless one is longer
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


class Cutter:
    """Cuts one text after another; unit must not match the empty string."""

    def __init__(self, unit: str, marks: tuple[str, str, str], plain_percent: int, spm_percent: int, seed: int):
        if regex.match(f"(?:{unit})", "") is not None:
            raise ValueError("a unit must not be empty")
        self.units = regex.compile(f"(?:(?P<unit>(?>{unit}))){{1,{UNITS_A_MATCH}}}+")
        self.marks, self.plain_percent, self.spm_percent, self.seed = marks, plain_percent, spm_percent, seed

    def ends(self, text: str) -> array:
        """Where each unit of text ends, from left to right."""
        found = array("I")
        for match in self.units.finditer(text):
            found.extend(match.ends("unit"))
        return found

    def draws(self, key: str) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{key}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]

    def cut(self, text: str, key: str) -> tuple:
        """A row of RESULT. What follows the last unit belongs to the suffix, what no unit holds to the next one."""
        ends = self.ends(text)
        n = len(ends)
        h1, h2, h3, h4 = self.draws(key)
        if not text or h3 % 100 >= 100 - self.plain_percent or any(mark in text for mark in self.marks):
            return n, PLAIN, None, None, text, _sha256(text)
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = ends[first - 1] if first else 0, ends[second - 1] if second else 0
        p, s, m = self.marks
        form = SUFFIX_FIRST if h4 % 100 < self.spm_percent else PREFIX_FIRST
        output = f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}" if form == SUFFIX_FIRST else f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"
        return n, form, a, b - a, output, _sha256(output)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    n, form, prefix, middle, output, digest = zip(*rows, strict=True)
    return pd.DataFrame({"n": n, "form": form, "prefix_chars": pd.array(prefix, "Int64"), "middle_chars": pd.array(middle, "Int64"), "output": output, "output_sha256": digest})


def fill_middle(
    docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = UNIT, marks: tuple[str, str, str] = MARKS, plain_percent: int = 10, spm_percent: int = 20, seed: int = 1
) -> DataFrame:
    """Adds n (units), form, prefix_chars, middle_chars, output and output_sha256 to docs.

    Form is plain (the text as it is) for plain_percent of the keys, for empty texts and for those that hold a mark;
    else spm (suffix, prefix, middle) for spm_percent and psm (prefix, suffix, middle) for the others. The
    prefix ends after the smaller of two drawn numbers of units, the middle after the larger. A null text is
    empty; a null key counts as an empty one; equal keys with equal texts give equal rows. Very long texts are taken
    whole, with one number for each unit. Other columns stay, columns of the new names are replaced, and an
    empty table gives an empty result.
    """

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        cutter = Cutter(unit, marks, plain_percent, spm_percent, seed)
        rows: list[tuple] = []
        for texts, keys in batches:
            held = 0
            for own, name in zip(texts, keys, strict=True):
                rows.append(cutter.cut(own, name))
                held += len(own)
                if held > PART_CHARS:
                    yield _frame(rows)
                    rows, held = [], 0
            if rows:
                yield _frame(rows)
                rows = []

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = F.pandas_udf(cut, RESULT)(whole, F.coalesce(F.col(key).cast("string"), F.lit("")))
    new = [field.split()[0] for field in RESULT.split(", ")]
    kept = [c for c in docs.columns if c not in new]
    return docs.select("*", found.alias("_cut")).select(*kept, *(F.col(f"_cut.{name}") for name in new))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that output was made from; exact, as texts that hold a mark stay plain."""
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)  # the first one is empty
    whole = F.when(form == SUFFIX_FIRST, F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))
    return F.when(form == PLAIN, output).otherwise(whole)
