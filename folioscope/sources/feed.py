"""Landed pages of a feed as a Spark source: one partition for each date window and pass.

A fetcher lands the pages of a window below path/<kind>/<first>-<last>/ (days as yyyymmdd, kind submitted or
updated) as Atom files and ends with an empty file `complete`; a window without it is not there. Register FeedSource once, then:

    spark.read.format("landed_feed").options(path=..., start="2024-01-01", end="2024-01-31").load()
    spark.readStream.format("landed_feed").options(path=...).load()
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "entry_id string, base_id string, version int, title string, summary string, published timestamp, updated timestamp, comment string, doi string, journal_ref string, primary_category string, authors array<string>, categories array<string>, kind string, query string"

#: The passes of a poll and the query field of each, and the most results of a query.
FIELDS = {"submitted": "submittedDate", "updated": "lastUpdatedDate"}
MOST_RECENT, MOST_BACKFILL = 500, 5000


class FeedCapReached(Exception):
    """A window has more entries than one query may return, so a smaller window has to be fetched."""


def feed_query(kind: str, first: date, last: date, category: str = "math.CO") -> str:
    """The query of a window, both days included."""
    return f"cat:{category} AND {FIELDS[kind]}:[{first:%Y%m%d}0000 TO {last:%Y%m%d}2359]"


def windows(first: date, last: date, days: int) -> list[tuple[date, date]]:
    """Windows of so many days that cover all days from first to last, the last one cut."""
    if days < 1:
        raise ValueError("days must be at least 1")
    starts = [first + timedelta(days=n) for n in range(0, (last - first).days + 1, days)]
    return [(s, min(last, s + timedelta(days=days - 1))) for s in starts]


@dataclass(order=True)
class FeedWindow(InputPartition):
    """Ordered by the last day, as polls are."""

    last: date
    first: date
    kind: str

    @property
    def folder(self) -> str:
        return f"{self.kind}/{self.first:%Y%m%d}-{self.last:%Y%m%d}"


class _Pages:
    """What batch and stream readers share."""

    def __init__(self, options: dict):
        self.path, self.category = options["path"], options.get("category", "math.CO")
        self.most, self.on_cap = int(options.get("max_results", MOST_BACKFILL)), options.get("on_cap", "fail")
        if self.on_cap not in ("fail", "stop"):
            raise ValueError("on_cap must be fail or stop")

    def _files(self, folder: str) -> tuple:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        return fs, fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{folder}", allow_not_found=True))

    def landed(self) -> list[FeedWindow]:
        """Complete windows in order: names of folders, not their pages."""
        found = []
        for kind in FIELDS:
            fs, folders = self._files(kind)
            done = fs.get_file_info([f"{f.path}/complete" for f in folders if f.type == pyarrow.fs.FileType.Directory])
            for info in done:
                if info.type == pyarrow.fs.FileType.File:
                    first, last = (datetime.strptime(d, "%Y%m%d").date() for d in info.path.split("/")[-2].split("-"))
                    found.append(FeedWindow(last, first, kind))
        return sorted(found)

    def read(self, partition: FeedWindow | None) -> Iterator[tuple]:
        """Entries of a window, page by page; a page is parsed as it is read. Without windows Spark asks once for none."""
        if partition is None:
            return
        fs, files = self._files(partition.folder)
        query, n = feed_query(partition.kind, partition.first, partition.last, self.category), 0
        for page in sorted(f.path for f in files if f.path.endswith(".xml")):
            with fs.open_input_stream(page) as stream:
                for _, element in ET.iterparse(stream):
                    if _local(element) == "entry":
                        n += 1
                        if n > self.most:
                            if self.on_cap == "stop":
                                return
                            raise FeedCapReached(f"{partition.folder} has more than {self.most} entries")
                        yield (*_entry(element), partition.kind, query)
                        element.clear()


def _local(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _moment(text: str | None) -> datetime | None:
    """A moment in UTC; null where it is none."""
    try:
        found = datetime.fromisoformat(text.strip()) if text else None
    except ValueError:
        return None
    return found and (found.replace(tzinfo=timezone.utc) if found.tzinfo is None else found.astimezone(timezone.utc))


def _entry(element) -> tuple:
    """An entry's columns up to categories; white space in texts is squeezed, what is missing is null."""
    texts, authors, categories, primary = {}, [], [], None
    for child in element:
        name = _local(child)
        if name == "author":
            authors += [" ".join(n.text.split()) for n in child if _local(n) == "name" and n.text]
        elif name == "category" and child.get("term"):
            categories.append(child.get("term"))
        elif name == "primary_category":
            primary = child.get("term")
        elif child.text and child.text.strip():
            texts[name] = " ".join(child.text.split())
    entry_id = texts.get("id")
    base, _, version = (entry_id or "").rsplit("/abs/", 1)[-1].rpartition("v")
    known = bool(base) and version.isascii() and version.isdigit()
    whole = (entry_id or "").rsplit("/abs/", 1)[-1] or None
    return (
        entry_id, base if known else whole, int(version) if known else whole and 1, texts.get("title"), texts.get("summary"), _moment(texts.get("published")), _moment(texts.get("updated")),
        texts.get("comment"), texts.get("doi"), texts.get("journal_ref"), primary or (categories[0] if categories else None), authors, categories,
    )


class _FeedReader(_Pages, DataSourceReader):
    """Windows that touch the days from start to end, each whole; without these options all."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.start, self.end = (date.fromisoformat(options[k]) if k in options else None for k in ("start", "end"))

    def partitions(self) -> list[FeedWindow]:
        return [w for w in self.landed() if (self.start is None or w.last >= self.start) and (self.end is None or w.first <= self.end)]


class _FeedStreamReader(_Pages, DataSourceStreamReader):
    """An offset is the last window taken. Windows have to land in the order of their last days; a late one is for a batch read."""

    def initialOffset(self) -> dict:
        return {"last": "0001-01-01", "first": "0001-01-01", "kind": ""}

    def latestOffset(self) -> dict:
        found = self.landed()
        return {"last": str(found[-1].last), "first": str(found[-1].first), "kind": found[-1].kind} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[FeedWindow]:
        low, high = (FeedWindow(date.fromisoformat(o["last"]), date.fromisoformat(o["first"]), o["kind"]) for o in (start, end))
        return [w for w in self.landed() if low < w <= high]

    def commit(self, end: dict) -> None:
        """Pages stay where they landed."""


class FeedSource(DataSource):
    """Options: path, category, max_results (5000) and on_cap (fail or stop) of a window; of batch reads start and end, too."""

    @classmethod
    def name(cls) -> str:
        return "landed_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FeedStreamReader(dict(self.options))


def windows_to_fetch(spark: SparkSession, path: str, first: date, last: date, days: int, category: str = "math.CO") -> DataFrame:
    """(kind, first, last, query): windows of both passes that have not landed whole, one row for each window."""
    done = {(w.kind, w.first, w.last) for w in _Pages({"path": path}).landed()}
    rows = [(kind, a, b, feed_query(kind, a, b, category)) for a, b in windows(first, last, days) for kind in FIELDS if (kind, a, b) not in done]
    return spark.createDataFrame(rows, "kind string, first date, last date, query string")


def revisions(entries: DataFrame) -> DataFrame:
    """Each revision once, of entries that overlapping windows and both passes have brought; entries without id are left out."""
    return entries.where(F.col("base_id").isNotNull()).dropDuplicates(["base_id", "version"])
