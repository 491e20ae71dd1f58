"""Keyset and offset pages, and the cursor that carries a keyset between calls."""

from __future__ import annotations

import base64
import binascii
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after(keys: list[tuple[str, bool]], values: list) -> Column:
    """Rows that come after values in the order of keys, (column, descending) each."""
    found, same = F.lit(False), F.lit(True)
    for (name, descending), value in zip(keys, values, strict=True):
        further = F.col(name) < F.lit(value) if descending else F.col(name) > F.lit(value)
        found, same = found | (same & further), same & (F.col(name) == F.lit(value))
    return found


def keyset_page(rows: DataFrame, keys: list[tuple[str, bool]], limit: int, values: list | None = None) -> DataFrame:
    """One page with has_more on every row. The last key must be unique; one row more than limit is looked at.

    Spark takes the page with one bounded heap for each task; nothing is sorted whole.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    order = [F.desc(k) if descending else F.asc(k) for k, descending in keys]
    wanted = rows.where(after(keys, values)) if values is not None else rows
    page = wanted.orderBy(*order).limit(limit + 1)
    more = page.agg((F.count("*") > limit).alias("has_more"))
    return page.orderBy(*order).limit(limit).join(F.broadcast(more))  # one row, of at most limit + 1


def offset_page(rows: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    """Page numbers start at 1; smaller ones mean the first page."""
    return rows.orderBy(*order).offset((max(page, 1) - 1) * per_page).limit(per_page)


def encode_cursor(order: str, value: str, row_id: int) -> str:
    body = json.dumps({"id": row_id, "order": order, "value": value}, sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(cursor: str, order: str) -> tuple[str, int]:
    """(value, id); a cursor that is damaged or belongs to another order is refused."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        value, row_id = str(found["value"]), int(found["id"])
    except (binascii.Error, ValueError, KeyError, TypeError) as error:
        raise ValueError("invalid cursor") from error
    if found.get("order") != order or row_id < 1:
        raise ValueError("cursor does not fit this order")
    return value, row_id


def all_of(conditions: list[Column]) -> Column:
    """Conjunction; without conditions every row passes."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
