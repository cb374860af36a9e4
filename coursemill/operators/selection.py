"""Exact quantiles of a column of any size: counts by value range, then refinement."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.session import release, stash

#: Equal parts that a range of values is counted by, and rows of a range that are looked at one by one.
PARTS, FEW = 4_096, 50_000


def order_statistics(df: DataFrame, column: str, ranks: list[int], parts: int = PARTS, few: int = FEW) -> dict[int, float]:
    """The values at these ranks (from 0) of the sorted values that are not null.

    Each pass counts the ranges that still hold a wanted rank in equal parts, and goes on with the parts
    that hold one, cut down to the values that occur in them. A range of few rows is read whole. So no
    task and no driver holds more than ``parts`` counts or ``few`` values for a rank, whatever the column.
    """
    found: dict[int, float] = {}
    values = stash(df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL"), "values")
    total = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    # ranges: (low, high, rows before, rows), with the ranks that they hold
    open_ = {(total["low"], total["high"], 0, total["n"]): [r for r in ranks if 0 <= r < total["n"]]} if total["n"] else {}
    while open_:
        later: dict[tuple, list[int]] = {}
        for (low, high, before, n), wanted in open_.items():
            if low == high:
                found |= dict.fromkeys(wanted, low)
            elif n <= few:
                listed = sorted(r["v"] for r in values.filter(F.col("v").between(low, high)).collect())
                found |= {r: listed[r - before] for r in wanted}
            else:
                part = F.least(F.floor((F.col("v") - low) / (high - low) * parts), F.lit(parts - 1))
                counts = values.filter(F.col("v").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("part").collect()
                at = before
                for c in counts:
                    inside = [r for r in wanted if at <= r < at + c["n"]]
                    if inside:
                        later.setdefault((c["low"], c["high"], at, c["n"]), []).extend(inside)
                    at += c["n"]
        open_ = later
    release(values)
    return found


def quantiles(df: DataFrame, column: str, shares: list[float], **sizes: int) -> list[float | None]:
    """Quantiles of the values that are not null, interpolated between neighbours; None without values."""
    n = df.filter(F.col(column).isNotNull()).count()
    if not n:
        return [None for _ in shares]
    places = [(n - 1) * s for s in shares]
    found = order_statistics(df, column, sorted({r for p in places for r in (math.floor(p), math.ceil(p))}), **sizes)
    out = []
    for p in places:
        low, high = found[math.floor(p)], found[math.ceil(p)]
        out.append(low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
    return out
