"""Ranked retrieval: legs, weighted reciprocal-rank fusion, refinement chains and compound lines.

A leg is a DataFrame (doc_id, rank from 0), cut to its depth before anything is fused, so that fusion works on few rows whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60
WEIGHTS = {"fts": 2.0, "dense": 1.0, "image": 2.0}
FUSE_DEPTH = 500


@dataclass
class Tuning:
    """Knobs of ranking; values that make no sense are ignored."""

    weights: dict
    image_floor: str = "absolute"
    image_max_distance: float | None = 0.945
    image_margin: float = 0.035

    @classmethod
    def make(cls, **given) -> Tuning:
        out = cls(dict(WEIGHTS))
        for name, w in (given.get("weights") or {}).items():
            if isinstance(w, (int, float)) and not isinstance(w, bool) and w >= 0:
                out.weights[name] = float(w)
        if given.get("image_floor") in ("absolute", "relative"):
            out.image_floor = given["image_floor"]
        if isinstance(m := given.get("image_max_distance"), (int, float)):
            out.image_max_distance = float(m) if m > 0 else None
        if isinstance(m := given.get("image_margin"), (int, float)) and m > 0:
            out.image_margin = float(m)
        return out


def leg(hits: DataFrame, *order, depth: int | None = None, slices: int = 64) -> DataFrame:
    """doc_id and rank of hits in an order, down to a depth. Without a depth ranks are given in two levels, an offset for each slice of the scores (a
    slices-th of a unit of score or distance) and a place inside it, so that no task sorts all hits."""
    if depth is not None:
        rows = hits.orderBy(*order).limit(depth)
        return rows.select("doc_id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))
    by = F.floor(-F.col("score") * slices) if "score" in hits.columns else F.floor(F.col("distance") * slices)
    rows = hits.withColumn("_slice", by)
    sizes = rows.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = sizes.select("_slice", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) - 1
    return rows.withColumn("_nth", nth).join(before, "_slice").select("doc_id", (F.col("_nth") + F.col("_before")).alias("rank"))


def depth_for(limit: int, offset: int = 0) -> int:
    return max((limit + offset) * 5, 100)


def fuse(legs: list[tuple[DataFrame, float]], k: int = K) -> DataFrame:
    """doc_id and score: the sum over legs of weight / (k + rank + 1). Ties keep the order in which documents were first seen, leg by leg."""
    if not legs:
        raise ValueError("nothing to fuse")
    rows = [one.select("doc_id", "rank", F.lit(i).alias("leg"), F.lit(float(w)).alias("weight")) for i, (one, w) in enumerate(legs)]
    all_rows = reduce(DataFrame.unionByName, rows)
    out = all_rows.groupBy("doc_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank") + 1)), 9).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    return out.orderBy(F.col("score").desc(), "first.leg", "first.rank").select("doc_id", "score")


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """A slice of an ordered DataFrame; a limit of 0 or None means all."""
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit else df


def combine(lines: list[DataFrame], op: str = "or") -> DataFrame:
    """doc_ids that any line, or every line, holds."""
    one = [x.select("doc_id") for x in lines]
    if op == "and":
        return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), one[1:], one[0].distinct())
    return reduce(DataFrame.unionByName, one).distinct()


def with_tail(fused: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id and score: fused members first, the other members after them in id order (score null)."""
    rows = members.join(fused, "doc_id", "left")
    return rows.orderBy(F.col("score").isNull(), F.col("score").desc(), "doc_id").select("doc_id", "score")
