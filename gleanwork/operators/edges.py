"""Typed edges (from_id, p, to_id, src, ts, conf). An edge without src was asserted by its document; others are derived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import predicate

EDGE = "from_id bigint, p string, to_id bigint, src string, ts timestamp, conf double"
_KEY = ["from_id", "p", "to_id"]


def _full(edges: DataFrame) -> DataFrame:
    have = {c.lower() for c in edges.columns}
    kinds = (("src", "string"), ("ts", "timestamp"), ("conf", "double"))
    return edges.select(*_KEY, *(F.col(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in kinds))


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], EDGE)


def link(edges: DataFrame, new: DataFrame, derived: bool = False) -> DataFrame:
    """edges with new ones; those already there stay as they are. Derived edges need a src, which can't be 'doc'."""
    new = _full(new)
    if derived:
        bad = F.col("src").isNull() | (F.col("src") == "doc")
        new = new.withColumn("src", F.when(bad, F.raise_error(F.lit("a derived edge needs a src other than 'doc'"))).otherwise(F.col("src")))
    fresh = new.dropDuplicates(_KEY).join(edges, _KEY, "left_anti")
    return _full(edges).unionByName(fresh)


def unlink(edges: DataFrame, gone: DataFrame, derived_only: bool = False) -> DataFrame:
    """edges without some; with derived_only asserted ones stay."""
    if derived_only:
        return edges.filter(F.col("src").isNull()).unionByName(edges.filter(F.col("src").isNotNull()).join(gone, _KEY, "left_anti").select(*edges.columns))
    return edges.join(gone, _KEY, "left_anti").select(*edges.columns)


def asserted(relations: DataFrame) -> DataFrame:
    """Edges from (doc_id, relations array<struct<p, to>>); unknown predicates and incomplete entries are left out, targets needn't exist."""
    from ..plans.spec import PREDICATES

    rows = relations.select(F.col("doc_id").alias("from_id"), F.explode("relations").alias("r")).select("from_id", F.col("r.p").alias("p"), F.col("r.to").cast("bigint").alias("to_id"))
    return _full(rows.filter(F.col("p").isin(*PREDICATES) & F.col("to_id").isNotNull()).distinct())


def outgoing(edges: DataFrame, doc_id: int, p: str | None = None, limit: int | None = None, start: int | None = None) -> DataFrame:
    """Neighbours that a document points to, in id order."""
    return _near(edges, "from_id", "to_id", doc_id, p, limit, start)


def incoming(edges: DataFrame, doc_id: int, p: str | None = None, limit: int | None = None, start: int | None = None) -> DataFrame:
    """Neighbours that point to a document, in id order."""
    return _near(edges, "to_id", "from_id", doc_id, p, limit, start)


def _near(edges, mine, other, doc_id, p, limit, start):
    rows = edges.filter(F.col(mine) == doc_id)
    if p is not None:
        rows = rows.filter(F.col("p") == predicate(p))
    if start is not None:
        rows = rows.filter(F.col(other) >= start)
    rows = rows.select("p", F.col(other).alias("doc_id")).orderBy("doc_id", "p")
    return rows if limit is None else rows.limit(limit)


def degree(edges: DataFrame, way: str = "out", p: str | None = None) -> DataFrame:
    """doc_id, p and n of every document that has edges."""
    if p is not None:
        edges = edges.filter(F.col("p") == predicate(p))
    node = {"out": "from_id", "in": "to_id"}[way]
    return edges.groupBy(F.col(node).alias("doc_id"), "p").agg(F.count("*").alias("n"))


def edges_of(edges: DataFrame, doc_id: int) -> DataFrame:
    """dir, p, doc_id (the other end) and src of every edge at a document."""
    src = F.coalesce("src", F.lit("doc")).alias("src")
    out = edges.filter(F.col("from_id") == doc_id).select(F.lit("out").alias("dir"), "p", F.col("to_id").alias("doc_id"), src)
    return out.unionByName(edges.filter(F.col("to_id") == doc_id).select(F.lit("in").alias("dir"), "p", F.col("from_id").alias("doc_id"), src))


def all_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumn("src", F.coalesce("src", F.lit("doc")))


def exists(edges: DataFrame, from_id: int, p: str, to_id: int) -> bool:
    return not edges.filter((F.col("from_id") == from_id) & (F.col("p") == predicate(p)) & (F.col("to_id") == to_id)).limit(1).isEmpty()


def delete_nodes(edges: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """edges without those at some documents."""
    gone = doc_ids.select("doc_id")
    return edges.join(gone, edges["from_id"] == gone["doc_id"], "left_anti").join(gone, F.col("to_id") == gone["doc_id"], "left_anti")


def remove(edges: DataFrame, src: str | None = None, p: str | None = None) -> DataFrame:
    """edges without the derived ones of a source or predicate; asserted edges can't be removed so."""
    if src is None and p is None:
        raise ValueError("name a src, a predicate or both")
    if src == "doc":
        raise ValueError("asserted edges belong to their documents")
    gone = F.col("src").isNotNull()
    if src is not None:
        gone = gone & (F.col("src") == src)
    if p is not None:
        gone = gone & (F.col("p") == predicate(p))
    return edges.filter(~gone)


def backfill(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and the relations (array<struct<p, to>>) that asserted edges hold and the document's own row lacks."""
    have = asserted(docs.select("doc_id", "relations"))
    missing = edges.filter(F.col("src").isNull()).join(have.select(*_KEY), _KEY, "left_anti").join(docs.select(F.col("doc_id").alias("from_id")), "from_id", "left_semi")
    return missing.groupBy(F.col("from_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("p", F.col("to_id").alias("to")))).alias("relations"))
