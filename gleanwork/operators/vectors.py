"""Vector spaces: chunk rows (space, model, doc_id, chunk_id, vector), exact cosine search, floors, and the embedding ledger.

Distances are computed in Arrow batches by one matrix product each; a document's distance is that of its best chunk.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CEILING, MARGIN = 0.945, 0.035
#: Approximate search: vectors that centroids are fitted on, lists at most, and the share of the ten nearest that a query is to find.
FIT_ROWS, MOST_LISTS, RECALL = 20_000, 4096, 0.95


def in_space(vectors: DataFrame, space: str, model: str | None = None) -> DataFrame:
    rows = vectors.filter(F.col("space") == space)
    return rows if model is None else rows.filter(F.col("model") == model)


def distances(rows: DataFrame, query, vector: str = "vector", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and cosine distance of every row; vectors that are null, zero or of another dimension have none."""
    q = np.asarray(query, np.float64)
    if q.ndim != 1 or not q.size or not np.isfinite(q).all() or not np.abs(q).max():
        raise ValueError("a query vector is finite and not zero")
    q = q / np.sqrt((q * q).sum())

    def run(batches):
        for b in batches:
            lists = b.column("v")
            ok = np.flatnonzero(np.asarray(pc.fill_null(lists.value_lengths(), 0)) == len(q))
            v = lists.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(len(ok), len(q)).astype(np.float64)
            norm = np.sqrt((v * v).sum(1))
            fine = np.isfinite(norm) & (norm > 0)
            d = 1 - (v[fine] @ q) / norm[fine]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ok[fine])), pa.array(np.round(d, 9))], ["doc_id", "distance"])

    return rows.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(vector).alias("v")).mapInArrow(run, "doc_id bigint, distance double")


def per_document(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.min("distance").alias("distance"))


def search(rows: DataFrame, query, scope: DataFrame | None = None, limit: int | None = None, offset: int = 0, min_distance: float | None = None, max_distance: float | None = None, exclude=(), vector: str = "vector", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and distance in order, ties by id. A max_distance of 0 or less sets no bound. The scope is applied before distances are computed."""
    rows = rows.withColumnRenamed(doc_id, "doc_id") if doc_id != "doc_id" else rows
    if scope is not None:
        rows = rows.join(scope.select("doc_id"), "doc_id", "left_semi")
    if exclude:
        rows = rows.filter(~F.col("doc_id").isin(*exclude))
    best = per_document(distances(rows, query, vector))
    if min_distance is not None:
        best = best.filter(F.col("distance") >= min_distance)
    if max_distance is not None and max_distance > 0:
        best = best.filter(F.col("distance") <= max_distance)
    out = best.orderBy("distance", "doc_id")
    if offset:
        out = out.offset(offset)
    return out if not limit else out.limit(limit)


def relative_floor(hits: DataFrame, margin: float = MARGIN, ceiling: float | None = CEILING) -> DataFrame:
    """Hits within margin of the best one, and under the ceiling where there is one; hits has one row a document."""
    best = hits.agg(F.min("distance").alias("best"))
    cap = F.col("best") + margin if ceiling is None else F.least(F.col("best") + margin, F.lit(ceiling))
    # one row
    return hits.crossJoin(F.broadcast(best)).filter(F.col("distance") <= cap).select(*hits.columns)


def document_vector(rows: DataFrame, doc_id: int, vector: str = "vector") -> list[float] | None:
    """The vector of a document's lowest chunk."""
    got = rows.filter(F.col("doc_id") == doc_id).orderBy("chunk_id").select(vector).first()
    return None if got is None else list(got[0])


def more_like(rows: DataFrame, doc_id: int, limit: int = 25, **options) -> DataFrame:
    """Documents nearest to one, itself left out."""
    v = document_vector(rows, doc_id)
    if v is None:
        return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0.0).alias("distance")).filter(F.lit(False))
    return search(rows, v, limit=limit, exclude=(doc_id,), **options)


def store(vectors: DataFrame, new: DataFrame, space: str, model: str, dim: int) -> DataFrame:
    """vectors with a space's rows for the documents of new replaced; chunks of another dimension are dropped."""
    rows = new.filter(F.size("vector") == dim).select(F.lit(space).alias("space"), F.lit(model).alias("model"), "doc_id", "chunk_id", "vector")
    touched = new.select(F.lit(space).alias("space"), F.lit(model).alias("model"), "doc_id").distinct()
    return vectors.join(touched, ["space", "model", "doc_id"], "left_anti").select(*rows.columns).unionByName(rows)


def delete(vectors: DataFrame, doc_ids: DataFrame, space: str | None = None) -> DataFrame:
    gone = doc_ids.select("doc_id").withColumn("gone", F.lit(True))
    out = vectors.join(gone, "doc_id", "left")
    hit = F.col("gone").isNotNull() if space is None else F.col("gone").isNotNull() & (F.col("space") == space)
    return out.filter(~hit).select(*vectors.columns)


def clear_space(vectors: DataFrame, space: str, model: str | None = None) -> DataFrame:
    hit = F.col("space") == space
    return vectors.filter(~(hit if model is None else hit & (F.col("model") == model)))


def tables(vectors: DataFrame) -> DataFrame:
    """space, model, dim, n_docs and n_chunks."""
    return vectors.groupBy("space", "model", F.size("vector").alias("dim")).agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"))


def table_name(name: str) -> dict | None:
    """The parts of vec_<space>__<slug>__<dim>."""
    m = re.fullmatch(r"vec_(.+?)__(.+)__(\d+)", name)
    return {"space": m[1], "slug": m[2], "dim": int(m[3])} if m else None


def dim_errors(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.filter(F.size("vector") != dim)


def ledger(vectors: DataFrame, seen: DataFrame) -> DataFrame:
    """space, model, doc_id and present for every document seen by an embedder."""
    have = vectors.select("space", "model", "doc_id").distinct().withColumn("present", F.lit(True))
    return seen.select("space", "model", "doc_id").distinct().join(have, ["space", "model", "doc_id"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def gap(embeddable: DataFrame, seen: DataFrame) -> DataFrame:
    """doc_ids of documents that no embedder has seen yet."""
    return embeddable.select("doc_id").distinct().join(seen.select("doc_id"), "doc_id", "left_anti")


def floor_per_query(hits: DataFrame, query: str = "query_id", margin: float = MARGIN, ceiling: float | None = CEILING) -> DataFrame:
    """relative_floor for many queries at once, by a window over each."""
    best = F.min("distance").over(Window.partitionBy(query)) + margin
    return hits.withColumn("_cap", best if ceiling is None else F.least(best, F.lit(ceiling))).filter(F.col("distance") <= F.col("_cap")).drop("_cap")


# -- approximate search: inverted lists around centroids


@dataclass
class Lists:
    """Every chunk row with the number of its list, and the lists' centroids."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int  # lists that a query looks into

    def search(self, query, limit: int, probes: int | None = None, **options) -> DataFrame:
        """The best of the lists nearest to the query; of all of them, the result is exact."""
        q = np.asarray(query, np.float64)
        near = np.argsort(-(self.centroids @ (q / np.linalg.norm(q))), kind="stable")
        return search(self.rows.filter(F.col("list").isin(near[: probes or self.probes].tolist())), query, limit=limit, **options)


def fit_centroids(sample: np.ndarray, n: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Spherical k-means over rows of length 1."""
    rng = np.random.default_rng(seed)
    n = min(n, len(sample))
    centroids = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-12), centroids)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10, queries: int = 200) -> int:
    """The fewest lists that hold a share of the k nearest of some vectors of the sample, by brute force."""
    q = sample[:queries]
    scores = q @ sample.T
    scores[np.arange(len(q)), np.arange(len(q))] = -2
    best = np.argsort(-scores, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
    at = np.sort(np.take_along_axis(place, (sample @ centroids.T).argmax(1)[best], 1).reshape(-1))
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1


def build_lists(rows: DataFrame, path: str, n: int | None = None, fit_rows: int = FIT_ROWS, recall: float = RECALL) -> Lists:
    """Inverted lists, stored by list in a folder: centroids are fitted on the first fit_rows vectors by a hash, every row is put
    into the list of its nearest one. How many lists a query looks into is measured on the same sample; where vectors have little structure, that
    is most of them. Rows are chunks of one space and dimension; those without a usable vector are left out."""
    v = F.col("vector").cast("array<double>")
    usable = rows.filter(F.size("vector") > 0).filter(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) > 0)
    held = usable.select(v.alias("v")).orderBy(F.xxhash64("doc_id", "chunk_id")).limit(fit_rows).collect()
    if not held:
        return Lists(rows.withColumn("list", F.lit(0)), np.zeros((1, 1)), 1)
    sample = np.array([r[0] for r in held])
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    centroids = fit_centroids(sample, n or max(1, min(MOST_LISTS, round(len(sample) ** 0.5))))

    def run(batches):
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "v"), pa.array((x @ centroids.T).argmax(1).astype(np.int32))], [*(c for c in b.schema.names if c != "v"), "list"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in usable.schema)
    usable.withColumn("v", v).mapInArrow(run, f"{kinds}, list int").repartition("list").write.partitionBy("list").parquet(path)
    return Lists(rows.sparkSession.read.parquet(path), centroids, probes_for(sample, centroids, recall))
