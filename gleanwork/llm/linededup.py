"""Line dedup over levelled sorted runs of line hashes.

A `LineStore` is a folder of runs and a manifest that names them; it outlives the job, so a later batch can be added. A run holds the
hashes (128 bits) of lines seen and where each stood first; every hash is in one run only. Runs are bucketed and sorted by
the hash, with as many buckets as the session that wrote them had shuffle partitions, so they are joined and merged without being shuffled or
sorted again. A new batch's lines are reduced to the first place of each hash (a minimum, combined before it is shuffled, however
often a line occurs), merge-anti-joined with every run, and what is left becomes a run of level 0. As soon as a level holds
`fanout` runs they are merged into one of the next level.

`dedup_lines` takes a table as `batches` batches, ranges of doc_id in ascending order, through a store of its own. Kept is the first
occurrence of a line in the order of doc_id (null first), text hash and line number. Lines shorter than
`min_chars` without outer blanks are never touched.

Defined results: null and empty texts stay; of repeated rows (same id and text) one keeps its lines and the others lose
all of at least min_chars; a document that had text and is left with blanks only goes; an empty table gives an empty
result; ids may be of any type that has an order; other columns pass through, whatever their names; `n_chars`, if there, is brought up to date.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import filesystem, fresh_path, isolated, keyed

#: Production parameters.
MIN_CHARS, BATCHES, FANOUT = 20, 4, 2
#: Ids, the first by a hash, that the batches' bounds are taken from; results don't depend on them.
CUT_ROWS = 1000
_H = ("_h1", "_h2")
_RUN = "_h1 bigint, _h2 bigint, _ki bigint, _kt bigint, _n int"


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Document, line number and hash of every line that counts."""
    out = keyed(docs.filter(F.col("text").isNotNull())).select(F.col("doc_id").alias("_id"), "_ki", "_kt", F.posexplode(F.split("text", "\n")).alias("_n", "_line"))
    out = out.withColumn("_line", F.trim("_line")).filter(F.length("_line") >= min_chars)
    return out.select("_id", "_ki", "_kt", "_n", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), "_line").alias("_h2"))


class LineStore:
    """Runs in a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.version, self.runs = 0, []
        self._frames: dict[str, DataFrame] = {}
        fs, where = filesystem(spark, self.folder)
        if fs.exists(where):
            names = sorted((f.getPath().getName() for f in fs.listStatus(where)), reverse=True)
            for name in (n for n in names if n.startswith("manifest-")):
                try:
                    held = json.loads(self._text(name))
                except ValueError:  # the write of this version broke off
                    continue
                self.version, self.runs = held["version"], held["runs"]
                break

    def _text(self, name: str) -> str:
        fs, where = filesystem(self.spark, f"{self.folder}/{name}")
        stream = fs.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, runs: list[dict]) -> None:
        """A new version of the manifest; readers see the old one or the new one."""
        name = f"manifest-{self.version + 1:08d}.json"
        fs, where = filesystem(self.spark, f"{self.folder}/{name}")
        stream = fs.create(where, True)
        stream.write(bytearray(json.dumps({"version": self.version + 1, "runs": runs}).encode()))
        stream.close()
        gone = [r["path"] for r in self.runs if r not in runs]
        self.version, self.runs = self.version + 1, runs
        for path in gone:
            self._frames.pop(path, None)
            fs.delete(filesystem(self.spark, path)[1], True)

    def _write(self, df: DataFrame, level: int) -> dict:
        """df as a run; the catalogue knows its buckets only while it is written and opened."""
        n, path, name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"{self.folder}/run-{uuid.uuid4().hex}", f"gleanwork_run_{uuid.uuid4().hex}"
        df.write.option("path", path).bucketBy(n, *_H).sortBy(*_H).format("parquet").saveAsTable(name)
        self._frames[path] = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return {"path": path, "level": level, "buckets": n}

    def frame(self, run: dict) -> DataFrame:
        if run["path"] not in self._frames:
            name = f"gleanwork_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({_RUN}) USING parquet CLUSTERED BY ({', '.join(_H)}) SORTED BY ({', '.join(_H)}) INTO {run['buckets']} BUCKETS LOCATION '{run['path']}'")
            self._frames[run["path"]] = self.spark.table(name)
            self.spark.sql(f"DROP TABLE {name}")
        return self._frames[run["path"]]

    def compact(self) -> None:
        """Merges the runs of every level that is full; runs share no hash, so a full outer merge join is their union, bucket by bucket."""
        while True:
            levels = [r["level"] for r in self.runs]
            full = min((k for k in levels if levels.count(k) >= self.fanout), default=None)
            if full is None:
                return
            merged = None
            for r in (r for r in self.runs if r["level"] == full):
                b = self.frame(r)
                if merged is None:
                    merged = b
                else:
                    b = b.select(*_H, *(F.col(c).alias(f"b{c}") for c in ("_ki", "_kt", "_n")))
                    merged = merged.join(b.hint("merge"), list(_H), "full_outer").select(*_H, *(F.coalesce(c, f"b{c}").alias(c) for c in ("_ki", "_kt", "_n")))
            self._commit([*(r for r in self.runs if r["level"] != full), self._write(merged, full + 1)])

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of lines; returns the places (_ki, _kt, _n) of those that no run held, to be read before the next batch comes."""
        self.compact()
        place = F.min(F.struct(F.col("_id").isNotNull().alias("o"), "_id", "_kt", "_n", "_ki")).alias("p")
        new = lines.groupBy(*_H).agg(place).select(*_H, "p._ki", "p._kt", "p._n")
        for r in self.runs:
            new = new.join(self.frame(r).select(*_H).hint("merge"), list(_H), "left_anti")
        run = self._write(new, 0)
        self._commit([*self.runs, run])
        return self.frame(run).select("_ki", "_kt", "_n")

    def places(self) -> DataFrame:
        """Where every line seen stood first."""
        rows = [self.frame(r).select("_ki", "_kt", "_n") for r in self.runs]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], "_ki bigint, _kt bigint, _n int")


def first_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """_ki, _kt and _n of every line that counts and occurs for the first time."""
    spark = docs.sparkSession
    lines = _lines(docs, min_chars)
    cuts = []
    if batches > 1:
        ids = sorted(r[0] for r in docs.select("doc_id").filter(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id")).limit(CUT_ROWS).collect())
        cuts = [ids[k * len(ids) // batches] for k in range(1, batches)] if ids else []
    batch = reduce(lambda c, cut: c + F.coalesce((F.col("_id") > F.lit(cut)).cast("int"), F.lit(0)), cuts, F.lit(0))
    path = fresh_path(spark, "lines")
    lines.withColumn("_batch", batch).write.partitionBy("_batch").parquet(path)
    lines = spark.read.schema(T.StructType([*lines.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(path)
    store = LineStore(spark, fresh_path(spark, "runs"), fanout)
    for b in range(len(cuts) + 1):
        store.add(lines.filter(F.col("_batch") == b).drop("_batch"))
    fs, where = filesystem(spark, path)
    fs.delete(where, True)
    return store.places()


@isolated
def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The documents without their duplicate lines."""
    stay = first_lines(docs, min_chars, batches, fanout).groupBy(F.col("_ki").alias("_si"), F.col("_kt").alias("_st")).agg(F.sort_array(F.collect_list("_n")).alias("_stay"))
    # the join and the window have the same keys, none of them null, so texts move once
    d = keyed(docs)
    d = d.join(stay, (d["_ki"] == stay["_si"]) & (d["_kt"] == stay["_st"]), "left")
    d = d.withColumn("_nth", F.row_number().over(Window.partitionBy("_ki", "_kt").orderBy("_ki")))
    stays = F.when(F.col("_nth") == 1, F.coalesce("_stay", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))

    def cut(lines):
        """The lines at the places that stay, short ones among them, in their order."""
        short = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.length(F.trim(F.get(lines, i))) < min_chars)
        return F.array_join(F.transform(F.sort_array(F.concat(stays, short)), lambda i: F.get(lines, i)), "\n")

    # as the variable of a lambda, the lines are split once for each row
    new = F.when(F.col("text").isNotNull(), F.get(F.transform(F.array(F.split("text", "\n")), cut), F.lit(0)))
    blank = lambda c: F.translate(c, " \t\r\n", "") == ""
    d = d.withColumn("_new", new).filter(F.col("text").isNull() | blank(F.col("text")) | ~blank(F.col("_new")))
    sizes = {"n_chars": F.when(F.col("_new").isNotNull(), F.length("_new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return d.withColumns({"text": F.col("_new"), **sizes}).select(*docs.columns)


def dedup_sql(min_chars: int = MIN_CHARS) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, * FROM documents),
l AS (SELECT rid, doc_id, i AS n, ls[i] AS line, length(trim(ls[i])) >= {min_chars} AS counts
      FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i)),
r AS (SELECT *, row_number() OVER (PARTITION BY counts, CASE WHEN counts THEN trim(line) END ORDER BY doc_id NULLS FIRST, rid, n) AS k FROM l),
k AS (SELECT rid, string_agg(line, chr(10) ORDER BY n) AS text FROM r WHERE NOT counts OR k = 1 GROUP BY rid)
SELECT d.doc_id, coalesce(k.text, CASE WHEN d.text IS NOT NULL THEN '' END) AS text, d.lang, d.source,
       coalesce(length(k.text), CASE WHEN d.text IS NOT NULL THEN 0 ELSE d.n_chars END)::BIGINT AS n_chars
FROM d LEFT JOIN k USING (rid)
WHERE d.text IS NULL OR translate(d.text, ' ' || chr(9) || chr(10) || chr(13), '') = ''
   OR translate(coalesce(k.text, ''), ' ' || chr(9) || chr(10) || chr(13), '') <> ''"""
