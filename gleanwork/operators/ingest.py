"""Writes: batch upserts with dedup, placement edits, deletes and id allocation. Each takes tables and returns tables.

A batch is merged against what is stored by joins on ids and primary checksums; nothing is looked up row by row, and derived
planes follow from the merged docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys
from ..schemas import REGISTRY
from ..session import delete_path, filesystem, names_in, written
from . import derive

FIRST_ID = 100_001


def allocate(new: DataFrame, taken: DataFrame, order: list, freed: DataFrame | None = None, first: int = FIRST_ID) -> DataFrame:
    """new with doc_id: the lowest freed ids first, then those after the highest taken, in the given order.

    Numbers are given in two levels, an offset for each slice of the order and a count inside it, so no task sorts all rows."""
    spark = new.sparkSession
    top = taken.agg(F.max("doc_id").alias("m"))
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = new.drop("doc_id")
    if isinstance(new.schema[order[0]].dataType, T.NumericType):
        # even slices of the range of the leading column keep the order; where it is text, a hash slices and decides
        ends = new.agg(F.min(order[0]).alias("_lo"), F.max(order[0]).alias("_hi"))
        at = (F.col(order[0]) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * slices
        rows = rows.crossJoin(F.broadcast(ends)).withColumn("_slice", F.coalesce(F.floor(at), F.lit(-1)).cast("int")).drop("_lo", "_hi")
    else:
        rows = rows.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    sizes = rows.groupBy("_slice").agg(F.count("*").alias("n"))
    offsets = sizes.select("_slice", F.coalesce(F.sum("n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) + F.col("_before")
    rows = rows.join(F.broadcast(offsets), "_slice").withColumn("_nth", nth).drop("_slice", "_before").crossJoin(F.broadcast(top))
    fresh = F.greatest(F.coalesce("m", F.lit(0)), F.lit(first - 1))
    if freed is None:
        return rows.withColumn("doc_id", (fresh + F.col("_nth")).cast("bigint")).drop("_nth", "m")
    pool = freed.select("doc_id").distinct().join(taken.select("doc_id"), "doc_id", "left_anti")
    pool = pool.select(F.col("doc_id").alias("_free"), F.row_number().over(Window.orderBy("doc_id")).alias("_at"))
    count = pool.agg(F.count("*").alias("_have"))
    rows = rows.join(pool, rows["_nth"] == pool["_at"], "left").crossJoin(F.broadcast(count))
    return rows.withColumn("doc_id", F.coalesce("_free", fresh + F.col("_nth") - F.col("_have")).cast("bigint")).drop("_nth", "_at", "_free", "_have", "m")


def primary(c: Column) -> Column:
    return F.get(c, F.lit(0))


def dedup_batch(batch: DataFrame, order: str = "pos") -> DataFrame:
    """One row for each schema and primary checksum: the first, with the locations of all."""
    w = Window.partitionBy("schema", primary(F.col("checksums"))).orderBy(order)
    rows = batch.withColumn("_n", F.row_number().over(w))
    every = F.collect_list("locations").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    none = F.array().cast("array<struct<url:string,metadata:map<string,string>>>")
    return rows.withColumn("locations", derive.merge_locations(none, F.flatten(every))).filter("_n = 1").drop("_n")


def resolve(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The batch with the doc_id of the stored document of the same schema and primary checksum, where a row has no id of its own."""
    rows = batch.withColumn("_cs", primary(F.col("checksums")))
    # only checksums of the batch are grouped
    have = stored.select("schema", F.explode("checksums").alias("_cs"), F.col("doc_id").alias("_known")).join(rows.select("schema", "_cs").distinct(), ["schema", "_cs"], "left_semi")
    rows = rows.join(have.groupBy("schema", "_cs").agg(F.max("_known").alias("_known")), ["schema", "_cs"], "left")
    return rows.withColumn("doc_id", F.coalesce("doc_id", "_known")).drop("_cs", "_known")


def merge(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Stored documents with incoming versions by doc_id: given columns replace stored ones, features keep their datasets, locations
    and metadata merge, checksums are those of the data that stays."""
    s, i = stored.alias("s"), incoming.select(*stored.columns).alias("i")
    both = s.join(i, F.col("s.doc_id") == F.col("i.doc_id"), "full_outer")
    pick = lambda c: F.coalesce(f"i.{c}", f"s.{c}")
    is_new, changed = F.col("s.doc_id").isNull(), F.col("i.doc_id").isNotNull()
    features = F.when(F.col("i.features").isNotNull(), keys.asserted(F.col("i.features"), F.col("s.features"))).otherwise(F.col("s.features"))
    locations = F.when(F.col("i.locations").isNotNull(), derive.merge_locations(F.col("s.locations"), F.col("i.locations"))).otherwise(F.col("s.locations"))
    meta = F.when(F.col("i.metadata").isNull(), F.col("s.metadata")).otherwise(F.struct(*(F.coalesce(F.col(f"i.metadata.{f}"), F.col(f"s.metadata.{f}")).alias(f) for f in stored.schema["metadata"].dataType.names)))
    sums = F.when(changed & (F.col("i.data").isNotNull()) & ~F.col("i.data").eqNullSafe(F.col("s.data")), F.coalesce("i.checksums", "s.checksums")).otherwise(F.coalesce("s.checksums", "i.checksums"))
    out = {"features": features, "locations": locations, "metadata": meta, "checksums": sums, "created_at": F.when(is_new, F.coalesce("i.created_at", now)).otherwise(F.col("s.created_at")), "updated_at": F.when(changed, now).otherwise(F.col("s.updated_at"))}
    return both.select(*(out.get(c, pick(c)).alias(c) for c in stored.columns))


def problem(schemas: bool = False) -> Column:
    """Why a row can't be stored, or null: no schema, no data, a negative id and, with schemas, a schema that isn't known, data that is no
    JSON object, or a required field that is missing."""
    why = F.when(F.coalesce(F.trim("schema"), F.lit("")) == "", "no schema").when(F.col("data").isNull() & F.col("doc_id").isNull(), "no data").when(F.coalesce(F.col("doc_id"), F.lit(0)) < 0, "negative id")
    if not schemas:
        return why
    known = F.lit(False)
    for s in REGISTRY.all():
        known = known | (F.col("schema") == s.id) | F.col("schema").startswith(s.id + "/")
    why = why.when(~known, "unknown schema").when(F.col("data").isNotNull() & F.json_object_keys("data").isNull(), "data is no JSON object")
    for s in sorted(REGISTRY.all(), key=lambda s: -len(s.id)):
        hit = (F.col("schema") == s.id) | F.col("schema").startswith(s.id + "/")
        for field in s.required:
            why = why.when(hit & F.col("data").isNotNull() & F.get_json_object("data", f"$.{field}").isNull(), f"{s.id} needs {field}")
    return why


def stage(stored: DataFrame, batch: DataFrame, now: Column, freed: DataFrame | None = None, schemas: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch (docs columns and pos) against what is stored: the documents as they are afterwards, the batch's (pos, doc_id), and rejected rows
    with the reason. The batch with its ids and the merged documents are written out, as every plane needs them."""
    judged = derive.with_checksums(batch).withColumn("reason", problem(schemas))
    good = judged.filter("reason is null").drop("reason")
    named = good.withColumn("_first", F.min("pos").over(Window.partitionBy("schema", primary(F.col("checksums")))))
    one = resolve(dedup_batch(good), stored)
    known = one.filter(F.col("doc_id").isNotNull())
    fresh = allocate(one.filter(F.col("doc_id").isNull()), stored.select("doc_id").unionByName(known.select("doc_id")), ["pos"], freed)
    incoming = written(known.unionByName(fresh.select(*known.columns)), "put-batch")
    ids = written(named.select("pos", F.col("_first").alias("_p")).join(incoming.select(F.col("pos").alias("_p"), "doc_id"), "_p").select("pos", "doc_id"), "put-ids")
    latest = incoming.withColumn("_l", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("pos").desc()))).filter("_l = 1").drop("_l", "pos")
    own = written(merge(stored.join(latest.select("doc_id"), "doc_id", "left_semi").select(*stored.columns), latest, now), "put-docs")
    return own, ids, judged.filter("reason is not null")


def put_many(stored: DataFrame, batch: DataFrame, now: Column, freed: DataFrame | None = None, schemas: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new docs, the batch's (pos, doc_id), and rejected rows with the reason."""
    own, ids, rejected = stage(stored, batch, now, freed, schemas)
    return replaced(stored, own, own), ids, rejected


def replaced(table: DataFrame, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """table with rows in place of those of some documents."""
    return table.join(ids.select("doc_id"), "doc_id", "left_anti").select(*rows.columns).unionByName(rows)


def put_paths(stored: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bulk placement of (path, and docs columns) by content: new documents one for each checksum with all locations, and (checksum, path) pairs of the new ones; what is stored already is skipped."""
    rows = derive.with_checksums(items).withColumn("_cs", primary(F.col("checksums")))
    fresh = rows.join(stored.select("schema", F.explode("checksums").alias("_cs")), ["schema", "_cs"], "left_anti")
    return dedup_batch(fresh.drop("_cs"), "path").drop("path"), fresh.select(F.col("_cs").alias("checksum"), "path").distinct()


def place(membership: DataFrame, doc_ids: DataFrame, names: list[str]) -> DataFrame:
    """Documents put under keys (of tree nodes, features or datasets)."""
    from .membership import tick

    return tick(membership, names, doc_ids)


def unplace(membership: DataFrame, doc_ids: DataFrame, names: list[str]) -> DataFrame:
    from .membership import untick

    return untick(membership, names, doc_ids)


def delete(docs: DataFrame, membership: DataFrame, doc_ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs and membership without some documents, and the tombstones (doc_id, deleted_at)."""
    gone = doc_ids.select("doc_id").distinct()
    stones = docs.select("doc_id").join(gone, "doc_id", "left_semi").withColumn("deleted_at", now)
    return docs.join(gone, "doc_id", "left_anti"), membership.join(gone, "doc_id", "left_anti").select("key", "doc_id"), stones


def delete_dataset(docs: DataFrame, membership: DataFrame, name: str, now: Column, drop_documents: bool = False):
    """Without a dataset's stamps and, on demand, its documents; returns docs, membership and tombstones."""
    key = keys.normalize(keys.DATASET + name)
    if key == keys.DEFAULT_DATASET:
        raise ValueError("the default dataset can't be deleted")
    ids = membership.filter(F.col("key") == key).select("doc_id")
    rest = membership.filter(F.col("key") != key)
    if drop_documents:
        return delete(docs, rest, ids, now)
    return docs, rest, docs.select("doc_id").filter(F.lit(False)).withColumn("deleted_at", now)


def provenance(given: dict | None) -> dict:
    """Of what a caller says about the cause of a write, the fields that are kept: origin, causedBy and depth."""
    return {k: v for k, v in (given or {}).items() if k in ("origin", "causedBy", "depth") and v is not None}


def _event_id(write: int, *parts) -> Column:
    """The same for the same change, however often it is worked out."""
    return F.sha1(F.concat_ws("|", F.lit(str(write)), *(F.coalesce(c.cast("string"), F.lit("")) for c in parts)))


def changes(before: DataFrame, after: DataFrame, reason: str, origin: str | None = None, write: int = 0) -> DataFrame:
    """change_log rows (event_id, doc_id, op, key, reason, origin) between two versions of membership."""
    cols = ("key", "doc_id")
    rows = after.select(*cols).exceptAll(before.select(*cols)).withColumn("op", F.lit("add")).unionByName(before.select(*cols).exceptAll(after.select(*cols)).withColumn("op", F.lit("remove")))
    return rows.select(_event_id(write, F.col("op"), F.col("key"), F.col("doc_id")).alias("event_id"), "doc_id", "op", "key", F.lit(reason).alias("reason"), F.lit(origin).cast("string").alias("origin"))


def events(doc_ids: DataFrame, reason: str, origin: str | None = None, write: int = 0, tree: str | None = None) -> DataFrame:
    """change_log rows of whole documents, op 'document', or 'tree' with the tree as key where one is named."""
    op = "document" if tree is None else "tree"
    return doc_ids.select("doc_id").distinct().select(_event_id(write, F.lit(op + reason), F.lit(tree), F.col("doc_id")).alias("event_id"), "doc_id", F.lit(op).alias("op"), F.lit(tree).cast("string").alias("key"), F.lit(reason).alias("reason"), F.lit(origin).cast("string").alias("origin"))


def outcome(doc_ids: DataFrame, docs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """doc_id, ok and reason of each asked document of a batch: whether it is there and, given members, is one of them."""
    rows = doc_ids.select("doc_id").distinct().join(docs.select("doc_id").distinct().withColumn("_there", F.lit(True)), "doc_id", "left")
    why = F.when(F.col("_there").isNull(), "no such document")
    if members is not None:
        rows = rows.join(members.select("doc_id").distinct().withColumn("_in", F.lit(True)), "doc_id", "left")
        why = why.when(F.col("_in").isNull(), "not linked")
    return rows.select("doc_id", why.isNull().alias("ok"), why.alias("reason"))


def needs_fts(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_ids whose text has to be indexed again: checksum, comment or summary changed."""
    facts = lambda df, n: df.select("doc_id", F.struct(primary(F.col("checksums")), "comment", "metadata.summary").alias(n))
    both = facts(after, "a").join(facts(before, "b"), "doc_id", "left")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id")


def backup(spark: SparkSession, source: str, folder: str, stamp: str, keep: int = 7, oldest: str | None = None) -> list[str]:
    """A dated copy of a folder of tables, on any Hadoop file system; of the copies the latest `keep` stay, of those none whose stamp sorts before `oldest`."""
    fs, where = filesystem(spark, source)
    to, target = filesystem(spark, f"{folder}/{stamp}")
    if to.exists(target):
        raise FileExistsError(f"{folder}/{stamp}")
    to.mkdirs(target.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, to, target, False, spark._jsc.hadoopConfiguration())
    held = names_in(spark, folder)
    stay = [n for n in held[-keep:] if oldest is None or n >= oldest]
    for name in held:
        if name not in stay:
            delete_path(spark, f"{folder}/{name}")
    return [f"{folder}/{n}" for n in stay]
