"""Set algebra over membership(key, doc_id): intersection, union, symmetric difference, and edits of whole keys.

Keys may be negated with `!`. Edits return the new membership; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as k


def _split(names) -> tuple[list[str], list[str]]:
    normal = [k.normalize(n) for n in names]
    return list(dict.fromkeys(n for n in normal if not n.startswith("!"))), list(dict.fromkeys(n[1:] for n in normal if n.startswith("!")))


def ids(membership: DataFrame, key: str) -> DataFrame:
    return membership.filter(F.col("key") == k.normalize(key)).select("doc_id")


def exists(membership: DataFrame, key: str) -> bool:
    return k.valid(k.normalize(key)) and not membership.filter(F.col("key") == k.normalize(key)).limit(1).isEmpty()


def listing(membership: DataFrame, prefix: str | None = None, internal: bool = False) -> DataFrame:
    """Distinct keys under a prefix; without one, internal keys are left out unless asked for."""
    rows = membership.select("key")
    if prefix:
        rows = rows.filter(F.col("key").startswith(prefix.rstrip("/") + "/"))
    elif not internal:
        rows = rows.filter(~F.col("key").startswith("internal/"))
    return rows.distinct()


def sizes(membership: DataFrame, prefix: str | None = None) -> DataFrame:
    rows = membership.filter(F.col("key").startswith(prefix)) if prefix else membership
    return rows.groupBy("key").agg(F.countDistinct("doc_id").alias("n"))


def keys_of(membership: DataFrame, doc_id: int, prefix: str | None = None) -> DataFrame:
    rows = membership.filter(F.col("doc_id") == doc_id)
    return (rows.filter(F.col("key").startswith(prefix)) if prefix else rows).select("key").distinct()


def all_of(membership: DataFrame, names, docs: DataFrame) -> DataFrame:
    """Documents with every key and none of the negated; only negated keys start from all of docs."""
    need, without = _split(names)
    if not need:
        return docs.select("doc_id").join(membership.filter(F.col("key").isin(*without)), "doc_id", "left_anti")
    rows = membership.filter(F.col("key").isin(*need, *without)).groupBy("doc_id")
    flags = rows.agg(F.countDistinct(F.when(F.col("key").isin(*need), F.col("key"))).alias("n"), F.bool_or(F.col("key").isin(*without) if without else F.lit(False)).alias("bad"))
    return flags.filter((F.col("n") == len(need)) & ~F.col("bad")).select("doc_id")


def any_of(membership: DataFrame, names) -> DataFrame:
    """Documents with any key and none of the negated."""
    want, without = _split(names)
    rows = membership.filter(F.col("key").isin(*want, *without)).groupBy("doc_id")
    flags = rows.agg(F.bool_or(F.col("key").isin(*want) if want else F.lit(False)).alias("ok"), F.bool_or(F.col("key").isin(*without) if without else F.lit(False)).alias("bad"))
    return flags.filter(F.col("ok") & ~F.col("bad")).select("doc_id")


def odd_of(membership: DataFrame, names) -> DataFrame:
    """Documents with an odd number of the keys (symmetric difference) and none of the negated."""
    want, without = _split(names)
    rows = membership.filter(F.col("key").isin(*want, *without)).groupBy("doc_id")
    flags = rows.agg(F.countDistinct(F.when(F.col("key").isin(*want), F.col("key"))).alias("n"), F.bool_or(F.col("key").isin(*without) if without else F.lit(False)).alias("bad"))
    return flags.filter((F.col("n") % 2 == 1) & ~F.col("bad")).select("doc_id")


def _guard(names, protect: bool = True) -> list[str]:
    out = [k.make(n) for n in names]
    if protect and k.DEFAULT_DATASET in out:
        raise ValueError("the default dataset is virtual: it can't be stamped")
    return out


def tick(membership: DataFrame, names, doc_ids: DataFrame) -> DataFrame:
    """doc_ids added to every key."""
    add = doc_ids.select(F.explode(F.array(*map(F.lit, _guard(names)))).alias("key"), F.col("doc_id"))
    return membership.select("key", "doc_id").unionByName(add).distinct()


def untick(membership: DataFrame, names, doc_ids: DataFrame) -> DataFrame:
    """doc_ids taken from every key."""
    gone = doc_ids.select(F.explode(F.array(*map(F.lit, _guard(names, False)))).alias("key"), "doc_id")
    return membership.join(gone, ["key", "doc_id"], "left_anti").select("key", "doc_id")


def untick_all(membership: DataFrame, doc_ids: DataFrame, prefix: str | None = None) -> DataFrame:
    """doc_ids taken from all keys, or from those under a prefix."""
    gone = doc_ids.select("doc_id").withColumn("gone", F.lit(True))
    if prefix is None:
        return membership.join(gone, "doc_id", "left_anti").select("key", "doc_id")
    other = membership.filter(~F.col("key").startswith(prefix))
    return other.unionByName(membership.filter(F.col("key").startswith(prefix)).join(gone, "doc_id", "left_anti").select(*other.columns)).select("key", "doc_id")


def merge(membership: DataFrame, source: str, targets) -> DataFrame:
    """The ids of one key added to others."""
    return tick(membership, targets, ids(membership, source))


def subtract(membership: DataFrame, source: str, targets) -> DataFrame:
    """The ids of one key taken from others."""
    return untick(membership, targets, ids(membership, source))


def rename(membership: DataFrame, old: str, new: str) -> DataFrame:
    """A key under another name; where that exists they merge."""
    new = _guard([new])[0]
    return membership.select(F.when(F.col("key") == k.normalize(old), F.lit(new)).otherwise(F.col("key")).alias("key"), "doc_id").distinct()


def delete(membership: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Membership without a key; dataset keys only by force."""
    key = k.normalize(key)
    if key.startswith(k.DATASET) and not force:
        raise ValueError("dataset keys are protected")
    return membership.filter(F.col("key") != key)


def inherit(membership: DataFrame, links: DataFrame) -> DataFrame:
    """Membership in which each to_id of links also has every key of its from_id."""
    more = membership.join(links.select(F.col("from_id").alias("doc_id"), "to_id"), "doc_id").select("key", F.col("to_id").alias("doc_id"))
    return membership.select("key", "doc_id").unionByName(more).distinct()


def migrate(membership: DataFrame, moves: DataFrame, exclude_trees=()) -> DataFrame:
    """Placement keys (trees) copied from old_id to new_id, some trees left out."""
    c = F.col("key")
    placed = membership.filter(c.startswith("context/") | c.startswith("vfs/"))
    for tree in exclude_trees:
        placed = placed.filter(~c.startswith(f"context/{tree}/") & ~c.startswith(f"vfs/{tree}/"))
    more = placed.join(moves.select(F.col("old_id").alias("doc_id"), "new_id"), "doc_id").select("key", F.col("new_id").alias("doc_id"))
    return membership.select("key", "doc_id").unionByName(more).distinct()


def in_range(doc_ids: DataFrame, low: int, high: int) -> DataFrame:
    """doc_ids inside an id range, for checks of who owns which ids."""
    return doc_ids.filter(F.col("doc_id").between(low, high))


class Collection:
    """Membership under a prefix of its own."""

    def __init__(self, prefix: str):
        self.prefix = prefix.rstrip("/") + "/"

    def key(self, name: str) -> str:
        bang, body = ("!", name[1:]) if name.startswith("!") else ("", name)
        return bang + k.make(body if body.startswith(self.prefix) else self.prefix + body)

    def listing(self, membership: DataFrame) -> DataFrame:
        return listing(membership, self.prefix)

    def tick(self, membership: DataFrame, names, doc_ids: DataFrame) -> DataFrame:
        return tick(membership, [self.key(n) for n in names], doc_ids)

    def untick(self, membership: DataFrame, names, doc_ids: DataFrame) -> DataFrame:
        return untick(membership, [self.key(n) for n in names], doc_ids)

    def all_of(self, membership: DataFrame, names, docs: DataFrame) -> DataFrame:
        return all_of(membership, [self.key(n) for n in names], docs)

    def any_of(self, membership: DataFrame, names) -> DataFrame:
        return any_of(membership, [self.key(n) for n in names])

    def odd_of(self, membership: DataFrame, names) -> DataFrame:
        return odd_of(membership, [self.key(n) for n in names])
