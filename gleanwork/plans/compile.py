"""Compiles a spec into one lazy DataFrame of candidate doc_ids.

All keys of a spec, whatever bucket they came from, are tested in one pass: membership is filtered to those keys and
aggregated per document into flags (with partial aggregation before the only shuffle), and the spec's boolean expression over
the flags decides. An expression that holds without any key is answered by an anti join against the documents that fail it.
Time, place and relation filters become sargable predicates over their planes, joined as semi or anti joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import geo as places
from ..operators import timelines
from .spec import Spec

#: Literal lists above this many values are joined as a table.
INLINE = 2000


@dataclass
class Planes:
    """The tables a query reads; a plane that isn't there is None and matches nothing."""

    docs: DataFrame
    membership: DataFrame
    timeline_pos: DataFrame | None = None
    geo: DataFrame | None = None
    edges: DataFrame | None = None
    fts: DataFrame | None = None
    vectors: DataFrame | None = None
    trees: dict = field(default_factory=dict)

    @property
    def spark(self):
        return self.docs.sparkSession

    def ids(self) -> DataFrame:
        return self.docs.select("doc_id")


# -- boolean expressions over membership keys


@dataclass(frozen=True)
class Key:
    """Whether a document has a key, any of several keys, or any key with a prefix."""

    values: tuple[str, ...] = ()
    prefix: str | None = None

    def test(self, key: Column) -> Column:
        out = key.isin(*self.values) if self.values else F.lit(False)
        return out | key.startswith(self.prefix) if self.prefix else out


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    parts: tuple


TRUE, FALSE = Op("and", ()), Op("or", ())


def both(*parts):
    return Op("and", tuple(p for p in parts if p != TRUE))


def either(*parts):
    return Op("or", tuple(p for p in parts if p != FALSE))


def no(part):
    return Op("not", (part,))


def atoms(e) -> list[Key]:
    return [e] if isinstance(e, Key) else [a for p in e.parts for a in atoms(p)]


def without_keys(e) -> bool:
    """What the expression says of a document that has none of its keys."""
    if isinstance(e, Key):
        return False
    v = [without_keys(p) for p in e.parts]
    return {"and": all(v), "or": any(v), "not": not (v and v[0])}[e.kind]


def column(e, flag) -> Column:
    if isinstance(e, Key):
        return flag(e)
    v = [column(p, flag) for p in e.parts]
    if e.kind == "not":
        return ~v[0]
    return reduce(lambda a, b: a & b, v, F.lit(True)) if e.kind == "and" else reduce(lambda a, b: a | b, v, F.lit(False))


def matching(membership: DataFrame, docs: DataFrame, e) -> DataFrame:
    """doc_ids of docs for which the expression holds."""
    if e == TRUE:
        return docs.select("doc_id")
    names = {a: f"k{i}" for i, a in enumerate(dict.fromkeys(atoms(e)))}
    if not names:
        return docs.select("doc_id").filter(F.lit(without_keys(e)))
    if len(names) == 1 and isinstance(e, Key):
        return membership.filter(e.test(F.col("key"))).select("doc_id").distinct()
    rows = membership.filter(reduce(lambda a, b: a | b, (a.test(F.col("key")) for a in names)))
    flags = rows.groupBy("doc_id").agg(*(F.bool_or(a.test(F.col("key"))).alias(n) for a, n in names.items()))
    holds = column(e, lambda a: F.col(names[a]))
    if without_keys(e):
        return docs.select("doc_id").join(flags.filter(~holds).select("doc_id"), "doc_id", "left_anti")
    return flags.filter(holds).select("doc_id")


# -- the parts of a spec


def bucket_expression(b, key=lambda k: Key((k,))):
    parts = [key(k) for k in b.allOf]
    if b.anyOf:
        # one test for plain keys, whatever their number
        parts.append(Key(tuple(b.anyOf)) if all(isinstance(key(k), Key) and key(k).prefix is None for k in b.anyOf) else either(*(key(k) for k in b.anyOf)))
    if b.noneOf:
        parts.append(no(Key(tuple(b.noneOf))))
    return both(*parts)


def dataset_split(features):
    """The features without their dataset part, and the dataset expression.

    Unstamped documents form the dataset `default`, which starts out selected: any-of adds datasets to the selection, all-of
    requires one, none-of takes one out, and all-of default leaves the unstamped ones alone."""
    is_set = lambda k: k.startswith(keys.DATASET)
    chosen = {keys.DEFAULT_DATASET, *(k for k in (*features.allOf, *features.anyOf) if is_set(k))} - {k for k in features.noneOf if is_set(k)}
    if keys.DEFAULT_DATASET in features.allOf:
        chosen = {keys.DEFAULT_DATASET}
    rest = type(features)(tuple(k for k in features.allOf if k != keys.DEFAULT_DATASET), tuple(k for k in features.anyOf if not is_set(k)), tuple(k for k in features.noneOf if not is_set(k)))
    named = tuple(sorted(chosen - {keys.DEFAULT_DATASET}))
    stamped = Key((), keys.DATASET)
    parts = [Key(named)] if named else []
    if keys.DEFAULT_DATASET in chosen:
        parts.append(no(stamped))
    return rest, either(*parts)


def path_expression(planes: Planes, entries):
    """Any of the entries; a context path needs all its layers, a directory its node or, recursively, any node below. Unknown paths match nothing."""
    out = []
    for p in entries:
        tree = planes.trees.get((p.type, p.tree))
        if tree is None:
            raise ValueError(f"no {p.type} tree {p.tree or 'by default'}")
        found = tree.keys_for(p.path, p.recursive)
        if found is None:
            continue
        out.append(both(*(Key((k,)) for k in found)) if p.type == "context" else Key(tuple(found)))
    return either(*out)


def _combine(planes: Planes, ids: DataFrame, filters, apply) -> DataFrame:
    """Semi and anti joins for filters under all-of, any-of and none-of."""
    by = {s: [apply(f) for f in filters if f.sigil == s] for s in ("allOf", "anyOf", "noneOf")}
    for one in by["allOf"]:
        ids = ids.join(one, "doc_id", "left_semi")
    if by["anyOf"]:
        ids = ids.join(reduce(DataFrame.unionByName, by["anyOf"]), "doc_id", "left_semi")
    if by["noneOf"]:
        ids = ids.join(reduce(DataFrame.unionByName, by["noneOf"]), "doc_id", "left_anti")
    return ids


def time_ids(planes: Planes, f, now: datetime | None = None) -> DataFrame:
    if planes.timeline_pos is None:
        return planes.ids().filter(F.lit(False))
    return planes.timeline_pos.filter(timelines.on(f.name) & timelines.overlaps(f.bounds(now))).select("doc_id")


def geo_ids(planes: Planes, f) -> DataFrame:
    if planes.geo is None:
        return planes.ids().filter(F.lit(False))
    return planes.geo.filter(places.predicate(f.kind, f.args)).select("doc_id")


def rel_ids(planes: Planes, f) -> DataFrame:
    """Documents one hop from any anchor: what the anchors point to, or with dir 'in' what points to them."""
    if planes.edges is None:
        return planes.ids().filter(F.lit(False))
    near, far = ("from_id", "to_id") if f.dir == "out" else ("to_id", "from_id")
    return planes.edges.filter((F.col("p") == f.p) & F.col(near).isin(*f.of)).select(F.col(far).alias("doc_id"))


def key_expression(planes: Planes, spec: Spec):
    """The part of a spec that membership keys decide."""
    features, datasets = dataset_split(spec.features)
    parts = [bucket_expression(features), bucket_expression(spec.raw), datasets]
    if spec.paths_in:
        parts.insert(0, path_expression(planes, spec.paths_in))
    if spec.paths_not:
        excluded = path_expression(planes, spec.paths_not)
        if excluded != FALSE:
            parts.append(no(excluded))
    return both(*parts)


def dependencies(planes: Planes, spec: Spec) -> tuple[list[Key], bool]:
    """The keys whose changes can change a spec's answer, and whether other planes can."""
    return atoms(key_expression(planes, spec)), spec.coarse


def candidates(planes: Planes, spec: Spec, now: datetime | None = None) -> DataFrame:
    """One lazy column doc_id, each live document at most once."""
    ids = matching(planes.membership, planes.docs, key_expression(planes, spec))
    if spec.times:
        ids = _combine(planes, ids, spec.times, lambda f: time_ids(planes, f, now))
    if spec.geo:
        ids = _combine(planes, ids, spec.geo, lambda f: geo_ids(planes, f))
    if spec.rel:
        ids = _combine(planes, ids, spec.rel, lambda f: rel_ids(planes, f))
    if spec.ids is not None:
        if len(spec.ids) <= INLINE:
            ids = ids.filter(F.col("doc_id").isin(*spec.ids)) if spec.ids else ids.filter(F.lit(False))
        else:
            ids = ids.join(planes.spark.createDataFrame([(i,) for i in spec.ids], "doc_id bigint"), "doc_id", "left_semi")
    return ids
