"""The document index: all planes of one corpus, and every read and write on them.

Reads return lazy DataFrames. Writes replace the index's tables by new lazy ones: what a batch changes is derived again for its documents
alone and takes the place of their old rows. `save` writes all planes out and switches to them by one manifest, after which they are read from
there, so a chain of writes doesn't grow its lineage. Every write appends what it did to the change log.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys
from .operators import derive, edges, fts, geo, ingest, membership, ranking, timelines, trees, vectors
from .plans import compile as plan
from .plans.spec import Spec, context_for_insert, normalize_match, parse, predicate
from .session import delete_path, names_in, read_text, write_text, written

#: All planes an index may have.
TABLES = ("docs", "membership", "timeline_pos", "geo", "edges", "fts", "vectors", "seen", "tombstones", "freed", "change_log", "postings", "lengths", "fts_stats")
VERSION = 2
#: Versions of an index that save leaves in place: readers of the one before still find their files.
KEEP = 2


class Index:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], tree_list=None, embed: Callable | None = None, tuning: ranking.Tuning | None = None, point_timelines: tuple[str, ...] = ()):
        """point_timelines: timelines whose positions keep their start only."""
        self.spark, self.tables, self.embed = spark, dict(tables), embed
        self.tuning = tuning or ranking.Tuning.make()
        self.point_timelines = tuple(n.lower() for n in point_timelines)
        self.writes = 0
        self.trees: dict[tuple[str, str | None], trees._Tree] = {}
        for t in tree_list or (trees.ContextTree(), trees.DirectoryTree()):
            self.add_tree(t)

    # -- making, saving

    @classmethod
    def from_docs(cls, spark: SparkSession, docs: DataFrame, placed: DataFrame | None = None, **options) -> Index:
        """Every plane derived from docs; placed adds membership that no row states."""
        out = cls(spark, {"docs": docs}, **options)
        return out.rebuild(placed=placed)

    def rebuild(self, placed: DataFrame | None = None, only: tuple[str, ...] | None = None) -> Index:
        """Derived planes from docs again: all, or some of membership, timeline_pos, geo, edges and fts. Placement and derived edges stay."""
        docs = self.docs
        want = only or ("membership", "timeline_pos", "geo", "edges", "fts")
        if "membership" in want:
            keep = placed
            if keep is None and "membership" in self.tables:
                c = F.col("key")
                keep = self.tables["membership"].filter(c.startswith("context/") | c.startswith("vfs/"))
            rows = derive.membership(docs, derive.device_facets(docs))
            self.tables["membership"] = rows if keep is None else rows.unionByName(keep.select("key", "doc_id")).distinct()
        if "timeline_pos" in want:
            self.tables["timeline_pos"] = timelines.as_points(derive.positions(docs, self.tables.get("tombstones")), self.point_timelines)
        if "geo" in want:
            self.tables["geo"] = derive.places(docs)
        if "edges" in want:
            held = self.tables.get("edges")
            made = derive.relations(docs)
            self.tables["edges"] = made if held is None else made.unionByName(held.filter(F.col("src").isNotNull()).join(made.select("from_id", "p", "to_id"), ["from_id", "p", "to_id"], "left_anti").select(*made.columns))
        if "fts" in want:
            self.tables["fts"] = derive.fts_text(docs).select("doc_id", "fts_text")
            if "postings" in self.tables:
                self.build_postings()
        return self

    def save(self, path: str) -> Index:
        """Every plane as Parquet in a folder of its own, sorted by what it is looked up by; a new manifest then names all of them at once."""
        order = {"membership": ("key", "doc_id"), "timeline_pos": ("timeline", "scale", "start_v"), "docs": ("doc_id",), "edges": ("from_id", "p", "to_id"), "geo": ("lat",), "vectors": ("space", "model", "doc_id"), "postings": ("gram", "doc_id"), "lengths": ("doc_id",)}
        if "lengths" in self.tables:
            self.tables["fts_stats"] = fts.statistics(self.tables["lengths"]).withColumn("signature", F.lit(fts.signature()))
        folders = {}
        for name, df in self.tables.items():
            folders[name] = f"{name}/{uuid.uuid4().hex}"
            (df.repartitionByRange(*order[name]).sortWithinPartitions(*order[name]) if name in order else df).write.parquet(f"{path}/{folders[name]}")
        held = [n for n in names_in(self.spark, path) if n.startswith("manifest-")]
        nth = int(held[-1][9:17]) + 1 if held else 1
        meta = {"version": VERSION, "tables": folders, "trees": [(t.kind, t.to_json()) for t in self._distinct_trees()], "point_timelines": self.point_timelines, "writes": self.writes}
        write_text(self.spark, f"{path}/manifest-{nth:08d}.json", json.dumps(meta))
        for name in held[: -KEEP + 1 or None]:
            try:
                old = json.loads(read_text(self.spark, f"{path}/{name}"))["tables"].values()
            except ValueError:
                old = ()
            for folder in old:
                delete_path(self.spark, f"{path}/{folder}")
            delete_path(self.spark, f"{path}/{name}")
        return self._read(path, folders)

    def _read(self, path: str, folders: dict[str, str]) -> Index:
        self.tables = {n: self.spark.read.parquet(f"{path}/{f}") for n, f in folders.items()}
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Index:
        """The newest version whose manifest is whole."""
        meta = None
        for name in reversed([n for n in names_in(spark, path) if n.startswith("manifest-")]):
            try:
                meta = json.loads(read_text(spark, f"{path}/{name}"))
                break
            except ValueError:  # the write of this version broke off
                continue
        if meta is None:
            raise ValueError(f"no index in {path}")
        if meta["version"] != VERSION:
            raise ValueError(f"index version {meta['version']}, expected {VERSION}: rebuild it")
        kinds = {"context": trees.ContextTree, "directory": trees.DirectoryTree}
        out = cls(spark, {}, [kinds[k].from_json(text) for k, text in meta["trees"]], **{"point_timelines": tuple(meta["point_timelines"]), **options})._read(path, meta["tables"])
        out.writes = meta["writes"]
        if "fts_stats" in out.tables and out.tables["fts_stats"].first()["signature"] != fts.signature():
            out.build_postings()  # made by other rules
        return out

    def clear(self) -> Index:
        """All planes emptied, trees as new."""
        self.tables = {n: df.limit(0) for n, df in self.tables.items()}
        self.trees = {}
        for t in (trees.ContextTree(), trees.DirectoryTree()):
            self.add_tree(t)
        return self

    def publish(self, folder: str) -> Index:
        """Appends the change log so far to a folder that live sessions follow, and empties it."""
        if "change_log" in self.tables:
            self.tables["change_log"].write.mode("append").parquet(folder)
            self.tables["change_log"] = self.tables["change_log"].limit(0)
        return self

    def _log(self, rows: DataFrame) -> None:
        held = self.tables.get("change_log")
        self.tables["change_log"] = rows if held is None else held.unionByName(rows)

    def _changed(self, before: DataFrame, after: DataFrame, reason: str, doc_ids: DataFrame | None = None, provenance: dict | None = None) -> None:
        """What a write changed in membership, of some documents, in the change log."""
        self.writes += 1
        if doc_ids is not None:
            before, after = (m.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("key", "doc_id") for m in (before, after))
        self._log(ingest.changes(before, after, reason, ingest.provenance(provenance).get("origin"), self.writes))

    def _events(self, doc_ids: DataFrame, reason: str, provenance: dict | None = None, tree: str | None = None) -> None:
        """One event a document, of a tree where one is named, in the change log."""
        self._log(ingest.events(doc_ids, reason, ingest.provenance(provenance).get("origin"), self.writes, tree))

    def _tree_events(self, doc_ids: DataFrame, spec: dict, reason: str, provenance: dict | None) -> None:
        """An event a document for each tree that a spec names."""
        for kind in ("context", "directory"):
            given = spec.get(kind)
            if given is not None:
                tree = self.tree(kind, given.get("tree") if isinstance(given, dict) else None)
                self._events(doc_ids, reason, provenance, f"{kind}/{tree.id}")

    # -- tables

    @property
    def docs(self) -> DataFrame:
        return self.tables["docs"]

    @property
    def planes(self) -> plan.Planes:
        t = self.tables
        return plan.Planes(t["docs"], t["membership"], t.get("timeline_pos"), t.get("geo"), t.get("edges"), t.get("fts"), t.get("vectors"), self.trees)

    # -- trees

    def add_tree(self, tree, default: bool = False) -> None:
        self.trees[(tree.kind, tree.id)] = tree
        if default or (tree.kind, None) not in self.trees:
            self.trees[(tree.kind, None)] = tree

    def _distinct_trees(self):
        return [t for (_, name), t in self.trees.items() if name is not None]

    def tree(self, kind: str, id: str | None = None):
        if (kind, id) not in self.trees:
            raise KeyError(f"no {kind} tree {id or 'by default'}")
        return self.trees[(kind, id)]

    def list_trees(self) -> list[tuple[str, str, str]]:
        return [(t.kind, t.id, t.name) for t in self._distinct_trees()]

    def rename_tree(self, kind: str, id: str, name: str) -> None:
        self.tree(kind, id).name = name

    def delete_tree(self, kind: str, id: str) -> None:
        """A tree and the membership under it; a default tree stays."""
        tree = self.tree(kind, id)
        if self.trees.get((kind, None)) is tree:
            raise ValueError("the default tree stays")
        del self.trees[(kind, id)]
        self.tables["membership"] = self.tables["membership"].filter(~F.col("key").startswith(keys.normalize(f"{tree.prefix}/{tree.id}/")))

    def tree_documents(self, kind: str, id: str | None = None, path: str | None = None, linked: bool | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        return ranking.page(trees.tree_documents(self.tables["membership"], self.tree(kind, id), path, linked).orderBy("doc_id"), limit, offset)

    def documents_under(self, scope: str) -> DataFrame:
        """doc_ids under 'dir://path' (with all below) or 'ctx://path'."""
        kind, _, path = scope.partition("://")
        if kind not in ("dir", "ctx"):
            raise ValueError("a scope is dir://... or ctx://...")
        spec = {"directory": {"path": path, "recursive": True}} if kind == "dir" else {"context": {"path": path}}
        return self.candidates(spec)

    def document_paths(self, doc_ids: DataFrame | None = None) -> DataFrame:
        rows = trees.placements(self.tables["membership"], self._distinct_trees())
        return rows if doc_ids is None else rows.join(doc_ids.select("doc_id"), "doc_id", "left_semi")

    # -- point reads

    def get(self, doc_id: int) -> DataFrame:
        return self.docs.filter(F.col("doc_id") == doc_id)

    def get_many(self, ids: list[int], pos: str | None = None) -> DataFrame:
        """Rows in the order of ids, with their place as a column if one is named; unknown ids are left out, repeated ones repeat."""
        order = self.spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "_rank int, doc_id bigint")
        rows = self.docs.join(order, "doc_id").orderBy("_rank")
        return rows.withColumnRenamed("_rank", pos) if pos else rows.drop("_rank")

    def fetch(self, ids: list[int], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """get_many down to a limit (0 or None: all), and one row with count (of what is returned), total_count (of ids that are there) and missing."""
        asked = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "doc_id bigint")
        there = asked.join(self.docs.select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("total_count"))
        data = ranking.page(self.get_many(ids), limit)
        return data, there.select((F.least("total_count", F.lit(limit)) if limit else F.col("total_count")).alias("count"), "total_count", (F.lit(len(dict.fromkeys(ids))) - F.col("total_count")).alias("missing"))

    def by_checksum(self, sums: list[str], schema: str | None = None) -> DataFrame:
        """pos, checksum and doc_id of each checksum, null where there is no such document."""
        asked = self.spark.createDataFrame(list(enumerate(sums)), "pos int, checksum string")
        held = self.docs.filter(F.col("schema") == schema) if schema else self.docs
        # only the asked ones are grouped
        rows = held.select(F.explode("checksums").alias("checksum"), "doc_id").join(asked.select("checksum"), "checksum", "left_semi").groupBy("checksum").agg(F.max("doc_id").alias("doc_id"))
        return asked.join(rows, "checksum", "left").select("pos", "checksum", "doc_id").orderBy("pos")

    def checksums(self, algorithm: str | None = None) -> DataFrame:
        rows = derive.checksums(self.docs)
        return rows.filter(F.col("checksum").startswith(f"{algorithm}/")) if algorithm else rows

    def _having(self, ids: DataFrame, spec: dict | None) -> DataFrame:
        """Those of some documents that exist and meet the spec's trees (all of them) and features; other parts of a spec don't count here."""
        s = parse(spec)
        ids = self.docs.select("doc_id").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        mine = self.tables["membership"].join(ids, "doc_id", "left_semi")
        for e in s.paths_in:
            ids = plan.matching(mine, ids, plan.path_expression(self.planes, [e])).join(ids, "doc_id", "left_semi")
        return plan.matching(mine, ids, plan.bucket_expression(s.features)).join(ids, "doc_id", "left_semi")

    def has(self, doc_id: int, spec: dict | None = None) -> bool:
        one = self.spark.createDataFrame([(doc_id,)], "doc_id bigint")
        return not self._having(one, spec).limit(1).isEmpty()

    def has_many(self, doc_ids: DataFrame, spec: dict | None = None) -> DataFrame:
        """doc_id and present of each asked document."""
        asked = doc_ids.select("doc_id").distinct()
        there = self._having(asked, spec).select("doc_id").distinct().withColumn("present", F.lit(True))
        return asked.join(there, "doc_id", "left").select("doc_id", F.coalesce("present", F.lit(False)).alias("present"))

    def has_checksum(self, checksum: str, spec: dict | None = None) -> bool:
        got = self.by_checksum([checksum]).first()
        return got["doc_id"] is not None and self.has(got["doc_id"], spec)

    def keys_of(self, doc_id: int, prefix: str | None = None) -> DataFrame:
        return membership.keys_of(self.tables["membership"], doc_id, prefix)

    # -- structural queries

    def candidates(self, spec: dict | Spec, now: datetime | None = None) -> DataFrame:
        return plan.candidates(self.planes, parse(spec), now)

    def count(self, spec: dict | Spec, now: datetime | None = None) -> int:
        return self.candidates(spec, now).count()

    def list(self, spec: dict | Spec | None = None, now: datetime | None = None) -> DataFrame:
        """Documents of a spec in id order or by a timeline; 100 unless a limit is given, 0 means all."""
        s = parse(spec)
        ids = self.candidates(s, now)
        limit = 100 if s.limit is None else s.limit
        if s.sort_by:
            ids = timelines.ordered(ids, self.tables["timeline_pos"], s.sort_by, s.desc)
            order = [F.col("sort_key").isNull(), F.col("sort_key").desc() if s.desc else F.col("sort_key"), F.col("doc_id").desc() if s.desc else F.col("doc_id")]
        else:
            order = [F.col("doc_id").desc() if s.desc else F.col("doc_id")]
            ids = ids.orderBy(*order)
        ids = ranking.page(ids, limit, s.offset)
        if s.ids_only:
            return ids.select("doc_id")
        return ids.join(self.docs, "doc_id").orderBy(*order).select(*self.docs.columns)

    # -- ranked queries

    def _space(self, space: str) -> DataFrame | None:
        held = self.tables.get("vectors")
        return None if held is None else vectors.in_space(held, space)

    def _embedded(self, text: str, space: str):
        return self.embed(text, space) if self.embed else None

    def build_postings(self) -> Index:
        """The text index, lazily: it is stored by `save`, or at once by `store_postings`. Without one, texts are scanned."""
        self.tables["postings"], self.tables["lengths"] = fts.postings(self.tables["fts"]), fts.lengths(self.tables["fts"])
        self.tables.pop("fts_stats", None)
        return self

    def store_postings(self, folder: str) -> Index:
        """The text index written to a folder and read from there."""
        fts.sorted_blocks(fts.blocks(self.tables["fts"])).write.parquet(folder)
        return self.use_postings(folder)

    def use_postings(self, folder: str) -> Index:
        """A text index that store_postings wrote."""
        rows = self.spark.read.parquet(folder)
        self.tables["postings"], self.tables["lengths"] = fts.unpacked(rows), fts.stored_lengths(rows)
        self.tables.pop("fts_stats", None)
        return self

    def text_scores(self, text: str, scope: DataFrame | None = None) -> DataFrame:
        if "postings" in self.tables:
            return fts.scores(self.tables["postings"], self.tables.get("fts_stats", self.tables["lengths"]), text, scope)
        return fts.scan_scores(self.tables["fts"], text, scope)

    def _fts(self, text: str, scope: DataFrame | None, limit: int | None) -> DataFrame:
        return fts.ranked(self.text_scores(text, scope), limit)

    def _image(self, text: str, scope: DataFrame | None, depth: int | None, relative: bool = False) -> DataFrame | None:
        rows, v = self._space("image"), self._embedded(text, "image")
        if rows is None or v is None:
            return None
        cap = self.tuning.image_max_distance
        if not relative and self.tuning.image_floor == "absolute":
            return vectors.search(rows, v, scope, depth, max_distance=cap)
        return vectors.relative_floor(vectors.search(rows, v, scope, depth), self.tuning.image_margin, None if relative else cap)

    def rank(self, match, scope: DataFrame | None, limit: int | None = 50, offset: int = 0, mode: str = "hybrid", relative: bool = False, min_distance: float | None = None, max_distance: float | None = None) -> DataFrame:
        """doc_id and score in rank order; what legs there are depends on the mode and on what is there to answer it."""
        match = normalize_match(match)
        limit = 50 if limit is None else limit
        depth = ranking.depth_for(limit, offset) if limit else None
        text, given = match["text"], match["vectors"]
        w = self.tuning.weights
        by_score, by_distance = (F.col("score").desc(), "doc_id"), ("distance", "doc_id")
        extra = []
        for one in given:
            rows = self._space(one["space"])
            if rows is not None:
                hits = vectors.search(rows, one["vector"], scope, depth, min_distance=one.get("minDistance"), max_distance=one.get("maxDistance"))
                extra.append((hits, one.get("weight", w.get(one["space"], 1.0))))
        as_leg = lambda hits, weight, order=by_distance: (ranking.leg(hits, *order, depth=depth), weight)
        if not text:
            if not extra:
                raise ValueError("no vector space of the match is there")
            if len(extra) == 1:
                return ranking.page(extra[0][0].select("doc_id", (-F.col("distance")).alias("score")).orderBy(F.col("score").desc(), "doc_id"), limit, offset)
            return ranking.page(ranking.fuse([as_leg(*x) for x in extra]), limit, offset)
        dense = image = None
        if mode != "fts" and self.tables.get("vectors") is not None:
            v = self._embedded(text, "text")
            rows = self._space("text")
            dense = vectors.search(rows, v, scope, depth, min_distance=min_distance, max_distance=max_distance) if v is not None else None
            image = self._image(text, scope, depth, relative)
        legs = []
        if mode != "vector" or (dense is None and image is None and not extra):
            legs.append(as_leg(self._fts(text, scope, depth), w["fts"], by_score))
        if dense is not None:
            legs.append(as_leg(dense, w["dense"]))
        if image is not None:
            legs.append(as_leg(image, w["image"]))
        legs += [as_leg(*x) for x in extra]
        if len(legs) == 1:
            only = self._fts(text, scope, None) if mode == "fts" or (dense is None and image is None) else dense if dense is not None else image
            score = F.col("score") if "score" in only.columns else -F.col("distance")
            return ranking.page(only.select("doc_id", score.alias("score")).orderBy(F.col("score").desc(), "doc_id"), limit, offset)
        return ranking.page(ranking.fuse(legs), limit, offset)

    def image_distances(self, text: str, spec: dict | Spec | None = None, n: int = 50, now: datetime | None = None) -> DataFrame:
        """doc_id and distance of the n (500 at most) nearest images, whatever the floor: what tuning it needs to see."""
        rows, v = self._space("image"), self._embedded(text, "image")
        if rows is None or v is None:
            raise ValueError("no image space, or nothing that embeds into it")
        return vectors.search(rows, v, self._scope(parse(spec), now), max(1, min(n, 500)))

    def _scope(self, s: Spec, now: datetime | None) -> DataFrame | None:
        bare = replace(s, match=None, limit=None, offset=0, sort_by=None)
        return None if plan.key_expression(self.planes, bare) == plan.TRUE and not s.coarse and s.ids is None else self.candidates(bare, now)

    def query(self, match, spec: dict | Spec | None = None, now: datetime | None = None) -> DataFrame:
        """doc_id and score of the best documents of a spec for a match."""
        s = parse(spec)
        return self.rank(match, self._scope(s, now), s.limit, s.offset, s.mode, min_distance=s.options.get("minDistance"), max_distance=s.options.get("maxDistance"))

    def search(self, spec: dict, now: datetime | None = None) -> DataFrame:
        """query where the spec has a text (query, search or q), list of ids otherwise."""
        s = parse(spec)
        return self.list(replace(s, ids_only=True), now) if s.match is None else self.query(s.match, s, now)

    def matches(self, text: str, scope: DataFrame | None, image_depth: int, relative: bool = False) -> DataFrame:
        """doc_ids that a text matches: every lexical match, and image hits to a depth."""
        out = self.text_scores(text, scope).select("doc_id")
        image = self._image(text, scope, image_depth, relative) if self.tables.get("vectors") is not None else None
        return out if image is None else out.unionByName(image.select("doc_id")).distinct()

    def _fold(self, texts: list[str], scope: DataFrame | None, depth: int) -> DataFrame | None:
        for k, text in enumerate(texts):
            scope = self.matches(text, scope, depth, k > 0)
        return scope

    def search_refined(self, texts: list[str], spec: dict | None = None, limit: int = 50, offset: int = 0, mode: str = "hybrid", now: datetime | None = None) -> DataFrame:
        """A chain of texts, each narrowing to its matches; the last one ranks. Without texts it lists."""
        texts = [x for x in texts if isinstance(x, str) and x.strip()]
        s = parse(spec)
        if not texts:
            return self.list(replace(s, limit=limit, offset=offset, ids_only=True), now)
        scope = self._fold(texts[:-1], self._scope(s, now), ranking.depth_for(limit, offset))
        return self.rank(texts[-1], scope, limit, offset, mode, relative=len(texts) > 1)

    def search_compound(self, lines: list[dict], op: str = "or", base: dict | None = None, limit: int = 50, offset: int = 0, mode: str = "hybrid", now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
        """Lines of chains, combined as sets; ranked by fusion of the lines' heads, other members behind in id order. Returns (doc_id, score) and (line, n)."""
        if op not in ("or", "and"):
            raise ValueError("op is or, or and")
        members, heads, counts = [], [], []
        for k, line in enumerate(lines):
            spec = dict(base or {})
            for field in ("filters", "features", "context", "directory"):
                if field in line:
                    spec[field] = [*spec[field], *line[field]] if isinstance(spec.get(field), list) and isinstance(line[field], list) else line[field]
            s = parse(spec)
            texts = [x for x in line.get("queries") or [] if isinstance(x, str) and x.strip()]
            scope = self._scope(s, now)
            if texts:
                scope = self._fold(texts[:-1], scope, ranking.depth_for(limit, offset))
                found = self.matches(texts[-1], scope, ranking.FUSE_DEPTH, len(texts) > 1)
                ranked = self.rank(texts[-1], scope, ranking.FUSE_DEPTH, 0, mode, relative=len(texts) > 1).join(found, "doc_id", "left_semi")
                heads.append((ranking.leg(ranked, F.col("score").desc(), "doc_id"), 1.0))
            else:
                found = self.candidates(s, now) if scope is None else scope
            members.append(found)
            counts.append(found.agg(F.count("*").alias("n")).select(F.lit(k).alias("line"), "n"))
        total = counts[0] if counts else self.spark.createDataFrame([], "line int, n bigint")
        for c in counts[1:]:
            total = total.unionByName(c)
        if not members:
            return self.spark.createDataFrame([], "doc_id bigint, score double"), total
        every = ranking.combine(members, op)
        fused = ranking.fuse(heads) if heads else self.spark.createDataFrame([], "doc_id bigint, score double")
        return ranking.page(ranking.with_tail(fused, every), limit, offset), total

    def search_by_vector(self, vector, spec: dict | None = None, space: str = "image", limit: int = 25, offset: int = 0, min_distance: float | None = None, max_distance: float | None = None, exclude=(), dim: int | None = None, now: datetime | None = None) -> DataFrame:
        rows = self._space(space)
        if rows is None:
            raise ValueError(f"no vector space {space}")
        if dim is not None and len(vector) != dim:
            raise ValueError(f"a vector of {len(vector)} in a space of {dim}")
        s = parse(spec)
        return vectors.search(rows, vector, self._scope(s, now), limit, offset, min_distance, max_distance, exclude)

    def more_like(self, doc_id: int, space: str = "image", limit: int = 25, **options) -> DataFrame:
        rows = self._space(space)
        if rows is None:
            raise ValueError(f"no vector space {space}")
        return vectors.more_like(rows, doc_id, limit, **options)

    # -- counts

    def list_datasets(self) -> DataFrame:
        """name, key and n of every dataset."""
        rows = membership.sizes(self.tables["membership"], keys.DATASET)
        return rows.select(F.substring("key", len(keys.DATASET) + 1, 1000).alias("name"), "key", "n")

    def facet_counts(self, facet: str) -> DataFrame:
        return membership.sizes(self.tables["membership"], f"data/{facet}/")

    def histogram(self, names, buckets, spec: dict | None = None) -> DataFrame:
        return timelines.histogram(self.tables["timeline_pos"], names, buckets, None if spec is None else self.candidates(spec))

    def stats(self) -> DataFrame:
        """table and n of every plane."""
        out = None
        for name, df in self.tables.items():
            one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    def geo_count(self) -> DataFrame:
        return self.tables["geo"].agg(F.countDistinct("doc_id").alias("n"))

    def embedding_report(self, space: str, schemas: list[str], comments: bool = False) -> DataFrame:
        """One row: how many documents could be embedded, and how many no embedder has seen."""
        some = membership.any_of(self.tables["membership"], [*schemas, *([keys.COMMENT] if comments else [])])
        gap = self.unembedded(space, schemas, comments)
        return some.agg(F.count("*").alias("total")).crossJoin(gap.agg(F.count("*").alias("gap")))

    def unembedded(self, space: str, schemas: list[str], comments: bool = False) -> DataFrame:
        """doc_ids of some schemas (and of commented documents) that no embedder of the space has seen."""
        names = [*schemas, *([keys.COMMENT] if comments else [])]
        some = membership.any_of(self.tables["membership"], names)
        seen = self.tables.get("seen")
        return some if seen is None else vectors.gap(some, seen.filter(F.col("space") == space))

    # -- writes

    def _write_keys(self, spec: dict | None, link_root: bool = True) -> list[str]:
        s = dict(spec or {})
        out: list[str] = []
        context = s.get("context")
        directory = s.get("directory")
        for kind, given in (("context", context), ("directory", directory)):
            if given is None:
                continue
            tree = self.tree(kind, given.get("tree") if isinstance(given, dict) else None)
            out += tree.write_keys(context_for_insert(given.get("path") if isinstance(given, dict) else given))
        for token in s.get("paths") or []:
            kind, path = ("directory", token[4:]) if token.startswith("dir:") else ("context", token.removeprefix("ctx:"))
            out += self.tree(kind).write_keys([path])
        if link_root:
            out += [self.tree("context").key(self.tree("context").root.layer)]
        features = s.get("features") or []
        for f in features if isinstance(features, list) else [*features.get("allOf", []), *features.get("anyOf", [])]:
            key = keys.make(str(f).lstrip("+!"))
            if key == keys.DEFAULT_DATASET:
                raise ValueError("the default dataset is virtual: it can't be stamped")
            out.append(key)
        return list(dict.fromkeys(out))

    def put_many(self, batch: DataFrame, spec: dict | None = None, now: Column | None = None, freed: DataFrame | None = None, provenance: dict | None = None, schemas: bool = False) -> tuple[DataFrame, DataFrame]:
        """A batch upserted and placed; returns (pos, doc_id) and rejected rows. Ids of deleted documents are given out again first.

        Planes are derived for the batch's documents (and for those on a device that it describes) and replace their rows; no other
        document is derived again. With schemas, rows that break their schema's required fields are rejected too."""
        now = F.current_timestamp() if now is None else now
        freed = self.tables.get("freed") if freed is None else freed
        stored = self.docs
        own, ids, rejected = ingest.stage(stored, batch, now, freed, schemas)
        names = self._write_keys(spec)
        features = [k for k in names if not k.startswith(("context/", "vfs/"))]
        if features:
            own = own.withColumn("features", F.array_union(F.coalesce("features", F.array().cast("array<string>")), F.array(*map(F.lit, features)))).select(*own.columns)
        touched = own.select("doc_id")
        if self.tables.get("freed") is not None:
            self.tables["freed"] = self.tables["freed"].join(touched, "doc_id", "left_anti")
        known = touched.join(stored.select("doc_id"), "doc_id", "left_semi")
        self._refresh(own, [k for k in names if k.startswith(("context/", "vfs/"))], stored, provenance)
        self._events(touched.join(known, "doc_id", "left_anti"), "created", provenance)
        self._events(known, "updated", provenance)
        return ids, rejected

    def _refresh(self, own: DataFrame, placed: list[str], stored: DataFrame, provenance: dict | None) -> None:
        """Some documents and their derived planes in place of what they had, and placement under some keys."""
        self.tables["docs"] = docs = ingest.replaced(stored, own, own)
        c, touched, old = F.col("key"), own.select("doc_id"), self.tables["membership"].select("key", "doc_id")
        # a device's facets are on the documents that name it
        on = own.filter(F.col("schema") == "data/schema/device").select(keys.normalized(F.concat(F.lit("device/id/"), derive.nested("data.deviceId"))).alias("key"))
        more = written(old.join(on, "key", "left_semi").select("doc_id").unionByName(touched).distinct(), "put-touched")
        mine = written(old.join(more, "doc_id", "left_semi").select("key", "doc_id"), "put-before")
        rows = derive.membership(docs.join(more, "doc_id", "left_semi"), derive.device_facets(docs)).unionByName(mine.filter(c.startswith("context/") | c.startswith("vfs/")))
        if placed:
            rows = rows.unionByName(touched.select(F.explode(F.array(*map(F.lit, placed))).alias("key"), "doc_id"))
        rows = written(rows.distinct(), "put-keys")
        self.tables["membership"] = ingest.replaced(old, rows, more)
        self._changed(mine, rows, "put", None, provenance)
        if "timeline_pos" in self.tables:
            # what a tombstone left of an id given out again goes with the rest
            self.tables["timeline_pos"] = ingest.replaced(self.tables["timeline_pos"], timelines.as_points(derive.positions(own), self.point_timelines), touched)
        if "geo" in self.tables:
            self.tables["geo"] = ingest.replaced(self.tables["geo"], derive.places(own), touched)
        if "edges" in self.tables:
            held, made = self.tables["edges"], derive.relations(own)
            asserted = held.filter(F.col("src").isNull()).join(touched.select(F.col("doc_id").alias("from_id")), "from_id", "left_anti").select(*made.columns)
            derived = held.filter(F.col("src").isNotNull()).join(made.select("from_id", "p", "to_id"), ["from_id", "p", "to_id"], "left_anti").select(*made.columns)
            self.tables["edges"] = asserted.unionByName(derived).unionByName(made)
        if "fts" in self.tables:
            texts = derive.fts_text(own).select("doc_id", "fts_text")
            self.tables["fts"] = ingest.replaced(self.tables["fts"], texts, touched)
            if "postings" in self.tables:
                # only texts whose checksum, comment or summary changed
                changed = written(ingest.needs_fts(stored.join(touched, "doc_id", "left_semi"), own), "put-texts")
                fresh = texts.join(changed, "doc_id", "left_semi")
                for name, make in (("postings", fts.postings), ("lengths", fts.lengths)):
                    self.tables[name] = ingest.replaced(self.tables[name], make(fresh), changed)
                self.tables.pop("fts_stats", None)

    def link(self, doc_ids: DataFrame, spec: dict, provenance: dict | None = None) -> Index:
        before, doc_ids = self.tables["membership"], written(doc_ids.select("doc_id").distinct(), "link")
        self.tables["membership"] = membership.tick(before, self._write_keys(spec, False), doc_ids)
        self._changed(before, self.tables["membership"], "linked", doc_ids, provenance)
        self._tree_events(doc_ids, spec, "linked", provenance)
        return self

    def unlink(self, doc_ids: DataFrame, spec: dict, provenance: dict | None = None) -> DataFrame:
        """Placement (the leaf, or with recursive all of a path or folder) and features taken away. Returns doc_id, ok and reason of each document."""
        gone: list[str] = []
        for kind in ("context", "directory"):
            given = spec.get(kind)
            if given is not None:
                given = given if isinstance(given, dict) else {"path": given}
                gone += self.tree(kind, given.get("tree")).unlink_keys(given.get("path") or "/", bool(given.get("recursive", spec.get("recursive"))))
        gone += [keys.make(str(f).lstrip("+!")) for f in spec.get("features") or []]
        before, doc_ids = self.tables["membership"], written(doc_ids.select("doc_id").distinct(), "unlink")
        self.tables["membership"] = membership.untick(before, gone, doc_ids)
        self._changed(before, self.tables["membership"], "unlinked", doc_ids, provenance)
        self._tree_events(doc_ids, spec, "unlinked", provenance)
        return ingest.outcome(doc_ids, self.docs, before.filter(F.col("key").isin(*gone)) if gone else before.limit(0))

    def delete(self, doc_ids: DataFrame, now: Column | None = None, provenance: dict | None = None) -> DataFrame:
        """Documents and all that derives from them; a tombstone each stays and their ids can be given out again. Returns doc_id, ok and reason of each."""
        now = F.current_timestamp() if now is None else now
        before, docs, doc_ids = self.tables["membership"], self.docs, written(doc_ids.select("doc_id").distinct(), "delete")
        self.tables["docs"], self.tables["membership"], stones = ingest.delete(docs, before, doc_ids, now)
        held = self.tables.get("tombstones")
        self.tables["tombstones"] = stones if held is None else held.unionByName(stones)
        freed = self.tables.get("freed")
        self.tables["freed"] = stones.select("doc_id") if freed is None else freed.unionByName(stones.select("doc_id")).distinct()
        gone = doc_ids
        for name in ("timeline_pos", "geo", "fts", "vectors", "seen", "postings", "lengths"):
            if name in self.tables:
                self.tables[name] = self.tables[name].join(gone, "doc_id", "left_anti").select(*self.tables[name].columns)
        self.tables.pop("fts_stats", None)
        if "timeline_pos" in self.tables:
            from .functions.time import timestamp_value

            self.tables["timeline_pos"] = self.tables["timeline_pos"].unionByName(timelines.positions(stones, "crud:deleted", "second", timestamp_value(F.col("deleted_at"), "second"), primary=F.lit(True)))
        if "edges" in self.tables:
            self.tables["edges"] = edges.delete_nodes(self.tables["edges"], gone)
        self._changed(before, self.tables["membership"], "deleted", gone, provenance)
        self._events(stones.select("doc_id"), "deleted", provenance)
        return ingest.outcome(doc_ids, docs)

    def delete_dataset(self, name: str, drop_documents: bool = False) -> Index:
        key = keys.normalize(keys.DATASET + name)
        if key == keys.DEFAULT_DATASET:
            raise ValueError("the default dataset can't be deleted")
        ids = membership.ids(self.tables["membership"], key)
        if drop_documents:
            self.delete(ids)
        self.tables["membership"] = membership.delete(self.tables["membership"], key, force=True)
        return self

    def relate(self, pairs: DataFrame, p: str, src: str, inherit: bool = False) -> Index:
        """Derived edges (from_id, to_id); with inherit the targets get the keys of the sources."""
        if not src or src == "doc":
            raise ValueError("a derived edge needs a src other than 'doc'")
        new = pairs.select("from_id", F.lit(predicate(p)).alias("p"), "to_id", F.lit(src).alias("src"))
        self.tables["edges"] = edges.link(self.tables["edges"], new, derived=True)
        if inherit:
            self.tables["membership"] = membership.inherit(self.tables["membership"], pairs)
        return self

    def unrelate(self, pairs: DataFrame, p: str) -> Index:
        """Derived edges removed; asserted ones belong to their rows and stay."""
        self.tables["edges"] = edges.unlink(self.tables["edges"], pairs.withColumn("p", F.lit(predicate(p))), derived_only=True)
        return self

    def assert_relation(self, doc_id: int, p: str, to: int, retract: bool = False) -> Index:
        """A relation written into (or out of) the document's own row; its edge follows."""
        one = F.struct(F.lit(predicate(p)).alias("p"), F.lit(to).cast("bigint").alias("to"))
        kind = "array<struct<p:string,to:bigint>>"
        have = F.coalesce(F.from_json(F.get_json_object("data", "$.relations"), kind), F.array().cast(kind))
        new = F.array_remove(have, one) if retract else F.array_union(have, F.array(one))
        # the row's other fields as they are: a map of raw JSON values put together again
        rest = F.map_filter(F.from_json("data", "map<string,string>"), lambda k, _: k != "relations")
        fields = F.transform(F.map_keys(rest), lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), _raw(F.col("data"), k)))
        body = F.concat(F.lit("{"), F.array_join(F.concat(fields, F.array(F.concat(F.lit('"relations":'), F.to_json(new)))), ","), F.lit("}"))
        self.tables["docs"] = self.docs.withColumn("data", F.when(F.col("doc_id") == doc_id, body).otherwise(F.col("data")))
        return self.rebuild(only=("edges",))

    def store_embeddings(self, new: DataFrame, space: str, model: str, dim: int) -> Index:
        """Chunk rows (doc_id, chunk_id, vector) in place of a document's; every document counts as seen."""
        empty = self.spark.createDataFrame([], "space string, model string, doc_id bigint, chunk_id int, vector array<float>")
        self.tables["vectors"] = vectors.store(self.tables.get("vectors", empty), new, space, model, dim)
        mark = new.select(F.lit(space).alias("space"), F.lit(model).alias("model"), "doc_id").distinct()
        held = self.tables.get("seen")
        self.tables["seen"] = mark if held is None else held.unionByName(mark).distinct()
        return self

    def near(self, lat: float, lon: float, metres: float) -> DataFrame:
        return self.tables["geo"].filter(geo.in_radius(F.col("lat"), F.col("lon"), lat, lon, metres)).select("doc_id")


def _raw(data: Column, name: Column) -> Column:
    """A top-level field of a JSON object as JSON text."""
    return F.to_json(F.variant_get(F.parse_json(data), F.lit("$"), "map<string,variant>")[name])
