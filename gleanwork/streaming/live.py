"""Live result sets: labelled cues, hard-ANDed, whose members are kept up to date from a change feed.

The feed is an append-only table change_log (doc_id, op, key, ...), read as a stream. Each micro-batch re-evaluates the session only if it
touched a key that some cue depends on (or if a cue depends on planes that have no keys), compares with the members written
by the last batch, and reports what came and went. Members are written under the batch's number in the checkpointed folder, so a
batch that runs again after a failure starts from the same predecessor and gives the same delta.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import compile as plan
from ..plans.spec import Spec, parse

CHANGE = "event_id string, doc_id bigint, op string, key string, reason string, origin string"
REASONS = ("created", "updated", "deleted", "linked", "unlinked", "tree", "rebuild")


def feed(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The change log as a stream."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", max_files).parquet(path)


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """op ('added' or 'removed') and doc_id between two sets of doc_ids, by one full join."""
    a, b = before.select("doc_id").withColumn("was", F.lit(True)), after.select("doc_id").withColumn("now", F.lit(True))
    both = a.join(b, "doc_id", "full_outer")
    return both.filter(F.col("was").isNull() | F.col("now").isNull()).select(F.when(F.col("was").isNull(), "added").otherwise("removed").alias("op"), "doc_id")


class Session:
    """mode 'live' resolves named time frames whenever it is evaluated, 'frozen' when a cue is added. emit is 'delta', 'ids' or 'page'."""

    def __init__(self, planes: Callable[[], plan.Planes], specs: dict | None = None, mode: str = "live", emit: str = "delta", clock: Callable[[], datetime] | None = None):
        if mode not in ("live", "frozen") or emit not in ("delta", "ids", "page"):
            raise ValueError("mode is live or frozen, emit is delta, ids or page")
        self.planes, self.mode, self.emit = planes, mode, emit
        self.clock = clock or (lambda: datetime.now(UTC))
        self.cues: dict[str, Spec] = {}
        self._given: dict[str, dict] = {}
        self.listeners: list[Callable] = []
        self.queries: list = []
        for label, s in (specs or {}).items():
            self.set(label, s)

    # -- cues

    def set(self, label: str, spec: dict) -> Session:
        """A cue, in place of one of that label."""
        parsed = parse(spec)
        self._given[label] = dict(spec)
        self.cues[label] = parsed.freeze(self.clock()) if self.mode == "frozen" else parsed
        return self

    def add(self, spec: dict, label: str | None = None) -> str:
        n = len(self.cues) + 1
        while label is None or label in self.cues:
            if label is not None:
                raise ValueError(f"there is a cue {label}")
            label = f"cue{n}" if f"cue{n}" not in self.cues else None
            n += 1
        self.set(label, spec)
        return label

    def patch(self, label: str, more: dict) -> Session:
        """A cue with lists extended and other fields replaced."""
        old = dict(self._given.get(label, {}))
        for k, v in more.items():
            old[k] = [*old[k], *v] if isinstance(old.get(k), list) and isinstance(v, list) else v
        return self.set(label, old)

    def remove(self, label: str) -> Session:
        self.cues.pop(label, None)
        self._given.pop(label, None)
        return self

    def clear(self) -> Session:
        self.cues.clear()
        self._given.clear()
        return self

    def labels(self) -> list[str]:
        return list(self.cues)

    @property
    def size(self) -> int:
        return len(self.cues)

    # -- members

    def ids(self, planes: plan.Planes | None = None) -> DataFrame:
        """doc_ids that every cue holds; without cues, all."""
        planes = planes or self.planes()
        sets = [plan.candidates(planes, s, self.clock()) for s in self.cues.values()]
        return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), sets) if sets else planes.ids()

    def count(self) -> int:
        return self.ids().count()

    def materialize(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        planes = self.planes()
        ids = self.ids(planes).orderBy("doc_id")
        if offset:
            ids = ids.offset(offset)
        if limit:
            ids = ids.limit(limit)
        return planes.docs.join(ids, "doc_id", "left_semi").orderBy("doc_id")

    def touched(self, changes: DataFrame, planes: plan.Planes | None = None) -> DataFrame:
        """Changes that can alter the members."""
        planes = planes or self.planes()
        tests = []
        for s in self.cues.values():
            found, coarse = plan.dependencies(planes, s)
            # a cue without keys of its own holds every live document
            if coarse or not found or plan.without_keys(plan.key_expression(planes, s)):
                return changes
            tests += [a.test(F.col("key")) for a in found]
        return changes.filter(reduce(lambda a, b: a | b, tests)) if tests else changes

    # -- the stream

    def on_change(self, listener: Callable) -> Session:
        self.listeners.append(listener)
        return self

    def _report(self, change: DataFrame, members: DataFrame, batch: int) -> None:
        out = change if self.emit == "delta" else members if self.emit == "ids" else self.materialize(100)
        for listener in self.listeners:
            listener(out, batch)

    def step(self, changes: DataFrame, batch: int, folder: str) -> DataFrame | None:
        """One micro-batch: the delta against the members of the batch before, or None where nothing changed."""
        spark = changes.sparkSession
        planes = self.planes()
        if self.touched(changes, planes).limit(1).isEmpty():
            return None
        known = [b for b in _written(spark, folder) if b < batch]
        before = spark.read.parquet(f"{folder}/batch-{known[-1]}") if known else planes.ids().filter(F.lit(False))
        self.ids(planes).write.mode("overwrite").parquet(f"{folder}/batch-{batch}")
        after = spark.read.parquet(f"{folder}/batch-{batch}")
        change = delta(before, after)
        if change.limit(1).isEmpty():
            return None
        self._report(change, after, batch)
        return change

    def start(self, changes: DataFrame, folder: str, every: str | None = None):
        """Follows a stream of changes; members and the stream's checkpoint live in the folder. `every` is the trigger's interval, else what is there is worked off."""
        w = changes.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(lambda df, n: self.step(df, n, folder) and None)
        q = (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
        self.queries.append(q)
        return q

    def close(self) -> None:
        for q in self.queries:
            q.stop()
        self.queries.clear()
        self.listeners.clear()

    # -- saving

    def serialize(self) -> str:
        return json.dumps({"mode": self.mode, "emit": self.emit, "cues": self._given, "at": self.clock().isoformat()})

    @classmethod
    def rehydrate(cls, text: str, planes: Callable[[], plan.Planes], clock: Callable[[], datetime] | None = None) -> Session:
        """A session as it was saved; frozen frames stay those of the time it was saved at."""
        got = json.loads(text)
        out = cls(planes, None, got["mode"], got["emit"], clock)
        saved = datetime.fromisoformat(got["at"])
        for label, s in got["cues"].items():
            out.set(label, s)
            if out.mode == "frozen":
                out.cues[label] = parse(s).freeze(saved)
        return out


def _written(spark: SparkSession, folder: str) -> list[int]:
    """Batches whose members were written completely, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = []
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if name.startswith("batch-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            done.append(int(name[6:]))
    return sorted(done)
