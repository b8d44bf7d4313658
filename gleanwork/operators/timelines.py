"""Timelines: positions of documents on named axes, overlap queries, groupings, histograms and sort keys.

A position row is (timeline, doc_id, scale, start_v, end_v, open_start, open_end, is_primary, ref). Every query is a range predicate over
plain integers, one pair of literals for each scale, so Parquet statistics prune it and nothing is tiled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as t

POSITION = "timeline string, doc_id bigint, scale string, start_v bigint, end_v bigint, open_start boolean, open_end boolean, is_primary boolean, ref string"


def positions(df: DataFrame, timeline: str, scale: str, start: Column, end: Column | None = None, doc_id: str = "doc_id", open_start: Column | None = None, open_end: Column | None = None, primary: Column | None = None, ref: Column | None = None) -> DataFrame:
    """Position rows from columns that hold values of one scale; rows without a start (unless open) are left out."""
    flag = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    a, b = flag(open_start), flag(open_end)
    first = F.when(a, F.lit(t.LOWEST)).otherwise(start.cast("bigint"))
    last = F.when(b, F.lit(t.HIGHEST)).otherwise((start if end is None else end).cast("bigint"))
    out = df.select(
        F.lit(timeline.lower()).alias("timeline"), F.col(doc_id).cast("bigint").alias("doc_id"), F.lit(t.scale_of(scale)).alias("scale"), first.alias("start_v"), last.alias("end_v"),
        a.alias("open_start"), b.alias("open_end"), (F.lit(True) if primary is None else primary).alias("is_primary"), (F.lit(None) if ref is None else ref).cast("string").alias("ref"),
    )
    return out.filter(F.col("start_v").isNotNull() & F.col("end_v").isNotNull() & (F.col("start_v") <= F.col("end_v")))


#: Endpoints that are read in the JVM: scale and form. Anything else, and what isn't valid here, goes through `time.interval`.
_FORMS = (
    ("year", r"^[1-9][0-9]{3}$"), ("month", r"^[1-9][0-9]{3}-(?:0[1-9]|1[0-2])$"), ("day", r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}$"),
    ("second", r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"), ("ms", r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{1,6}Z$"),
)


def _once(c: Column, use) -> Column:
    """use(c) with c worked out once for each row, however often use refers to it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _point(text: Column) -> Column:
    """struct<scale, value> of an endpoint in one of the common forms; null otherwise, with a null value where there is no such day or time."""
    year = F.substring(text, 1, 4).cast("bigint") - 1970
    micros = F.unix_micros(F.try_to_timestamp(text))
    values = {"year": year, "month": year * 12 + F.substring(text, 6, 2).cast("bigint") - 1, "day": F.unix_date(F.try_to_date(text)), "second": F.floor(micros / 1_000_000), "ms": F.floor(micros / 1000)}
    out = F.when(F.lit(False), F.lit(None).cast("struct<scale:string,value:bigint>"))
    for scale, form in _FORMS:
        out = out.when(text.rlike(form), F.struct(F.lit(scale).alias("scale"), values[scale].cast("bigint").alias("value")))
    return out


def from_entries(entries: DataFrame) -> DataFrame:
    """Position rows from (doc_id, pos, name, scale, start, end, end_given, is_primary, ref) as documents carry them.

    Endpoints are parsed by the rules of `time.interval`; entries that break them go. One entry of each document and timeline is
    the primary one: the first marked as such, else the first. ISO dates and times, years and months without a scale of their own are
    read in the JVM, other notations in Python by Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    scaled = (lambda v, s=r["scale"]: {"scale": s, "value": v}) if r["scale"] else (lambda v: v)
                    start = r["start"] if r["start"] is None else scaled(r["start"])
                    i = t.interval(start, (r["end"] if r["end"] is None else scaled(r["end"])) if r["end_given"] else t.ABSENT)
                except ValueError:
                    continue
                if max(-i.start, i.end) > t.HIGHEST + 1:
                    continue
                scale, a, z = i.scale, i.start, i.end
                rows.append((r["name"].lower(), r["doc_id"], scale, a, z, i.open_start, i.open_end, bool(r["is_primary"]), r["ref"], r["pos"]))
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.int32()]
            names = ["timeline", "doc_id", "scale", "start_v", "end_v", "open_start", "open_end", "is_primary", "ref", "pos"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    rows = entries.filter(F.col("name").isNotNull()).select("doc_id", F.col("pos").cast("int").alias("pos"), "name", "scale", "start", "end", F.coalesce("end_given", F.lit(False)).alias("end_given"), "is_primary", "ref")
    # struct<scale, a, z> of what can be read here
    span = lambda p, q: F.struct(p["scale"].alias("scale"), p["value"].alias("a"), F.when(~F.col("end_given"), p["value"]).when(F.col("end").isNull(), F.lit(t.HIGHEST)).when(q["scale"] == p["scale"], q["value"]).alias("z"))
    read = _once(F.when(F.coalesce("scale", F.lit("")) == "", _point(F.col("start"))), lambda p: _once(_point(F.col("end")), lambda q: span(p, q)))
    rows = rows.withColumn("_r", read)
    plain = F.col("_r.a").isNotNull() & F.col("_r.z").isNotNull()
    here = rows.filter(plain & (F.col("_r.a") <= F.col("_r.z"))).select(
        F.lower("name").alias("timeline"), "doc_id", F.col("_r.scale").alias("scale"), F.col("_r.a").alias("start_v"), F.col("_r.z").alias("end_v"), F.lit(False).alias("open_start"),
        (F.col("end_given") & F.col("end").isNull()).alias("open_end"), F.coalesce("is_primary", F.lit(False)).alias("is_primary"), "ref", "pos",
    )
    parsed = here.unionByName(rows.filter(~plain).drop("_r").mapInArrow(run, POSITION + ", pos int"))
    first = F.row_number().over(Window.partitionBy("doc_id", "timeline").orderBy(F.col("is_primary").desc(), "pos"))
    return parsed.withColumn("is_primary", first == 1).drop("pos")


def as_points(pos: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Positions of which some timelines keep the start only; what is open at its start has none and goes."""
    if not names:
        return pos
    point = F.col("timeline").isin(*(n.lower() for n in names))
    out = pos.filter(~(point & F.col("open_start")))
    return out.withColumns({"end_v": F.when(point, F.col("start_v")).otherwise(F.col("end_v")), "open_end": ~point & F.col("open_end")}).select(*pos.columns)


def on(names: str | list[str]) -> Column:
    """Rows of a timeline, of several, or of all ('*' or 'all')."""
    if names in ("*", "all"):
        return F.lit(True)
    return F.col("timeline").isin(*(n.lower() for n in ([names] if isinstance(names, str) else names)))


def overlaps(bounds: dict[str, tuple[int | None, int | None]], scales: list[str] | None = None) -> Column:
    """Rows whose interval meets a query range, given its bounds at every scale."""
    parts = []
    for s, (low, high) in bounds.items():
        if scales is None or s in scales:
            c = F.col("scale") == s
            if high is not None:
                c = c & (F.col("start_v") <= F.lit(high))
            if low is not None:
                c = c & (F.col("end_v") >= F.lit(low))
            parts.append(c)
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def query(pos: DataFrame, names, start, end=t.ABSENT, mode: str = "union", scales: list[str] | None = None) -> DataFrame:
    """Documents whose positions meet a range.

    mode 'union': doc_id; 'grouped': timeline and doc_id; 'layers': timeline, layer (a primary position's scale, or 'multi') and
    doc_id. Each row once; a group is as many rows as it has documents, never one row."""
    hits = pos.filter(on(names) & overlaps(t.query_bounds(start, end), [t.scale_of(s) for s in scales] if scales else None))
    layer = F.when(F.col("is_primary"), F.col("scale")).otherwise(F.lit("multi")).alias("layer")
    columns = {"union": ("doc_id",), "grouped": ("timeline", "doc_id"), "layers": ("timeline", layer, "doc_id")}
    if mode not in columns:
        raise ValueError(f"mode is union, grouped or layers, not {mode!r}")
    return hits.select(*columns[mode]).distinct()


def _meeting(rows: DataFrame, bounds: list[tuple[int, str, int | None, int | None]]) -> DataFrame:
    """rows with the number of each range (number, scale, low, high) that they meet, once for each."""
    grid = rows.sparkSession.createDataFrame(bounds, "bucket int, scale string, low bigint, high bigint")
    return rows.join(grid, "scale").filter((F.col("high").isNull() | (F.col("start_v") <= F.col("high"))) & (F.col("low").isNull() | (F.col("end_v") >= F.col("low"))))


def query_each(pos: DataFrame, names, ranges: list) -> DataFrame:
    """bucket (a range's number) and doc_id of the documents that meet each of several ranges, each range as `query` has it. One pass and one aggregate for
    all: a union of as many queries holds an aggregate for each in every task."""
    limits = [t.query_bounds(*(r if isinstance(r, (tuple, list)) else (r, t.ABSENT))) for r in ranges]
    bounds = [(k, s, low, high) for k, by in enumerate(limits) for s, (low, high) in by.items()]
    hull: dict[str, tuple[int | None, int | None]] = {}
    for s in {s for by in limits for s in by}:
        lows, highs = zip(*(by[s] for by in limits if s in by), strict=True)
        hull[s] = (None if None in lows else min(lows), None if None in highs else max(highs))
    return _meeting(pos.filter(on(names) & overlaps(hull)), bounds).select("bucket", "doc_id").distinct()


def histogram(pos: DataFrame, names, buckets: list[tuple], within: DataFrame | None = None) -> DataFrame:
    """bucket (its number), timeline and n: documents that meet each bucket, each once a timeline; counts of 0 aren't listed.

    Malformed buckets count nothing. The buckets are literals, so each row is tested where it is read and only pairs that meet are counted."""
    spark = pos.sparkSession
    rows = pos.filter(on(names))
    if within is not None:
        rows = rows.join(within.select("doc_id"), "doc_id", "left_semi")
    bounds = []
    for k, b in enumerate(buckets):
        try:
            start, end = b if isinstance(b, (tuple, list)) else (b, t.ABSENT)
            bounds += [(k, s, low, high) for s, (low, high) in t.query_bounds(start, end).items()]
        except ValueError:
            continue
    if not bounds:
        return spark.createDataFrame([], "bucket int, timeline string, n bigint")
    # each document once a bucket and timeline, then a plain count: both combine before they shuffle
    return _meeting(rows, bounds).select("bucket", "timeline", "doc_id").distinct().groupBy("bucket", "timeline").agg(F.count("*").alias("n"))


def histogram_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("bucket").agg(F.sum("n").alias("total"))


def count(pos: DataFrame, name: str) -> DataFrame:
    return pos.filter(on(name)).agg(F.countDistinct("doc_id").alias("n"))


def scales(pos: DataFrame, name: str) -> DataFrame:
    return pos.filter(on(name)).select("scale").distinct()


def names(pos: DataFrame) -> DataFrame:
    return pos.select("timeline").distinct()


def open_extent(pos: DataFrame) -> DataFrame:
    """For each document, timeline, scale and open side: the earliest start of its ongoing positions, the latest end of those since forever."""
    side = F.when(F.col("open_end"), F.lit("end")).when(F.col("open_start"), F.lit("start"))
    return pos.withColumn("side", side).filter(F.col("side").isNotNull()).groupBy("doc_id", "timeline", "scale", "side").agg(F.min(F.when(F.col("open_end"), F.col("start_v"))).alias("start_v"), F.max(F.when(F.col("open_start"), F.col("end_v"))).alias("end_v"))


def counts(pos: DataFrame) -> DataFrame:
    """timeline and n of every timeline."""
    return pos.groupBy("timeline").agg(F.countDistinct("doc_id").alias("n"))


def values(pos: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """doc_id, scale, start_v and end_v of the positions that some documents have on a timeline."""
    return pos.filter(on(name)).join(ids.select("doc_id"), "doc_id", "left_semi").select("doc_id", "scale", "start_v", "end_v")


def clear_values(rows: DataFrame, column: str, doc_ids: DataFrame) -> DataFrame:
    """rows whose value in a column is taken from some documents; without one they match no comparison."""
    gone = doc_ids.select("doc_id").distinct().withColumn("_gone", F.lit(True))
    return rows.join(gone, "doc_id", "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*rows.columns)


def remove(pos: DataFrame, doc_ids: DataFrame, name: str | None = None) -> DataFrame:
    """Positions without those of some documents, on one timeline or on all."""
    gone = doc_ids.select("doc_id")
    if name is None:
        return pos.join(gone, "doc_id", "left_anti")
    return pos.join(gone.withColumn("timeline", F.lit(name.lower())), ["doc_id", "timeline"], "left_anti")


def drop(pos: DataFrame, name: str) -> DataFrame:
    return pos.filter(~on(name))


def sort_keys(pos: DataFrame, name: str) -> DataFrame:
    """doc_id and sort_key (milliseconds, DECIMAL) of the primary position; of several scales the finest counts."""
    rank = F.coalesce(F.element_at(F.create_map(*(x for s, k in t.ORDER.items() for x in (F.lit(s), F.lit(k)))), F.col("scale")), F.lit(-1))
    rows = pos.filter(on(name) & F.col("is_primary")).select("doc_id", t.sort_key_column(F.col("scale"), F.col("start_v")).alias("sort_key"), rank.alias("fine"))
    return rows.groupBy("doc_id").agg(F.max_by("sort_key", F.struct("fine", "sort_key")).alias("sort_key"))


def ordered(ids: DataFrame, pos: DataFrame, name: str, desc: bool = False) -> DataFrame:
    """ids with sort_key, in its order; documents without a value trail, and desc turns both parts round."""
    rows = ids.join(sort_keys(pos, name), "doc_id", "left")
    tail = F.col("sort_key").isNull()
    return rows.orderBy(tail, F.col("sort_key").desc(), F.col("doc_id").desc()) if desc else rows.orderBy(tail, F.col("sort_key"), "doc_id")


def compare(values: DataFrame, column: str, op: str, *operands) -> DataFrame:
    """Rows whose value satisfies =, !=, >, >=, <, <= or between; rows without a value never do."""
    c = F.col(column)
    if op == "between":
        return values.filter(c.between(*operands))
    return values.filter({"=": c == operands[0], "!=": c != operands[0], ">": c > operands[0], ">=": c >= operands[0], "<": c < operands[0], "<=": c <= operands[0]}[op])
