"""Mix sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash. A document's virtual finish time is the running token count
of its source divided by the source's weight; documents are taken in order of that time until the token budget is full.

Running sums are two-level so that no task holds a whole source, however hot: totals per (source, slice of the hash
range), offsets of slices by a window over those few totals, and a running sum inside each slice. The cut at the budget
is found the same way over slices of virtual time. Everything is integer arithmetic, so results don't depend on the plan.

Defined results: text null or blank counts 0 tokens and takes its place in the queue; a null source is a source of its
own; a source without a weight has weight `other`; weights of 0 or less drop a source; repeated rows are separate
entries, whose order among themselves makes no difference; an empty table gives an empty result; other columns pass through
`mix` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import isolated, materialize

#: Production parameters: relative weights; the budget is a share of the corpus's tokens, in thousandths.
WEIGHTS = {"src0": 6, "src1": 3, "src2": 2}
OTHER, BUDGET_PER_MILLE, SEED = 1, 500, "mix-1"
#: Documents a slice holds on average; only the size of tasks depends on it.
SLICE_ROWS = 50_000
#: Sources whose last admitted entries are broadcast, at some 100 bytes each; results don't depend on it.
MOST_SOURCES = 100_000


def n_tokens(text):
    """Tokens for mixing: runs of anything but space, tab and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("bigint")


def shuffle_key(doc_id, seed: str):
    return F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 16)


def _schedule(docs: DataFrame, weights: dict, other: int, per_mille: int, seed: str, budget: int | None, slice_rows: int) -> DataFrame:
    """(doc_id, source, tokens, key, slice, vft, total before it), one row for each document within the budget."""
    lcm = math.lcm(*(w for w in [*weights.values(), other] if w > 0))
    step = F.lit(lcm // other if other > 0 else 0)
    for name, w in weights.items():
        step = F.when(F.col("_w_src") == F.lit(name), F.lit(lcm // w if w > 0 else 0)).otherwise(step)
    rows = docs.select(F.col("doc_id").alias("_w_id"), F.col("source").alias("_w_src"), n_tokens(F.col("text")).alias("_w_n"))
    rows = rows.withColumn("_w_key", shuffle_key(F.col("_w_id"), seed)).withColumn("_w_step", F.coalesce(step, F.lit(lcm // other if other > 0 else 0)).cast("bigint"))
    rows = materialize(rows, "mix-rows")
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("_w_n"), F.lit(0)).alias("t")).first()
    total = budget if budget is not None else facts["t"] * per_mille // 1000
    # slices of the hash range, as leading hex digits: as many as keep a slice near slice_rows
    digits = max(1, math.ceil(math.log(max(1, facts["n"] / slice_rows), 16)))
    rows = rows.filter(F.col("_w_step") > 0).withColumn("_w_slice", F.substring("_w_key", 1, digits))
    by_slice = rows.groupBy("_w_src", "_w_slice").agg(F.sum("_w_n").alias("_w_sum"))
    before = Window.partitionBy("_w_src").orderBy("_w_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_slice.select(F.col("_w_src").alias("_o_src"), F.col("_w_slice").alias("_o_slice"), F.coalesce(F.sum("_w_sum").over(before), F.lit(0)).alias("_o"))
    inner = Window.partitionBy("_w_src", "_w_slice").orderBy("_w_key", "_w_id", "_w_n").rowsBetween(Window.unboundedPreceding, 0)
    timed = rows.withColumn("_w_run", F.sum("_w_n").over(inner))
    timed = timed.join(offsets, timed["_w_src"].eqNullSafe(offsets["_o_src"]) & (timed["_w_slice"] == offsets["_o_slice"]))
    timed = timed.select("_w_id", "_w_src", "_w_n", "_w_key", ((F.col("_w_run") + F.col("_o")) * F.col("_w_step")).alias("_w_vft"))
    timed = materialize(timed, "mix-timed")
    # the budget's cut, over slices of virtual time
    top = timed.agg(F.max("_w_vft").alias("m")).first()["m"] or 0
    width = max(1, -(-(top + 1) // max(1, math.ceil(facts["n"] / slice_rows) * 4)))
    timed = timed.withColumn("_w_part", F.floor(F.col("_w_vft") / F.lit(width)).cast("bigint"))
    sums = timed.groupBy("_w_part").agg(F.sum("_w_n").alias("_p_sum"))
    # one window over few rows: the number of slices, not of documents
    parts = sums.select(F.col("_w_part").alias("_p_part"), F.coalesce(F.sum("_p_sum").over(Window.orderBy("_w_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p_off")).filter(F.col("_p_off") <= total)
    order = Window.partitionBy("_w_part").orderBy("_w_vft", F.col("_w_src").asc_nulls_first(), "_w_key", "_w_id", "_w_n").rowsBetween(Window.unboundedPreceding, 0)
    placed = timed.join(parts, timed["_w_part"] == parts["_p_part"])
    placed = placed.withColumn("_w_cum", F.sum("_w_n").over(order) + F.col("_p_off"))
    return placed.filter(F.col("_w_cum") <= total).select("_w_id", "_w_src", "_w_n", "_w_key", "_w_vft", "_w_cum")


@isolated
def schedule(docs: DataFrame, weights: dict | None = None, other: int = OTHER, per_mille: int = BUDGET_PER_MILLE, seed: str = SEED, budget: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, source, n_tokens, vft (times the weights' least common multiple) and cum_tokens, in the order of the mix."""
    s = _schedule(docs, WEIGHTS if weights is None else weights, other, per_mille, seed, budget, slice_rows)
    s = s.orderBy("_w_vft", F.col("_w_src").asc_nulls_first(), "_w_key", "_w_id", "_w_n")
    return s.select(F.col("_w_id").alias("doc_id"), F.col("_w_src").alias("source"), F.col("_w_n").alias("n_tokens"), F.col("_w_vft").alias("vft"), F.col("_w_cum").alias("cum_tokens"))


@isolated
def mix(docs: DataFrame, weights: dict | None = None, other: int = OTHER, per_mille: int = BUDGET_PER_MILLE, seed: str = SEED, budget: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The documents within the budget, all columns, range-sorted into the order of the mix.

    A source's documents enter in one fixed order, so what the budget admits is a prefix of each source: the key of its last
    admitted entry keeps the rest where it was read. Texts of admitted documents alone move, to meet their entries and for the final
    sort. Repeated rows that straddle the end of a prefix are told apart by counting them.
    """
    weights = WEIGHTS if weights is None else weights
    s = materialize(_schedule(docs, weights, other, per_mille, seed, budget, slice_rows), "mix-kept")
    entry = s.groupBy("_w_id", "_w_src", "_w_n").agg(F.sort_array(F.collect_list(F.struct("_w_vft", "_w_key", "_w_cum"))).alias("_w_slots"))
    d = docs.withColumns({"_w_tn": n_tokens(F.col("text")), "_w_tk": shuffle_key(F.col("doc_id"), seed)})
    last = materialize(s.groupBy(F.col("_w_src").alias("_l_src")).agg(F.max("_w_key").alias("_l_key")), "mix-last")
    if last.count() <= MOST_SOURCES:
        # one short row a source, counted; with more of them the documents behind their source's last entry just move along
        d = d.join(F.broadcast(last), d["source"].eqNullSafe(last["_l_src"]) & (d["_w_tk"] <= last["_l_key"]), "left_semi")
    on = d["doc_id"].eqNullSafe(entry["_w_id"]) & d["source"].eqNullSafe(entry["_w_src"]) & (d["_w_tn"] == entry["_w_n"])
    joined = d.join(entry.hint("shuffle_hash"), on)
    nth = F.row_number().over(Window.partitionBy("_w_id", "_w_src", "_w_n").orderBy(F.xxhash64("text")))
    joined = joined.withColumn("_w_nth", nth).filter(F.col("_w_nth") <= F.size("_w_slots"))
    joined = joined.withColumn("_w_slot", F.element_at("_w_slots", F.col("_w_nth")))
    return joined.orderBy("_w_slot._w_vft", F.col("source").asc_nulls_first(), "_w_slot._w_key", "doc_id", "_w_tn").select(*docs.columns)


def schedule_sql(weights: dict | None = None, other: int = OTHER, per_mille: int = BUDGET_PER_MILLE, seed: str = SEED) -> str:
    weights = WEIGHTS if weights is None else weights
    lcm = math.lcm(*weights.values(), other)
    cases = " ".join(f"WHEN source = '{k}' THEN {lcm // w}" for k, w in weights.items())
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0)::BIGINT AS n_tokens,
         substring(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 16) AS k,
         (CASE {cases} ELSE {lcm // other} END)::BIGINT AS step
  FROM documents),
t AS (SELECT *, (sum(n_tokens) OVER (PARTITION BY source ORDER BY k, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) * step)::BIGINT AS vft FROM d),
c AS (SELECT *, (sum(n_tokens) OVER (ORDER BY vft, source NULLS FIRST, k, doc_id, n_tokens ROWS UNBOUNDED PRECEDING))::BIGINT AS cum_tokens FROM t)
SELECT doc_id, source, n_tokens, vft, cum_tokens FROM c
WHERE cum_tokens <= (SELECT sum(n_tokens)::BIGINT * {per_mille} // 1000 FROM d)"""
