"""The queries op1 to op10 over the shared tables, and their SQL where it can express them."""

from __future__ import annotations

from . import decontaminate, findings, langid, linededup, mixing, quality, secrets, simhash, tokens, topk, warc
from .runtime import table


def op1_topk(spark, sf_dir):
    """Every row whose id is divisible by 20 as a query, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.filter("vec_id % 20 = 0"), rows)


def op2_decontaminate(spark, sf_dir):
    return decontaminate.removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_secrets(spark, sf_dir):
    """No table has labelled findings, so those made from a seed stand in for them."""
    return secrets.scan(table(spark, sf_dir, "documents"), findings.table(spark))


def op7_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_decontaminate, op3_language_id, op4_mixing, op5_warc, op6_secrets, op7_quality, op8_line_dedup, op9_simhash_dedup, op10_token_counts)}

ORACLES = {"op1_topk": topk.topk_sql(), "op2_decontaminate": decontaminate.spans_sql(), "op4_mixing": mixing.schedule_sql(), "op5_warc": warc.WARC_SQL, "op8_line_dedup": linededup.dedup_sql()}
