"""Shared scratch folder and small helpers for multi-pass operators."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import filesystem, table  # noqa: F401
from ..session import scratch as fresh_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there and no executor holds it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what materialize wrote for df; nothing lazy may need it any more."""
    fs, where = filesystem(df.sparkSession, df._scratch)
    fs.delete(where, True)
    fs.cancelDeleteOnExit(where)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list:
    """Columns (_id, _tx) that tell documents apart even when ids repeat; rows that agree on both are repeated rows."""
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.lit(7), F.col(text)).alias("_tx")]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _ki and _kt, hashes of id and text that are never null: _kt is the _tx of row_key."""
    return docs.withColumns({"_ki": F.xxhash64(F.lit(3), F.col("doc_id")), "_kt": F.xxhash64(F.lit(7), F.col("text"))})


#: Columns that operators use by name.
_KNOWN = ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic", "item_id", "vec_id", "embedding", "page_id", "url", "html", "path", "span_begin", "span_end", "rule", "is_secret")


def isolated(operator):
    """Wraps an operator so that no other column of a table, whatever its name, meets a name used inside or differs only in case."""

    @functools.wraps(operator)
    def wrapped(*args, **parameters):
        back: dict[str, str] = {}

        def renamed(df):
            if not isinstance(df, DataFrame):
                return df
            names, free = [], set(_KNOWN)
            for k, name in enumerate(df.columns):
                names.append(name if name in free else f"x{len(back)}_{k}")
                free.discard(name)
                back[names[-1]] = name
            return df.toDF(*names)

        out = operator(*map(renamed, args), **{k: renamed(v) for k, v in parameters.items()})
        return out.toDF(*(back.get(c, c) for c in out.columns))

    return wrapped
