"""Files as documents, and documents as files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.derive import DOCS

#: By extension; anything else is application/octet-stream.
TYPES = {
    "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "css": "text/css", "csv": "text/csv", "js": "text/javascript", "json": "application/json", "xml": "application/xml",
    "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
    "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "mov": "video/quicktime", "eml": "message/rfc822", "parquet": "application/vnd.apache.parquet", "py": "text/x-python",
}


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * and ? don't; a pattern without a slash names a segment anywhere."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if pattern.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "{" and "}" in pattern[k:]:
            end = pattern.index("}", k)
            out, k = out + "(?:" + "|".join(re.escape(x) for x in pattern[k + 1 : end].split(",")) + ")", end + 1
            continue
        out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
    return f"^{out}$" if "/" in pattern else f"(?:^|/){out}(?:/|$)"


def scan(spark: SparkSession, root: str, device: str = "local", exclude: tuple[str, ...] = (".git", "node_modules", "*.tmp")) -> DataFrame:
    """A document row (and pos) for each file below root: content hashes, media type and a file:// location on the device.

    The name is filtered where files are listed; contents are hashed where they are read and not kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    local = F.regexp_replace("path", r"^[a-z0-9+.\-]+:/*", "/")
    rel = F.regexp_replace(local, "^" + re.escape(re.sub(r"^[a-z0-9+.\-]+:/*", "/", base)) + "/?", "")
    rows = files.withColumn("_rel", rel)
    for p in exclude:
        rows = rows.filter(~F.col("_rel").rlike(glob_regex(p)))
    name = F.element_at(F.split("_rel", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    types = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    null = lambda t: F.lit(None).cast(t)
    meta = F.struct(F.coalesce(F.element_at(types, ext), F.lit("application/octet-stream")).alias("contentType"), name.alias("filename"), null("string").alias("summary"), null("struct<lat:double,lon:double>").alias("geo"))
    where = F.array(F.struct(F.concat(F.lit(f"file://{device}"), local).alias("url"), null("map<string,string>").alias("metadata")))
    data = F.to_json(F.struct(name.alias("name"), F.col("length").alias("size")))
    sums = F.array(F.concat(F.lit("sha1/"), F.sha1("content")), F.concat(F.lit("sha256/"), F.sha2("content", 256)))
    made = {"schema": F.lit("data/schema/file"), "data": data, "locations": where, "metadata": meta, "checksums": sums, "updated_at": F.col("modificationTime")}
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], DOCS).schema}
    return rows.select(*((made[c] if c in made else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()), F.col("_rel").alias("pos"))


def dump_documents(docs: DataFrame, ids: DataFrame, path: str) -> None:
    """A selection as JSON lines."""
    docs.join(ids.select("doc_id"), "doc_id", "left_semi").write.json(path)


def dump_keys(membership: DataFrame, names: list[str] | None, path: str) -> None:
    """key and doc_id of the named keys, or of all, as JSON lines, one for each member; files hold whole ranges of keys."""
    rows = membership.filter(F.col("key").isin(*names)) if names else membership
    rows.select("key", "doc_id").distinct().repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").write.json(path)
