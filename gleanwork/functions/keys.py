"""Membership keys: normal form, validity, and the keys that follow from a document's fields.

A key is a lower-case path such as `tag/lang/en`. Everything here exists twice where both are needed: on the driver for the
literals of a query, and as Column expressions for data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES = ("internal/", "context/", "vfs/", "feature/", "device/", "client/", "tag/", "data/", "custom/")
DATASET = "data/dataset/"
DEFAULT_DATASET = DATASET + "default"
SCHEMA = "data/schema/"
COMMENT = "feature/has-comment"
NO_LOCATION = "data/no-location"
#: Facet namespaces that no schema may claim.
RESERVED_FACETS = frozenset({"abstraction", "schema", "kind", "mime", "backend", "source", "dataset", "no-location"})
#: Keys that only derivation may set; asserted features with these prefixes are ignored.
DERIVED_PREFIXES = ("data/mime/", "data/backend/", "device/id/", "device/os/", "device/type/", "data/schema/", "feature/has-comment", "internal/")
RETIRED_PREFIXES = ("data/kind/", "data/abstraction/", "data/source/")


def normalize(key: str) -> str:
    """The normal form of a literal key; a leading `!` stays."""
    key = str(key).strip()
    bang, body = ("!", key[1:]) if key.startswith("!") else ("", key)
    body = re.sub(r"\s+", "_", body.replace("\\", "/")).lower()
    body = re.sub(r"[^a-z0-9_\-./:@+]", "_", body)
    return bang + re.sub(r"/+", "/", re.sub(r"_+", "_", body))


def normalized(key: Column) -> Column:
    """The normal form of a key column."""
    c = F.lower(F.regexp_replace(F.translate(F.trim(key), "\\", "/"), r"\s+", "_"))
    c = F.regexp_replace(c, r"[^a-z0-9_\-./:@+]", "_")
    return F.regexp_replace(F.regexp_replace(c, "_+", "_"), "/+", "/")


def valid(key: str) -> bool:
    body = key[1:] if key.startswith("!") else key
    return body.startswith(PREFIXES) and not body.endswith("/")


def make(key: str) -> str:
    """The normal form of a key that has to be valid."""
    out = normalize(key)
    if not valid(out):
        raise ValueError(f"key {key!r} needs one of the prefixes {', '.join(PREFIXES)}")
    return out


def is_valid(key: Column) -> Column:
    return key.rlike("^(?:" + "|".join(PREFIXES) + ")") & ~key.endswith("/")


def prefixes(path: Column, base: str) -> Column:
    """Every path prefix from below base on: data/schema/a/b gives data/schema/a and data/schema/a/b."""
    parts = F.split(path, "/")
    skip = base.rstrip("/").count("/") + 1
    n = F.size(parts)
    return F.when(path.startswith(base) & (n > skip), F.transform(F.sequence(F.lit(skip + 1), F.greatest(n, F.lit(skip + 1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array(path))


def schema_keys(schema: Column, subtype: Column | None = None) -> Column:
    """The roll-up keys of a schema id, and of its subtype unless that holds a slash."""
    keys = prefixes(schema, SCHEMA)
    if subtype is not None:
        ok = subtype.isNotNull() & (F.trim(subtype) != "") & ~subtype.contains("/")
        keys = F.when(ok, F.concat(keys, F.array(F.concat(schema, F.lit("/"), F.trim(subtype))))).otherwise(keys)
    return F.transform(F.when(schema.isNull() | (schema == ""), F.array().cast("array<string>")).otherwise(keys), normalized)


def mime_keys(content_type: Column) -> Column:
    """data/mime/<type> and data/mime/<type>/<subtype>; nothing for the JSON default or a malformed type."""
    clean = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    ok = clean.rlike("^[^/]+/.+$") & (clean != "application/json")
    both = F.array(F.concat(F.lit("data/mime/"), F.split_part(clean, F.lit("/"), F.lit(1))), F.concat(F.lit("data/mime/"), clean))
    return F.transform(F.when(ok, both).otherwise(F.array().cast("array<string>")), normalized)


def facet_key(field: str, value: Column) -> Column | None:
    """data/<leaf>/<value> for a declared facet field; None where the namespace belongs to the engine."""
    leaf = field.rsplit(".", 1)[-1]
    if not leaf or leaf in RESERVED_FACETS:
        return None
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v != "", normalized(F.concat(F.lit(f"data/{leaf}/"), v)))


def asserted(features: Column, previous: Column | None = None) -> Column:
    """Features a client may assert, first occurrence first; dataset stamps of the previous version are carried over."""
    banned = [*DERIVED_PREFIXES, *RETIRED_PREFIXES]
    ok = lambda k: k.isNotNull() & (k != "") & ~_starts_any(k, banned)
    out = F.filter(F.coalesce(features, F.array().cast("array<string>")), ok)
    if previous is not None:
        out = F.concat(out, F.filter(F.coalesce(previous, F.array().cast("array<string>")), lambda k: k.startswith(DATASET)))
    return F.array_distinct(out)


def _starts_any(c: Column, options) -> Column:
    out = F.lit(False)
    for p in options:
        out = out | c.startswith(p)
    return out
