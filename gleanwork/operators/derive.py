"""Everything that follows from a document's row: membership keys, checksums, index text, positions, places and edges.

Each derivation is one transformation of docs, so rebuilding a plane is running it again. docs has the columns doc_id, schema, data (JSON
text), comment, features, locations, timelines, metadata, checksums and timestamps; all but doc_id and schema may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, recurrence, urls
from ..schemas import REGISTRY, Registry
from . import edges, geo, timelines

DOCS = (
    "doc_id bigint, schema string, data string, comment string, features array<string>, locations array<struct<url:string,metadata:map<string,string>>>, "
    "timelines array<struct<name:string,scale:string,start:string,end:string,end_given:boolean,is_primary:boolean,ref:string>>, "
    "metadata struct<contentType:string,filename:string,summary:string,geo:struct<lat:double,lon:double>>, checksums array<string>, "
    "created_at timestamp, updated_at timestamp, orphaned_at timestamp"
)


def _empty() -> Column:
    return F.array().cast("array<string>")


def nested(path: str) -> Column:
    """A field by its dotted path: data.a.b from the JSON, anything else from the row."""
    if path == "data":
        return F.col("data")
    if path.startswith("data."):
        return F.get_json_object("data", "$." + path[5:])
    if path == "locationUrls":
        return F.array_join(F.transform("locations", lambda x: x["url"]), " ")
    return F.col(path)


def _by_schema(registry: Registry, value, default: Column) -> Column:
    """A CASE over the schemas for which value(schema) is given; sub-schemas inherit from the nearest registered id."""
    out = None
    for s in sorted(registry.all(), key=lambda s: -len(s.id)):
        v = value(s)
        if v is not None:
            hit = (F.col("schema") == s.id) | F.col("schema").startswith(s.id + "/")
            out = F.when(hit, v) if out is None else out.when(hit, v)
    return default if out is None else out.otherwise(default)


#: What schemas add besides their declared fields: feature keys (array<string>) and location urls (array<string>), as functions of the row.
FEATURES: dict = {
    "data/schema/message/email": lambda: email_features(
        nested("data.folder.path"), F.coalesce(F.from_json(nested("data.attachments"), "array<string>"), _empty()), nested("data.isFlagged").cast("boolean"), F.from_json(nested("data.platformMetadata.flags"), "array<string>")
    )
}
LOCATIONS: dict = {
    "data/schema/application": lambda: install_locations(F.from_json(nested("data.installs"), "map<string,struct<status:string,path:string>>"), nested("data.sourceUrl")),
    "data/schema/dotfile": lambda: dotfile_locations(F.from_json(nested("data.links"), "map<string,string>")),
}


def _hooked(hooks: dict, default: Column) -> Column:
    """A hook of the row's schema or of the nearest one above it."""
    out = F.when(F.lit(False), default)
    for id in sorted(hooks, key=len, reverse=True):
        out = out.when((F.col("schema") == id) | F.col("schema").startswith(id + "/"), hooks[id]())
    return F.coalesce(out, default)


def all_locations() -> Column:
    """A row's locations and those its schema derives."""
    kind = "array<struct<url:string,metadata:map<string,string>>>"
    urls_ = F.filter(_hooked(LOCATIONS, _empty()), lambda u: u.isNotNull())
    more = F.transform(urls_, lambda u: F.struct(u.alias("url"), F.lit(None).cast("map<string,string>").alias("metadata")))
    return F.concat(F.coalesce("locations", F.array().cast(kind)), more)


def membership(docs: DataFrame, devices: DataFrame | None = None, registry: Registry = REGISTRY) -> DataFrame:
    """membership(key, doc_id): asserted features and every key that a row implies. devices (device, os, type) adds their facets."""
    subtype = _by_schema(registry, lambda s: nested(s.subtype) if s.subtype else None, F.lit(None).cast("string"))
    facets = _by_schema(registry, lambda s: F.array_compact(F.array(*(k for f in s.facets if (k := keys.facet_key(f, nested(f))) is not None))) if s.facets else None, _empty())
    given = F.transform(keys.asserted(F.col("features")), keys.normalized)
    comment = F.when(F.length(F.trim("comment")) > 0, F.array(F.lit(keys.COMMENT))).otherwise(_empty())
    own = [given, keys.schema_keys(F.col("schema"), subtype), facets, keys.mime_keys(F.col("metadata.contentType")), urls.backend_keys(F.col("_at")), comment, F.transform(_hooked(FEATURES, _empty()), keys.normalized)]
    docs = docs.withColumn("_at", all_locations())
    rows = docs.select("doc_id", F.explode(F.array_distinct(F.concat(*(F.coalesce(c, _empty()) for c in own)))).alias("key")).select("key", "doc_id")
    on = docs.select("doc_id", F.explode(urls.device_ids(F.col("_at"))).alias("device"))
    at = on.select(keys.normalized(F.concat(F.lit("device/id/"), "device")).alias("key"), "doc_id")
    out = [rows, at]
    if devices is not None:
        known = devices.select(keys.normalized(F.concat(F.lit("device/id/"), "device")).alias("id"), urls.device_os(F.col("os")).alias("os"), urls.device_type(F.col("type")).alias("type"))
        facts = at.join(known, at["key"] == known["id"]).select("doc_id", F.explode(F.array_compact(F.array(keys.normalized(F.concat(F.lit("device/os/"), "os")), keys.normalized(F.concat(F.lit("device/type/"), "type"))))).alias("key"))
        out.append(facts.select("key", "doc_id"))
    return reduce(DataFrame.unionByName, out).distinct()


def device_facets(docs: DataFrame) -> DataFrame:
    """devices (device, os, type) from the device documents."""
    d = docs.filter(F.col("schema") == "data/schema/device")
    return d.select(nested("data.deviceId").alias("device"), F.coalesce(nested("data.platform"), nested("data.deviceOs"), nested("data.os")).alias("os"), F.coalesce(nested("data.type"), nested("data.deviceType")).alias("type")).filter(F.col("device").isNotNull())


def checksum_source(registry: Registry = REGISTRY) -> Column:
    """The text a document's identity is taken from: its listed fields as JSON, or all of its data without relations."""
    content = F.to_json(F.map_filter(F.from_json("data", "map<string,string>"), lambda k, _: k != "relations"))
    return _by_schema(registry, lambda s: F.concat_ws("", *(F.coalesce(F.to_json(F.struct(nested(f).alias("v"))), F.lit("")) for f in s.checksum)) if s.checksum and s.checksum != ("data",) else None, content)


def checksum_strings(text: Column, algorithms=("sha1", "sha256")) -> Column:
    """algorithm/hex for each algorithm, the first is the primary one."""
    make = {"sha1": F.sha1(text), "sha256": F.sha2(text, 256), "sha512": F.sha2(text, 512), "md5": F.md5(text)}
    return F.array(*(F.concat(F.lit(a + "/"), make[a]) for a in algorithms))


def with_checksums(docs: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """docs whose missing checksums are worked out."""
    return docs.withColumn("checksums", F.coalesce(F.when(F.size("checksums") > 0, F.col("checksums")), checksum_strings(checksum_source(registry))))


def checksums(docs: DataFrame) -> DataFrame:
    """checksum, schema and doc_id; of several documents the latest holds a checksum."""
    rows = docs.select(F.explode("checksums").alias("checksum"), "schema", "doc_id")
    return rows.groupBy("checksum", "schema").agg(F.max("doc_id").alias("doc_id"))


#: Unicode's space separators, which a field's text begins and ends without.
_SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def _trimmed(path: str) -> Column:
    return F.trim(nested(path).cast("string"), F.lit(_SPACES))


def fts_text(docs: DataFrame, registry: Registry = REGISTRY, blank: bool = False) -> DataFrame:
    """doc_id, schema, updated_at and fts_text of documents that have any text. Blank fields are left out, or with blank are empty lines."""
    given = lambda c: c if blank else F.when(~c.isin("", "{}", "[]"), c)
    text = lambda fields: F.concat_ws("\n", *(given(_trimmed(f)) for f in (*fields, "comment", "metadata.summary")))
    rows = docs.select("doc_id", "schema", "updated_at", _by_schema(registry, lambda s: text(s.fts) if s.fts else None, text(())).alias("fts_text"))
    return rows.filter(F.col("fts_text") != "")


def embedding_text(docs: DataFrame, registry: Registry = REGISTRY, blank: bool = False) -> DataFrame:
    """doc_id, schema, field and text: the fields of each document that an embedder is given, one row each; blank ones are left out, or with blank are empty."""
    one = lambda f: F.struct(F.lit(f).alias("field"), _trimmed(f).alias("text"))
    none = F.array().cast("array<struct<field:string,text:string>>")
    fields = _by_schema(registry, lambda s: F.array(*map(one, s.embed or s.fts)) if s.embed or s.fts else None, none)
    rows = docs.select("doc_id", "schema", F.explode(fields).alias("e")).select("doc_id", "schema", "e.field", "e.text")
    return rows.filter(F.col("text").isNotNull() if blank else ~F.col("text").isin("", "{}", "[]"))


def timeline_entries(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, name, scale, start, end, end_given, is_primary, ref): the entries of rows, then due dates of tasks and occurrences of events."""
    listed = docs.select("doc_id", F.posexplode("timelines").alias("pos", "t")).select("doc_id", "pos", "t.*").withColumn("is_primary", F.coalesce("is_primary", F.lit(False))).withColumn("end_given", F.coalesce("end_given", F.col("end").isNotNull()))
    events = docs.filter(F.col("schema").startswith("data/schema/event"))
    listed = listed.join(events.select("doc_id").withColumn("name", F.lit("events")), ["doc_id", "name"], "left_anti").select("doc_id", "pos", "name", "scale", "start", "end", "end_given", "is_primary", "ref")
    blank = lambda df, name: df.select("doc_id", "pos", F.lit(name).alias("name"), F.lit(None).cast("string").alias("scale"), "start", "end", "end_given", F.lit(False).alias("is_primary"), F.lit(None).cast("string").alias("ref"))
    due = docs.filter(F.col("schema").startswith("data/schema/task")).select("doc_id", F.lit(0).alias("pos"), nested("data.dueDate").alias("start"), F.lit(None).cast("string").alias("end"), F.lit(False).alias("end_given")).filter(F.col("start").isNotNull())
    ends = F.array_contains(F.json_object_keys("data"), "end")
    source = events.select("doc_id", nested("data.start").alias("start"), nested("data.end").alias("end"), ends.alias("end_given"), nested("data.recurrence").alias("recurrence"))
    return listed.unionByName(blank(due, "tasks")).unionByName(blank(recurrence.expand_events(source), "events"))


def positions(docs: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """All positions: entries, and the lifecycle timelines crud:created, crud:updated and, from tombstones (doc_id, deleted_at), crud:deleted."""
    from ..functions.time import timestamp_value

    out = timelines.from_entries(timeline_entries(docs))
    for name, col in (("crud:created", "created_at"), ("crud:updated", "updated_at")):
        out = out.unionByName(timelines.positions(docs, name, "second", timestamp_value(F.col(col), "second"), primary=F.lit(True)))
    if deleted is not None:
        out = out.unionByName(timelines.positions(deleted, "crud:deleted", "second", timestamp_value(F.col("deleted_at"), "second"), primary=F.lit(True)))
    return out


def places(docs: DataFrame, cells: bool = True) -> DataFrame:
    return geo.derive(docs, F.col("metadata.geo.lat"), F.col("metadata.geo.lon"), cells=cells)


def relations(docs: DataFrame) -> DataFrame:
    """Edges that documents assert in data.relations."""
    r = F.from_json(F.get_json_object("data", "$.relations"), "array<struct<p:string,to:bigint>>")
    return edges.asserted(docs.select("doc_id", r.alias("relations")).filter(F.col("relations").isNotNull()))


# -- per-schema rules


def task_status(status: Column, completed: Column) -> Column:
    """struct<status, completed>: 'pending' by default, and the two kept in step."""
    s = F.coalesce(F.nullif(F.lower(F.trim(status)), F.lit("")), F.when(completed, F.lit("completed")).otherwise(F.lit("pending")))
    return F.struct(s.alias("status"), (s == "completed").alias("completed"))


def email_features(folder: Column, attachments: Column, flagged: Column, flags: Column) -> Column:
    """Feature keys of an e-mail: sent or received by its folder, with attachment, flagged."""
    sent = F.coalesce(folder, F.lit("")).rlike(r"(?i)(^|[^a-z])sent([^a-z]|$)")
    starred = F.coalesce(flagged, F.lit(False)) | F.coalesce(F.exists(flags, lambda x: F.lower(x).contains("flagged")), F.lit(False))
    return F.array_compact(F.array(F.when(sent, F.lit("feature/email/sent")).otherwise(F.lit("feature/email/received")), F.when(F.size(attachments) > 0, F.lit("feature/email/attachment")), F.when(starred, F.lit("feature/email/flagged"))))


def within_frame(ts: Column, name: str, now: Column) -> Column:
    """Whether an instant is in today, yesterday, thisWeek, thisISOWeek, thisMonth, thisQuarter or thisYear."""
    if name in ("today", "yesterday"):
        return F.to_date(ts) == F.date_sub(F.to_date(now), 0 if name == "today" else 1)
    unit = {"thisWeek": "week", "thisISOWeek": "week", "thisMonth": "month", "thisQuarter": "quarter", "thisYear": "year"}[name]
    return F.date_trunc(unit, ts) == F.date_trunc(unit, now)


def install_locations(installs: Column, source_url: Column | None = None) -> Column:
    """Locations of an application: every device whose install counts as present (a missing status does, 'missing' doesn't), then the source."""
    there = F.map_filter(installs, lambda _, v: F.coalesce(v["status"], F.lit("unknown")) != "missing")
    one = lambda e: F.coalesce(urls.device_file_url(e["key"], e["value"]["path"]), urls.device_url(e["key"]))
    out = F.transform(F.map_entries(there), one)
    if source_url is not None:
        out = F.concat(out, F.filter(F.array(source_url), lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.array_distinct(out)


def dotfile_locations(links: Column) -> Column:
    return F.transform(F.map_entries(links), lambda e: urls.device_file_url(e["key"], urls.home_placeholder(e["value"])))


def merge_maps(stored: Column, incoming: Column) -> Column:
    """Keys of both; an incoming value wins over the stored one."""
    return F.coalesce(F.map_zip_with(stored, incoming, lambda _, a, b: F.coalesce(b, a)), incoming, stored)


def merge_locations(first: Column, more: Column) -> Column:
    """Locations by url, the first of each wins."""
    none = F.array().cast("array<struct<url:string,metadata:map<string,string>>>")
    a, b = F.coalesce(first, none), F.coalesce(more, none)
    return F.aggregate(F.concat(a, b), none, lambda acc, x: F.when(F.exists(acc, lambda y: y["url"] == x["url"]), acc).otherwise(F.concat(acc, F.array(x))))


def set_primary(items: Column, value: Column) -> Column:
    """Identity entries with the one of a value primary and no other."""
    return F.transform(items, lambda x: x.withField("primary", x["value"] == value))


def upsert_entry(items: Column, entry: Column) -> Column:
    """Identity entries with one added, or replaced where type and value agree."""
    rest = F.filter(items, lambda x: ~((x["type"] == entry["type"]) & (x["value"] == entry["value"])))
    return F.concat(rest, F.array(entry))


def link_scheme(uri: Column) -> Column:
    return F.when(uri.contains(":"), F.lower(F.split_part(uri, F.lit(":"), F.lit(1))))


def add_tags(tags: Column, *more: str) -> Column:
    return F.array_union(F.coalesce(tags, _empty()), F.array(*map(F.lit, more)))


def remove_tags(tags: Column, *gone: str) -> Column:
    return F.array_except(F.coalesce(tags, _empty()), F.array(*map(F.lit, gone)))


def renamed_schema(schema: Column) -> Column:
    """A schema id of an earlier version under its present name."""
    from ..schemas import RENAMED

    table = F.create_map(*(F.lit(x) for pair in RENAMED.items() for x in pair))
    return F.coalesce(F.element_at(table, schema), schema)
