"""The schema registry: which fields of a document's data are text, identity, facet or subtype, and how versions merge.

Ids are paths below data/schema/; every prefix of an id is a membership key. Core schemas are sealed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

DOCUMENT = "data/schema/document"


@dataclass(frozen=True)
class Schema:
    id: str
    tier: str = "app"
    fields: tuple[tuple[str, str], ...] = ()  # name, Spark type; open records have none
    required: tuple[str, ...] = ()
    fts: tuple[str, ...] = ()
    checksum: tuple[str, ...] = ()
    facets: tuple[str, ...] = ()
    subtype: str | None = None
    merge: tuple[str, ...] = ()  # map fields that merge on dedup instead of being replaced
    supplied_checksum: bool = False
    embed: tuple[str, ...] = ()  # fields for an embedder; those of the text index where none are named

    def struct(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in self.fields)


def _core() -> list[Schema]:
    s = "string"
    person = "struct<address:string,name:string>"
    return [
        Schema(DOCUMENT, "core", (), (), ("data",), ("data",)),
        Schema("data/schema/file", "core", (), (), ("locationUrls", "metadata.filename"), (), supplied_checksum=True),
        Schema("data/schema/message", "core", (("text", s), ("sender", "struct<id:string,name:string,displayName:string,username:string>"), ("channel", "struct<id:string,name:string,type:string>"), ("platform", s), ("timestamp", s), ("threadId", s)), ("text",), ("data.text", "data.sender.name", "data.sender.displayName", "data.channel.name"), ("data.text", "data.sender.id", "data.channel.id", "data.timestamp", "data.platform")),
        Schema("data/schema/message/email", "core", (("subject", s), ("body", s), ("from", person), ("to", f"array<{person}>"), ("cc", f"array<{person}>"), ("bcc", f"array<{person}>"), ("date", s), ("messageId", s), ("references", "array<string>")), ("subject",), ("data.subject", "data.body", "data.from.address", "data.from", "data.to"), ("data.messageId", "data.from.address", "data.subject")),
        Schema("data/schema/event", "core", (("title", s), ("type", s), ("start", s), ("end", s), ("allDay", "boolean"), ("location", s), ("recurrence", s)), ("title", "start"), ("data.title", "data.description", "data.location"), ("data.title", "data.start", "data.type"), subtype="data.type"),
        Schema("data/schema/task", "core", (("title", s), ("description", s), ("status", s), ("completed", "boolean"), ("dueDate", s), ("priority", "int")), ("title",), ("data.title", "data.description"), ("data.title", "data.description", "data.dueDate"), ("data.status",)),
        Schema("data/schema/identity", "core", (("displayName", s), ("type", s), ("identifiers", "array<struct<type:string,value:string,primary:boolean>>"), ("channels", "array<struct<type:string,value:string,primary:boolean>>"), ("links", "array<string>")), ("displayName",), ("data.displayName", "data.primaryEmail", "data.identifiers", "data.channels", "data.links"), ("data.displayName", "data.identifiers", "data.channels"), subtype="data.type"),
        Schema("data/schema/device", "core", (("deviceId", s), ("name", s), ("platform", s), ("arch", s), ("type", s)), ("deviceId",), ("data.name", "data.deviceId", "data.alias", "data.hostname", "data.description"), ("data.deviceId",)),
        Schema("data/schema/application", "core", (("appId", s), ("name", s), ("type", s), ("installs", "map<string,struct<status:string,path:string>>")), ("appId",), ("data.name", "data.appId", "data.type", "data.description", "data.urls"), ("data.appId",), subtype="data.type", merge=("installs",)),
        Schema("data/schema/note", "app", (("title", s), ("content", s)), ("content",), ("data.title", "data.content"), ("data.title", "data.content")),
        Schema("data/schema/tab", "app", (("url", s), ("title", s)), ("url",), ("data.title", "data.url"), ("data.url",)),
        Schema("data/schema/link", "app", (("uri", s), ("label", s), ("tags", "array<string>"), ("properties", "map<string,string>")), ("uri",), ("data.label", "data.description", "data.uri"), ("data.uri",)),
        Schema("data/schema/dotfile", "app", (("url", s), ("type", s), ("links", "map<string,string>")), ("url",), ("data.urls", "data.url", "data.description"), ("data.url",), subtype="data.type", merge=("links",)),
        *(Schema(f"internal/layers/{x}", "internal") for x in ("view", "context", "label", "system", "universe", "workspace", "project")),
    ]


class Registry:
    def __init__(self):
        self._held = {s.id: s for s in _core()}

    def register(self, schema: Schema) -> Schema:
        have = self._held.get(schema.id)
        if have and have.tier == "core":
            raise ValueError(f"{schema.id} is sealed")
        if schema.tier == "core" or not schema.id.startswith(("data/schema/", "internal/")):
            raise ValueError("registered schemas are app or internal ones below data/schema/ or internal/")
        self._held[schema.id] = schema
        return schema

    def unregister(self, id: str) -> None:
        if self.get(id).tier == "core":
            raise ValueError(f"{id} is sealed")
        del self._held[id]

    def get(self, id: str) -> Schema:
        if id not in self._held:
            raise KeyError(f"no schema {id}")
        return self._held[id]

    def has(self, id: str) -> bool:
        return id in self._held

    def listing(self, prefix: str = "") -> list[str]:
        return sorted(x for x in self._held if x.startswith(prefix))

    def resolve(self, key: str) -> Schema | None:
        """The nearest registered schema at or above a key."""
        parts = key.split("/")
        return next((self._held[x] for n in range(len(parts), 0, -1) if (x := "/".join(parts[:n])) in self._held), None)

    def extend(self, id: str, fields: tuple[tuple[str, str], ...]) -> Schema:
        """An app schema with more fields."""
        s = self.get(id)
        known = dict(s.fields)
        return self.register(replace(s, fields=tuple({**known, **dict(fields)}.items())))

    def describe(self, id: str) -> dict:
        """A schema's descriptor: tier, fields, required ones and what is indexed of it."""
        s = self.get(id)
        return {"id": s.id, "tier": s.tier, "fields": dict(s.fields), "required": list(s.required), "index": {"fts": list(s.fts), "checksum": list(s.checksum), "embed": list(s.embed or s.fts)}, "facets": list(s.facets), "subtype": s.subtype}

    def all(self) -> list[Schema]:
        return list(self._held.values())


REGISTRY = Registry()

#: Ids of earlier versions.
RENAMED = {"data/abstraction/" + x: "data/schema/" + x for x in ("document", "file", "note", "tab", "link", "task", "event", "device", "dotfile", "identity", "application")} | {
    "data/abstraction/email": "data/schema/message/email", "data/abstraction/message": "data/schema/message", "data/abstraction/todo": "data/schema/task", "data/abstraction/contact": "data/schema/identity",
}
