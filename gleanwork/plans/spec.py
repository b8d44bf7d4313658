"""The query spec: a plain dict in, a checked `Spec` out. Runs on the driver; touches no data.

Tokens carry a sigil: `+x` is all-of, `!x` none-of, a bare `x` any-of. Filter tokens are `t:<timeline>:<time or frame or a..b>`,
`geo:bbox|near|cell:...`, or raw keys; raw keys are all required unless negated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime

from ..functions import keys
from ..functions import time as t

PREDICATES = ("includes", "references", "derived-from", "mentions", "replies-to", "depicts", "authored-by", "member-of")
_INVERSE = frozenset({"included-by", "referenced-by", "derives", "mentioned-by", "replied-to-by", "replied-by", "depicted-by", "depicted-in", "authors", "authored"})
MAX_ID = (1 << 63) - 1


def predicate(name) -> str:
    """A forward predicate's name; inverse spellings and unknown names raise."""
    if name in _INVERSE:
        raise ValueError(f"{name!r} is an inverse: use the forward predicate with dir='in'")
    if name not in PREDICATES:
        raise ValueError(f"unknown predicate {name!r}; there are {', '.join(PREDICATES)}")
    return name


def sigil(token) -> tuple[str, str]:
    text = str(token).strip()
    if text[:1] == "+":
        return "allOf", text[1:].strip()
    if text[:1] == "!":
        return "noneOf", text[1:].strip()
    return "anyOf", text


@dataclass(frozen=True)
class PathEntry:
    type: str
    path: str
    tree: str | None = None
    recursive: bool = False


@dataclass(frozen=True)
class TimeFilter:
    sigil: str
    name: str
    start: object = None
    end: object = None
    frame: str | None = None

    def bounds(self, now: datetime | None = None) -> dict:
        if self.frame:
            a, b = t.frame(self.frame, now)
            return t.query_bounds(a, b)
        return t.query_bounds(self.start, self.end)


@dataclass(frozen=True)
class GeoFilter:
    sigil: str
    kind: str
    args: tuple


@dataclass(frozen=True)
class RelFilter:
    sigil: str
    p: str
    of: tuple[int, ...]
    dir: str


@dataclass(frozen=True)
class Buckets:
    allOf: tuple[str, ...] = ()
    anyOf: tuple[str, ...] = ()
    noneOf: tuple[str, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.allOf or self.anyOf or self.noneOf)


@dataclass(frozen=True)
class Spec:
    paths_in: tuple[PathEntry, ...] = ()
    paths_not: tuple[PathEntry, ...] = ()
    features: Buckets = Buckets()
    raw: Buckets = Buckets()
    times: tuple[TimeFilter, ...] = ()
    geo: tuple[GeoFilter, ...] = ()
    rel: tuple[RelFilter, ...] = ()
    ids: tuple[int, ...] | None = None
    match: object = None
    limit: int | None = None
    offset: int = 0
    sort_by: str | None = None
    desc: bool = False
    ids_only: bool = False
    mode: str = "hybrid"
    options: dict = field(default_factory=dict)

    @property
    def coarse(self) -> bool:
        """Whether it depends on planes that have no membership keys."""
        return bool(self.times or self.geo or self.rel)

    def freeze(self, now: datetime) -> Spec:
        """Named time frames replaced by the days they stand for now."""
        fixed = []
        for f in self.times:
            if f.frame:
                a, b = t.frame(f.frame, now)
                f = TimeFilter(f.sigil, f.name, a.date().isoformat(), b.date().isoformat())
            fixed.append(f)
        return replace(self, times=tuple(fixed))


def _path(token) -> tuple[str, PathEntry]:
    mark, body = sigil(token)
    kind = "context"
    if body.startswith("ctx:"):
        body = body[4:]
    elif body.startswith("dir:"):
        kind, body = "directory", body[4:]
    return mark, PathEntry(kind, body or "/")


def _selector(kind: str, given) -> PathEntry:
    if isinstance(given, dict):
        return PathEntry(kind, given.get("path") or given.get(kind) or "/", given.get("tree") or given.get("treeId"), given.get("recursive") is True)
    return PathEntry(kind, given or "/")


def parse_paths(spec: dict) -> tuple[list[PathEntry], list[PathEntry]]:
    """Entries that widen (any of them) and entries that exclude."""
    into: list[PathEntry] = []
    out: list[PathEntry] = []
    paths = spec.get("paths")
    if isinstance(paths, dict):
        tokens = [*(("in", x) for x in paths.get("in") or []), *(("not", x) for x in paths.get("not") or [])]
    else:
        tokens = [("in", x) for x in ([paths] if isinstance(paths, str) else paths or [])]
    for side, token in tokens:
        if token:
            mark, entry = _path(token)
            (out if side == "not" or mark == "noneOf" else into).append(entry)
    for kind in ("context", "directory"):
        if spec.get(kind) is not None:
            into.append(_selector(kind, spec[kind]))
    return into, out


def parse_features(given) -> Buckets:
    held: dict[str, list[str]] = {"allOf": [], "anyOf": [], "noneOf": []}
    if given is None:
        return Buckets()
    if isinstance(given, dict):
        for bucket in held:
            for k in given.get(bucket) or []:
                if bucket != "noneOf" and str(k).startswith("!"):
                    held["noneOf"].append(str(k)[1:])
                else:
                    held[bucket].append(str(k))
    elif isinstance(given, (list, tuple)):
        for token in given:
            if token:
                mark, body = sigil(token)
                held[mark].append(body)
    else:
        raise ValueError("features are a list of tokens or a dict of allOf, anyOf and noneOf")
    return Buckets(*(tuple(dict.fromkeys(keys.normalize(k) for k in held[b])) for b in ("allOf", "anyOf", "noneOf")))


def _time(mark: str, body: str) -> TimeFilter:
    parts = body.split(":")
    used = 2 if parts[0] == "crud" else 1
    name, rest = ":".join(parts[:used]), ":".join(parts[used:])
    if not name or not rest or (used == 2 and len(parts) < 3):
        raise ValueError(f"malformed time filter t:{body}")
    if rest in t.FRAMES:
        return TimeFilter(mark, name, frame=rest)
    if ".." in rest:
        start, end = (x.strip() for x in rest.split("..", 1))
        f = TimeFilter(mark, name, start or None, end or None)
    else:
        f = TimeFilter(mark, name, rest, rest)
    f.bounds()
    return f


def _geo(mark: str, body: str) -> GeoFilter:
    kind, _, rest = body.partition(":")
    args = [a.strip() for a in rest.split(",") if a.strip()]
    try:
        if kind == "bbox" and len(args) == 4:
            return GeoFilter(mark, kind, tuple(map(float, args)))
        if kind == "near" and len(args) == 3 and (m := re.fullmatch(r"(?i)(\d+(?:\.\d+)?)(km|m)?", args[2])):
            return GeoFilter(mark, kind, (float(args[0]), float(args[1]), float(m[1]) * (1000 if (m[2] or "").lower() == "km" else 1)))
        if kind == "cell" and args and all(a.isdecimal() for a in args):
            return GeoFilter(mark, kind, tuple(map(int, args)))
    except ValueError:
        pass
    raise ValueError(f"malformed place filter geo:{body}")


def parse_filters(given) -> tuple[Buckets, list[TimeFilter], list[GeoFilter]]:
    """Raw keys, time filters and place filters; malformed and unsupported tokens raise here, before anything runs."""
    if isinstance(given, dict):
        if given.get("glob") or given.get("regexp"):
            raise ValueError("glob and regexp filters aren't supported")
        old = given.get("timeline")
        given = [f"t:crud:updated:{x}" for x in (old if isinstance(old, (list, tuple)) else [old] if old else [])]
    need, without, times, places = [], [], [], []
    for token in given or []:
        if not token:
            continue
        mark, body = sigil(token)
        if body.startswith(("g:", "re:")):
            raise ValueError(f"{body.split(':')[0]}: filters aren't supported")
        if body.startswith("t:"):
            times.append(_time(mark, body[2:]))
        elif body.startswith("geo:"):
            places.append(_geo(mark, body[4:]))
        else:
            (without if mark == "noneOf" else need).append(keys.normalize(body))
    return Buckets(tuple(need), (), tuple(without)), times, places


def _id(value) -> int:
    if isinstance(value, str) and re.fullmatch(r"\d+", value.strip()):
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= MAX_ID:
        raise ValueError(f"no document id: {value!r}")
    return value


def parse_rel(given) -> list[RelFilter]:
    out = []
    for entry in [given] if isinstance(given, dict) else given or []:
        of = entry.get("of")
        anchors = tuple(_id(x) for x in (of if isinstance(of, (list, tuple)) else [] if of is None else [of]))
        if not anchors:
            raise ValueError("a relation needs at least one anchor in `of`")
        way, op = entry.get("dir") or "out", entry.get("op") or "anyOf"
        if way not in ("in", "out"):
            raise ValueError(f"dir is 'in' or 'out', not {way!r}")
        if op not in ("allOf", "anyOf", "noneOf"):
            raise ValueError(f"op is allOf, anyOf or noneOf, not {op!r}")
        out.append(RelFilter(op, predicate(entry.get("p")), anchors, way))
    return out


def parse_ids(given) -> tuple[int, ...] | None:
    return None if given is None else tuple(dict.fromkeys(_id(x) for x in given))


def sort_name(given) -> str | None:
    """'content', 't:content' and {'timeline': 'content'} all name a timeline."""
    if isinstance(given, dict):
        given = given.get("timeline")
    if not given:
        return None
    return str(given)[2:] if str(given).startswith("t:") else str(given)


def normalize_match(given):
    """None, a text, or {text, vectors: [{space, vector, weight}]} with at least one leg."""
    if given is None or (isinstance(given, str) and not given.strip()):
        return None
    if isinstance(given, str):
        return {"text": given.strip(), "vectors": []}
    if not isinstance(given, dict):
        raise ValueError("a match is a text or a dict of text and vectors")
    text = given.get("text")
    if text is not None and not isinstance(text, str):
        raise ValueError("match text is a string")
    legs = given.get("vectors") or []
    for leg in legs:
        v = leg.get("vector") if isinstance(leg, dict) else None
        if v is None or not len(v) or not leg.get("space"):
            raise ValueError("a vector leg has a space and a vector")
    if not (text and text.strip()) and not legs:
        raise ValueError("a match needs a text or a vector leg")
    return {"text": (text or "").strip() or None, "vectors": list(legs)}


def parse(spec: dict | Spec | None) -> Spec:
    """The whole spec; options may stand at the top or under `options`, the top wins."""
    if isinstance(spec, Spec):
        return spec
    spec = dict(spec or {})
    o = {**(spec.get("options") or {}), **{k: v for k, v in spec.items() if k != "options"}}
    into, out = parse_paths(spec)
    raw, times, places = parse_filters(spec.get("filters"))
    limit = o.get("limit")
    offset = max(0, int(o.get("offset") or 0))
    if o.get("page"):
        offset = (max(1, int(o["page"])) - 1) * (limit or 100)
    match = next((o[k] for k in ("query", "search", "q", "match") if o.get(k) is not None), None)
    mode = str(o.get("mode") or "hybrid").lower()
    if mode not in ("fts", "vector", "hybrid"):
        raise ValueError(f"mode is fts, vector or hybrid, not {mode!r}")
    return Spec(
        tuple(into), tuple(out), parse_features(spec.get("features")), raw, tuple(times), tuple(places), tuple(parse_rel(spec.get("rel"))), parse_ids(spec.get("ids")),
        normalize_match(match), None if limit is None else max(0, int(limit)), offset, sort_name(o.get("sortBy", o.get("sort_by"))), str(o.get("order", "")).lower() == "desc" or bool(o.get("desc")),
        bool(o.get("idsOnly", o.get("ids_only"))), mode, {k: o[k] for k in ("minDistance", "maxDistance", "space", "debug") if k in o},
    )


def context_for_insert(given) -> list[str]:
    """Paths of a write: one, several, or the root."""
    out = [given] if isinstance(given, str) else list(given or [])
    return [p if str(p).startswith("/") else f"/{p}" for p in out] or ["/"]


def path_layers(path: str) -> list[str]:
    """Layer names on a path, the root first."""
    return ["/", *(p.strip() for p in str(path).split("/") if p.strip())]
