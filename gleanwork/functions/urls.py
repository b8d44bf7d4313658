"""Location URLs: `scheme://authority/key?query`, where an authority may hold `:`, `@` and `{PLACEHOLDERS}`."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import normalized

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"


class Location(NamedTuple):
    scheme: str
    backend: str
    key: str
    query: str | None


def parse_location(url) -> Location | None:
    m = re.match(_SCHEME, url) if isinstance(url, str) else None
    if not m:
        return None
    rest, mark, query = url[m.end() :].partition("?")
    backend, _, key = rest.partition("/")
    return Location(m[1].lower(), backend, key, query if mark else None)


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, _SCHEME, 1), F.lit("")))


def _rest(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"([^?]*)", 2)


def authority(url: Column) -> Column:
    return F.when(scheme(url).isNotNull(), F.split_part(_rest(url), F.lit("/"), F.lit(1)))


def location_key(url: Column) -> Column:
    return F.when(scheme(url).isNotNull(), F.regexp_extract(_rest(url), "^[^/]*/?(.*)$", 1))


def location_query(url: Column) -> Column:
    return F.when(scheme(url).isNotNull() & url.contains("?"), F.regexp_extract(url, r"\?(.*)$", 1))


def location(url: Column) -> Column:
    """struct<scheme, backend, key, query>, null where there is no scheme."""
    return F.when(scheme(url).isNotNull(), F.struct(scheme(url).alias("scheme"), authority(url).alias("backend"), location_key(url).alias("key"), location_query(url).alias("query")))


def _placeholder(c: Column) -> Column:
    return c.rlike(r"^\{.*\}$")


def backend_keys(locations: Column) -> Column:
    """data/backend keys of array<struct<url, metadata>>: a declared backend wins, then scheme and scheme/authority; file and device don't count."""

    def one(x: Column) -> Column:
        declared = F.trim(F.coalesce(x["metadata"]["backend"], F.lit("")))
        s, a = scheme(x["url"]), authority(x["url"])
        base = F.concat(F.lit("data/backend/"), s)
        full = F.when((a != "") & ~_placeholder(a), F.array(base, F.concat(base, F.lit("/"), a))).otherwise(F.array(base))
        none = F.array().cast("array<string>")
        return F.when(declared != "", F.array(F.concat(F.lit("data/backend/"), declared))).when(s.isNull() | s.isin("file", "device"), none).otherwise(full)

    return F.array_distinct(F.transform(F.flatten(F.transform(F.coalesce(locations, F.array().cast("array<struct<url:string,metadata:map<string,string>>>")), one)), normalized))


def device_ids(locations: Column) -> Column:
    """Device authorities of file:// and device:// locations, placeholders left out."""

    def one(x: Column) -> Column:
        s, a = scheme(x["url"]), authority(x["url"])
        return F.when(s.isin("file", "device") & (a != "") & ~_placeholder(a), a)

    return F.array_distinct(F.array_compact(F.transform(F.coalesce(locations, F.array().cast("array<struct<url:string,metadata:map<string,string>>>")), one)))


def device_os(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v == "", F.lit(None)).when(v.isin("darwin", "macos", "osx"), "mac").when(v.isin("win32", "win", "windows_nt"), "windows").otherwise(v)


def device_type(value: Column) -> Column:
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


def home_placeholder(path: Column) -> Column:
    """`~` and `{{home}}` at the front become $HOME."""
    return F.regexp_replace(F.regexp_replace(path, r"(?i)^\{\{\s*home\s*\}\}(?=/|$)", r"\$HOME"), r"^~(?=/|$)", r"\$HOME")


def device_file_url(device: Column, path: Column) -> Column:
    return F.when((device != "") & (path != ""), F.concat(F.lit("file://"), device, F.when(path.startswith("/"), "").otherwise("/"), path))


def device_url(device: Column) -> Column:
    return F.when(device != "", F.concat(F.lit("device://"), device))


DOTFILES = "workspace:dotfiles"


def dotfile_url(value: str) -> str:
    """The normal form of a dotfile's identity, `repository#entry`; raises on an empty part or a way out of the repository."""
    value = unicodedata.normalize("NFC", value).strip()
    if not value:
        raise ValueError("empty dotfile url")
    repo, mark, entry = value.partition("#")
    if not mark:
        if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", value):
            entry = value
        else:
            repo, entry = DOTFILES, value
    if not repo or (not mark and repo == value):
        raise ValueError(f"no repository in {value!r}")
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):(//[^/]+)?(.*)$", repo, re.S)
    if m:
        repo = f"{m[1].lower()}:{(m[2] or '').lower()}{m[3]}"
    segments = [s for s in entry.split("/") if s not in ("", ".")]
    if not segments:
        raise ValueError(f"no entry in {value!r}")
    if ".." in segments:
        raise ValueError(f"{value!r} leaves its repository")
    return f"{repo.rstrip('/')}#{'/'.join(segments)}"


def dotfile_entry(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "#(.*)$", 1), F.lit(""))


def resolve_uri(uri: Column, variables: dict[str, str]) -> Column:
    """`{NAME}` replaced by its value; unknown names stay."""
    for name, value in variables.items():
        uri = F.replace(uri, F.lit("{" + name + "}"), F.lit(value))
    return uri
