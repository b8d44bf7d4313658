"""Literal cases of the driver-side parts: time, keys, locations, specs, trees, recurrence."""

from datetime import UTC, datetime

import numpy as np
import pytest

from gleanwork.functions import keys, recurrence, urls
from gleanwork.functions import time as t
from gleanwork.operators import fts, geo, ranking, trees, vectors
from gleanwork.plans.spec import Buckets, GeoFilter, parse, parse_ids, path_layers, predicate
from gleanwork.schemas import REGISTRY, Registry, Schema
from gleanwork.sources.files import glob_regex

day = lambda s: t.point(s).value


@pytest.mark.parametrize(
    ("text", "scale", "value"),
    [("1769", "year", -201), ("-44", "year", -2014), ("1769-08", "month", -2405), ("19700102", "day", 1), ("1970-01-02", "day", 1), ("541 MYA", "Myr", -541), ("2.5 Gyr", "Gyr", -2), ("1970-01-01T00:01:00Z", "second", 60), ("1970-01-01T00:00:00.250Z", "ms", 250), (1500, "ms", 1500)],
)
def test_endpoints(text, scale, value):
    assert t.point(text) == (scale, value)


@pytest.mark.parametrize("bad", ["", "1999-13", "2023-02-29", "soon", 1.5, True, None, "12 parsecs"])
def test_no_endpoints(bad):
    with pytest.raises(ValueError):
        t.point(bad)


def test_intervals():
    assert t.interval("1914", "1918") == ("year", -56, -52, False, False)
    assert t.interval("1769", "1770-06-01").end == -200  # a finer end is floored
    with pytest.raises(ValueError):
        t.interval("1770-06-01", "1771")  # a coarser one has no such precision
    with pytest.raises(ValueError):
        t.interval("1918", "1914")
    assert t.interval("1990", None) == ("year", 20, t.HIGHEST, False, True)
    assert t.interval(None, "1990").open_start and t.interval("1990", "ongoing").open_end and t.interval("-inf", "1990").open_start
    with pytest.raises(ValueError):
        t.interval("present", "1990")


def test_scales_agree_with_the_calendar():
    assert t.spread("year", 0, 0, "day") == (0, 364) and t.spread("month", 1, 1, "day") == (31, 58)
    assert t.spread("Kyr", -1, -1, "year") == (-1000, -1) and t.spread("year", 50, 50, "ms") == (day("2020-01-01") * 86_400_000, (day("2020-12-31") + 1) * 86_400_000 - 1)
    for y in (-4712, -1, 0, 1600, 1900, 2000, 2100, 400_000):
        n = t.days_from_civil(y, 3, 1)
        assert t.civil_from_days(n) == (y, 3, 1) and t.civil_from_days(n - 1)[1] == 2
    assert t.query_bounds("500 MYA", "480 MYA")["Kyr"] == (-500_000, -479_001)
    # a bound too wide for a fine scale is clamped, an open one isn't there
    assert t.query_bounds("4 Gyr", None)["ns"] == (t.LOWEST, None)


def test_cells():
    assert t.cells(50, 50, "year") == [("year", 50)]
    assert len(t.cells(day("2020-02-01"), day("2020-02-28"), "day")) == 28
    assert t.cells(day("2020-02-01"), day("2020-02-29"), "day") == [("month", 601)]
    rng = np.random.default_rng(1)
    for a, n in zip(rng.integers(-9999, 9999, 50).tolist(), rng.integers(0, 3000, 50).tolist(), strict=True):
        tiles = [t.spread(s, v, v, "day") for s, v in t.cells(a, a + n, "day")]
        assert tiles[0][0] == a and tiles[-1][1] == a + n and all(x[1] + 1 == y[0] for x, y in zip(tiles, tiles[1:], strict=False))


def test_frames():
    now = datetime(2024, 2, 29, 13, 45, 10, tzinfo=UTC)  # a Thursday
    at = lambda name: tuple(x.isoformat()[:19] for x in t.frame(name, now))
    assert at("now") == ("2024-02-29T13:00:00", "2024-02-29T13:59:59") and at("yesterday")[0] == "2024-02-28T00:00:00"
    assert at("thisWeek") == ("2024-02-26T00:00:00", "2024-03-03T23:59:59") and at("lastMonth") == ("2024-01-01T00:00:00", "2024-01-31T23:59:59")
    assert at("nextYear")[1] == "2025-12-31T23:59:59" and at("thisDecade") == ("2020-01-01T00:00:00", "2029-12-31T23:59:59")
    assert at("lastCentury")[0] == "1900-01-01T00:00:00" and at("thisMillennium")[1] == "2999-12-31T23:59:59"
    assert len(t.FRAMES) == 22


def test_keys():
    assert keys.normalize(r" Tag\Some Thing//é__x ") == "tag/some_thing/_x" and keys.normalize("!Tag/A") == "!tag/a"
    assert keys.make("TAG/x") == "tag/x" and not keys.valid("other/x") and keys.valid("!data/x")
    with pytest.raises(ValueError):
        keys.make("nonsense")


def test_locations():
    assert urls.parse_location("IMAP://me@host:99/INBOX;UID=3?x=1") == ("imap", "me@host:99", "INBOX;UID=3", "x=1")
    assert urls.parse_location("s3://bucket") == ("s3", "bucket", "", None) and urls.parse_location("no url") is None
    assert urls.dotfile_url("./shell//bashrc/") == "workspace:dotfiles#shell/bashrc"
    assert urls.dotfile_url("Git+SSH://git@GitHost.org/me/Dots/#a/./B") == "git+ssh://git@githost.org/me/Dots#a/B"
    for bad in ("", "#x", "a/../b", "./", "ssh://host/repo"):
        with pytest.raises(ValueError):
            urls.dotfile_url(bad)


def test_spec():
    s = parse({"paths": ["/a", "!dir:/b"], "features": ["x/y", "+tag/a", "!tag/b"], "filters": ["+t:crud:created:today", "!t:life:1900..1950", "geo:near:48,17,5km", "tag/raw", "!tag/not"], "rel": {"p": "mentions", "of": ["5", 6], "dir": "in"}, "ids": [], "options": {"limit": 9, "page": 3}, "limit": 5})
    assert [p.path for p in s.paths_in] == ["/a"] and s.paths_not[0].type == "directory"
    assert s.features == Buckets(("tag/a",), ("x/y",), ("tag/b",)) and s.raw == Buckets(("tag/raw",), (), ("tag/not",))
    assert s.times[0].frame == "today" and s.times[0].sigil == "allOf" and (s.times[1].start, s.times[1].end) == ("1900", "1950")
    assert s.geo == (GeoFilter("anyOf", "near", (48.0, 17.0, 5000.0)),) and s.rel[0].of == (5, 6) and s.ids == () and s.coarse
    assert s.limit == 5 and s.offset == 10
    assert parse({"features": {"allOf": ["a/b", "!c/d"]}}).features == Buckets(("a/b",), (), ("c/d",))
    assert parse({"sortBy": {"timeline": "content"}}).sort_by == parse({"sortBy": "t:content"}).sort_by == "content"
    assert parse({"filters": {"timeline": "today"}}).times[0].name == "crud:updated"
    frozen = parse({"filters": ["t:tasks:thisWeek"]}).freeze(datetime(2024, 2, 29, tzinfo=UTC)).times[0]
    assert (frozen.start, frozen.end, frozen.frame) == ("2024-02-26", "2024-03-03", None)


@pytest.mark.parametrize(
    "bad",
    [{"filters": ["g:*.md"]}, {"filters": ["re:^alpha"]}, {"filters": ["t:content"]}, {"filters": ["t:content:never"]}, {"filters": ["geo:bbox:1,2,3"]}, {"filters": ["geo:cell:x"]}, {"rel": {"p": "mentioned-by", "of": 1}}, {"rel": {"p": "likes", "of": 1}}, {"rel": {"p": "mentions", "of": []}}, {"rel": {"p": "mentions", "of": 1, "dir": "up"}}, {"ids": [-1]}, {"ids": ["a"]}, {"features": "x"}, {"query": {"text": ""}}, {"mode": "magic"}],
)
def test_specs_that_raise(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_parsers():
    assert parse_ids([3, "4", 3, 0]) == (3, 4, 0) and parse_ids(None) is None
    assert path_layers("/a/ b //c") == ["/", "a", "b", "c"] and predicate("member-of") == "member-of"
    assert fts.query_tokens("Élève, the X — don't") == ["eleve", "the", "don"] and fts.grams_of("abcd") == ["abc", "bcd", "abcd"]
    assert vectors.table_name("vec_image__clip-base__512") == {"space": "image", "slug": "clip-base", "dim": 512} and vectors.table_name("x") is None
    tuned = ranking.Tuning.make(weights={"fts": -1, "dense": 4}, image_floor="odd", image_max_distance=0, image_margin=-1)
    assert tuned.weights == {"fts": 2.0, "dense": 4.0, "image": 2.0} and tuned.image_floor == "absolute" and tuned.image_max_distance is None and tuned.image_margin == 0.035
    import re

    hit = lambda p, s: bool(re.search(glob_regex(p), s))
    assert hit("*.tmp", "a/b.tmp") and hit(".git", "x/.git/config") and not hit("*.tmp", "a.tmpx") and hit("src/**/*.py", "src/a/b/c.py") and hit("src/**/*.py", "src/c.py") and hit("*.{js,ts}", "x.ts")


def test_context_tree():
    c = trees.ContextTree()
    c.insert("/work/alpha")
    c.insert("/home/Alpha")
    assert c.keys_for("/work/alpha")[-1] == c.keys_for("/home/alpha")[-1]  # a layer is shared by name
    assert c.keys_for("/nowhere") is None and len(c.keys_for("/")) == 1
    c.view("/work/alpha/mine", {"features": ["tag/x"]})
    assert c.keys_for("/work/alpha/mine") == c.keys_for("/work/alpha")
    assert c.unlink_keys("/work/alpha") == c.keys_for("/work/alpha")[-1:] and c.unlink_keys("/work/alpha", True) == c.keys_for("/work/alpha")
    c.rename_layer("alpha", "beta")
    assert c.exists("/home/beta") and not c.exists("/work/alpha")
    c.lock_layer("beta")
    with pytest.raises(ValueError):
        c.delete_layer("beta")
    c.lock_layer("beta", False)
    c.delete_layer("beta")
    assert not c.exists("/home/beta") and trees.ContextTree.from_json(c.to_json()).paths() == c.paths()
    with pytest.raises(ValueError):
        c.unlink_keys("/")


def test_directory_tree():
    d = trees.DirectoryTree()
    d.insert("/a/b/c")
    d.insert("/x/b")
    assert d.keys_for("/a/b") != d.keys_for("/x/b") and len(d.keys_for("/a", True)) == 3 and len(d.keys_for("/a")) == 1
    pairs = d.copy("/a/b", "/y")
    assert d.exists("/y/b/c") and len(pairs) == 2 and d.keys_for("/y/b")[0] == pairs[0][1]
    d.move("/a/b", "/x/z")
    assert d.exists("/x/z/b/c") and not d.exists("/a/b")
    with pytest.raises(ValueError):
        d.move("/x", "/x/z")
    d.lock("/x/z")
    with pytest.raises(ValueError):
        d.insert("/x/z/new")
    d.remove("/x/b")
    assert d.listing("/x") == ["z"] and d.path_of(d.node("/x/z").layer.id) == "/x/z"


def test_recurrence():
    start = "2024-01-31T10:00:00Z"
    days = lambda rule, s=start: [x[0][:10] for x in recurrence.occurrences(rule, s)]
    assert days("FREQ=MONTHLY;COUNT=3") == ["2024-01-31", "2024-03-31", "2024-05-31"]
    assert days("FREQ=YEARLY;COUNT=2", "2024-02-29T00:00:00Z") == ["2024-02-29", "2028-02-29"]
    assert days("FREQ=WEEKLY;BYDAY=MO,WE;COUNT=4") == ["2024-01-31", "2024-02-05", "2024-02-07", "2024-02-12"]
    assert days("FREQ=DAILY;UNTIL=20240202") == ["2024-01-31", "2024-02-01", "2024-02-02"]
    many = recurrence.occurrences("FREQ=DAILY", start)
    assert len(many) == recurrence.CAP + 1 and many[-1][1:] == (None, True)
    assert recurrence.occurrences("FREQ=MONTHLY;BYDAY=1MO;UNTIL=20250101", start) == [(start, "2025-01-01T23:59:59.000Z", True)]
    assert recurrence.occurrences("FREQ=DAILY;COUNT=2", start, "2024-01-31T11:30:00Z", True)[1][1] == "2024-02-01T11:30:00.000Z"
    assert recurrence.occurrences(None, start) == [(start, None, False)] and recurrence.occurrences("x", None) == []
    assert len(recurrence.occurrences("FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,TU", start)) == 1


def test_cells_on_the_sphere():
    ids = geo.cell_ids(np.array([49.703498679]), np.array([11.770681595]), 30)
    assert hex(ids[0]) == "0x47a1cbd595522b39"
    fine, coarse = (geo.cell_ids(np.array([48.1486]), np.array([17.1077]), k)[0] for k in (21, 5))
    low = int(coarse) & -int(coarse)
    assert int(coarse) - low < int(fine) < int(coarse) + low


def test_registry():
    r = Registry()
    assert r.resolve("data/schema/message/email/x").id == "data/schema/message/email" and r.resolve("nothing") is None
    assert "data/schema/note" in r.listing("data/schema/n") and REGISTRY.has("data/schema/task")
    r.register(Schema("data/schema/car", fts=("data.name",)))
    assert r.extend("data/schema/car", (("wheels", "int"),)).struct() == "`wheels` int"
    for bad in (lambda: r.register(Schema("data/schema/task")), lambda: r.unregister("data/schema/file"), lambda: r.register(Schema("elsewhere/x"))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        r.get("data/schema/none")


def test_recurrence_in_the_jvm_is_that_of_python(spark):
    """Every rule through both ways; a series ends with the calendar instead of failing."""
    from gleanwork.functions import recurrence

    rules = [None, "", "FREQ=DAILY;COUNT=3", "FREQ=WEEKLY;INTERVAL=2;COUNT=512", "FREQ=DAILY", "FREQ=DAILY;INTERVAL=999;COUNT=512", "FREQ=DAILY;INTERVAL=1000000", "FREQ=WEEKLY;INTERVAL=3000", "FREQ=DAILY;COUNT=600", "FREQ=DAILY;COUNT=0", "FREQ=WEEKLY;BYDAY=TU,FR;COUNT=5", "FREQ=MONTHLY;COUNT=4", "FREQ=YEARLY", "FREQ=DAILY;UNTIL=20240110", "FREQ=HOURLY", "nonsense"]
    times = [("2024-01-31T10:00:00Z", None, False), ("2024-02-29T10:00:00.250Z", "2024-02-29T11:30:00Z", True), ("2024-01-01", None, False), ("9999-12-30T00:00:00Z", "9999-12-31T00:00:00Z", True), ("2024-13-01T00:00:00Z", None, False), ("2024-01-05T10:00:00Z", None, True), (None, None, False), ("2024-01-05T10:00:00+02:00", "2024-01-05T09:00:00Z", True)]
    rows = [(k, *t, r) for k, (r, t) in enumerate((r, t) for r in rules for t in times)]
    df = spark.createDataFrame(rows, "doc_id bigint, start string, end string, end_given boolean, recurrence string")
    got: dict = {}
    for r in recurrence.expand_events(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["end_given"]))
    for k, start, end, given, rule in rows:
        assert got.get(k, []) == recurrence.occurrences(rule, start, end, given), (rule, start, end)


def test_entries_in_the_jvm_are_those_of_python(spark):
    """Every pair of endpoints against time.interval."""
    from gleanwork.functions import time as t
    from gleanwork.operators import timelines

    ends = ["1769", "0099", "1999-02", "1999-13", "1999-02-28", "1999-02-30", "2000-02-29T23:59:59Z", "2000-02-29T24:30:00Z", "2000-02-29T23:59:59.5Z", "2000-02-29T23:59:59.123456Z", "2000-02-29T23:59:59+01:00", "66 MYA", "∞", "x", "", None]
    rows = [(k, 0, "A", s, a, z, given, False, None) for k, (s, a, z, given) in enumerate((s, a, z, g) for s in (None, "day") for a in ends for z in ends for g in (True, False))]
    df = spark.createDataFrame(rows, "doc_id bigint, pos int, name string, scale string, start string, end string, end_given boolean, is_primary boolean, ref string")
    got = {r["doc_id"]: (r["scale"], r["start_v"], r["end_v"], r["open_start"], r["open_end"]) for r in timelines.from_entries(df).collect()}
    for k, _, _, scale, a, z, given, _, _ in rows:
        as_given = lambda v, s=scale: v if v is None or s is None else {"scale": s, "value": v}
        try:
            i = t.interval(as_given(a), as_given(z) if given else t.ABSENT)
            want = (i.scale, i.start, i.end, i.open_start, i.open_end)
        except ValueError:
            want = None
        assert got.get(k) == want, (scale, a, z, given)
