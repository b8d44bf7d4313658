"""The index end to end, and the literal cases of its operators."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import keys
from gleanwork.index import Index
from gleanwork.operators import derive, edges, fts, geo, ingest, membership, ranking, timelines, trees, vectors
from gleanwork.sources import connectors, files
from gleanwork.streaming import live

def ids(df, column="doc_id"):
    return sorted(r[0] for r in df.select(column).collect())


def now():
    return F.lit("2024-05-01 12:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def batch(spark):
    def make(rows):
        full = [(k, r.get("doc_id"), r.get("schema"), json.dumps(r["data"]) if "data" in r else None, r.get("comment"), r.get("features"), r.get("locations"), r.get("timelines"), r.get("metadata"), None, None, None, None) for k, r in enumerate(rows)]
        return spark.createDataFrame(full, "pos int, " + derive.DOCS)

    return make


ROWS = [
    {"schema": "data/schema/note", "data": {"title": "a", "content": "broken door alpha", "relations": [{"p": "mentions", "to": 100002}]}, "features": ["tag/red", "data/mime/forged", "data/dataset/wiki"]},
    {"schema": "data/schema/event", "data": {"title": "e", "type": "meeting", "start": "2024-01-31T10:00:00Z", "recurrence": "FREQ=MONTHLY;COUNT=3"}, "metadata": ("text/plain; charset=x", "f", None, (48.1486, 17.1077))},
    {"schema": "data/schema/note", "data": {"title": "a", "content": "broken door alpha"}, "locations": [("s3://Bucket/k", None)]},
    {"schema": "", "data": {}},
    {"schema": "data/schema/file", "data": {"name": "x"}, "locations": [("imap://acc/INBOX;UID=3", None), ("file://Dev1/x", None), ("file://{ROOT}/y", None)], "comment": " hi "},
    {"schema": "data/schema/task", "data": {"title": "t", "status": "Pending", "dueDate": "2024-03-05"}},
    {"schema": "data/schema/device", "data": {"deviceId": "dev1", "name": "laptop", "platform": "darwin", "type": "Laptop"}},
    {"schema": "data/schema/note", "data": {"title": "era", "content": "old"}, "timelines": [("life", None, "1769-08-15", None, False, False, "x"), ("life", None, "1799-11-09", "1804-05-18", True, False, None), ("deep", None, "66 MYA", None, False, True, None), ("life", None, "bad", None, False, False, None)]},
]


@pytest.fixture(scope="module")
def index(spark, batch, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    ix = Index.from_docs(spark, spark.createDataFrame([], derive.DOCS))
    got, rejected = ix.put_many(batch(ROWS), {"context": "/work/alpha", "features": ["tag/batch"]}, now())
    assert {r["pos"]: r["doc_id"] for r in got.collect()} == {0: 100001, 1: 100002, 2: 100001, 4: 100003, 5: 100004, 6: 100005, 7: 100006}
    assert [(r["pos"], r["reason"]) for r in rejected.collect()] == [(3, "no schema")]
    ix.save(path)
    return Index.open(spark, path)


def keys_of(ix, doc_id):
    return {r[0] for r in ix.keys_of(doc_id).collect()}


def test_derived_keys(index):
    note = keys_of(index, 100001)
    assert {"tag/red", "tag/batch", "data/schema/note", "data/dataset/wiki", "data/backend/s3", "data/backend/s3/bucket"} <= note and "data/mime/forged" not in note
    assert {"data/schema/event", "data/schema/event/meeting", "data/mime/text", "data/mime/text/plain"} <= keys_of(index, 100002)
    assert {"device/id/dev1", "device/os/mac", "device/type/laptop", "data/backend/imap/acc", keys.COMMENT} <= keys_of(index, 100003)
    assert "data/status/pending" in keys_of(index, 100004) and not any("{" in k or "root" in k for k in keys_of(index, 100003))


def test_listing(index):
    every = {"features": ["data/dataset/wiki"]}
    assert ids(index.list(every)) == list(range(100001, 100007)) and 100001 not in ids(index.list({}))
    assert ids(index.list({"context": "/work/alpha", "features": ["+tag/red", "data/dataset/wiki"]})) == [100001]
    assert ids(index.list({"context": "/nowhere", **every})) == [] and ids(index.list({"features": ["+data/dataset/default", "+data/dataset/wiki"]})) == []
    assert [r[0] for r in index.list({**every, "limit": 2, "offset": 1, "desc": True, "idsOnly": True}).collect()] == [100005, 100004]
    assert index.list({**every, "limit": 0}).count() == 6 and index.count({"ids": [100002, 5]}) == 1 and index.count({"ids": []}) == 0
    assert index.has(100001, {"features": ["+tag/red"]}) and not index.has(100002, {"features": ["+tag/red"]}) and not index.has(1)
    assert [r["doc_id"] for r in index.get_many([100003, 7, 100001, 100003]).collect()] == [100003, 100001, 100003]
    cs = index.get(100002).first()["checksums"]
    assert cs[0].startswith("sha1/") and [r["doc_id"] for r in index.by_checksum([cs[0], "sha1/none"]).collect()] == [100002, None] and index.has_checksum(cs[1])


def test_timelines_of_documents(index):
    hit = lambda token, **o: ids(index.list({"filters": [token], **o}))
    assert hit("t:events:2024-03-31") == [100002] and hit("t:events:2024-02-29") == [] and hit("t:tasks:2024-03") == [100004]
    assert hit("t:life:1769") == [100006] and hit("t:life:1769-08-16") == [] and hit("t:life:1799-12") == [100006] and hit("t:life:1799-02") == [] and hit("t:life:1768") == []
    assert hit("t:deep:70 MYA..60 MYA") == [100006] and hit("t:deep:50 MYA..40 MYA") == [] and hit("!t:life:1700..1900") == [100002, 100003, 100004, 100005]
    assert hit("t:crud:created:2024-05-01") == [100002, 100003, 100004, 100005, 100006]
    assert hit("t:tasks:thisMonth", **{}) == [] and ids(index.list({"filters": ["t:tasks:thisMonth"]}, datetime(2024, 3, 9, tzinfo=UTC))) == [100004]
    first = [r["doc_id"] for r in index.list({"sortBy": "life", "limit": 2, "idsOnly": True}).collect()]
    assert first == [100006, 100002]


def test_text_geo_edges(index):
    both = {"features": ["data/dataset/wiki"]}
    assert ids(index.query("broken door", both)) == [100001] and ids(index.query("zz", both)) == []
    stored = Index(index.spark, index.tables, embed=None).build_postings()
    assert [tuple(r) for r in stored.query("door", both).collect()] == [tuple(r) for r in index.query("door", both).collect()]
    assert ids(index.list({"filters": ["geo:near:48.1486,17.1077,5km"]})) == [100002] and ids(index.list({"filters": ["geo:bbox:0,0,10,10"]})) == []
    assert ids(index.list({"rel": {"p": "mentions", "of": 100001}})) == [100002] and ids(index.list({"rel": {"p": "mentions", "of": 100002, "dir": "in"}, **both})) == [100001]
    ranked, counts = index.search_compound([{"queries": ["door"]}, {"features": ["tag/batch"]}], base=both)
    assert [r[0] for r in ranked.collect()][0] == 100001 and ranked.count() == 6 and {r["line"]: r["n"] for r in counts.collect()} == {0: 1, 1: 6}
    assert ids(index.search_refined(["broken", "alpha"], both)) == [100001] and ids(index.search({"q": "old"})) == [100006] and len(ids(index.search(both))) == 6


def test_rebuilding_gives_the_same(index):
    again = Index(index.spark, {k: index.tables[k] for k in ("docs", "membership", "edges")}, [index.tree("context"), index.tree("directory")]).rebuild()
    for name in ("membership", "timeline_pos", "geo", "edges", "fts"):
        a, b = again.tables[name], index.tables[name].select(*again.tables[name].columns)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_updates_and_deletes(spark, index, batch):
    ix = Index(spark, index.tables, [index.tree("context"), index.tree("directory")])
    ix.put_many(batch([{"doc_id": 100001, "schema": "data/schema/note", "data": {"title": "b", "content": "new words"}, "features": ["tag/blue"]}]), {"directory": "/in/box"}, now())
    note = keys_of(ix, 100001)
    assert "tag/blue" in note and "tag/red" not in note and "data/dataset/wiki" in note  # a dataset's stamp stays
    assert ids(ix.query("new words", {"features": ["data/dataset/wiki"]})) == [100001] and ids(ix.query("broken", {"features": ["data/dataset/wiki"]})) == []
    assert ids(ix.tables["membership"].filter(F.col("key") == ix.tree("directory").keys_for("/in/box")[0])) == [100001]
    some = spark.createDataFrame([(100002,)], "doc_id bigint")
    ix.relate(spark.createDataFrame([(100003, 100004)], "from_id bigint, to_id bigint"), "depicts", "faces", inherit=True)
    assert "device/id/dev1" in keys_of(ix, 100004) and edges.exists(ix.tables["edges"], 100003, "depicts", 100004)
    ix.unrelate(spark.createDataFrame([(100003, 100004)], "from_id bigint, to_id bigint"), "depicts")
    assert not edges.exists(ix.tables["edges"], 100003, "depicts", 100004)
    ix.assert_relation(100003, "includes", 100005)
    assert json.loads(ix.get(100003).first()["data"]) == {"name": "x", "relations": [{"p": "includes", "to": 100005}]} and edges.exists(ix.tables["edges"], 100003, "includes", 100005)
    ix.assert_relation(100003, "includes", 100005, retract=True)
    assert not edges.exists(ix.tables["edges"], 100003, "includes", 100005)
    ix.link(some, {"features": ["tag/linked"]}).unlink(some, {"context": "/work/alpha"})
    assert "tag/linked" in keys_of(ix, 100002) and ids(ix.list({"context": "/work/alpha"})) == [100003, 100004, 100005, 100006]
    ix.delete(some, now())
    assert ids(ix.get(100002)) == [] and keys_of(ix, 100002) == set() and ids(timelines.query(ix.tables["timeline_pos"], "crud:deleted", "2024")) == [100002]
    with pytest.raises(ValueError):
        ix.link(some, {"features": ["data/dataset/default"]})
    ix.delete_dataset("wiki")
    assert ids(ix.list({})) == [100001, 100003, 100004, 100005, 100006]


def test_allocation_reuses_freed_ids(spark):
    new = spark.range(5).select(F.col("id").alias("pos"))
    taken = spark.createDataFrame([(100001,), (100007,)], "doc_id bigint")
    freed = spark.createDataFrame([(100003,), (100002,), (100007,)], "doc_id bigint")
    got = {r["pos"]: r["doc_id"] for r in ingest.allocate(new, taken, ["pos"], freed).collect()}
    assert got == {0: 100002, 1: 100003, 2: 100008, 3: 100009, 4: 100010}


def test_histogram_cases(spark):
    from gleanwork.functions import time as t

    def pos(rows):
        full = [(n, i, *(lambda v: (v.scale, v.start, v.end, v.open_start, v.open_end))(t.interval(a, b)), True, None) for n, i, a, b in rows]
        return spark.createDataFrame(full, timelines.POSITION)

    decades = [("1900", "1909"), ("1910", "1919"), ("1920", "1929"), ("x", "y")]
    counts = lambda p, names="life": {r["bucket"]: r["n"] for r in timelines.histogram(p, names, decades).collect()}
    assert counts(pos([("life", 1, "1912", "1912"), ("life", 2, "1914", "1918"), ("life", 3, "1915", "1915")])) == {1: 3}
    p = pos([("life", 1, "1895", "1905"), ("other", 1, "1901", "1901"), ("life", 1, "1902", "1902")])
    assert counts(p) == {0: 1} and [tuple(r) for r in timelines.histogram_totals(timelines.histogram(p, "*", decades)).collect()] == [(0, 2)]
    eras = pos([("era", 1, "1998", "2006"), ("era", 2, "2005", "2010"), ("era", 3, "2020", "2025"), ("era", 4, "1950", None), ("era", 4, "2000", None)])
    find = lambda a, b: ids(timelines.query(eras, "era", a, b))
    assert find("2008", "2008") == [2, 4] and find("2015", None) == [3, 4] and find(None, "1999") == [1, 4] and find("1960", "1960") == [4]
    assert [tuple(r) for r in timelines.open_extent(eras).collect()] == [(4, "era", "year", "end", -20, None)]
    zeit = timelines.query(pos([("wiki", 1, "600", "600"), ("geology", 100, "2 Myr", None), ("history", 10, "500", "700"), ("none", 7, "1900", "1900")]), ["wiki", "geology", "none", "absent"], "600", mode="grouped")
    assert sorted(map(tuple, zeit.collect())) == [("geology", 100), ("wiki", 1)]


def test_vector_cases(spark):
    e1 = [1.0] + [0.0] * 7
    rows = [(1, 0, e1), (2, 0, [0.9, 0.1] + [0.0] * 6), (3, 0, [0.0, 1.0] + [0.0] * 6), (4, 0, [0.0] * 8), (5, 0, [1.0]), (6, 0, None), (3, 1, [0.5, 0.5] + [0.0] * 6)]
    v = spark.createDataFrame(rows, "doc_id bigint, chunk_id int, vector array<float>")
    hits = vectors.search(v, e1).collect()
    assert [r["doc_id"] for r in hits] == [1, 2, 3] and hits[1]["distance"] == pytest.approx(0.006, abs=1e-3) and hits[2]["distance"] == pytest.approx(0.293, abs=1e-3)
    assert ids(vectors.search(v, e1, max_distance=0.01)) == [1, 2] and ids(vectors.more_like(v, 1)) == [2, 3] and ids(vectors.search(v, e1, max_distance=0)) == [1, 2, 3]
    near = spark.createDataFrame([(i, 0.92 + 0.005 * i) for i in range(3)] + [(10 + i, 1.12 + 0.005 * i) for i in range(3)], "doc_id bigint, distance double")
    assert ids(vectors.relative_floor(near, 0.035, None)) == [0, 1, 2] and ids(vectors.relative_floor(near, 0.035, 0.923)) == [0]
    with pytest.raises(ValueError):
        vectors.search(v, [0.0] * 8)
    stored = vectors.store(spark.createDataFrame([("text", "m", 1, 0, [1.0, 2.0])], "space string, model string, doc_id bigint, chunk_id int, vector array<float>"), spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0])], "doc_id bigint, chunk_id int, vector array<float>"), "text", "m", 2)
    assert [r["vector"] for r in stored.collect()] == [[1.0, 0.0]]


def test_fts_scope_is_an_intersection(spark):
    texts = spark.createDataFrame([(k, f"broken door {w} " + "x" * (70 if k == 3 else 3)) for k, w in enumerate(["one", "two", "aaaa aaa", "ünï", None or "door door"])], "doc_id bigint, fts_text string")
    scope = texts.filter("doc_id % 2 = 0")
    whole, part = (fts.scan_scores(texts, "broken door", s) for s in (None, scope))
    assert sorted(map(tuple, part.collect())) == sorted(tuple(r) for r in whole.collect() if r["doc_id"] % 2 == 0)
    index = fts.scores(fts.postings(texts), fts.lengths(texts), "aaa door")
    assert sorted((r[0], round(r[1], 9)) for r in index.collect()) == sorted((r[0], round(r[1], 9)) for r in fts.scan_scores(texts, "aaa door").collect())
    assert ids(fts.scan_scores(texts, "UNI")) == [3] and fts.scan_scores(texts, "a ?").count() == 0


def test_edits_of_edges(spark):
    e = spark.createDataFrame([(1, "mentions", 2, None), (1, "depicts", 2, "faces"), (3, "mentions", 1, "ner")], "from_id bigint, p string, to_id bigint, src string")
    assert edges.remove(e, src="ner").count() == 2 and edges.remove(e, p="mentions").count() == 2 and ids(edges.outgoing(e, 1, "mentions")) == [2]
    for bad in (lambda: edges.remove(e), lambda: edges.remove(e, src="doc"), lambda: edges.outgoing(e, 1, "mentioned-by")):
        with pytest.raises(ValueError):
            bad()
    more = edges.link(e, spark.createDataFrame([(1, "mentions", 2, "ner"), (5, "mentions", 6, "ner")], "from_id bigint, p string, to_id bigint, src string"), derived=True)
    assert more.count() == 4 and more.filter("from_id = 1 AND p = 'mentions'").first()["src"] is None
    with pytest.raises(Exception, match="derived edge"):
        edges.link(e, spark.createDataFrame([(1, "depicts", 9, "doc")], "from_id bigint, p string, to_id bigint, src string"), derived=True).collect()
    docs = spark.createDataFrame([(1, [])], "doc_id bigint, relations array<struct<p:string,to:bigint>>")
    assert [[tuple(x) for x in r["relations"]] for r in edges.backfill(edges.link(edges.empty(spark), e), docs).collect()] == [[("mentions", 2)]]


def test_membership_edits(spark):
    m = spark.createDataFrame([("tag/a", 1), ("tag/a", 2), ("tag/b", 2), ("context/t/1", 1)], "key string, doc_id bigint")
    one = spark.createDataFrame([(1,)], "doc_id bigint")
    assert ids(membership.ids(membership.tick(m, ["tag/b"], one), "tag/b")) == [1, 2] and ids(membership.ids(membership.untick(m, ["tag/a"], one), "tag/a")) == [2]
    assert membership.untick_all(m, one, "tag/").count() == 3 and membership.rename(m, "tag/a", "tag/b").filter("key = 'tag/b'").count() == 2
    moved = membership.migrate(m, spark.createDataFrame([(1, 9)], "old_id bigint, new_id bigint"))
    assert ids(moved.filter("key = 'context/t/1'")) == [1, 9] and not moved.filter("key = 'tag/a' AND doc_id = 9").count()
    c = membership.Collection("custom/x")
    assert ids(c.any_of(c.tick(m, ["q"], one), ["q"])) == [1] and membership.exists(m, "tag/a") and not membership.exists(m, "nonsense")
    with pytest.raises(ValueError):
        membership.delete(m, "data/dataset/x")
    d = trees.DirectoryTree()
    d.insert("/a/b")
    held = membership.tick(m, d.keys_for("/a/b"), one)
    assert ids(membership.ids(trees.copy_members(held, d.copy("/a/b", "/z")), d.keys_for("/z/b")[0])) == [1]


def test_live_session(spark, tmp_path):
    docs = spark.range(10).select(F.col("id").alias("doc_id"))
    state = {"m": [("tag/a", 1), ("tag/a", 2), ("tag/b", 2)]}

    def planes():
        from gleanwork.plans.compile import Planes

        return Planes(docs, spark.createDataFrame(state["m"], "key string, doc_id bigint"))

    s = live.Session(planes, {"one": {"features": ["+tag/a"]}}, clock=lambda: datetime(2024, 1, 1, tzinfo=UTC))
    seen = []
    s.on_change(lambda df, n: seen.append(sorted(map(tuple, df.collect()))))
    log, folder = f"{tmp_path}/log", f"{tmp_path}/state"

    def change(rows):
        spark.createDataFrame([(str(k), d, op, key, "updated", None) for k, (d, op, key) in enumerate(rows)], live.CHANGE).write.mode("append").parquet(log)
        s.start(live.feed(spark, log), folder).awaitTermination()

    change([(1, "add", "tag/a")])
    assert seen == [[("added", 1), ("added", 2)]]
    state["m"] = [("tag/a", 2), ("tag/a", 3)]
    change([(5, "add", "tag/unrelated")])
    assert len(seen) == 1  # no cue depends on that key
    change([(3, "add", "tag/a"), (1, "remove", "tag/a")])
    assert seen[1] == [("added", 3), ("removed", 1)]
    s.patch("one", {"features": ["+tag/b"]})
    assert ids(s.ids()) == [] and s.labels() == ["one"] and s.add({"ids": [3]}) in s.labels()
    again = live.Session.rehydrate(s.serialize(), planes)
    assert again.size == 2 and ids(again.ids()) == []
    again.remove("one")
    assert again.count() == 1 and ids(again.materialize()) == [3] and ids(again.clear().ids()) == list(range(10))
    frozen = live.Session(planes, {"t": {"filters": ["t:x:today"]}}, mode="frozen", clock=lambda: datetime(2024, 1, 1, tzinfo=UTC))
    assert frozen.cues["t"].times[0].start == "2024-01-01"
    s.close()


def test_scanner_and_dumps(spark, tmp_path):
    (tmp_path / "d/sub/.git").mkdir(parents=True)
    (tmp_path / "d/a.txt").write_text("hello")
    (tmp_path / "d/sub/b.png").write_bytes(b"x")
    (tmp_path / "d/sub/.git/c").write_text("no")
    rows = {r["pos"]: r for r in files.scan(spark, f"{tmp_path}/d", "dev").collect()}
    assert set(rows) == {"a.txt", "sub/b.png"} and rows["a.txt"]["metadata"]["contentType"] == "text/plain" and rows["a.txt"]["checksums"][0] == "sha1/aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d"
    assert rows["sub/b.png"]["locations"][0]["url"] == f"file://dev{tmp_path}/d/sub/b.png"
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id bigint, t string")
    files.dump_documents(docs, docs.filter("doc_id = 2"), f"{tmp_path}/out")
    assert [r["t"] for r in spark.read.json(f"{tmp_path}/out").collect()] == ["y"]
    files.dump_keys(spark.createDataFrame([("tag/a", 2), ("tag/a", 1)], "key string, doc_id bigint"), None, f"{tmp_path}/keys")
    assert [tuple(r) for r in spark.read.schema("key string, doc_id bigint").json(f"{tmp_path}/keys").orderBy("doc_id").collect()] == [("tag/a", 1), ("tag/a", 2)]


def test_connectors(spark):
    def data(df):
        r = df.first()
        return r["schema"], json.loads(r["data"])

    slack = spark.createDataFrame([("hi", "U1", "bob", "1700000000.250", [("up", 2, ["U2"])])], "text string, user string, username string, ts string, reactions array<struct<name:string,count:bigint,users:array<string>>>")
    schema, d = data(connectors.message_from_slack(slack, "C1", "general"))
    assert schema == connectors.MESSAGE and d["timestamp"] == "2023-11-14T22:13:20.250Z" and d["reactions"][0]["emoji"] == "up" and d["channel"]["name"] == "general"
    imap = spark.createDataFrame([(" ", "a  b", ("Me@X.org", "Me"), [("You@Y.org", None), ("", "x")], "<a> <b> <a>", 7)], "subject string, text string, from struct<address:string,name:string>, to array<struct<address:string,name:string>>, references string, uid bigint")
    schema, d = data(connectors.email_from_imap(imap))
    assert schema == connectors.EMAIL and d["subject"] == "(no subject)" and d["from"]["address"] == "me@x.org" and [x["address"] for x in d["to"]] == ["you@y.org"] and d["messageId"] == "imap-uid-7" and d["references"] == ["<a>", "<b>"] and d["bodyPreview"] == "a b"
    graph = spark.createDataFrame([("s", ("html", "<p>"), (("a@b", "A"),), "id1")], "subject string, body struct<contentType:string,content:string>, from struct<emailAddress:struct<address:string,name:string>>, id string")
    assert data(connectors.email_from_graph(graph))[1] | {} == data(connectors.email_from_graph(graph))[1] and data(connectors.email_from_graph(graph))[1]["bodyHtml"] == "<p>"
    irc = spark.createDataFrame([("yo", "nick", "#c", "h")], "message string, nick string, channel string, host string")
    assert data(connectors.message_from_irc(irc))[1]["channel"]["type"] == "channel"
    teams = spark.createDataFrame([(("text", "x"), "2024")], "body struct<contentType:string,content:string>, createdDateTime string")
    assert data(connectors.message_from_teams(teams, "t"))[1]["text"] == "x"


def test_document_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(derive.email_features(F.lit("[x]/Sent Items"), F.array(F.lit(1)), F.lit(None).cast("boolean"), F.array(F.lit("\\Flagged")))) == ["feature/email/sent", "feature/email/attachment", "feature/email/flagged"]
    assert tuple(get(derive.task_status(F.lit(None).cast("string"), F.lit(True)))) == ("completed", True)
    installs = F.from_json(F.lit('{"d1": {"path": "/opt/x"}, "d2": {"status": "missing"}, "d3": {"status": "installed"}}'), "map<string,struct<status:string,path:string>>")
    assert sorted(get(derive.install_locations(installs, F.lit("https://x")))) == ["device://d3", "file://d1/opt/x", "https://x"]
    assert get(derive.dotfile_locations(F.create_map(F.lit("d"), F.lit("~/.bashrc")))) == ["file://d/$HOME/.bashrc"]
    assert get(derive.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))) == {"a": 1, "b": 3}
    assert get(derive.renamed_schema(F.lit("data/abstraction/todo"))) == "data/schema/task" and get(derive.link_scheme(F.lit("HTTPS://x"))) == "https"
    assert get(derive.add_tags(F.lit(None).cast("array<string>"), "a", "b")) == ["a", "b"] and get(derive.remove_tags(F.array(F.lit("a"), F.lit("b")), "a")) == ["b"]
    at, now = F.lit("2024-02-26 01:00:00").cast("timestamp"), F.lit("2024-02-29 13:00:00").cast("timestamp")
    assert get(derive.within_frame(at, "thisWeek", now)) and not get(derive.within_frame(at, "today", now)) and get(derive.within_frame(at, "thisQuarter", now))
    assert geo.EARTH > 0


def test_versions_and_backups(spark, tmp_path, batch):
    path = f"file://{tmp_path}/ix"
    ix = Index.from_docs(spark, spark.createDataFrame([], derive.DOCS))
    for k in range(3):
        ix.put_many(batch([{"schema": "data/schema/note", "data": {"content": f"text number {k}"}}]), now=now())
        ix.save(path)
    assert Index.open(spark, path).docs.count() == 3
    names = sorted(p.name for p in (tmp_path / "ix").iterdir() if p.name.startswith("manifest"))
    assert names == ["manifest-00000002.json", "manifest-00000003.json"] and len(list((tmp_path / "ix" / "docs").iterdir())) == 2
    # a manifest whose write broke off is passed over
    (tmp_path / "ix" / "manifest-00000004.json").write_text('{"version"')
    assert Index.open(spark, path).docs.count() == 3
    for k in range(4):
        held = ingest.backup(spark, path, f"file://{tmp_path}/b", f"2024-01-0{k + 1}", keep=2)
    assert [p[-2:] for p in held] == ["03", "04"] and Index.open(spark, held[-1]).docs.count() == 3
    assert [p[-2:] for p in ingest.backup(spark, path, f"file://{tmp_path}/b", "2024-01-05", keep=3, oldest="2024-01-04")] == ["04", "05"]


def test_a_limit_of_0_cuts_no_image_hits(spark):
    class Images(Index):
        def __init__(self):
            self.tables, self.tuning = {"vectors": True}, ranking.Tuning.make()

        def _space(self, space):
            return rows if space == "image" else None

        def _embedded(self, text, space):
            return [1.0, 0.0] if space == "image" else None

    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1])], "doc_id bigint, chunk_id int, vector array<float>")
    all_hits = Images().rank("x", None, limit=0, mode="vector")
    assert "Limit" not in all_hits._jdf.queryExecution().analyzed().toString()
    assert [r["doc_id"] for r in all_hits.collect()] == [1, 2]


def test_locks_have_holders_and_layers_stand_once():
    ctx = trees.ContextTree()
    ctx.insert("/a/b")
    with pytest.raises(ValueError):
        ctx.insert("/a/b/A")
    assert ctx.lock("/a/b", holder="x") and ctx.lock("/a/b", holder="y") and ctx.holders("/a/b") == ["x", "y"]
    assert ctx.lock("/a/b", False, "x") and not ctx.lock("/a/b", False, "y")
    ctx.locked = True
    ctx.lock_layer("a", holder="z")
    again = trees.ContextTree.from_json(ctx.to_json())
    assert again.locked and again.holders("/a") == ["z"]
    folders = trees.DirectoryTree()
    folders.insert("/f")
    folders.update_node("/f", colour="red")
    assert trees.DirectoryTree.from_json(folders.to_json()).node("/f").layer.extra == {"colour": "red"}


def test_approximate_search_finds_nearly_all(spark, sf, tmp_path):
    base = sf.replace("0.001", "0.1")
    rows = spark.read.parquet(f"{base}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_id"), F.col("embedding").alias("vector"))
    lists = vectors.build_lists(rows, str(tmp_path / "lists"))
    assert lists.rows.count() == rows.count() and len(lists.centroids) > 10
    assert lists.probes < len(lists.centroids)
    hit = 0
    for k in range(0, 200, 20):
        q = vectors.document_vector(rows, k)
        exact = ids(vectors.search(rows, q, limit=10))
        hit += len(set(exact) & set(ids(lists.search(q, 10))))
    assert hit >= 90
    assert ids(lists.search(q, 10, probes=len(lists.centroids))) == exact
    assert vectors.build_lists(rows.limit(0), str(tmp_path / "none")).search([1.0], 5).count() == 0


def test_command_line(spark, tmp_path, batch):
    from gleanwork import cli

    path = f"file://{tmp_path}/ix"
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "broken-door.txt").write_text("text")
    assert cli.main([path, "scan", str(tmp_path / "files")], spark) == ["1 files"]
    assert cli.main([path, "count", "+data/mime/text"], spark) == ["1"] and cli.main([path, "find"], spark) == ["100001"]
    assert "broken-door.txt" in cli.main([path, "get", "100001"], spark)[0]
    assert cli.main([path, "search", "broken"], spark)[0].startswith("100001") and cli.main([path, "tree"], spark) == ["/"]
