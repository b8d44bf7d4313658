from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gleanwork.llm import linededup, simhash
from gleanwork.llm.text import WORD, hash_of


def lines_by_hand(rows, least):
    """Documents with the first of each long line, in the order of ids."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out[i] = None
            continue
        kept = []
        for line in t.split("\n"):
            if len(line.strip(" ")) >= least:
                if line.strip(" ") in seen:
                    continue
                seen.add(line.strip(" "))
            kept.append(line)
        new = "\n".join(kept)
        if not t.strip(" \t\r\n") or new.strip(" \t\r\n"):
            out[i] = new
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (7, 3)])
def test_lines_against_brute_force(make, batches, fanout):
    rng = np.random.default_rng(batches)
    lines = [f"line number {k} of the pool, long enough to count" for k in range(40)] + ["short", "", "  padded line that counts as well  "]
    rows = [(i, "\n".join(lines[j] for j in rng.integers(0, len(lines), rng.integers(0, 9)))) for i in range(120)] + [(None, lines[0] + "\n" + lines[1]), (500, None)]
    got = linededup.dedup_lines(make([(i, t, "en", "s") for i, t in rows]), batches=batches, fanout=fanout).collect()
    assert {r["doc_id"]: r["text"] for r in got} == lines_by_hand(rows, linededup.MIN_CHARS)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_a_store_outlives_the_call(make, spark, tmp_path):
    """Batches added by different stores over one folder, through compactions; the catalogue is left as it was."""
    line = "a line that is long enough, number {}".format
    batches = [[(10 * b + k, "\n".join(line(x) for x in range(b * 2 + k, b * 2 + k + 5)), "en", "s") for k in range(4)] for b in range(6)]
    before, seen = {t.name for t in spark.catalog.listTables()}, set()
    for rows in batches:
        store = linededup.LineStore(spark, f"file://{tmp_path}/store", fanout=2)
        docs = make(rows)
        places = store.add(linededup._lines(docs, linededup.MIN_CHARS))
        got = places.join(linededup.keyed(docs), ["_ki", "_kt"]).selectExpr("doc_id", "split(text, '\n')[_n] AS line").collect()
        want = []
        for i, t, *_ in rows:
            for x in t.split("\n"):
                if x not in seen:
                    seen.add(x)
                    want.append((i, x))
        assert sorted(map(tuple, got)) == sorted(want)
    store = linededup.LineStore(spark, f"file://{tmp_path}/store")
    assert store.places().count() == len(seen) and sorted(r["level"] for r in store.runs) == [0, 0, 2]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_ids_of_any_type(spark):
    lines = ["the first of all lines here", "the second of all lines here"]
    rows = [("b", lines[0]), ("a", lines[0] + "\n" + lines[1]), ("ä", lines[1] + "\nshort"), (None, lines[1])]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string"), batches=3).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {None: lines[1], "a": lines[0], "ä": "short"}


def _shingles(text, n=5):
    w = [x.lower() for x in WORD.findall(text)]
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def test_near_copies_are_found_and_others_left(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    group = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs).collect()}
    sets = {i: _shingles(t) for i, t in rows.items() if len(t.split()) >= 30}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    shared = Counter()
    for held in index.values():
        for a in range(len(held)):
            for b in range(a):
                shared[held[b], held[a]] += 1
    near = [p for p, n in shared.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= 0.7]
    assert len(near) > 20
    hit = sum(group.get(a, -1) == group.get(b, -2) for a, b in near)
    assert hit / len(near) >= 0.9
    # members of a group are near copies of its representative or of another member
    linked = {i for p, n in shared.items() if n / min(len(sets[p[0]]), len(sets[p[1]])) >= 0.3 for i in p}
    strangers = [i for i in group if i in sets and i not in linked]
    assert len(strangers) <= 0.01 * len(rows)


def test_groups_equal_brute_force_over_fingerprints(make):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    base = [[words[j] for j in rng.integers(0, 400, 120)] for _ in range(12)]
    rows = []
    for k in range(150):
        t = list(base[k % 12])
        for _ in range(rng.integers(0, 14)):
            t[rng.integers(0, len(t))] = words[rng.integers(0, 400)]
        rows.append((k, " ".join(t), "en", "s"))
    docs = make(rows)
    f, have = simhash.fingerprints(pa.array([r[1] for r in rows]))
    assert have.all()
    label = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if np.bitwise_count(f[a] ^ f[b]).sum() <= simhash.DISTANCE:
                x, y = sorted((find(a), find(b)))
                label[y] = x
                links[a] += 1
                links[b] += 1
    size = Counter(find(k) for k in range(len(rows)))
    want = {k: (find(k), size[find(k)], links[k]) for k in range(len(rows)) if size[find(k)] > 1}
    read = lambda df: {r["doc_id"]: (r["group_id"], r["group_size"], r["n_links"]) for r in df.collect()}
    assert read(simhash.near_duplicates(docs)) == want
    assert simhash.keep_one(docs).count() == len(size)
    # neither the partitions of the input nor the blocks matter
    assert read(simhash.near_duplicates(docs.repartition(50))) == want == read(simhash.near_duplicates(docs.coalesce(1), block_rows=7, task_rows=5))


def fingerprint_by_hand(text, hash_of=hash_of):
    """A SimHash written out: for each of 192 bits, the majority of the distinct words' hash bits."""
    hashes = [splitmix((h >> 20) + 0x9E3779B97F4A7C15) for h in {hash_of(m.group().lower()) for m in WORD.finditer(text)}]
    bits = []
    for _ in range(3):
        bits += [2 * sum(h >> (8 * byte + bit) & 1 for h in hashes) > len(hashes) for byte in range(8) for bit in range(8)]
        hashes = [splitmix(h + 0x9E3779B97F4A7C15) for h in hashes]
    return bits


def splitmix(h):
    m = (1 << 64) - 1
    h &= m
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m
    h = (h ^ h >> 27) * 0x94D049BB133111EB & m
    return h ^ h >> 31


def test_fingerprints_against_a_naive_simhash(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()] + ["one", "", "x " * 700]
    f, _ = simhash.fingerprints(pa.array(texts))
    for k, t in enumerate(texts):
        if WORD.search(t):
            # packed with the bits of each byte apart, the lowest first
            got = np.unpackbits(f[k].view(np.uint8)).reshape(3, 8, 8).transpose(0, 2, 1)
            assert (got == np.array(fingerprint_by_hand(t)).reshape(3, 8, 8)).all()


def test_a_group_that_holds_a_third_of_all_rows(make):
    """Near copies of one text, so many that its words are the commonest of the corpus."""
    rng = np.random.default_rng(41)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    base, texts = say(120), []
    for _ in range(300):
        t = list(base)
        t[int(rng.integers(0, 120))] = "changed" + say(1)[0]
        texts.append(" ".join(t))
    texts += [" ".join(say(120)) for _ in range(600)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(make([(k, t, "en", "s") for k, t in enumerate(texts)])).collect()}
    assert set(got) == set(range(300)) and {(r["group_id"], r["group_size"], r["n_links"]) for r in got.values()} == {(0, 300, 299)}


def test_all_pairs_within_the_distance_are_found_by_band(make):
    rng = np.random.default_rng(11)
    texts = []
    for k in range(300):
        t = rng.integers(0, 50_000, 100)
        copy = t.copy()
        at = rng.choice(100, 8 + k % 9, replace=False)
        copy[at] = rng.integers(50_000, 90_000, len(at))
        texts += [" ".join(f"w{x}" for x in t), " ".join(f"w{x}" for x in copy)]
    docs = make([(k, t, "en", "s") for k, t in enumerate(texts)])
    f, _ = simhash.fingerprints(pa.array(texts))
    group = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs).collect()}
    bands = defaultdict(list)
    for a in range(len(texts)):
        for b in np.flatnonzero(np.bitwise_count(f[a] ^ f[a + 1 :]).sum(1) <= simhash.DISTANCE) + a + 1:
            bands[int(np.bitwise_count(f[a] ^ f[b]).sum()) // 4].append(group.get(a, -1) == group.get(int(b), -2))
    assert min(len(bands[b]) for b in (6, 7, 8)) >= 20
    assert {b: sum(hit) / len(hit) for b, hit in bands.items()} == dict.fromkeys(bands, 1.0)


@pytest.mark.parametrize("distance", [0, 10, 31, 38, 45])
def test_every_pair_within_the_distance_counts_once(distance):
    rng = np.random.default_rng(distance)
    shared = simhash.shared_in_group(distance)
    f = rng.integers(0, 256, (200, 24), dtype=np.uint8)
    bits = np.unpackbits(f, axis=1)
    for row in bits:
        row[rng.choice(192, distance, replace=False)] ^= 1
    a, b = f.view(np.uint64), np.packbits(bits, axis=1).view(np.uint64)
    same = simhash.keys_of(a, shared) == simhash.keys_of(b, shared)
    keys = simhash.keys_of(a, shared)
    one = np.ones(2, np.int64)
    for k in range(200):
        found = [simhash._links(int(key), np.stack([a[k], b[k]]), one, None, distance) for key in keys[k][same[k]]]
        assert sum(links[0] for _, links in found) == 1 and any(root[1] == 0 for root, _ in found)


@pytest.mark.parametrize("bits", [0, 3, 9, 16])
@pytest.mark.parametrize("two", [False, True])
def test_lists_against_brute_force_whatever_is_looked_up(monkeypatch, bits, two):
    """Rows of few values, so that lists are long, with weights; of two blocks only pairs across them count."""
    rng = np.random.default_rng(bits)
    bits_of = lambda *shape: rng.integers(0, 2, shape, dtype=np.uint8)
    base = bits_of(40, 192)
    rows = base[rng.integers(0, 40, 700)] ^ (rng.random((700, 192)) < rng.uniform(0, 0.2, (700, 1)))
    f, weight = np.packbits(rows, axis=1).view(np.uint64), rng.integers(1, 5, 700)
    side = rng.random(700) < 0.4 if two else None
    monkeypatch.setattr(simhash, "_key_bits", lambda *_: bits)
    near = (rows[:, None] != rows[None]).sum(2) <= simhash.DISTANCE
    np.fill_diagonal(near, False)
    if two:
        near &= side[:, None] != side[None]
    keys = simhash.keys_of(f, simhash.shared_in_group(simhash.DISTANCE))[0]
    found = [simhash._links(int(key), f, weight, side, simhash.DISTANCE) for key in keys]
    assert (sum(links for _, links in found) == near @ weight).all() and near.sum() > 1000
    at = np.arange(700)
    label = simhash._spanning(700, np.concatenate([at] * len(found)), np.concatenate([root for root, _ in found]))
    assert (label == simhash._spanning(700, *np.nonzero(near))).all()


def test_few_of_all_pairs_are_compared():
    """The share falls as a table grows, for all its groups together; it was 0.137 for any table."""

    def share(rows):
        return sum(len(simhash._ball(b, t)) / (1 << b) for t in (simhash._BITS - simhash.shared_in_group(simhash.DISTANCE)).tolist() for b in [simhash._key_bits(rows, rows, t)])

    shares = [share(rows) for rows in (30_000, 240_000, 1_000_000, 4_000_000)]
    assert shares == sorted(shares, reverse=True) and shares[2] < 0.1 and shares[3] < 0.06
