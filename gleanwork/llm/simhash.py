"""SimHash near-dedup over an inverted index of groups of bits, of which one is guaranteed to be near.

A document's fingerprint is a SimHash of its distinct words: 192 bits, all of them indexed. Each word counts once, so that the few words
that texts of a language have most of don't make unrelated texts alike; no statistics of the corpus enter, so a fingerprint depends on its text
alone, and no word is lost to a copy because there are many copies.

All 192 bits are 12 groups of 16. Let a group tolerate so many differing bits that the tolerances, each plus 1, sum to the distance plus 1
(2, 2, 2 and 3 in turn for 38). Then of two fingerprints within the distance, whichever bits differ, one group differs in no more than
its tolerance, and there is such a group where it and the three behind it, in a ring, also stay below the sum of their tolerances plus 1:
start behind the group at which the running sum of excesses is highest. So each group is a list of all fingerprints, sorted by the group's
value, in which every one meets those whose values differ in no more bits than tolerated; of these pairs the 64 bits of the four groups
are compared, and all 192 where they are near enough. Exactly the pairs within the distance are found. Of more fingerprints more bits of the
values are looked up, so the share of all pairs that is compared falls, to 5 % (were the values evenly spread) where all 16 are; blocks of
half a million look up 14 to 16. From there on comparisons grow with the square of the number of different fingerprints.

A pair that is near in several groups counts in the lowest one only, so the number of links of each document is exact. Documents of
equal fingerprint are one node of the index, which carries their number, so thousands of copies don't make millions of pairs; nothing
is capped. A list of more than `block_rows` fingerprints is cut into blocks of about that size, and each pair of blocks is a task's
work: no task holds more than two blocks, however many rows there are. A task reports, for each node, the number of its links and one
link towards the others it met, not all pairs. Groups are the connected components, found with large-star and small-star steps until nothing changes; those steps
are minima by key and joins, so a node of very many links is no single row.

Defined results: null texts and texts without words are in no group; a null doc_id is a document like others, never
chosen over one with an id; repeated rows are copies of each other; the representative is the lowest doc_id, then text hash; an
empty table gives an empty result; other columns pass through `keep_one`, whatever their names. Nothing depends on how the input
is partitioned.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import discard, isolated, keyed, materialize, row_key
from .text import mix, word_hashes

#: Production parameter.
DISTANCE = 38
#: Rows of the index that a task is given about, as long as their keys are no larger; and the most of one key in a block.
TASK_ROWS, BLOCK_ROWS = 400_000, 500_000
_GROUPS, _BITS, _RUN = 12, 16, 4
#: Pairs held before they are reduced to spanning links, or looked at over all bits; pairs compared at once.
_HELD, _MET, _AT_ONCE = 1 << 20, 1 << 17, 1 << 15
_LANE = np.uint64(0x0101010101010101)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NODE = "struct<a:bigint,b:bigint,c:bigint>"


def _distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each distinct word of each text, of 44 bits of its own, and where each text's words begin."""
    h, offs = word_hashes(column)
    n = len(offs) - 1
    key = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offs)) << np.uint64(44) | h >> np.uint64(20)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return mix((key & np.uint64((1 << 44) - 1)) + _STEP), np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(44))


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Three 64-bit words for each text, and whether it has words."""
    if len(column) >= 1 << 20:
        parts = [fingerprints(column.slice(k, 1 << 19)) for k in range(0, len(column), 1 << 19)]
        return np.concatenate([f for f, _ in parts]), np.concatenate([have for _, have in parts])
    h, offs = _distinct(column)
    n = len(offs) - 1
    have = np.diff(offs) > 0
    out = np.zeros((n, 3), np.uint64)
    size = np.diff(offs)
    full = np.flatnonzero(size)
    if not len(full):
        return out, have
    # sums of at most 255 words fit the byte lanes of a 64-bit integer
    blocks = -(-size[full] // 255)
    begin = np.repeat(offs[:-1][full], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    owner = np.cumsum(blocks) - blocks
    for k in range(3):
        sums = np.empty((len(begin), 8), np.uint64)
        for lane in range(8):
            sums[:, lane] = np.add.reduceat((h >> np.uint64(lane)) & _LANE, begin)
        bits = np.add.reduceat(sums.view(np.uint8).astype(np.int64), owner, axis=0)
        out[full, k] = np.packbits(bits * 2 > size[full][:, None], axis=1).view(np.uint64)[:, 0]
        h = mix(h + _STEP)
    return out, have


def shared_in_group(distance: int) -> np.ndarray:
    """For each group, the bits that two fingerprints within the distance share at least in one of the groups; more than there are: never needed."""
    if not 0 <= distance < 64:
        raise ValueError("distance is 0 to 63")
    each, more = divmod(distance + 1, _GROUPS)
    at = np.arange(_GROUPS + 1) * more // _GROUPS
    return _BITS + 1 - each - np.diff(at)


def keys_of(f: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Lists that each fingerprint is in: the groups that may be the near one."""
    return np.tile(np.flatnonzero(shared <= _BITS).astype(np.int32), (len(f), 1))


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest row of each row's component."""
    label = np.arange(n, dtype=np.int32)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        label = new[label]
        different = label[a] != label[b]
        a, b = a[different], b[different]
    return label


def _near_runs(x: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Whether a group is near, and so are it and those behind it: pairs, groups. x: the fingerprints' differences."""
    apart = np.bitwise_count(np.ascontiguousarray(x).view(np.uint16))
    run = sum(np.roll(apart, -k, 1) for k in range(_RUN))
    return (apart <= _BITS - shared) & (run <= _run_limits(shared))


def _run_limits(shared: np.ndarray) -> np.ndarray:
    return sum(np.roll(_BITS + 1 - shared, -k) for k in range(_RUN)) - 1


def _ball(bits: int, tolerance: int) -> np.ndarray:
    """Values of some bits of which no more than the tolerated number are set."""
    x = np.arange(1 << bits)
    return x[np.bitwise_count(x) <= tolerance]


def _key_bits(left: int, right: int, tolerance: int) -> int:
    """Bits of a group by which rows are looked up: the cheapest, of a look-up for each value and the comparisons it leaves (microseconds)."""

    def cost(bits: int) -> float:
        near = sum(comb(bits, k) for k in range(min(bits, tolerance) + 1))
        met = right * near / (1 << bits)
        return min(left, 1 << bits) * (60 + 0.03 * near + 0.01 * met) + left * met * 0.0012

    return min(range(_BITS + 1), key=cost)


def _met(value: np.ndarray, other: np.ndarray | None, run: np.ndarray, other_run: np.ndarray, bits: int, tolerance: int, limit: int):
    """Rows a and b of pairs whose values (sorted) differ in no more than the tolerated bits and whose runs are within the limit. Without
    other values the pairs are of rows of one table, each once."""
    ball, one = _ball(bits, tolerance), other is None
    begin = np.searchsorted(value if one else other, np.arange((1 << bits) + 1))
    xor, count = np.empty(_AT_ONCE, np.uint64), np.empty(_AT_ONCE, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(value)) + 1, [len(value)]])
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if len(value) else ():
        near = ball ^ int(value[lo])
        if one:
            near = near[near >= value[lo]]
        at, n = begin[near], begin[near + 1] - begin[near]
        ends = np.cumsum(n)
        b = np.arange(ends[-1]) + np.repeat(at - ends + n, n)
        theirs = other_run[b]
        for k in range(0, len(b), _AT_ONCE):
            some = theirs[k : k + _AT_ONCE]
            step = _AT_ONCE // len(some)
            for i in range(lo, hi, step):
                own = run[i : min(i + step, hi)]
                size = len(own) * len(some)
                np.bitwise_xor(own[:, None], some, out=xor[:size].reshape(len(own), -1))
                hit = np.flatnonzero(np.bitwise_count(xor[:size], out=count[:size]) <= limit)
                if len(hit):
                    row, col = np.divmod(hit, len(some))
                    row, col = row + i, b[col + k]
                    if one:
                        row, col = row[row < col], col[row < col]
                    yield row, col


def _links(key: int, f: np.ndarray, weight: np.ndarray, side: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one list: lowest row of each row's component, and the weight of its links, by the pairs within the distance that count
    there, as the list's group is the lowest near one. side: with two blocks, pairs within one count elsewhere."""
    shared = shared_in_group(distance)
    tolerance, limit = int(_BITS - shared[key]), int(_run_limits(shared)[key])
    root, links, left, right, held = np.arange(len(f), dtype=np.int32), np.zeros(len(f), np.int64), [], [], 0
    rows = [x.astype(np.int32) for x in ([np.arange(len(f))] if side is None else [np.flatnonzero(side), np.flatnonzero(~side)])]
    bits = _key_bits(len(rows[0]), len(rows[-1]), tolerance)
    sorted_, values, runs = [], [], []
    for r in rows:
        groups_ = np.ascontiguousarray(f).view(np.uint16)[:, (key + np.arange(_RUN)) % _GROUPS][r]
        value = groups_[:, 0] >> np.uint16(_BITS - bits) if bits else np.zeros(len(r), np.uint16)
        order = np.argsort(value, kind="stable")
        sorted_.append(r[order])
        values.append(value[order])
        runs.append(np.ascontiguousarray(groups_[order]).view(np.uint64)[:, 0])

    def reduced() -> np.ndarray:
        moved = np.flatnonzero(root != np.arange(len(f), dtype=np.int32)).astype(np.int32)
        return _spanning(len(f), np.concatenate([moved, *left]), np.concatenate([root[moved], *right]))

    def looked_at(met: list) -> int:
        a, b = sorted_[0][np.concatenate([a for a, _ in met])], sorted_[-1][np.concatenate([b for _, b in met])]
        x = f[a] ^ f[b]
        near = np.flatnonzero(np.bitwise_count(x).sum(1) <= distance)
        near = near[_near_runs(x[near], shared).argmax(1) == key]
        a, b = a[near], b[near]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        left.append(a)
        right.append(b)
        return len(a)

    met, waiting = [], 0
    for pair in _met(values[0], values[1] if side is not None else None, runs[0], runs[-1], bits, tolerance, limit):
        met.append(pair)
        waiting += len(pair[0])
        if waiting > _MET:
            held += looked_at(met)
            met, waiting = [], 0
            if held > _HELD:
                root, left, right, held = reduced(), [], [], 0
    if met:
        looked_at(met)
    return (reduced() if left else root), links


def _search(batches, distance: int):
    """Each node that has a link here: u, a node v it is linked to (itself, if it is the lowest of those), and the weight of its links."""
    held: list[list[np.ndarray]] = [[], [], [], []]
    for b in batches:
        if b.num_rows:
            for column, c in zip(held, ("list", "side", "weight"), strict=False):
                column.append(b.column(c).to_numpy(zero_copy_only=False).copy())
            held[3].append(np.stack([b.column(c).to_numpy() for c in ("f1", "f2", "f3")], 1).view(np.uint64))
    if not held[0]:
        return
    list_, side, weight, f = (np.concatenate(held.pop(0)) for _ in range(4))
    order = np.argsort(list_, kind="stable")
    # most tasks have one list, which needs no copy
    lists = np.split(order, np.flatnonzero(np.diff(list_[order])) + 1) if list_.min() < list_.max() else [slice(None)]
    del order
    for rows in lists:
        key, two = divmod(int(list_[rows][0]), 2)
        nodes = f[rows]
        root, links = _links(key & 0xFFFF, nodes, weight[rows], side[rows] if two else None, distance)
        at = np.flatnonzero(links)
        u, v = nodes[at].view(np.int64), nodes[root[at]].view(np.int64)
        as_node = lambda x: pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(3)], ["a", "b", "c"])
        yield pa.RecordBatch.from_arrays([as_node(u), as_node(v), pa.array(links[at])], ["u", "v", "n"])


def _components(links: DataFrame) -> DataFrame:
    """u and its component's lowest node v, for every node that isn't the lowest of its own. links: pairs u, v in any order."""

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        out = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.unionByName(low.select("u", F.col("m").alias("v"))).distinct()

    e = materialize(links.filter(F.col("u") != F.col("v")).select("u", "v").distinct(), "simhash-links")
    sign = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            return e
        old, sign = e, now
        e = materialize(small(large(e)), "simhash-links")
        discard(old)


def _tasks(sizes: dict[int, int], task_rows: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of each key, where each key's pairs of blocks begin in the third, and the task of each pair; small keys share one."""
    blocks, base = np.zeros((2, max(sizes, default=0) + 1), np.int64)
    out, task, held = [], 0, 0
    for key, n in sorted(sizes.items()):
        blocks[key], base[key] = -(-n // block_rows), len(out)
        for i in range(blocks[key]):
            for j in range(i, blocks[key]):
                rows = n // int(blocks[key]) * (1 + (i < j))
                if held and held + rows > task_rows:
                    task, held = task + 1, 0
                out.append(task)
                held += rows
    return blocks, base, np.array(out or [0], np.int32)


def groups(docs: DataFrame, distance: int = DISTANCE, task_rows: int = TASK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """_id, _tx, number of such rows, the key (_gi, _gt) and size of the group, and the number of links of each such row, for every
    document in a group of two or more rows."""
    shared = shared_in_group(distance)

    def run(batches):
        for b in batches:
            f, have = fingerprints(b.column("text"))
            f = f.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_tx"), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(3)), pa.array(have)], ["_id", "_tx", "f1", "f2", "f3", "have"])

    source = docs.select(*row_key(), "text")
    kind = source.schema["_id"].dataType.simpleString()
    prints = source.mapInArrow(run, f"_id {kind}, _tx bigint, f1 bigint, f2 bigint, f3 bigint, have boolean").filter("have").drop("have")
    prints = materialize(prints, "simhash-prints")
    nodes = materialize(prints.groupBy("f1", "f2", "f3").agg(F.count("*").alias("weight")), "simhash-nodes")

    # each list has all fingerprints
    n = nodes.count()
    sizes = dict.fromkeys(keys_of(np.empty((1, 3), np.uint64), shared)[0].tolist(), n) if n > 1 else {}
    rows = -(-sum(sizes.values()) // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks, base, tasks = _tasks(sizes, max(1, min(task_rows, rows)), block_rows)

    def index(batches):
        for b in batches:
            f = np.stack([b.column(c).to_numpy() for c in ("f1", "f2", "f3")], 1).view(np.uint64)
            keys = keys_of(f, shared)
            row, key = np.repeat(np.arange(len(f)), keys.shape[1]), keys.reshape(-1).astype(np.int64)
            some = key < len(blocks)
            row, key = row[some], key[some]
            of = blocks[key]
            row, key, of = row[of > 0], key[of > 0], of[of > 0]
            own = ((mix(f[row, 0] ^ mix(f[row, 1])) >> np.uint64(1)) % of.astype(np.uint64)).astype(np.int64)
            again = np.repeat(np.arange(len(row)), of)
            other = np.arange(len(again)) - np.repeat(np.cumsum(of) - of, of)
            row, key, own, of = row[again], key[again], own[again], of[again]
            low, high = np.minimum(own, other), np.maximum(own, other)
            task = tasks[base[key] + low * of - low * (low - 1) // 2 + high - low]
            # a list is named by its blocks, its key, and whether the blocks are two
            name = ((low << 20 | high) << 16 | key) << 1 | (low < high)
            out = b.select(["f1", "f2", "f3", "weight"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(name), pa.array(own == low), *out.columns], ["task", "list", "side", "f1", "f2", "f3", "weight"])

    rows = nodes.mapInArrow(index, "task int, list bigint, side boolean, f1 bigint, f2 bigint, f3 bigint, weight bigint")
    found = rows.repartitionById(int(tasks[-1]) + 1, F.col("task")).drop("task").mapInArrow(lambda it: _search(it, distance), f"u {_NODE}, v {_NODE}, n bigint")
    found = materialize(found, "simhash-found")
    degree = found.groupBy("u").agg(F.sum("n").alias("_links"))
    comp = _components(found).select("u", F.col("v").alias("_root"))
    print_ = F.struct(F.col("f1").alias("a"), F.col("f2").alias("b"), F.col("f3").alias("c"))
    keyed_ = prints.groupBy("_id", "_tx", print_.alias("u")).agg(F.count("*").alias("_rows"))
    # nodes with a link or of several rows; of the rest nothing is in a group
    known = nodes.select(print_.alias("u"), "weight").join(degree, "u", "left").filter((F.col("weight") > 1) | F.col("_links").isNotNull())
    known = known.join(comp, "u", "left").select("u", F.coalesce("_root", "u").alias("_root"), (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("_links"))
    keyed_ = materialize(keyed_.join(known, "u"), "simhash-grouped")
    lead = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_tx").alias("t")))
    every = keyed_.groupBy("_root").agg(lead.alias("_lead"), F.sum("_rows").alias("_size"))
    return keyed_.join(every, "_root").select("_id", "_tx", "_rows", F.col("_lead.i").alias("_gi"), F.col("_lead.t").alias("_gt"), "_size", "_links")


@isolated
def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, group_id (the representative's doc_id), group_size and n_links (other documents within the distance), one row for each document in a group."""
    g = groups(docs, **parameters)
    g = g.select("_id", "_gi", "_size", "_links", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_k"))
    return g.select(F.col("_id").alias("doc_id"), F.col("_gi").alias("group_id"), F.col("_size").alias("group_size"), F.col("_links").alias("n_links"))


@isolated
def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without those that have a better representative of their group."""
    g = groups(docs, **parameters)
    lead = F.col("_id").eqNullSafe(F.col("_gi")) & (F.col("_tx") == F.col("_gt"))
    g = g.select(F.xxhash64(F.lit(3), "_id").alias("_xi"), F.col("_tx").alias("_xt"), (~lead).alias("_other"))
    d = keyed(docs)
    # the join and the window have the same keys, none of them null, so texts move once
    d = d.join(g, (d["_ki"] == g["_xi"]) & (d["_kt"] == g["_xt"]), "left").filter(~F.coalesce("_other", F.lit(False)))
    d = d.withColumn("_nth", F.row_number().over(Window.partitionBy("_ki", "_kt").orderBy("_ki")))
    # of repeated rows one stays; rows in no group (without words) all stay
    return d.filter(F.col("_other").isNull() | (F.col("_nth") == 1)).select(*docs.columns)
