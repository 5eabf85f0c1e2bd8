"""SimHash fingerprints, Hamming links found through vantage-point trees, and their connected components.

A vantage-point tree is grown on the driver from a sample of at most ``TREE_SAMPLE`` distinct fingerprints, so its
size is bounded; every distinct fingerprint is then sent down it. At a node with vantage v and radius r a
fingerprint goes inside where d(f, v) <= r, and outside where d(f, v) > r - limit. By the triangle inequality two
fingerprints within `limit` of each other always meet in one of the two: shards overlap at the boundary only.
Inside a shard fingerprints within `limit` bits agree in one of limit + 1 blocks of bits, so only those that share a block are
compared; where many share one, they are split by further vantage points, and what is left is compared exactly. Shards return
one link to a smallest member per local component, never the pairs of a dense group.

At a shingle similarity of 0.8 fingerprints differ in some 15 of 100 bits, where triangle bounds prune nothing. For
that width (`one_of_each`) a document has ``BANDS`` 64-bit SimHash fingerprints more, each of a sample of ``ROWS`` of its
shingles (those of least hash), and documents meet where the tree finds such fingerprints within `LIMIT` bits; inside each
such part 256-bit fingerprints of all shingles are compared under a limit that near copies hardly miss, and
links go to a smallest member as above. The components of these links are candidates only: inside each the shingle
sets themselves are compared, and links of a similarity of 0.8 or more make the classes.
Parts of more than ``SHARD_SIZE`` are dealt into blocks, and every two blocks of a part meet in a task of their own: the
links of a large part are those of one comparison of all its members, at a cost that grows with the square of the part.

Null text: as empty, fingerprint zero, linked like any other. Fewer words than a shingle: the whole sequence is
the shingle. Repeated rows: each is a document. Null id: never a component's name unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import packed, small, texts

SHINGLE = 3
LIMIT = 2
SEED = 42
TREE_SAMPLE = 20_000
SHARD_SIZE = 4096
# a sample's fingerprint weighs this much less than a document in a shard; fewer shards overlap less
LIGHT = 16
# fingerprints that are sent down the tree together
AT_ONCE = 262_144
# fingerprints that share a block of bits and are still compared pair by pair, and pairs held at once in a shard
RUN = 64
PAIRS = 1_000_000
# shingles of the documents that are compared in one task
SHARD_SHINGLES = 2_000_000
# the wide form: the share of the shingles that near copies have in common, as a fraction
SIMILAR = (4, 5)
# bits in which candidates may differ: sets of a similarity of 0.8 differ in 39 of 256 on average, the smallest in 48,
# with a deviation of 6; 64-bit words, keys and minima per key
WIDE_LIMIT = 80
WORDS = 4
BANDS, ROWS = 20, 6
_RANDOM = np.random.default_rng(SEED)
FACTORS = _RANDOM.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _RANDOM.integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = _RANDOM.integers(0, 2**63, WORDS, np.uint64)
BYTES = _RANDOM.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RANDOM.integers(0, 2**61)) * 8 + 5
_POWERS = np.ones((2, 1), np.uint64)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(shingle, len(words))
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    begin = end - length
    one = xxhash.xxh64_digest
    n = len(words) - size + 1
    found = b"".join([one(joined[a:b], SEED) for a, b in zip(begin[:n].tolist(), end[size - 1 :].tolist())])
    return np.frombuffer(found, ">u8").astype(np.uint64)


def ascending(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _powers(n: int) -> np.ndarray:
    """The powers 0 to n of BASE, and of its inverse, modulo 2^64."""
    if _POWERS.shape[1] <= n:
        factors = np.array([[BASE], [pow(BASE, -1, 2**64)]], np.uint64).repeat(2 * n, axis=1)
        globals()["_POWERS"] = np.concatenate((np.ones((2, 1), np.uint64), np.cumprod(factors, axis=1, dtype=np.uint64)), axis=1)
    return _POWERS


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Ascending hashes of the distinct shingles, for the wide form: each is a polynomial of the shingle's bytes, as the difference of
    two running sums, and mixed."""
    joined = np.frombuffer(b" ".join(text.encode().lower().split()), np.uint8)
    if not len(joined):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(joined))
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(BYTES[joined] * power[: len(joined)], out=sums[1:])
    end = np.append(np.flatnonzero(joined == 32), len(joined))
    begin = np.append(0, end[:-1] + 1)
    size = min(shingle, len(end))
    begin = begin[: len(end) - size + 1]
    return ascending(_mixed((sums[end[size - 1 :]] - sums[begin]) * inverse[begin]))


def majorities(hashes: np.ndarray) -> np.ndarray:
    """The bits that over half of the rows have, of rows of one or more words."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 255):  # so many ones fit in a byte
        some = hashes[at : at + 255].astype("<u8")
        ones += np.add.reduce(np.unpackbits(some.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    return int(majorities(hashes[:, None])[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set where over half of the shingles' hashes have it."""
    return majority(shingle_hashes(text, shingle))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def sample_fingerprints(least: np.ndarray) -> np.ndarray:
    """The SimHash of each of BANDS samples, of the ROWS shingles whose hashes are `least`."""
    hashes = _mixed(_mixed(least).reshape(BANDS, ROWS) * MIX)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(BANDS, ROWS, 8), axis=2, bitorder="little")
    return np.packbits(bits.sum(axis=1) * 2 > ROWS, axis=1, bitorder="little").view("<u8")[:, 0]


def wide_fingerprint(hashes: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The words of a SimHash of WORDS * 64 bits, and the fingerprints of BANDS samples of the shingles."""
    words = majorities(_mixed(hashes[:, None] ^ SALTS)).tolist()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[at : at + 256, None] * FACTORS).min(axis=0), out=least)
    return words, sample_fingerprints(least)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, **columns: str) -> DataFrame:
    """doc_id, u1, u2 (the row's key) and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.text], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "u2": batch.u2, "fp": fp})

    t = texts(docs, **columns)
    return t.withColumn("u2", F.xxhash64(F.col("doc_id").isNull(), "text")).mapInPandas(run, "doc_id long, u2 long, fp long")


def distances(fps: np.ndarray, vantage: np.int64) -> np.ndarray:
    return np.bitwise_count((fps ^ vantage).view(np.uint64))


def _split(fps: np.ndarray, pick: int, limit: int) -> tuple[np.int64, int, np.ndarray] | None:
    """Vantage, radius and distances of a useful split; None where one child would hold nearly everything."""
    vantage = fps[pick % len(fps)]
    d = distances(fps, vantage)
    within = np.bincount(d, minlength=65).cumsum()
    radius = int(np.searchsorted(within, (len(fps) + 1) // 2))
    if within[radius] == len(fps):
        radius -= 1
    if radius < 0 or within[radius] - (within[radius - limit] if radius >= limit else 0) > 0.7 * len(fps):
        return None
    return vantage, radius, d


def grow_tree(sample: np.ndarray, leaf: int, limit: int = LIMIT) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inside, outside); a negative child -k - 1 is shard k. The sample bounds the tree."""
    nodes: list[list[int]] = []
    shards = 0

    def place(fps: np.ndarray) -> int:
        nonlocal shards
        cut = _split(fps, len(fps) * 7919 // 104729 + len(nodes), limit) if len(fps) > max(leaf, 2) else None
        if cut is None:
            shards += 1
            return -shards
        vantage, radius, d = cut
        nodes.append([int(vantage), radius, 0, 0])
        at = len(nodes) - 1
        nodes[at][2] = place(fps[d <= radius])
        nodes[at][3] = place(fps[d > radius])
        return at

    root = place(np.sort(sample))
    assert root <= 0
    return [tuple(n) for n in nodes]


def shards_of(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], limit: int = LIMIT) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in fps): each fingerprint's own shard and those it overlaps."""
    if not nodes:
        yield 0, np.arange(len(fps))
        return
    stack = [(0, np.arange(len(fps)))]
    while stack:
        at, rows = stack.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -at - 1, rows
            continue
        vantage, radius, inside, outside = nodes[at]
        d = distances(fps[rows], np.int64(vantage)).astype(np.int64)
        stack.append((inside, rows[d <= radius]))
        stack.append((outside, rows[d > radius - limit]))


def local_links(fps: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest of its part) that connect exactly what pairs within `limit` connect."""
    fps = ascending(fps)
    n = len(fps)
    ends = np.linspace(0, 64, limit + 2).astype(int).tolist()
    a, b = [], []
    for low, high in zip(ends, ends[1:]):
        block = (fps.view(np.uint64) >> np.uint64(low)) & np.uint64(2 ** (high - low) - 1)
        order = np.argsort(block)
        block, sorted_fps = block[order], fps[order]
        first = np.flatnonzero(np.r_[n > 0, block[1:] != block[:-1]])
        size = np.diff(np.r_[first, n])
        for one, other in run_pairs(size):
            near = distances(sorted_fps[one], sorted_fps[other]) <= limit
            a.append(order[one[near]])
            b.append(order[other[near]])
            if sum(map(len, a)) > n + PAIRS:
                a, b = _stars(n, a, b)
        for k in np.flatnonzero(size > RUN).tolist():
            member, least = split_links(sorted_fps[first[k] : first[k] + size[k]], limit)
            a.append(np.searchsorted(fps, least))
            b.append(np.searchsorted(fps, member))
            if sum(map(len, a)) > n + PAIRS:
                a, b = _stars(n, a, b)
    if not any(map(len, a)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    (root,), (moved,) = _stars(n, a, b)
    return fps[moved], fps[root]


def run_pairs(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of places inside runs of these sizes that lie one behind the other; longer runs than RUN are left out."""
    ends = np.cumsum(size)
    after = np.repeat(ends, size) - np.arange(size.sum()) - 1  # members of its run behind each place
    at = np.flatnonzero(np.repeat((size > 1) & (size <= RUN), size))
    for step in range(1, RUN):
        at = at[after[at] >= step]
        if not len(at):
            break
        yield at, at + step


def _stars(n: int, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The smallest members, and what they connect, in place of the links a-b."""
    root = _join(n, np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(root != np.arange(n))
    return [root[moved]], [moved]


def split_links(fps: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """`local_links` of a part that is split by vantage points as the tree is."""
    left, right = [], []
    stack = [ascending(fps)]
    turn = 0
    while stack:
        part = stack.pop()
        turn += 1
        if len(part) < 2:
            continue
        cut = _split(part, turn * 7919, limit) if len(part) > 256 else None
        if cut is not None:
            _, radius, d = cut
            d = d.astype(np.int64)
            stack += [part[d <= radius], part[d > radius - limit]]
        elif len(part) <= 1024:
            a, b = np.nonzero(np.triu(np.bitwise_count((part[:, None] ^ part[None, :]).view(np.uint64)) <= limit, 1))
            if len(a):
                root = _join(len(part), a, b)
                moved = np.flatnonzero(root != np.arange(len(part)))
                left.append(part[moved])
                right.append(part[root[moved]])
        else:
            _walk(part, limit, left, right)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _join(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each item's component, for links a-b inside one small part."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _walk(part: np.ndarray, limit: int, left: list, right: list) -> None:
    """A dense part: visit each component once, comparing with what is not yet visited; memory stays linear."""
    rest = part
    while len(rest):
        start, rest = rest[0], rest[1:]
        front = [start]
        while front and len(rest):
            near = distances(rest, front.pop()) <= limit
            found = rest[near]
            rest = rest[~near]
            left.append(found)
            right.append(np.full(len(found), start))
            front.extend(found)


def sent(batches: Iterator[np.ndarray], nodes: list[tuple[int, int, int, int]], limit: int = LIMIT, at_once: int = AT_ONCE) -> Iterator[pd.DataFrame]:
    """shard and fps, one row for the fingerprints of some `at_once` that go to a shard: neither the walk down the tree nor the
    rows are paid for by small batches, whose number grows with the input as that of the shards does."""
    held: list[np.ndarray] = []

    def walked() -> pd.DataFrame:
        fps = np.concatenate(held)
        found = [(shard, fps[rows].astype("<i8").tobytes()) for shard, rows in shards_of(fps, nodes, limit)]
        return pd.DataFrame(found, columns=["shard", "fps"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= at_once:
            yield walked()
            held = []
    if held:
        yield walked()


def links(distinct: DataFrame, limit: int = LIMIT, shard_size: int = SHARD_SIZE, sample_size: int = TREE_SAMPLE) -> DataFrame:
    """(fp, root) links between distinct fingerprints, through the shards of one vantage-point tree."""
    total = distinct.count()
    # each partition sends the driver its least hashes: of few, as at most some twice the sample lie below the bound
    bound = -(2**63) + 2**64 * 2 * sample_size // max(total, 1)
    low = distinct.select("fp").filter(F.xxhash64("fp") < bound) if bound < 2**63 else distinct.select("fp")
    sample = low.orderBy(F.xxhash64("fp"), "fp").limit(sample_size).toPandas().fp.to_numpy()
    nodes = grow_tree(sample, max(2, round(shard_size * len(sample) / max(total, 1))), limit) if total > shard_size else []

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return sent((batch.fp.to_numpy() for batch in batches), nodes, limit)

    def close(shard: pd.DataFrame) -> pd.DataFrame:
        a, b = local_links(np.frombuffer(b"".join(shard.fps), "<i8"), limit)
        return pd.DataFrame({"fp": a, "root": b})

    return distinct.select("fp").mapInPandas(send, "shard int, fps binary").groupBy("shard").applyInPandas(close, "fp long, root long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp, root: each linked node's smallest connected node. Large-star and small-star rounds: a round replaces the
    links of a node by links to its least neighbour; nothing but a minimum per node is gathered."""
    edges = settle(edges.select(F.greatest("fp", "root").alias("a"), F.least("fp", "root").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(down, "a")
        small = near.select("a", F.col("m").alias("b")).union(near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = settle(small.distinct())
        # a fixed point: the sum over links no longer changes
        state = edges.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        before = state


def distinct_prints(prints: DataFrame, *more: str) -> DataFrame:
    """One row per fp: the first row that has it (`first`), with its columns `more`."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "u2", *more)
    return settle(prints.groupBy("fp").agg(F.min(key).alias("first")))


def named_classes(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, component_id (smallest doc_id) and the key of the row that stands for the component (keep_*)."""
    named = distinct.join(components(edges), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min(F.struct("first.none", "first.id", "first.u2")).alias("best"))
    return named.join(best, "root").select("fp", F.col("best.id").alias("component_id"), F.col("best.u2").alias("keep_u2"))


def classes(prints: DataFrame, limit: int = LIMIT, shard_size: int = SHARD_SIZE, sample_size: int = TREE_SAMPLE) -> DataFrame:
    """The classes of 64-bit fingerprints that differ in at most `limit` bits, by the vantage-point tree."""
    distinct = distinct_prints(prints)
    return named_classes(distinct, links(distinct, limit, shard_size, sample_size))


def wide_fingerprints(docs: DataFrame, shingle: int, **columns: str) -> DataFrame:
    """doc_id, u2, fp (a hash of the set of shingles), the words of its SimHash, the fingerprints of its samples (keys) and the number of shingles.
    Each distinct shingle counts once, so a repeated one cannot decide the SimHash alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.text]
            found = [wide_fingerprint(x) for x in sets]
            words = np.array([w for w, _ in found], np.uint64).reshape(-1, WORDS)
            fp = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "u2": batch.u2, "fp": fp, "words": list(words.view(np.int64)), "keys": [k.view(np.int64) for _, k in found], "size": [len(x) for x in sets]})

    t = texts(docs, **columns).withColumn("u2", F.xxhash64(F.col("doc_id").isNull(), "text"))
    return t.mapInPandas(run, "doc_id long, u2 long, fp long, words array<long>, keys array<long>, size long")


def part_links(words: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, places of its component beyond it), each component once; memory stays linear."""
    rest = np.arange(len(words))
    while len(rest) > 1:
        start, rest = rest[0], rest[1:]
        front, members = [start], []
        while front and len(rest):
            near = np.bitwise_count(words[rest] ^ words[front.pop()]).sum(axis=1, dtype=np.int64) <= limit
            members.append(rest[near])
            front.extend(rest[near].tolist())
            rest = rest[~near]
        if any(map(len, members)):
            yield start, np.concatenate(members)


def dealt(rows: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """`rows` with the columns block and other, sorted by task. `parts` gives the `blocks` of each crowded key: its
    rows are hashed into blocks and each row goes to the tasks (own block, any other block), so that every two rows
    of a key meet in some task, however large the key is."""
    b, other = F.col("own"), F.col("pair")
    own = F.pmod(F.xxhash64("fp", key), F.col("blocks"))
    all_others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: i != b)
    rows = rows.join(small(parts), key, "left").withColumn("own", F.when(F.col("blocks") > 1, own).otherwise(0))
    rows = rows.withColumn("pair", F.explode(F.when(F.col("blocks") > 1, all_others).otherwise(F.array(F.lit(0).cast("long")))))
    rows = rows.withColumn("block", F.least(b, other)).withColumn("other", F.greatest(b, other)).drop("own", "pair", "blocks")
    # a fixed number of partitions: the rows are small, comparing them is not
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, key, "block", "other").sortWithinPartitions(key, "block", "other", "fp")


def task_links(rows: DataFrame, key: str, walk: Callable[[pd.DataFrame, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(fp, root) links of what `walk` joins inside each task of the `dealt` rows; it gets rows, and where tasks begin and end."""
    task = [key, "block", "other"]

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        cut = rows[task].to_numpy()
        first = np.flatnonzero(np.r_[True, (cut[1:] != cut[:-1]).any(axis=1)])
        last = np.r_[first[1:], len(rows)]
        fps = rows.fp.to_numpy()
        pairs = [(fps[at], fps[root]) for at, root in walk(rows, first, last)]
        none = np.empty(0, np.int64)
        return pd.DataFrame({"fp": np.concatenate([none, *(x for x, _ in pairs)]), "root": np.concatenate([none, *(y for _, y in pairs)])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted; the last task of a batch may go on in the next one
        held = None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if held is None else pd.concat((held, batch), ignore_index=True)
            open_ = (batch[task] == batch[task].iloc[-1]).all(axis=1).to_numpy()
            held = batch[open_].reset_index(drop=True)
            if not open_.all():
                yield close(batch[~open_].reset_index(drop=True))
        if held is not None:
            yield close(held)

    return rows.mapInPandas(run, "fp long, root long").distinct()


def meeting(distinct: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """key, part: the sample fingerprints that others lie within LIMIT bits of, by the vantage-point tree, and the smallest
    that such links reach from them; the others are parts of their own."""
    # a fixed number of partitions: the rows are small, the walk down the tree is not
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    samples = settle(distinct.select(F.explode("first.keys").alias("fp")).repartition(parts, "fp").distinct())
    return components(links(samples, LIMIT, LIGHT * shard_size)).select(F.col("fp").alias("key"), F.col("root").alias("part"))


def wide_links(distinct: DataFrame, limit: int = WIDE_LIMIT, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(fp, root) links that connect exactly what pairs within `limit` bits connect whose samples meet in the tree."""
    names = [f"w{i}" for i in range(WORDS)]
    keyed = distinct.select("fp", F.explode("first.keys").alias("key"))
    keyed = keyed.join(small(meeting(distinct, shard_size)), "key", "left").select("fp", F.coalesce("part", "key").alias("key"))
    # most keys are held by one document, which meets nobody there
    held = F.count(F.lit(1)).over(Window.partitionBy("key"))
    shared = settle(keyed.repartition("key").withColumn("held", held).filter("held > 1").select("fp", "key").distinct())
    words = distinct.select("fp", *[F.col("first.words")[i].alias(w) for i, w in enumerate(names)])
    keyed = shared.join(words, "fp")
    crowded = shared.groupBy("key").count().filter(F.col("count") > shard_size)
    parts = settle(crowded.select("key", F.ceil(2 * F.col("count") / shard_size).alias("blocks")))

    def walk(rows: pd.DataFrame, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words, n = rows[names].to_numpy().view(np.uint64), len(rows)
        a, b = [], []
        for one, other in run_pairs(last - first):
            near = np.bitwise_count(words[one] ^ words[other]).sum(axis=1, dtype=np.int64) <= limit
            a.append(one[near])
            b.append(other[near])
            if sum(map(len, a)) > n + PAIRS:
                a, b = _stars(n, a, b)
        if a:
            (root,), (moved,) = _stars(n, a, b)
            yield moved, root
        for k in np.flatnonzero(last - first > RUN).tolist():
            for at, more in part_links(words[first[k] : last[k]], limit):
                yield first[k] + more, np.full(len(more), first[k] + at)

    return task_links(dealt(keyed, "key", parts), "key", walk)


def alike(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which of the `sets` have a similarity of SIMILAR or more with `one`; all are sorted and without repeats."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not len(one):
        return sizes == 0
    flat = np.concatenate(sets)
    found = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.diff(np.r_[0, np.cumsum(found)][np.r_[0, np.cumsum(sizes)]])
    return SIMILAR[1] * both >= SIMILAR[0] * (len(one) + sizes - both)


def set_links(words: np.ndarray, sets: list[np.ndarray], limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """As `part_links`, of the pairs within `limit` bits whose sets are alike."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    rest = np.arange(len(words))
    while len(rest) > 1:
        start, rest = rest[0], rest[1:]
        front, members = [start], []
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(words[rest] ^ words[at]).sum(axis=1, dtype=np.int64) <= limit
            near &= SIMILAR[1] * np.minimum(sizes[rest], sizes[at]) >= SIMILAR[0] * np.maximum(sizes[rest], sizes[at])
            where = np.flatnonzero(near)
            for cut in range(0, len(where), 256):
                some = where[cut : cut + 256]
                near[some] = alike(sets[at], [sets[i] for i in rest[some].tolist()])
            members.append(rest[near])
            front.extend(rest[near].tolist())
            rest = rest[~near]
        if any(map(len, members)):
            yield start, np.concatenate(members)


def similar_links(docs: DataFrame, distinct: DataFrame, candidates: DataFrame, shingle: int, limit: int = WIDE_LIMIT, shard_size: int = SHARD_SIZE, shard_shingles: int = SHARD_SHINGLES, **columns: str) -> DataFrame:
    """(fp, root) links of the fingerprints that `candidates` connects and whose shingle sets are alike."""
    names = [f"w{i}" for i in range(WORDS)]
    groups = components(candidates)
    groups = groups.union(groups.select("root", "root")).distinct()
    words = [F.col("first.words")[i].alias(w) for i, w in enumerate(names)]
    members = settle(distinct.join(groups, "fp").select("fp", "root", F.col("first.id").alias("id"), F.col("first.none").alias("none"), F.col("first.u2").alias("u2"), "first.size", *words))
    weight = F.greatest(F.count(F.lit(1)) / shard_size, F.sum("size") / shard_shingles)
    parts = settle(members.groupBy("root").agg(weight.alias("weight")).filter("weight > 1").select("root", F.ceil(2 * F.col("weight")).alias("blocks")))
    # the text of a member is that of its first row; rows that repeat it are the same
    t = texts(docs, **columns).select("text", F.col("doc_id").alias("id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("u2"))
    m = small(members)
    rows = t.join(m, t.id.eqNullSafe(members.id) & (t.u2 == members.u2)).select("fp", "root", *names, "text").dropDuplicates(["fp"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(hashes=[shingle_set(x, shingle).tobytes() for x in batch.text])

    def walk(rows: pd.DataFrame, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words, sets = rows[names].to_numpy().view(np.uint64), [np.frombuffer(x, np.uint64) for x in rows.hashes]
        for a, b in zip(first.tolist(), last.tolist()):
            for at, more in set_links(words[a:b], sets[a:b], limit):
                yield a + more, np.full(len(more), a + at)

    sets = rows.mapInPandas(hashed, f"fp long, root long, {', '.join(f'{w} long' for w in names)}, hashes binary").withColumnRenamed("root", "class")
    return task_links(dealt(sets, "class", parts.withColumnRenamed("root", "class")), "class", walk)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT, **columns: str) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = settle(fingerprints(docs, shingle, **columns))
    out = prints.join(classes(prints, limit), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, limit: int = WIDE_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each class of near copies (five-word shingles, 0.8 of them shared): that of the
    smallest id, and of repeated rows the first."""
    prints = settle(wide_fingerprints(docs, shingle, id_col=id_col, text_col=text_col))
    distinct = distinct_prints(prints, "words", "keys", "size")
    candidates = wide_links(distinct, limit)
    named = named_classes(distinct, similar_links(docs, distinct, candidates, shingle, limit, id_col=id_col, text_col=text_col))
    keep = prints.join(named, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("u2") == F.col("keep_u2"))).select("doc_id", "u2").distinct()
    r = F.col("row")
    rows = packed(docs).withColumns({"k1": r[id_col].cast("long"), "k2": F.xxhash64(r[id_col].cast("long").isNull(), F.coalesce(r[text_col], F.lit("")))})
    rows = rows.join(keep, rows.k1.eqNullSafe(keep.doc_id) & (rows.k2 == keep.u2), "left_semi")
    first = Window.partitionBy("k1", "k2").orderBy(F.lit(0))
    return rows.withColumn("place", F.row_number().over(first)).filter("place = 1").select("row.*")
