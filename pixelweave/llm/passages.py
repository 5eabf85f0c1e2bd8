"""Windows of text that occur more than once in a corpus, found without listing every position.

Shared by the byte form (`suffixes`) and the word form (`automata`). Steps:

1. Every window of `size` items belongs to one anchor gram (`winnow`), which equal windows share. Anchors are some
   two per window length; they are the only positions that are sorted and counted.
2. An anchor whose gram occurs once has no repeated window and leaves. Where the whole stretch of an anchor's
   windows occurs again at the same offsets, all of them are repeated. Both are counts per key, added up before the
   exchange and joined back, so a frequent gram or stretch is split like any skewed join.
3. What is left lies at the edges of copied text. The stretches of one gram (and one of each repeated kind) go to
   one bounded shard, which compares them exactly. Grams with more than `shard_rows` such stretches are not
   gathered: each of their windows is counted by its fingerprint instead.

Rows are known by `common.unit`, which depends on their content alone: recomputed tasks agree, and repeated rows
count as repetitions of each other and share their result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import stored
from .winnow import anchors

# items whose anchors are found together, and bytes of rows given on together
BATCH_ITEMS = 1 << 16
SHARD_BYTES = 1 << 20
SLICE_BYTES = 1 << 22


@dataclass(frozen=True)
class Kind:
    """What an item is: `codes` turns a text into numbers and a cutter; cutter(a, b) gives items a..b as bytes."""

    codes: Callable[[str], tuple[np.ndarray, Callable[[int, int], bytes]]]
    size: int
    gram: int
    # solve(list of stretches, size) -> per stretch (first, last) repeated start inside it, or -1, -1
    solve: Callable[[list[bytes], int], tuple[np.ndarray, np.ndarray]]
    shard_rows: int


def squeezed(rows: DataFrame) -> DataFrame:
    """The rows with the column text as compressed bytes z, so that an exchange writes less."""
    rest = [f.name for f in rows.schema if f.name != "text"]
    schema = ", ".join([*(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in rest), "z binary"])

    def pack(batches):
        import pyarrow as pa

        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [squeeze.compress(t.as_py().encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(z, pa.binary())], [*rest, "z"])

    return rows.mapInArrow(pack, schema)


def keyed(docs: DataFrame) -> DataFrame:
    """u1, u2 and the text as compressed bytes, from doc_id and text; other columns stay."""
    short = F.xxhash64(F.col("doc_id").isNull(), "text")
    return squeezed(docs.withColumns({"u1": F.coalesce("doc_id", F.xxhash64("text")), "u2": short.bitwiseAND(0x7FFFFFFF).cast("int")}))


def unpack(z: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(z).decode()


def sliced(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of about SLICE_BYTES, so that a batch of many long stretches is never held whole."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= SLICE_BYTES:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _anchor_rows(docs: DataFrame, kind: Kind) -> DataFrame:
    """u1, u2, g (gram), w (the stretch of all its windows), p (anchor and first and last offset, packed)."""
    rows = docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("u1"), F.xxhash64(F.col("doc_id").isNull(), "text").bitwiseAND(0x7FFFFFFF).cast("int").alias("u2"), "text")

    def found(u1: list, u2: list, parts: list) -> pd.DataFrame:
        codes = np.concatenate([c for c, _ in parts])
        ends = np.cumsum([len(c) for c, _ in parts])
        a, first, last, g = anchors(codes, kind.size, kind.gram, ends)
        row = np.searchsorted(ends, a, side="right")
        base = np.concatenate(([0], ends[:-1]))[row]
        a, first, last = a - base, first - base, last - base
        one = xxhash.xxh3_64_intdigest
        w = np.fromiter((one(parts[r][1](f, e)) for r, f, e in zip(row.tolist(), first.tolist(), (last + kind.size).tolist())), np.uint64, len(a))
        low, high = a - last, a - first
        with np.errstate(over="ignore"):
            w = w * np.uint64(0x9E3779B97F4A7C15) + (low * 4096 + high).astype(np.uint64)
        return pd.DataFrame({"u1": np.array(u1, np.int64)[row], "u2": np.array(u2, np.int32)[row], "g": g.view(np.int64), "w": w.view(np.int64), "p": a << 24 | low << 12 | high})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            u1, u2, parts, held = [], [], [], 0
            for i, j, text in zip(batch.u1.tolist(), batch.u2.tolist(), batch.text):
                codes = kind.codes(text)
                if len(codes[0]) < kind.size:
                    continue
                u1.append(i)
                u2.append(j)
                parts.append(codes)
                held += len(codes[0])
                if held > BATCH_ITEMS:
                    yield found(u1, u2, parts)
                    u1, u2, parts, held = [], [], [], 0
            if parts:
                yield found(u1, u2, parts)

    return rows.mapInPandas(run, "u1 long, u2 int, g long, w long, p long")


def _contexts(docs: DataFrame, open_rows: DataFrame, kind: Kind) -> DataFrame:
    """The stretch (bytes) of each open anchor: u1, u2, g, hot, first (its first start), high (the anchor's place in
    it) and body."""
    lists = open_rows.groupBy("u1", "u2").agg(F.collect_list(F.struct("g", "p", "hot")).alias("open"))
    joined = keyed(docs.select("doc_id", "text")).drop("doc_id").join(lists, ["u1", "u2"])

    def stretches(batch: pd.DataFrame) -> Iterator[tuple]:
        for u1, u2, z, listed in zip(batch.u1.tolist(), batch.u2.tolist(), batch.z, batch.open):
            cut = kind.codes(unpack(z))[1]
            for x in listed:
                p = x["p"]
                a, low, high = p >> 24, p >> 12 & 4095, p & 4095
                yield u1, u2, x["g"], x["hot"], a - high, high, cut(a - high, a - low + kind.size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from sliced(stretches(batch), ["u1", "u2", "g", "hot", "first", "high", "body"])

    return joined.select("u1", "u2", "z", "open").mapInPandas(run, "u1 long, u2 int, g long, hot boolean, first long, high int, body binary")


def _solved(shards: DataFrame, kind: Kind) -> DataFrame:
    """Repeated starts of the stretches, found in shards that hold all stretches of a gram."""

    def result(rows: list[tuple]) -> pd.DataFrame:
        first, last = kind.solve([r[3] for r in rows], kind.size)
        hit = np.flatnonzero(first >= 0)
        begin = np.array([r[2] for r in rows], np.int64)[hit]
        return pd.DataFrame({"u1": np.array([r[0] for r in rows], np.int64)[hit], "u2": np.array([r[1] for r in rows], np.int32)[hit], "b": begin + first[hit], "e": begin + last[hit] + kind.size})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, at = [], 0, None
        for batch in batches:
            for u1, u2, g, first, body in zip(batch.u1.tolist(), batch.u2.tolist(), batch.g.tolist(), batch["first"].tolist(), batch.body):
                if g != at and size >= SHARD_BYTES:
                    yield result(held)
                    held, size = [], 0
                at = g
                held.append((u1, u2, first, bytes(body)))
                size += len(body)
        if held:
            yield result(held)

    lined = shards.repartition("g").sortWithinPartitions("g").select("u1", "u2", "g", "first", "body")
    return lined.mapInPandas(run, "u1 long, u2 int, b long, e long")


def _counted(rows: DataFrame, kind: Kind) -> DataFrame:
    """Repeated starts of the stretches of very frequent grams, by counts of fingerprints and no gathering.

    The windows of a stretch are taken in blocks by their offset to the anchor. What all windows of a block share is
    nearly as long as a window; only blocks for which it occurs twice are looked at window by window.
    """
    block = max(1, kind.size // 4)

    def digest(codes_cut, a: int, b: int, offset: int) -> bytes:
        return xxhash.xxh3_128_digest(codes_cut(a, b) + b"|%d" % offset)

    def block_rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for u1, u2, first, high, body in zip(batch.u1.tolist(), batch.u2.tolist(), batch["first"].tolist(), batch.high.tolist(), batch.body):
            codes, cut = kind.codes(bytes(body).decode("utf-8", "surrogateescape"))
            low = high - (len(codes) - kind.size)
            for k in range(low // block, high // block + 1):
                at = high - k * block
                begin, end = max(0, at - block + 1), min(at, len(codes) - kind.size)
                yield u1, u2, first + begin, cut(begin, end + kind.size), digest(cut, at, at - block + 1 + kind.size, k)

    def window_rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for u1, u2, first, body in zip(batch.u1.tolist(), batch.u2.tolist(), batch["first"].tolist(), batch.body):
            codes, cut = kind.codes(bytes(body).decode("utf-8", "surrogateescape"))
            for i in range(len(codes) - kind.size + 1):
                yield u1, u2, first + i, xxhash.xxh3_128_digest(cut(i, i + kind.size))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from sliced(block_rows(batch), ["u1", "u2", "first", "body", "h"])

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from sliced(window_rows(batch), ["u1", "u2", "b", "h"])

    def twice(df: DataFrame) -> DataFrame:
        # written, so that the join deals both sides anew and can split a frequent key
        repeated = stored(df.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
        return df.join(repeated, "h").drop("h")

    cores = rows.select("u1", "u2", "first", "high", "body").mapInPandas(blocks, "u1 long, u2 int, first long, body binary, h binary")
    single = twice(cores).mapInPandas(windows, "u1 long, u2 int, b long, h binary")
    return twice(single).select("u1", "u2", "b", (F.col("b") + kind.size).alias("e"))


def spans(docs: DataFrame, kind: Kind) -> DataFrame:
    """u1, u2, spans: for each row with repeated windows, the item ranges [b, e) that they cover, unmerged.

    `docs` has doc_id and text (not null). A row's list is bounded by its own length.
    """
    rows = _anchor_rows(docs, kind)
    # tables are written so that the joins deal both sides anew and can split a frequent key
    shared = stored(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g"))
    kept = stored(rows.join(shared, "g"))
    same = stored(kept.groupBy("g", "w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("u1", "u2", "p")).alias("one")))
    # grams with a stretch of its own; the count of kinds bounds their shard
    mixed = same.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("least = 1").select("g", (F.col("kinds") > kind.shard_rows).alias("hot"))
    again = same.filter("n > 1").select("g", "w")
    p = F.col("p")
    anchor = F.shiftright(p, 24)
    whole = kept.join(again, ["g", "w"]).select("u1", "u2", (anchor - p.bitwiseAND(4095)).alias("b"), (anchor - F.shiftright(p, 12).bitwiseAND(4095) + kind.size).alias("e"))
    open_rows = same.join(mixed, "g").select("g", "hot", "one.u1", "one.u2", "one.p")

    contexts = stored(_contexts(docs, open_rows, kind))
    edges = _solved(contexts.filter("not hot"), kind).unionByName(_counted(contexts.filter("hot"), kind))
    # one number per range keeps the exchange small
    ranges = whole.unionByName(edges).select("u1", "u2", (F.shiftleft("b", 31) + F.col("e")).alias("r"))
    return ranges.groupBy("u1", "u2").agg(F.collect_list("r").alias("spans"))


def covered(packed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (begins, ends) of the packed ranges, in order."""
    packed = np.unique(np.asarray(packed, np.int64))
    b, e = packed >> 31, packed & ((1 << 31) - 1)
    if not len(b):
        return b, e
    reach = np.maximum.accumulate(e)
    cut = np.flatnonzero(b[1:] > reach[:-1]) + 1
    return b[np.concatenate(([0], cut))], np.minimum(reach[np.concatenate((cut - 1, [len(b) - 1]))], n)


def with_spans(docs: DataFrame, kind: Kind) -> DataFrame:
    """Every row of `docs` (doc_id, text and any others) with its compressed text z and its spans (null: none)."""
    return keyed(docs).join(spans(docs, kind), ["u1", "u2"], "left").drop("u1", "u2")
