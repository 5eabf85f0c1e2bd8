"""Prefix trie of rebuilt conversations by composable fingerprints; no rebuilt text is ever made.

A rebuilt conversation is a base's first turns and then the own turns after as many. A sequence of turns is an element of a
monoid: (r**n, sum of k_i r**i) mod p in four lanes of 31 bits, k_i from the turn's role and text; two elements combine
without their turns. So:

1. Spark orders the turns (references only, no text) by range over all partitions; a conversation may lie over many.
   Each partition folds its turns; one element per partition is carried over to the next ones.
2. A conversation's head element comes from its base, its own suffix is the own prefix with the own head
   taken off, moved by r**(shift): one product and one sum per turn, in columns.
3. Turns of equal element at equal depth form a node. Groups are verified through the stored turns they refer to:
   all last turns of a node share one key and all parents one element, and every key stands for one (role, text).
   By induction the sequences are equal. Where a check fails, all is done again with other hash seeds.
4. The smallest member owns a node, so a conversation owns the lower end of its path. Counts of owned nodes give the depth up to
   which a conversation is stored already, and with it leaves and saved tokens of every subtree as plain sums over
   members. No step walks the tree level by level, however deep it is.
5. Ids of conversations that end in a node are put in order by range, joined in chunks, and hashed chunk by chunk.

Groups of any size: sums are combined before each exchange; joins send the few keys above a share of all rows by
broadcast (at most `HOT` of them), the rest by shuffle.

Order: turn (null first), then role and text by hash, so equal rows follow each other and each counts. Null role or text: empty. Rows without
conv_id belong to no conversation. c - c % 100 and % keep the sign of c. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import stored

P = 2**31 - 1
LANES = 4
# keys sent by broadcast at most, in a join with hot keys
HOT = 4096
HEADS = 6
BASES = 100
# ids joined to one string before they are hashed
CHUNK = 50_000
KEY = ["depth", "f1", "f2"]


def bases(seed: int) -> list[int]:
    """The r of each lane."""
    digest = hashlib.sha256(b"prefix trie %d" % seed).digest()
    return [int.from_bytes(digest[8 * i : 8 * i + 8], "big") % (P - 3) + 2 for i in range(LANES)]


def powers(r: int, n: np.ndarray) -> np.ndarray:
    """r**n mod P for whole n >= 0, by tables of 4096 powers of 12 bits each."""
    out = np.ones(len(n), np.int64)
    step = r
    while n.any():
        table = np.ones(4096, np.int64)
        for i in range(1, 4096):
            table[i] = int(table[i - 1]) * step % P
        out = out * table[n & 4095] % P
        step = pow(step, 4096, P)
        n = n >> 12
    return out


def turn_rows(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """conv_id, turn, k1, k2, role, text of the rows with a conv_id."""
    c = conversations
    empty = F.lit("")
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"], empty).alias("role"), F.coalesce(c["text"], empty).alias("text"))
    keys = {f"k{i}": F.xxhash64(F.lit(2 * seed + i), "role", "text") for i in (1, 2)}
    return rows.filter("conv_id IS NOT NULL").withColumns(keys)


def _folded(seed: int):
    """Batches of ordered turns to elements within the partition: position, prefix before (p), prefix with the turn (q)."""
    rs = bases(seed)
    schema = "block int, conv_id long, pos long, k1 long, k2 long, cp long, s long, " + ", ".join(f"p{i} int, q{i} int" for i in range(LANES)) + ", last boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        held, open_conv, n0, s0, q0 = None, None, 0, 0, [0] * LANES
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            conv, k1, k2, cp = (batch.column(c).to_numpy() for c in ("conv_id", "k1", "k2", "cp"))
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            first = np.repeat(starts, np.diff(np.r_[starts, m]))
            goes_on = (first == 0) & (open_conv is not None and conv[0] == open_conv)
            pos = np.arange(m) - first + 1 + np.where(goes_on, n0, 0)
            total = np.cumsum(cp)
            s = total - (total - cp)[first] + np.where(goes_on, s0, 0)
            columns = []
            for i, r in enumerate(rs):
                k = ((k1, k2)[i // 2].view(np.uint64) >> np.uint64(33 * (i % 2))).astype(np.int64) % P
                term = k % P * powers(r, pos) % P
                running = np.cumsum(term)
                q = (running - (running - term)[first] + np.where(goes_on, q0[i], 0)) % P
                columns += [(q - term) % P, q]
                q0[i] = int(q[-1])
            n0, s0, open_conv = int(pos[-1]), int(s[-1]), conv[-1]
            if held is not None:
                yield held
            arrays = [np.full(m, block, np.int32), conv, pos, k1, k2, cp, s, *[c.astype(np.int32) for c in columns]]
            names = ["block", "conv_id", "pos", "k1", "k2", "cp", "s", *[f"{t}{i}" for i in range(LANES) for t in "pq"]]
            last = np.zeros(m, bool)
            last[-1] = True
            held = pa.RecordBatch.from_arrays([pa.array(a) for a in (*arrays, np.zeros(m, bool))], [*names, "last"])
            final = pa.RecordBatch.from_arrays([pa.array(a) for a in (*arrays, last)], [*names, "last"])
        if held is not None:
            yield final

    return run, schema


def _carried(spark: SparkSession, folded: DataFrame, seed: int) -> DataFrame:
    """block, conv_id and the element of the conversation's turns in all blocks before; a row per block at most."""
    rs = bases(seed)
    names = ["pos", "s", *[f"q{i}" for i in range(LANES)]]
    # one row a partition
    rows = sorted(folded.filter("last").select("block", "conv_id", *names).collect())
    found, state = [], None
    for row in rows:
        conv, (n, s, *q) = row.conv_id, row[2:]
        if state is not None:
            (at, n0, s0, *q0), lead = state, [pow(r, state[1], P) for r in rs]
            found.append((row.block, at, n0, s0, *q0, *lead))
            if conv == at:
                n, s, q = n + n0, s + s0, [(a + w * b) % P for a, w, b in zip(q0, lead, q)]
        state = (conv, n, s, *q)
    schema = "block int, conv_id long, n0 long, s0 long, " + ", ".join(f"c{i} long" for i in range(LANES)) + ", " + ", ".join(f"w{i} long" for i in range(LANES))
    return spark.createDataFrame(found, schema)


def own_turns(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """conv_id, pos, k1, k2, cp, s, p0.., q0..: every turn with its place and the prefix elements before and with it."""
    narrow = turn_rows(conversations, seed).select("conv_id", "turn", "k1", "k2", F.length("text").cast("long").alias("cp"))
    order = ["conv_id", F.asc_nulls_first("turn"), "k1", "k2"]
    run, schema = _folded(seed)
    folded = stored(narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "k1", "k2", "cp").mapInArrow(run, schema))
    j = folded.join(F.broadcast(_carried(narrow.sparkSession, folded, seed)), ["block", "conv_id"], "left")

    def whole(name: str, i: int) -> Column:
        return F.when(F.col("n0").isNull(), F.col(name).cast("long")).otherwise((F.col(f"c{i}") + F.col(f"w{i}") * F.col(name)) % P).alias(name)

    zero = F.lit(0)
    lanes = [whole(f"{t}{i}", i) for i in range(LANES) for t in "pq"]
    return j.select("conv_id", (F.col("pos") + F.coalesce("n0", zero)).alias("pos"), "k1", "k2", "cp", (F.col("s") + F.coalesce("s0", zero)).alias("s"), *lanes)


def _print(lanes: list[Column]) -> list[Column]:
    a, b, c, d = lanes
    return [F.shiftleft(a, 31).bitwiseOR(b), F.shiftleft(c, 31).bitwiseOR(d)]


def spread_join(big: DataFrame, keyed: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join with `keyed` (one row a key; `weight`: rows of `big` with it). Keys with over 1/HOT of all rows, so
    fewer than HOT, are broadcast; the others have few rows each and go by shuffle."""
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    limit = max(1000, total // HOT)
    hot, cold = keyed.filter(F.col(weight) > limit), keyed.filter(F.col(weight) <= limit)
    few = F.broadcast(hot)
    return big.join(few, on).unionByName(big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def _head(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def members(own: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(a row per rebuilt conversation and depth, a row per conversation), from `own_turns`."""
    rs = bases(seed)
    c, h = F.col("conv_id"), _head(F.col("conv_id"))
    at_h = F.col("pos") == h
    sums = [F.max(F.when(at_h, F.col(n))).alias(f"h_{n}") for n in ("s", *[f"q{i}" for i in range(LANES)])]
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("own_n"), F.sum("cp").alias("own_cp"), *sums)
    lanes = [f"{t}{i}" for i in range(LANES) for t in "pq"]
    top = own.filter((c % BASES == 0) & (F.col("pos") < HEADS))
    # at most HEADS - 1 turns a base
    heads = top.groupBy(c.alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "k1", "k2", "cp", "s", *lanes))).alias("head"))
    convs = convs.withColumns({"base": c - c % BASES, "h": h.cast("int")}).join(heads, "base", "left")
    convs = convs.withColumn("head", F.when(F.col("head").isNull() | (F.col("h") == 0), F.array().cast(heads.schema["head"].dataType)).otherwise(F.slice("head", 1, F.greatest("h", F.lit(1)))))
    held = F.size("head")
    end = F.element_at("head", -1)
    shift = held - F.col("h")
    zero = F.lit(0).cast("long")

    def turned(i: int) -> Column:
        """r**shift, shift from -(HEADS - 1) to 0."""
        return F.element_at(F.array(*[F.lit(pow(rs[i], -k, P)).cast("long") for k in range(HEADS)]), 1 - shift)

    more = F.col("own_n") > F.col("h")
    columns = {f"t{i}": turned(i) for i in range(LANES)}
    convs = convs.withColumns(columns)
    add = {f"a{i}": (F.when(held > 0, end[f"q{i}"]).otherwise(zero) - F.col(f"t{i}") * F.coalesce(f"h_q{i}", zero) % P + P) % P for i in range(LANES)}
    before = F.when(held > 0, end["s"]).otherwise(zero)
    convs = convs.withColumns(add | {"shift": shift.cast("long"), "s_shift": before - F.coalesce("h_s", zero)})
    convs = convs.withColumn("length", held + F.when(more, F.col("own_n") - F.col("h")).otherwise(zero))
    convs = stored(convs.withColumn("total", before + F.when(more, F.col("own_cp") - F.coalesce("h_s", zero)).otherwise(zero)))

    columns = ["conv_id", "depth", "f1", "f2", "g1", "g2", "k1", "k2", "cp", "s", "length"]

    def row(source: DataFrame, depth: Column, q: list[Column], p: list[Column], *rest: Column) -> DataFrame:
        return source.select("conv_id", depth.cast("long").alias("depth"), *[x.alias(n) for x, n in zip(_print(q) + _print(p), ("f1", "f2", "g1", "g2"))], *rest, "length")

    none = [zero] * LANES
    root = row(convs, zero, none, none, *[zero.alias(n) for n in ("k1", "k2", "cp", "s")])
    x = convs.select("conv_id", "length", F.explode("head").alias("t"))
    top = row(x, F.col("t.pos"), [F.col(f"t.q{i}") for i in range(LANES)], [F.col(f"t.p{i}") for i in range(LANES)], *[F.col(f"t.{n}").alias(n) for n in ("k1", "k2", "cp", "s")])
    need = ["conv_id", "own_n", "length", "shift", "s_shift", *[f"{t}{i}" for i in range(LANES) for t in "ta"]]
    j = spread_join(own.filter(F.col("pos") > h), convs.filter(more).select(*need), ["conv_id"], "own_n")
    q, p = ([(F.col(f"a{i}") + F.col(f"t{i}") * F.col(f"{t}{i}")) % P for i in range(LANES)] for t in "qp")
    below = row(j, F.col("pos") + F.col("shift"), q, p, F.col("k1"), F.col("k2"), F.col("cp"), (F.col("s") + F.col("s_shift")).alias("s"))
    rows = root.select(*columns).unionByName(top.select(*columns)).unionByName(below.select(*columns))
    return stored(rows), convs.select("conv_id", "length", "total")


def _ends(rows: DataFrame) -> DataFrame:
    """depth, f1, f2, ends_sha256 of the nodes where conversations end."""
    order = [*KEY, "conv_id"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy() for k in KEY])
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
            cuts = np.unique(np.r_[np.flatnonzero(new), np.arange(0, len(conv), CHUNK)])
            parts = [",".join(map(str, part.tolist())) for part in np.split(conv, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*[pa.array(keys[cuts, i]) for i in range(3)], pa.array(conv[cuts]), pa.array(parts)], [*KEY, "first", "ids"])

    joined = rows.filter("depth = length").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "depth long, f1 long, f2 long, first long, ids string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done = []
            for depth, f1, f2, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")]):
                if (depth, f1, f2) == current:
                    state.update(b",")
                else:
                    if current is not None:
                        done.append((*current, state.hexdigest()))
                    current, state = (depth, f1, f2), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), d)) for d in done])
        if current is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), (*current, state.hexdigest())))])

    # the ids of one node come as strings of many ids, in order, and are hashed as they pass
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "depth long, f1 long, f2 long, ends_sha256 string")


def trie(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node."""
    content = turn_rows(conversations, seed).select("k1", "k2", "role", "text").distinct().groupBy("k1", "k2").count().filter("count > 1")
    if not content.isEmpty():
        return trie(conversations, seed + 1)
    rows, convs = members(own_turns(conversations, seed), seed)
    low = [F.min(n).alias(f"low_{n}") for n in ("k1", "k2", "g1", "g2")]
    high = [F.max(n).alias(n) for n in ("k1", "k2", "g1", "g2")]
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("cp").alias("cp"), F.max("length").alias("longest"), *low, *high)
    nodes = stored(nodes)
    if not nodes.filter(" OR ".join(f"low_{n} <> {n}" for n in ("k1", "k2", "g1", "g2"))).isEmpty():
        return trie(conversations, seed + 1)

    shared = F.col("n_convs") > 1
    owned = nodes.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("owned"), F.sum("cp").alias("owned_cp"), F.max(F.when(shared, F.col("depth"))).alias("shared_to"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf")
    )
    # the owner of a node down to its own end: depths above `stored_to` are its own, `open_to` is its deepest shared node
    zero = F.lit(0).cast("long")
    facts = convs.join(owned, "conv_id", "left").select(
        "conv_id",
        (F.col("length") + 1).alias("rows"),
        (F.col("length") - F.coalesce("owned", zero)).alias("stored_to"),
        (F.col("total") - F.coalesce("owned_cp", zero)).alias("stored_cp"),
        F.coalesce("leaf", zero).alias("leaf"),
        "shared_to",
    )
    facts = stored(facts.withColumn("open_to", F.greatest("stored_to", F.coalesce("shared_to", F.lit(-1)))))
    near = spread_join(rows.drop("k1", "k2", "length"), facts.drop("shared_to"), ["conv_id"], "rows").filter("depth <= open_to + 1")
    near = stored(near)
    nothing = F.lit(None).cast("long")
    inside = near.filter("depth <= open_to").select(
        *KEY, F.col("leaf").alias("n_leaves"), F.when(F.col("depth") <= F.col("stored_to"), F.col("stored_cp") - F.col("s") + F.col("cp")).otherwise(zero).alias("saved"), zero.alias("n_children"), nothing.alias("parent")
    )
    first = near.filter("depth > stored_to AND depth > 0")
    parent_key = [(F.col("depth") - 1).alias("depth"), F.col("g1").alias("f1"), F.col("g2").alias("f2")]
    children = first.select(*parent_key, zero.alias("n_leaves"), zero.alias("saved"), F.lit(1).cast("long").alias("n_children"), nothing.alias("parent"))
    # where an owner's part begins, the parent belongs to another: one look-up per conversation
    begins = first.filter("depth = stored_to + 1").select("f1", "f2", *[x.alias(n) for x, n in zip((F.col("depth") - 1, F.col("g1"), F.col("g2")), ("up", "g1", "g2"))])
    wanted = begins.groupBy("up", "g1", "g2").agg(F.count(F.lit(1)).alias("asked"))
    owners = stored(nodes.filter(shared).select(F.col("depth").alias("up"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("conv_id").alias("parent")).join(wanted, ["up", "g1", "g2"]))
    parents = spread_join(begins, owners, ["up", "g1", "g2"], "asked").select((F.col("up") + 1).alias("depth"), "f1", "f2", zero.alias("n_leaves"), zero.alias("saved"), zero.alias("n_children"), "parent")
    sums = inside.unionByName(children).unionByName(parents).groupBy(*KEY).agg(*[F.sum(n).alias(n) for n in ("n_leaves", "saved", "n_children")], F.max("parent").alias("parent"))
    out = nodes.join(sums, KEY, "left").join(_ends(rows), KEY, "left")
    alone = ~shared
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(alone, (F.col("longest") > F.col("depth")).cast("long")).otherwise(F.coalesce("n_children", zero)).alias("n_children"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.coalesce("n_leaves", zero)).alias("n_leaves"),
        F.coalesce("saved", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
