"""Registration of frames with many stars: triangles of near neighbours instead of all triples.

Every star forms triangles with pairs of its nearest stars, so their number grows with the stars, not with
their cube. Triangles match on shape, size (the scale is known to lie in [0.9, 1.1]) and handedness, and the order of
their sides says which corner is which: a match is three votes. Pairs of stars that are each other's most voted
partner are kept.

Frames of at most ARRAY_STARS stars are dealt in blocks with the stars of their session's reference: a task lists the triangles of a
block in arrays, counts its votes there and writes one row per frame (`block_pairs`). Frames with more stars take joins,
windows and sums over rows, with the same results; no such frame is one array.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import distance
from ..functions.salting import CELL_ROWS, FEW_ROWS, cell_join
from ..model import FRAME

NEIGHBOURS = 6
# scale of a frame against its reference, and the step of size cells that covers it with one cell to each side
SCALES = (0.90, 1.10)
SIZE_STEP = 0.11
TOLERANCE = 0.02
# what a star adds to the weight of its partition of frames: the triangles and the vote rows it brings
WEIGHT = 100
# stars up to which a frame, with its reference, is matched in arrays; stars of the frames in one block; pairs, and triangles, looked at together
ARRAY_STARS = 4096
BLOCK_STARS = 20_000
PAIRS_AT_ONCE = 1_000_000
TRIANGLES_AT_ONCE = 2048


def nearest(stars: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """star_idx, x, y and up to k nearest other stars (rank, other, ox, oy, d) within the cell size of a grid.

    Cells are as wide as a circle of about 4 k stars at the frame's mean density, so all partners lie in the 3 x 3
    cells around a star. Ties go to the smaller star_idx.
    """
    s = stars.select(*FRAME, "star_idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    span = s.groupBy(*FRAME).agg(F.count("*").alias("_n"), (F.max("x") - F.min("x") + 1.0).alias("_w"), (F.max("y") - F.min("y") + 1.0).alias("_h"))
    cell = F.sqrt(F.col("_w") * F.col("_h") * 4.0 * k / (3.141592653589793 * F.col("_n")))
    s = s.join(span, FRAME).withColumn("_cell", cell).drop("_n", "_w", "_h")
    s = s.withColumn("_cy", F.floor(F.col("y") / F.col("_cell"))).withColumn("_cx", F.floor(F.col("x") / F.col("_cell")))
    around = F.sequence(F.lit(-1), F.lit(1))
    # a star is listed in its own cell and as a neighbour in the 3 x 3 cells around; a cell holds some 4 k stars
    own = F.struct("star_idx", "x", "y", F.col("_cell").alias("cell"))
    at = F.explode(F.flatten(F.transform(around, lambda a: F.transform(around, lambda b: F.struct(a.alias("dy"), b.alias("dx"))))))
    c = s.select(*FRAME, "_cy", "_cx", own.alias("_s"), at.alias("_at"))
    c = c.select(*FRAME, (F.col("_cy") + F.col("_at.dy")).alias("_cy"), (F.col("_cx") + F.col("_at.dx")).alias("_cx"), "_s", ((F.col("_at.dy") == 0) & (F.col("_at.dx") == 0)).alias("_own"))
    c = c.groupBy(*FRAME, "_cy", "_cx").agg(F.collect_list(F.when(F.col("_own"), F.col("_s"))).alias("_stars"), F.collect_list("_s").alias("_around"))
    c = c.select(*FRAME, F.explode("_stars").alias("_s"), "_around")
    apart = lambda o: distance(F.col("_s.x"), F.col("_s.y"), o["x"], o["y"])
    partners = F.transform(F.filter("_around", lambda o: o["star_idx"] != F.col("_s.star_idx")), lambda o: F.struct(apart(o).alias("d"), o["star_idx"].alias("other"), o["x"].alias("ox"), o["y"].alias("oy")))
    first = F.slice(F.sort_array(F.filter(partners, lambda o: o["d"] <= F.col("_s.cell"))), 1, k)
    j = c.select(*FRAME, "_s", F.posexplode(first).alias("_rank", "_o"))
    return j.select(*FRAME, "_s.star_idx", "_s.x", "_s.y", (F.col("_rank") + 1).alias("rank"), "_o.other", "_o.ox", "_o.oy", "_o.d")


def near_triangles(stars: DataFrame, k: int = NEIGHBOURS, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """Triangles of each star with two of its k nearest: corners (opposite to the shortest, middle, longest side),
    d0 and d1 (shorter sides over the longest), size (the longest) and hand (+1 or -1). Sides lie in [low, high].

    At most stars * k * (k - 1) / 2 rows; a triangle found from several corners comes once.
    """
    near = nearest(stars, k)
    partner = F.struct(F.col("other").alias("i"), F.col("ox").alias("x"), F.col("oy").alias("y"))
    # at most k partners a star
    own = near.groupBy(*FRAME, "star_idx", "x", "y").agg(F.collect_list(partner).alias("_p"))
    own = own.withColumn("_s", F.struct(F.col("star_idx").alias("i"), "x", "y"))
    picks = F.array(*[F.struct(F.get("_p", F.lit(a)).alias("a"), F.get("_p", F.lit(b)).alias("b")) for a, b in combinations(range(k), 2)])
    t = own.select(*FRAME, "_s", F.explode(picks).alias("_q")).filter("_q.a IS NOT NULL AND _q.b IS NOT NULL")
    t = t.select(*FRAME, F.sort_array(F.array("_s", "_q.a", "_q.b")).alias("_t"))
    t = t.select(*FRAME, *[F.col("_t")[n].alias(f"_v{n}") for n in range(3)])
    t = t.withColumns({f"_i{n}": F.col(f"_v{n}.i") for n in range(3)}).dropDuplicates([*FRAME, "_i0", "_i1", "_i2"])

    def side(a: int, b: int) -> Column:
        return distance(F.col(f"_v{a}.x"), F.col(f"_v{a}.y"), F.col(f"_v{b}.x"), F.col(f"_v{b}.y"))

    # each side with the corner opposite to it, ascending
    sides = F.sort_array(F.array(*[F.struct(side((n + 1) % 3, (n + 2) % 3).alias("d"), F.col(f"_v{n}.i").alias("i"), F.col(f"_v{n}.x").alias("x"), F.col(f"_v{n}.y").alias("y")) for n in range(3)]))
    t = t.select(*FRAME, sides.alias("_s")).select(*FRAME, *[F.col("_s")[n].alias(f"_s{n}") for n in range(3)])
    t = t.filter(F.col("_s0.d").between(low, high) & F.col("_s2.d").between(low, high) & (F.col("_s2.d") > 1e-6))
    dx = lambda a, b: F.col(f"_s{a}.x") - F.col(f"_s{b}.x")
    dy = lambda a, b: F.col(f"_s{a}.y") - F.col(f"_s{b}.y")
    hand = F.when(dx(1, 0) * dy(2, 0) - dy(1, 0) * dx(2, 0) >= 0, 1).otherwise(-1)
    return t.select(
        *FRAME,
        F.array(*[F.col(f"_s{n}.i").cast("int") for n in range(3)]).alias("corners"),
        (F.col("_s0.d") / F.col("_s2.d")).alias("d0"),
        (F.col("_s1.d") / F.col("_s2.d")).alias("d1"),
        F.col("_s2.d").alias("size"),
        hand.alias("hand"),
    )


def near_votes(targets: DataFrame, references: DataFrame, tolerance: float = TOLERANCE, limit: int = CELL_ROWS, few: int = FEW_ROWS) -> DataFrame:
    """frame, ref, tgt, votes: pairs of stars at the same corner of triangles of equal shape, size and hand.

    Cells are of the tolerance in shape and of a tenth in size; a reference triangle is repeated for the cells
    around its own, so the join is on equal cells; counted as few they go to the targets, else crowded cells are salted.
    """
    cells = {"_c0": F.floor(F.col("d0") / tolerance), "_c1": F.floor(F.col("d1") / tolerance), "_c2": F.floor(F.log("size") / SIZE_STEP)}
    t = targets.withColumns(cells)
    around = F.sequence(F.lit(-1), F.lit(1))
    r = references.select("session", "hand", F.col("corners").alias("_ref"), F.col("d0").alias("_r0"), F.col("d1").alias("_r1"), F.col("size").alias("_rsize"), *[c.alias(f"_b{n}") for n, c in enumerate(cells.values())])
    for n in range(3):
        r = r.withColumn("_d", F.explode(around)).withColumn(f"_c{n}", F.col(f"_b{n}") + F.col("_d")).drop("_d", f"_b{n}")
    j = cell_join(t, r, ["session", "hand", "_c0", "_c1", "_c2"], F.struct("frame_id", "corners"), limit, few)
    scale = F.col("_rsize") / F.col("size")
    j = j.filter((F.abs(F.col("d0") - F.col("_r0")) < tolerance) & (F.abs(F.col("d1") - F.col("_r1")) < tolerance) & scale.between(*SCALES))
    pair = F.explode(F.array(*[F.struct(F.get("_ref", F.lit(n)).alias("ref"), F.get("corners", F.lit(n)).alias("tgt")) for n in range(3)])).alias("_v")
    return j.select(*FRAME, pair).groupBy(*FRAME, F.col("_v.ref").alias("ref"), F.col("_v.tgt").alias("tgt")).agg(F.count("*").alias("votes"))


def mutual_votes(votes: DataFrame, least: int = 2) -> DataFrame:
    """frame, matches, pair_idx, ref, tgt: pairs that are the most voted of both their stars (ties: smaller ref, then tgt), with
    at least ``least`` votes; pair_idx counts from 0 by falling votes. ``matches`` is a third of all votes of the frame; a
    frame without such pairs has one row without a pair."""
    frame = Window.partitionBy(*FRAME)
    order = [F.desc("votes"), "ref", "tgt"]
    best = lambda *key: F.row_number().over(Window.partitionBy(*FRAME, *key).orderBy(*order))
    v = votes.withColumn("matches", F.ceil(F.sum("votes").over(frame) / 3)).withColumn("_first", best()).filter((F.col("votes") >= least) | (F.col("_first") == 1))
    v = v.withColumn("_a", best("tgt")).withColumn("_b", best("ref"))
    mutual = (F.col("votes") >= least) & (F.col("_a") == 1) & (F.col("_b") == 1)
    v = v.withColumn("_mutual", mutual).filter(F.col("_mutual") | (F.col("_first") == 1))
    index = F.sum(F.col("_mutual").cast("int")).over(frame.orderBy(*order)) - 1
    pair = lambda c: F.when(F.col("_mutual"), F.col(c).cast("int")).alias(c)
    return v.withColumn("pair_idx", index).select(*FRAME, "matches", pair("pair_idx"), pair("ref"), pair("tgt"))


# ---- frames in arrays: stars are ordered by frame (counted from 0) and star_idx, and named by their places -------------


def _run_places(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which run, place) of runs of n places from `first`."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def nearest_places(frame: np.ndarray, x: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The places of up to k stars as in `nearest`, in order of distance; -1 where there are fewer."""
    first = np.flatnonzero(np.append(True, frame[1:] != frame[:-1]))
    count = np.diff(np.append(first, len(frame)))
    span = lambda v: np.maximum.reduceat(v, first) - np.minimum.reduceat(v, first) + 1.0
    cell = np.sqrt(span(x) * span(y) * 4.0 * k / (3.141592653589793 * count))[frame]
    at = lambda v: (v - np.minimum.reduceat(v, first)[frame]).astype(np.int64) + 1
    cx, cy = at(np.floor(x / cell)), at(np.floor(y / cell))
    wide = int(cx.max()) + 2
    key = (frame * (int(cy.max()) + 2) + cy) * wide + cx
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    # the three cells of a row around a star's lie one behind the other
    rows = key[:, None] + np.array([-wide, 0, wide])
    low, high = np.searchsorted(ordered, rows - 1, "left"), np.searchsorted(ordered, rows + 1, "right")
    found = np.full((len(x), k), -1)
    part = np.cumsum((high - low).sum(axis=1)) // PAIRS_AT_ONCE
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(x))
    for a, b in zip(cuts, cuts[1:]):
        run, place = _run_places(low[a:b].ravel(), (high - low)[a:b].ravel())
        star, other = a + run // 3, order[place]
        dx, dy = x[star] - x[other], y[star] - y[other]
        d = np.sqrt(dx * dx + dy * dy)
        near = np.flatnonzero((other != star) & (d <= cell[star]))
        near = near[np.lexsort((other[near], d[near], star[near]))]
        star, other = star[near], other[near]
        begin = np.flatnonzero(np.append(True, star[1:] != star[:-1])) if len(star) else np.empty(0, int)
        rank = np.arange(len(star)) - np.repeat(begin, np.diff(np.append(begin, len(star))))
        found[star[rank < k], rank[rank < k]] = other[rank < k]
    return found


def triangle_arrays(frame: np.ndarray, x: np.ndarray, y: np.ndarray, low: float, high: float, k: int = NEIGHBOURS) -> dict[str, np.ndarray]:
    """corners, d0, d1, size and hand as in `near_triangles`."""
    near = nearest_places(frame, x, y, k) if len(x) else np.empty((0, k), int)
    picks = [(np.flatnonzero(near[:, b] >= 0), a, b) for a, b in combinations(range(k), 2)]
    t = np.sort(np.concatenate([np.stack((s, near[s, a], near[s, b]), axis=1) for s, a, b in picks]), axis=1)
    t = t[np.lexsort((t[:, 2], t[:, 1], t[:, 0]))]
    t = t[np.append(True, (t[1:] != t[:-1]).any(axis=1))] if len(t) else t

    def side(a: int, b: int) -> np.ndarray:
        dx, dy = x[t[:, a]] - x[t[:, b]], y[t[:, a]] - y[t[:, b]]
        return np.sqrt(dx * dx + dy * dy)

    # each side with the corner opposite to it, ascending
    sides = np.stack((side(1, 2), side(2, 0), side(0, 1)), axis=1)
    by = np.argsort(sides, axis=1, kind="stable")
    sides, t = np.take_along_axis(sides, by, 1), np.take_along_axis(t, by, 1)
    ok = (sides[:, 0] >= low) & (sides[:, 0] <= high) & (sides[:, 2] >= low) & (sides[:, 2] <= high) & (sides[:, 2] > 1e-6)
    sides, t = sides[ok], t[ok]
    a, b, c = t.T
    turn = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
    return {"corners": t, "d0": sides[:, 0] / sides[:, 2], "d1": sides[:, 1] / sides[:, 2], "size": sides[:, 2], "hand": np.where(turn >= 0, 1, 0)}


def like_triangles(t: dict[str, np.ndarray], r: dict[str, np.ndarray], tolerance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(target, reference) of triangles of like shape, size and hand. References are ordered by hand, cells of size and of d0, then d1."""
    if not len(t["d0"]) or not len(r["d0"]):
        return
    step = lambda s: np.floor(np.log(s["size"]) / SIZE_STEP)
    least = min(step(t).min(), step(r).min()) - 1.0
    sizes, shapes = max(step(t).max(), step(r).max()) - least + 2.0, np.floor(1.0 / tolerance) + 4.0
    cell = lambda s: (s["hand"] * sizes + step(s) - least) * shapes + np.floor(s["d0"] / tolerance) + 1.0
    order = np.argsort(4.0 * cell(r) + r["d1"])
    place = (4.0 * cell(r) + r["d1"])[order]
    around = (np.array([[-1.0], [0.0], [1.0]]) * shapes + np.array([-1.0, 0.0, 1.0])).reshape(-1, 1)
    margin = tolerance + 1e-9 + 4.0 * np.spacing(8.0 * sizes * shapes)
    for a in range(0, len(t["d0"]), TRIANGLES_AT_ONCE):
        some = {c: v[a : a + TRIANGLES_AT_ONCE] for c, v in t.items()}
        at = (4.0 * (cell(some) + around) + some["d1"]).ravel()
        first, past = np.searchsorted(place, at - margin), np.searchsorted(place, at + margin)
        run, found = _run_places(first, past - first)
        i, j = a + run % len(some["d0"]), order[found]
        scale = r["size"][j] / t["size"][i]
        like = (np.abs(t["d0"][i] - r["d0"][j]) < tolerance) & (np.abs(t["d1"][i] - r["d1"][j]) < tolerance)
        like &= (scale >= SCALES[0]) & (scale <= SCALES[1])
        yield i[like], j[like]


def _summed_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of their counts."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, int)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _block_pairs(schema: T.StructType, tolerance: float, low: float, high: float, least: int):
    """Triangles, matches and pairs of the frames of one block, from their stars and those of the session's reference."""
    arrow = to_arrow_schema(schema)

    def stars(t: pa.Table) -> tuple[np.ndarray, ...]:
        frame, idx, x, y = (t[c].to_numpy() for c in ("frame_id", "star_idx", "x", "y"))
        order = np.lexsort((idx, frame))
        return frame[order], idx[order], x[order], y[order]

    def run(targets: pa.Table, references: pa.Table) -> pa.Table:
        if not targets.num_rows:
            return arrow.empty_table()
        frame, idx, x, y = stars(targets)
        ids, at = np.unique(frame, return_inverse=True)
        _, r_idx, rx, ry = stars(references)
        t = triangle_arrays(at, x, y, low, high)
        r = triangle_arrays(np.zeros(len(rx), int), rx, ry, low, high)
        of = at[t["corners"][:, 0]]
        matches = np.zeros(len(ids), np.int64)
        keys, counts, n = [], [], len(rx)
        for i, j in like_triangles(t, r, tolerance):
            matches += np.bincount(of[i], minlength=len(ids))
            key, count = _summed_up([(t["corners"][i] * n + r["corners"][j]).ravel()], [np.ones(3 * len(i), np.int64)])
            keys.append(key)
            counts.append(count)
            if sum(map(len, keys)) > 4 * PAIRS_AT_ONCE:
                key, count = _summed_up(keys, counts)
                keys, counts = [key], [count]
        key, votes = _summed_up(keys, counts)
        key, votes = key[votes >= least], votes[votes >= least]
        tgt, ref = key // max(n, 1), key % max(n, 1)
        order = np.lexsort((tgt, ref, -votes, at[tgt]))
        tgt, ref = tgt[order], ref[order]
        # the first of each target and of each frame's reference star
        best = np.zeros((2, len(tgt)), bool)
        best[0, np.unique(tgt, return_index=True)[1]] = True
        best[1, np.unique(at[tgt] * n + ref, return_index=True)[1]] = True
        tgt, ref = tgt[best.all(axis=0)], ref[best.all(axis=0)]
        ends = np.append(0, np.cumsum(np.bincount(at[tgt], minlength=len(ids)))).astype("int32")
        columns = [r_idx[ref].astype("int32"), idx[tgt].astype("int32"), x[tgt], y[tgt], rx[ref], ry[ref]]
        pairs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c) for c in columns], ["ref", "tgt", "x", "y", "rx", "ry"]))
        session = pa.array(targets["session"][:1].to_pylist() * len(ids), arrow.field("session").type)
        out = [session, pa.array(ids), pa.array(np.bincount(of, minlength=len(ids))), pa.array(matches), pairs]
        return pa.table([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)

    return run


def block_pairs(stars: DataFrame, references: DataFrame, dealt, tolerance: float = TOLERANCE, low: float = 0.0, high: float = float("inf"), least: int = 2) -> DataFrame:
    """frame, triangles, matches and _p, the mutual pairs (ref, tgt, x, y, rx, ry) in order; the results are those of `near_triangles`,
    `near_votes` and `mutual_votes`. ``references``: the frames (session, frame_id) that are references. ``dealt`` (rows, weight, keys) puts
    the rows of equal keys into one partition."""
    pair = T.StructType([T.StructField(c, T.IntegerType()) for c in ("ref", "tgt")] + [T.StructField(c, T.DoubleType()) for c in ("x", "y", "rx", "ry")])
    schema = T.StructType([stars.schema[c] for c in FRAME]).add("triangles", T.LongType()).add("matches", T.LongType()).add("_p", T.ArrayType(pair))
    key = ["session", "_block"]
    s = stars.select(*FRAME, "star_idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    parts = s.groupBy("session").agg(F.ceil(F.count(F.lit(1)) / BLOCK_STARS).cast("int").alias("_blocks"))
    targets = cell_join(s, parts, ["session"], F.col("frame_id")).withColumn("_block", F.pmod(F.hash("frame_id"), F.col("_blocks"))).drop("_blocks")
    ref = s.join(references.select(*FRAME), FRAME, "left_semi").join(parts, "session")
    ref = ref.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    ref = ref.toDF(*ref.columns)  # new columns: both sides come of the same stars
    g = dealt(targets, F.lit(WEIGHT), key).groupBy(*key).cogroup(ref.groupBy(*key))
    return g.applyInArrow(_block_pairs(schema, tolerance, low, high, least), schema)
