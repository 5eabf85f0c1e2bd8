"""Background gradients: a grid of clipped medians, pruned, filled and subtracted.

A frame's grid has rows*cols nodes, a fixed number, so it travels as one array per
frame and channel; pruning and filling are expressions on that array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import Background
from ..functions.arrays import clip_upper, let, not_null, sorted_mad, sorted_median
from ..functions.columns import mad_sigma
from ..model import FRAME
from . import stats as S


def box_size(width: Column) -> Column:
    """1.5 % of the width, at least 9, made odd."""
    raw = F.greatest(F.floor(width * C.NODE_BOX_FRACTION), F.lit(C.NODE_BOX_MIN))
    return (raw + F.when(raw % 2 == 0, 1).otherwise(0)).cast("int")


def node_position(i: Column, size: Column, count: int) -> Column:
    """Node i of ``count`` along an axis: i*(size-1) div (count-1), so both edges have one."""
    return F.floor(i * (size - 1) / (count - 1)).cast("int")


def usable(frames: DataFrame, config: Background) -> DataFrame:
    return frames.filter((F.col("width") >= config.cols) & (F.col("height") >= config.rows))


def node_grid(frames: DataFrame, config: Background = Background()) -> DataFrame:
    """Node positions of every frame that is at least as large as the grid."""
    if config.cols < 2 or config.rows < 2:
        raise ValueError("the grid needs at least two nodes per axis")
    rows = F.explode(F.sequence(F.lit(0), F.lit(config.rows - 1))).alias("row")
    cols = F.explode(F.sequence(F.lit(0), F.lit(config.cols - 1))).alias("col")
    g = usable(frames, config).select(*FRAME, "width", "height", rows).select("*", cols)
    return g.select(
        *FRAME,
        "row",
        "col",
        node_position(F.col("col"), F.col("width"), config.cols).alias("nx"),
        node_position(F.col("row"), F.col("height"), config.rows).alias("ny"),
        box_size(F.col("width")).alias("box"),
    )


def _candidates(pos: str, size: str, count: int) -> Column:
    """Indices of the few nodes along one axis whose box may hold a pixel."""
    half = F.floor(F.col("_box") / 2)
    step = (count - 1) / (F.col(size) - 1)
    first = F.greatest(F.floor((F.col(pos) - half) * step), F.lit(0)).cast("int")
    last = F.least(F.ceil((F.col(pos) + half + 1) * step), F.lit(count - 1)).cast("int")
    return F.sequence(first, F.greatest(last, first))


def _covers(node: str, pos: str, size: str, count: int) -> Column:
    return F.abs(node_position(F.col(node), F.col(size), count) - F.col(pos)) <= F.floor(F.col("_box") / 2)


def node_boxes(pixels: DataFrame, frames: DataFrame, config: Background = Background()) -> DataFrame:
    """Samples of each node: frame, ch, row, col, v.

    A pixel computes the nodes that cover it, so the range join needs no join: pixels
    outside every box vanish in the scan's own stage.
    """
    dims = usable(frames, config).select(*FRAME, "width", "height").withColumn("_box", box_size(F.col("width")))
    j = pixels.join(dims, FRAME)
    # most pixels of a real sensor lie outside every box and go with the first filter
    r = j.withColumn("row", F.explode(_candidates("y", "height", config.rows))).filter(_covers("row", "y", "height", config.rows))
    c = r.withColumn("col", F.explode(_candidates("x", "width", config.cols))).filter(_covers("col", "x", "width", config.cols))
    return c.select(*FRAME, "ch", "row", "col", "v")


def node_values(pixels: DataFrame, frames: DataFrame, config: Background = Background()) -> DataFrame:
    """Median of each box after three rounds of upper clipping at 3 sigma.

    A box is a few thousand samples at most (1.5 % of the width, squared).
    """
    boxes = node_boxes(pixels, frames, config).groupBy(*FRAME, "ch", "row", "col").agg(F.collect_list("v").alias("_a"))
    clipped = clip_upper(F.sort_array("_a"), C.NODE_CLIP_SIGMA, C.NODE_CLIP_ROUNDS)
    return boxes.select(*FRAME, "ch", "row", "col", let(clipped, sorted_median).alias("value"))


def to_grids(nodes: DataFrame, frames: DataFrame, config: Background) -> DataFrame:
    """frame, channels, grids: per channel the node values in row-major order, NULL where missing."""
    n = config.rows * config.cols
    per_channel = nodes.groupBy(*FRAME, "ch").agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("row") * config.cols + F.col("col")).cast("int"), "value"))).alias("_m")
    )
    filled = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at("_m", i))
    per_frame = per_channel.select(*FRAME, "ch", filled.alias("_g")).groupBy(*FRAME).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ch", "_g"))), lambda s: s["_g"]).alias("grids")
    )
    return per_frame.join(frames.select(*FRAME, "width", "height", "channels"), FRAME)


def _neighbours(g: Column, i: Column, config: Background, offsets: list[tuple[int, int]]) -> Column:
    row, col = F.floor(i / config.cols), i % config.cols

    def pick(dr: int, dc: int) -> Column:
        r, c = row + dr, col + dc
        inside = (r >= 0) & (r < config.rows) & (c >= 0) & (c < config.cols)
        return F.when(inside, F.get(g, (r * config.cols + c).cast("int")))

    return not_null(F.array(*[pick(dr, dc) for dr, dc in offsets]))


AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]
SIDES = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def pruned(grid: Column, config: Background) -> Column:
    """NULL for nodes over median + 2.5 sigma, then for nodes over 1.05 x their neighbours' median."""

    def stage1(values: Column) -> Column:
        m = sorted_median(values)
        limit = m + C.PRUNE_SIGMA * mad_sigma(sorted_mad(values, m))
        return let(limit, lambda lim: F.transform(grid, lambda v: F.when(v <= lim, v)))

    def stage2(g: Column) -> Column:
        def keep(v: Column, i: Column) -> Column:
            around = F.sort_array(_neighbours(g, i, config, AROUND))
            return let(
                around,
                lambda a: F.when(v.isNotNull() & ((F.size(a) == 0) | (v <= sorted_median(a) * C.PRUNE_NEIGHBOUR_FACTOR)), v),
            )

        return F.transform(g, keep)

    values = F.sort_array(not_null(grid))
    return F.when(F.size(values) < 4, grid).otherwise(let(let(values, stage1), stage2))


def inpainted(grid: Column, config: Background) -> Column:
    """Fill NULL nodes from the mean of their known sides, all at once, until nothing changes.

    A value travels one node per round, so rows + cols rounds always suffice.
    """

    def fill(g: Column, _: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            mean = let(
                _neighbours(g, i, config, SIDES),
                lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)),
            )
            return F.coalesce(v, mean)

        # a full grid is passed on untouched
        return F.when(F.exists(g, lambda v: v.isNull()), F.transform(g, one)).otherwise(g)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(config.rows + config.cols)), grid, fill)
    return F.transform(done, lambda v: F.coalesce(v, F.lit(0.0)))


def build_model(nodes: DataFrame, frames: DataFrame, config: Background = Background()) -> DataFrame:
    """frame, width, height, channels, grids (complete), valid_nodes.

    Pruning looks at green (or the only channel) and its verdict holds for all channels;
    with fewer than four surviving nodes the grid is flat at the survivors' median.
    """
    g = to_grids(nodes, frames, config)
    judge = F.get("grids", F.when(F.col("channels") > 1, 1).otherwise(0))
    g = g.withColumn("_kept", pruned(judge, config))
    masked = F.transform("grids", lambda grid: F.transform(grid, lambda v, i: F.when(F.get("_kept", i).isNotNull(), v)))
    survivors = F.sort_array(not_null(F.col("_kept")))
    g = g.withColumn("valid_nodes", F.size(survivors))
    flat = F.array_repeat(F.coalesce(sorted_median(survivors), F.lit(0.0)), config.rows * config.cols)
    done = F.when(F.col("valid_nodes") < C.MIN_VALID_NODES, F.transform("grids", lambda _: flat)).otherwise(
        F.transform(masked, lambda grid: inpainted(grid, config))
    )
    return g.select(*FRAME, "width", "height", "channels", done.alias("grids"), "valid_nodes")


def pruned_nodes(nodes: DataFrame, frames: DataFrame, config: Background = Background()) -> DataFrame:
    """Surviving nodes of the judged channel: frame, row, col, value."""
    g = to_grids(nodes, frames, config)
    judge = F.get("grids", F.when(F.col("channels") > 1, 1).otherwise(0))
    e = g.select(*FRAME, F.posexplode(pruned(judge, config)).alias("_i", "value")).filter("value IS NOT NULL")
    return e.select(*FRAME, F.floor(F.col("_i") / config.cols).cast("int").alias("row"), (F.col("_i") % config.cols).alias("col"), "value")


def model_nodes(model: DataFrame, config: Background = Background()) -> DataFrame:
    """The model as rows: frame, ch, row, col, nx, ny, value."""
    e = model.select(*FRAME, "width", "height", F.posexplode("grids").alias("ch", "_g")).select(
        *FRAME, "width", "height", "ch", F.posexplode("_g").alias("_i", "value")
    )
    row, col = F.floor(F.col("_i") / config.cols).cast("int"), (F.col("_i") % config.cols)
    return e.select(
        *FRAME,
        "ch",
        row.alias("row"),
        col.alias("col"),
        node_position(col, F.col("width"), config.cols).alias("nx"),
        node_position(row, F.col("height"), config.rows).alias("ny"),
        "value",
    )


Estimator = Callable[[DataFrame, DataFrame, Background], DataFrame]


def estimate(pixels: DataFrame, frames: DataFrame, config: Background = Background(), custom: Estimator | None = None) -> DataFrame:
    """Background model of every frame; ``custom(pixels, frames, config)`` may supply its own."""
    if custom is not None:
        return custom(pixels, frames, config)
    return build_model(node_values(pixels, frames, config), frames, config)


def _cell(pos: Column, size: Column, count: int) -> tuple[Column, Column]:
    """Index of the cell that holds a coordinate, and the position within it."""
    guess = F.floor(pos * (count - 1) / (size - 1)).cast("int")
    cell = F.when(node_position(guess + 1, size, count) <= pos, guess + 1).otherwise(guess)
    cell = F.least(cell, F.lit(count - 2))
    a, b = node_position(cell, size, count), node_position(cell + 1, size, count)
    return cell, (pos - a) / (b - a)


def _centre_cell(pos: Column, size: Column, count: int) -> tuple[Column, Column, Column]:
    g = (pos + 0.5) * count / size - 0.5
    low = F.least(F.greatest(F.floor(g), F.lit(0)), F.lit(count - 1)).cast("int")
    return low, F.least(low + 1, F.lit(count - 1)), F.least(F.greatest(g - low, F.lit(0.0)), F.lit(1.0))


def evaluate(pixels: DataFrame, model: DataFrame, config: Background = Background(), mode: str = "nodes", keep: bool = False) -> DataFrame:
    """Add ``bg`` to every pixel; ``keep`` leaves pixels of frames without a model in, with a null.

    ``nodes`` interpolates between node coordinates (used for subtraction); ``centre``
    treats nodes as centres of equal cells.  The model joins on the frame alone.
    """
    m = model.select(*FRAME, F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("grids").alias("_grids"))
    j = pixels.join(m, FRAME, "left" if keep else "inner")
    x, y, w, h = F.col("x"), F.col("y"), F.col("_w"), F.col("_h")
    if mode == "nodes":
        (x0, fx), (y0, fy) = _cell(x, w, config.cols), _cell(y, h, config.rows)
        x1, y1 = x0 + 1, y0 + 1
    else:
        x0, x1, fx = _centre_cell(x, w, config.cols)
        y0, y1, fy = _centre_cell(y, h, config.rows)
    j = j.select(
        *pixels.columns,
        F.get("_grids", F.col("ch")).alias("_g"),
        *[c.alias(n) for c, n in ((x0, "_x0"), (x1, "_x1"), (y0, "_y0"), (y1, "_y1"), (fx, "_fx"), (fy, "_fy"))],
    )

    def node(r: str, c: str) -> Column:
        return F.get("_g", (F.col(r) * config.cols + F.col(c)).cast("int"))

    fx, fy = F.col("_fx"), F.col("_fy")
    top = node("_y0", "_x0") * (1.0 - fx) + node("_y0", "_x1") * fx
    bottom = node("_y1", "_x0") * (1.0 - fx) + node("_y1", "_x1") * fx
    return j.select(*pixels.columns, (top * (1.0 - fy) + bottom * fy).alias("bg"))


def reference_level(grid: Column, percentile: float) -> Column:
    return let(F.sort_array(grid), lambda a: F.get(a, F.floor((F.size(a) - 1) * F.lit(percentile)).cast("int")))


def auto_aggressiveness(grid: Column) -> Column:
    """From the spread of the nodes: 0.7 for even grids, 0.15 for uneven ones, linear between."""
    n = F.size(grid)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def by_mean(mean: Column) -> Column:
        cv = F.sqrt(total(F.transform(grid, lambda v: (v - mean) * (v - mean))) / n) / mean
        return F.when(mean < 1e-9, 0.5).otherwise(
            let(cv, lambda k: F.when(k < 0.03, 0.7).when(k > 0.15, 0.15).otherwise(0.7 - (k - 0.03) / 0.12 * 0.55))
        )

    return let(total(grid) / n, by_mean)


def subtraction_levels(model: DataFrame, config: Background = Background()) -> DataFrame:
    """Model with per-channel reference levels and the aggressiveness."""
    judge = F.get("grids", F.when(F.col("channels") > 1, 1).otherwise(0))
    refs = F.transform("grids", lambda g: reference_level(g, config.reference_percentile) if config.gradient_only else F.lit(0.0))
    strength = auto_aggressiveness(judge) if config.aggressiveness < 0 else F.lit(float(config.aggressiveness))
    return model.withColumn("refs", refs).withColumn("aggressiveness", strength)


def subtract(pixels: DataFrame, model: DataFrame, config: Background = Background()) -> DataFrame:
    """max(v - a*(bg - ref), 0); pixels of a frame without a model (smaller than the grid) stay as they are."""
    levels = subtraction_levels(model, config).select(*FRAME, "refs", "aggressiveness")
    j = evaluate(pixels, model, config, keep=True).join(levels, FRAME, "left")
    v = F.greatest(F.col("v") - F.col("aggressiveness") * (F.col("bg") - F.get("refs", F.col("ch"))), F.lit(0.0))
    v = F.when(F.col("aggressiveness").isNull(), F.col("v")).otherwise(v)
    return j.withColumn("v", v).select(*pixels.columns)


def block_medians(pixels: DataFrame, frames: DataFrame, rows: int, cols: int, k: float = 2.5) -> DataFrame:
    """Median per block after one cut at median + k*1.4826*mad."""
    dims = frames.select(*FRAME, F.floor(F.col("width") / cols).alias("_bw"), F.floor(F.col("height") / rows).alias("_bh"))
    j = pixels.join(dims, FRAME)
    b = j.withColumn("row", F.least(F.floor(F.col("y") / F.col("_bh")), F.lit(rows - 1)).cast("int")).withColumn(
        "col", F.least(F.floor(F.col("x") / F.col("_bw")), F.lit(cols - 1)).cast("int")
    )
    return S.upper_sigma_clip(b, [*FRAME, "ch", "row", "col"], k, 1, keep_flat=False, tasks=S.tasks_for(frames))
