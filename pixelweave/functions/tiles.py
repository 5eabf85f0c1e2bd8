"""Frames as square tiles: one row per tile, its samples as little-endian float64 bytes.

Tile (ty, tx) covers rows ty*side to ty*side + h - 1 and columns tx*side to tx*side + w - 1 of a frame of
fw x fh samples; a sample that is not there is NaN. No task holds a frame: kernels see one tile with
its halo, and only the strips within the halo's reach of a neighbour are sent to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..model import FRAME

SIDE = 256
KEY = [*FRAME, "ch", "ty", "tx"]
# bytes of samples in one emitted batch, and of those turned into rows at a time
BATCH = 1 << 22
SHAPE = [T.StructField(n, T.IntegerType()) for n in ("ch", "ty", "tx", "h", "w", "fh", "fw")]


def tile_schema(df: DataFrame, extra: Sequence[T.StructField] = ()) -> T.StructType:
    """Tile columns with the frame key types of `df`."""
    frame = [T.StructField(n, df.schema[n].dataType) for n in FRAME]
    return T.StructType([*frame, *SHAPE, *extra, T.StructField("data", T.BinaryType())])


class Rows:
    """Collects output rows and gives them as batches of bounded size."""

    def __init__(self, schema: T.StructType):
        self.schema, self.rows, self.size = to_arrow_schema(schema), [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 64 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if self.size >= BATCH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def samples(data: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(h, w)


def records(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, a slice of some BATCH bytes at a time."""
    step = max(1, BATCH * batch.num_rows // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield from batch.slice(at, step).to_pylist()


def _sorted_by(df: DataFrame, keys: list[str], *then: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *then)


def cut(pixels: DataFrame, frames: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of a long table. Samples outside the frame's size, and frames `frames` does not list, have no tile."""
    ch = F.col("ch") if "ch" in pixels.columns else F.lit(0).alias("ch")
    dims = frames.select(*FRAME, F.col("height").cast("int").alias("fh"), F.col("width").cast("int").alias("fw"))
    ty, tx = (F.floor(F.col(c) / side).cast("int").alias(f"t{c}") for c in "yx")
    rows = pixels.select(*FRAME, ch.cast("int"), ty, tx, "y", "x", F.col("v").cast("double"))
    canvas = T.StructType([f for f in tile_schema(pixels).fields if f.name not in ("h", "w", "fh", "fw")])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, grid = Rows(canvas), None, None
        for batch in batches:
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*KEY, "y", "x", "v")}
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for k in KEY:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            cuts = np.flatnonzero(change)
            for a, b in zip(cuts, np.r_[cuts[1:], batch.num_rows]):
                key = tuple(cols[k][a] for k in KEY)
                if key != current:
                    if current is not None:
                        yield from out.add(*current, grid.tobytes())
                    current, grid = key, np.full((side, side), np.nan)
                grid[cols["y"][a:b] - key[3] * side, cols["x"][a:b] - key[4] * side] = cols["v"][a:b]
        if current is not None:
            yield from out.add(*current, grid.tobytes())
        yield from out.flush()

    whole = _sorted_by(rows, KEY, "y", "x").mapInArrow(assemble, canvas).join(dims, FRAME)
    schema = tile_schema(pixels)

    def crop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for r in records(batch):
                h, w = min(side, r["fh"] - r["ty"] * side), min(side, r["fw"] - r["tx"] * side)
                if min(h, w, r["ty"] + 1, r["tx"] + 1) > 0:
                    data = np.ascontiguousarray(samples(r["data"], side, side)[:h, :w]).tobytes()
                    yield from out.add(*[r[k] for k in KEY], h, w, r["fh"], r["fw"], data)
        yield from out.flush()

    return whole.mapInArrow(crop, schema)


def of_frames(frames: DataFrame, side: int = SIDE, data: str = "data") -> DataFrame:
    """Tiles of frame rows whose `data` array holds rows of interleaved channels; a frame is cut where it is read."""
    schema = tile_schema(frames)
    rows = frames.select(*FRAME, *[F.col(c).cast("int") for c in ("height", "width", "channels")], F.col(data).cast("array<double>").alias("data"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            values = batch.column("data")
            for i, r in enumerate(batch.drop_columns(["data"]).to_pylist()):
                fh, fw, n = r["height"], r["width"], r["channels"]
                cube = values[i].values.to_numpy(zero_copy_only=False).reshape(fh, fw, n)
                for c in range(n):
                    for y in range(0, fh, side):
                        for x in range(0, fw, side):
                            part = np.ascontiguousarray(cube[y : y + side, x : x + side, c], "<f8")
                            yield from out.add(*[r[k] for k in FRAME], c, y // side, x // side, *part.shape, fh, fw, part.tobytes())
        yield from out.flush()

    return rows.mapInArrow(slices, schema)


def melt(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """The long table of tiles: session, frame_id, ch, y, x, v; NaN samples are not there."""
    fields = [tiles.schema[n] for n in FRAME]
    schema = T.StructType([*fields, *[T.StructField(n, T.IntegerType()) for n in ("ch", "y", "x")], T.StructField("v", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in (*KEY, "h", "w")}
                v = samples(batch.column("data")[i].as_buffer(), r["h"], r["w"])
                y, x = np.nonzero(~np.isnan(v))
                if not len(y):
                    continue
                same = [pa.array([r[n]] * len(y), f.type) for n, f in zip((*FRAME, "ch"), arrow)]
                place = [pa.array((a + o * side).astype(np.int32)) for a, o in ((y, r["ty"]), (x, r["tx"]))]
                yield pa.RecordBatch.from_arrays([*same, *place, pa.array(v[y, x])], schema=arrow)

    return tiles.select(*KEY, "h", "w", "data").mapInArrow(spread, schema)


def _pieces(schema: T.StructType) -> T.StructType:
    """A part of a tile on its way to a tile that needs it: where it begins in the frame, and its size."""
    return T.StructType([*schema.fields[:-1], *[T.StructField(n, T.IntegerType()) for n in ("py", "px", "ph", "pw")], schema.fields[-1]])


Need = Callable[[dict], Iterator[tuple[int, int, tuple[int, int, int, int]]]]


def exchanged(tiles: DataFrame, need: Need, kernel, out_schema: T.StructType, side: int) -> DataFrame:
    """Send the parts of each tile that other tiles need to them, then run `kernel` on every tile that got any.

    `need(tile)` gives (ty, tx, (y0, x0, y1, x1)) of the targets that may want a part of it: the part is what the rectangle
    has in common with the tile. `kernel(target, parts)` gets the target's columns and a list of
    (y0, x0, samples) and yields output rows. Extra columns of `tiles` must be the same in all tiles of a frame.
    """
    fields = [f for f in tiles.schema.fields if f.name not in ("h", "w", "data")]
    plain = T.StructType([*fields, tiles.schema["data"]])
    schema = _pieces(plain)
    names = [f.name for f in fields]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in (*names, "h", "w")}
                v = samples(batch.column("data")[i].as_buffer(), r["h"], r["w"])
                top, left = r["ty"] * side, r["tx"] * side
                for ty, tx, (y0, x0, y1, x1) in need(r):
                    y0, x0, y1, x1 = max(y0, top), max(x0, left), min(y1, top + r["h"]), min(x1, left + r["w"])
                    if y0 < y1 and x0 < x1:
                        part = np.ascontiguousarray(v[y0 - top : y1 - top, x0 - left : x1 - left])
                        yield from out.add(*[{**r, "ty": ty, "tx": tx}[n] for n in names], y0, x0, *part.shape, part.tobytes())
        yield from out.flush()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, parts = Rows(out_schema), None, []
        for batch in batches:
            for r in records(batch):
                key = tuple(r[k] for k in KEY)
                if current is not None and key != tuple(current[k] for k in KEY):
                    for row in kernel(current, parts):
                        yield from out.add(*row)
                    current, parts = None, []
                if current is None:
                    current = {n: r[n] for n in names}
                parts.append((r["py"], r["px"], samples(r["data"], r["ph"], r["pw"])))
        if current is not None:
            for row in kernel(current, parts):
                yield from out.add(*row)
        yield from out.flush()

    # a tile gets at most the parts of the tiles around it, so a run of equal keys is bounded
    return _sorted_by(tiles.mapInArrow(send, schema), KEY, "py", "px").mapInArrow(receive, out_schema)


def canvas(parts: list[tuple[int, int, np.ndarray]], y0: int, x0: int, y1: int, x1: int) -> np.ndarray:
    """The rectangle of the frame put together from parts; NaN where none has a sample."""
    out = np.full((y1 - y0, x1 - x0), np.nan)
    for py, px, v in parts:
        a, b, c, d = max(py, y0), min(py + v.shape[0], y1), max(px, x0), min(px + v.shape[1], x1)
        if a < b and c < d:
            out[a - y0 : b - y0, c - x0 : d - x0] = v[a - py : b - py, c - px : d - px]
    return out


def size_of(r: dict, side: int) -> tuple[int, int]:
    """Height and width of a tile from its frame's size."""
    return min(side, r["fh"] - r["ty"] * side), min(side, r["fw"] - r["tx"] * side)


def with_halo(tiles: DataFrame, radius: int, kernel, out_schema: T.StructType, side: int = SIDE, repeat_edge: bool = False) -> DataFrame:
    """Run `kernel(tile, block)` on every tile; `block` is the tile with `radius` samples around it.

    Outside the frame the block holds NaN, or the edge's samples where `repeat_edge`.
    """

    def need(r: dict) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
        rows, columns = -(-r["fh"] // side), -(-r["fw"] // side)
        h, w = size_of(r, side)
        for ty in range(max(0, (r["ty"] * side - radius) // side), min(rows - 1, (r["ty"] * side + h - 1 + radius) // side) + 1):
            for tx in range(max(0, (r["tx"] * side - radius) // side), min(columns - 1, (r["tx"] * side + w - 1 + radius) // side) + 1):
                yield ty, tx, (ty * side - radius, tx * side - radius, (ty + 1) * side + radius, (tx + 1) * side + radius)

    def run(r: dict, parts: list) -> Iterator[tuple]:
        y0, x0 = r["ty"] * side, r["tx"] * side
        if not any(y0 <= py < y0 + side and x0 <= px < x0 + side for py, px, _ in parts):
            return  # only strips of neighbours: the tile itself has no sample
        h, w = size_of(r, side)
        a, b, c, d = max(0, y0 - radius), min(r["fh"], y0 + h + radius), max(0, x0 - radius), min(r["fw"], x0 + w + radius)
        block = canvas(parts, a, c, b, d)
        around = ((a - y0 + radius, y0 + h + radius - b), (c - x0 + radius, x0 + w + radius - d))
        block = np.pad(block, around, mode="edge") if repeat_edge else np.pad(block, around, constant_values=np.nan)
        yield from kernel({**r, "h": h, "w": w}, block)

    return exchanged(tiles, need, run, out_schema, side)


def shifted(block: np.ndarray, radius: int, dy: int, dx: int) -> np.ndarray:
    """The samples at an offset from each sample of the tile inside the block."""
    h, w = block.shape[0] - 2 * radius, block.shape[1] - 2 * radius
    return block[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
