"""SER video as a Spark data source: ``spark.read.format("ser_frames")``.

Frames have a fixed size, so a file is split by frame ranges and each task seeks to its
own first frame. Ranges of small files share a task.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .files import list_files, open_file

# format constants, fixed values
SIGNATURE = b"LUCAM-RECORDER"
HEADER = "<14s7I40s40s40sQQ"
HEADER_SIZE = 178
COLOURS = {0: "mono", 8: "RGGB", 9: "GRBG", 10: "GBRG", 11: "BGGR", 100: "rgb", 101: "bgr"}
# bytes of a file that one task reads at least, if there are more, and those that opening a file counts as
TASK_BYTES = 1 << 22
OPEN_BYTES = 1 << 16
# bytes of samples in one batch of rows
BATCH = 1 << 22
EPOCH = datetime(1601, 1, 1, tzinfo=timezone.utc)
SER_SCHEMA = (
    "path string, frame_index bigint, width int, height int, channels int, bit_depth int, colour string, "
    "observer string, instrument string, telescope string, ts timestamp, reason string, data array<double>"
)


def filetime(ticks: int) -> datetime | None:
    """100-nanosecond ticks since 1601; zero means unknown."""
    return EPOCH + timedelta(microseconds=ticks // 10) if ticks else None


def to_filetime(t: datetime) -> int:
    d = t - EPOCH
    return (d.days * 86_400_000_000 + d.seconds * 1_000_000 + d.microseconds) * 10


def parse_header(b: bytes) -> dict:
    if len(b) < HEADER_SIZE:
        raise ValueError("SER header too short")
    f = struct.unpack(HEADER, b[:HEADER_SIZE])
    if f[0] != SIGNATURE:
        raise ValueError("Invalid SER signature")
    if f[2] not in COLOURS:
        raise ValueError(f"Unknown SER color ID: {f[2]}")
    text = [s.rstrip(b"\0 ").decode("utf-8", "replace") for s in f[8:11]]
    h = {
        "colour": COLOURS[f[2]],
        "little": f[3] != 0,
        "width": f[4],
        "height": f[5],
        "bit_depth": f[6],
        "count": f[7],
        "observer": text[0],
        "instrument": text[1],
        "telescope": text[2],
    }
    h["samples"] = 3 if h["colour"] in ("rgb", "bgr") else 1
    h["bytes"] = 1 if h["bit_depth"] <= 8 else 2
    h["frame_size"] = h["width"] * h["height"] * h["samples"] * h["bytes"]
    return h


def decode_frame(raw: bytes, h: dict) -> tuple[np.ndarray, int]:
    """(interleaved values in [0, 1], channels): mono becomes three equal channels, BGR is
    swapped, a colour filter frame stays mono for the debayer operators.

    Only colour-filter and RGB frames honour the byte order flag.
    """
    swap = h["bytes"] == 2 and not h["little"] and h["colour"] not in ("mono", "bgr")
    dtype = "u1" if h["bytes"] == 1 else (">u2" if swap else "<u2")
    a = np.frombuffer(raw, dtype=dtype).astype("float64") / (255.0 if h["bytes"] == 1 else 65535.0)
    if h["colour"] == "mono":
        return np.repeat(a, 3), 3
    if h["colour"] == "bgr":
        return a.reshape(-1, 3)[:, ::-1].reshape(-1), 3
    return a, h["samples"]


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges  # path, first frame, frame after the last


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    def column(f: pa.Field) -> pa.Array:
        values = [r.get(f.name) for r in rows]
        if f.name != "data":
            return pa.array(values, f.type)
        ends = np.cumsum([0, *(0 if v is None else v.size for v in values)], dtype=np.int32)
        flat = np.concatenate([np.empty(0), *(v for v in values if v is not None)])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), type=f.type, mask=pa.array([v is None for v in values]))

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


class SerReader(DataSourceReader):
    """Without ``framesPerTask`` a task reads ranges of one file or of several, of some TASK_BYTES; with it, one range of so many frames."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path = options["path"]
        self.asked = "framespertask" in options
        self.per_task = int(options.get("framespertask", 64))
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        out: list[_Ranges] = []
        room = 0
        for path in list_files(self.path, (".ser",)):
            count, size = 1, 1  # where the header is wrong the task reports the reason
            try:
                with open_file(path) as f:
                    h = parse_header(f.read(HEADER_SIZE))
                    count, size = h["count"], max(h["frame_size"], 1)
            except ValueError:
                pass
            step = self.per_task if self.asked else max(self.per_task, TASK_BYTES // size)
            for i in range(0, count, step):
                last = min(i + step, count)
                need = max((last - i) * size, OPEN_BYTES)
                if self.asked or need > room:
                    out.append(_Ranges([]))
                    room = TASK_BYTES
                out[-1].ranges.append((path, i, last))
                room -= need
        return out or [_Ranges([])]

    def rows(self, path: str, first: int, last: int) -> Iterator[dict]:
        try:
            with open_file(path) as f:
                h = parse_header(f.read(HEADER_SIZE))
                end = HEADER_SIZE + h["frame_size"] * h["count"]
                stamped = os.fstat(f.fileno()).st_size >= end + 8 * h["count"]
                base = {k: h[k] for k in ("width", "height", "bit_depth", "colour", "observer", "instrument", "telescope")}
                for i in range(first, last):
                    row = {"path": path, "frame_index": i, **base, "channels": 3 if h["colour"] in ("mono", "rgb", "bgr") else 1}
                    if "data" in self.schema.names:
                        f.seek(HEADER_SIZE + i * h["frame_size"])
                        raw = f.read(h["frame_size"])
                        if len(raw) < h["frame_size"]:
                            row["reason"] = f"Failed to read frame data: {len(raw)} of {h['frame_size']} bytes"
                        else:
                            row["data"] = decode_frame(raw, h)[0]
                    if stamped:
                        f.seek(end + 8 * i)
                        row["ts"] = filetime(struct.unpack("<Q", f.read(8))[0])
                    yield row
        except ValueError as e:
            yield {"path": path, "reason": str(e)}

    def read(self, p: _Ranges) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        held, size = [], 0
        for place in p.ranges:
            for row in self.rows(*place):
                held.append(row)
                size += 256 + (row["data"].nbytes if row.get("data") is not None else 0)
                if size >= BATCH:
                    yield _batch(held, arrow)
                    held, size = [], 0
        if held:
            yield _batch(held, arrow)


class SerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ser_frames"

    def schema(self) -> T.StructType | str:
        if str(self.options.get("pixels", "true")).lower() == "true":
            return SER_SCHEMA
        return SER_SCHEMA.removesuffix(", data array<double>")

    def reader(self, schema) -> DataSourceReader:
        return SerReader(dict(self.options), schema)


def ser_frames(spark: SparkSession, path: str, session: str = "ser", pixels: bool = True) -> DataFrame:
    """Frame rows of all SER files under ``path``; frame_id hashes path and index."""
    spark.dataSource.register(SerSource)
    rows = spark.read.format("ser_frames").option("path", path).option("pixels", str(pixels).lower()).load()
    return rows.select(
        F.lit(session).alias("session"),
        F.xxhash64("path", "frame_index").alias("frame_id"),
        (F.col("frame_index") + 1).alias("frame_number"),
        "*",
        F.when(F.col("colour").isin("RGGB", "GRBG", "GBRG", "BGGR"), F.col("colour")).alias("pattern"),
    )


def header_bytes(w: int, h: int, count: int, colour: str, bit_depth: int, text: tuple[str, str, str] = ("", "", ""), start: int = 0) -> bytes:
    code = {v: k for k, v in COLOURS.items()}[colour]
    names = [t.encode()[:40] for t in text]
    return struct.pack(HEADER, SIGNATURE, 0, code, 1, w, h, bit_depth, count, *names, start, start)


def write_ser(frames: DataFrame, path: str, bit_depth: int = 16, colour: str = "mono", part_frames: int = 4096) -> DataFrame:
    """Frames of a session as SER files of up to ``part_frames`` frames each, in frame order.

    ``frames``: session, frame_number (1-based, dense), width, height, channels, data
    (interleaved) and optionally ts.  A long session becomes a series of files, written
    by different tasks.  Returns path and frames of each file.
    """
    top = 255.0 if bit_depth <= 8 else 65535.0
    kind = "<u1" if bit_depth <= 8 else "<u2"

    def save(key, table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["frame_number"])
        first = rows[0]
        folder = os.path.join(path, str(key[0].as_py()))
        os.makedirs(folder, exist_ok=True)
        target = os.path.join(folder, f"part_{key[1].as_py():06d}.ser")
        with open(target + ".tmp", "wb") as f:
            f.write(header_bytes(first["width"], first["height"], len(rows), colour, bit_depth))
            for r in rows:
                a = np.asarray(r["data"], dtype="float64")
                if colour == "bgr":
                    a = a.reshape(-1, 3)[:, ::-1].reshape(-1)
                f.write(np.floor(np.clip(a, 0.0, 1.0) * top + 0.5).astype(kind).tobytes())
            if all(r.get("ts") is not None for r in rows):
                for r in rows:
                    f.write(struct.pack("<Q", to_filetime(r["ts"])))
        os.replace(target + ".tmp", target)
        return pa.table({"path": [target], "frames": pa.array([len(rows)], pa.int64())})

    cols = ["session", "part", "frame_number", "width", "height", "data", *(["ts"] if "ts" in frames.columns else [])]
    parts = frames.withColumn("part", F.floor((F.col("frame_number") - 1) / part_frames).cast("long")).select(*cols)
    return parts.groupBy("session", "part").applyInArrow(save, "path string, frames bigint")
