"""FITS frames as a Spark data source: ``spark.read.format("fits_frames")``.

A file is one frame.  Header columns need only the header blocks; the pixel array is
decoded only when the reader is asked for it (option ``pixels`` = true).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import list_files, open_file

CARD, BLOCK = 80, 2880
DTYPES = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}  # BITPIX, fixed values
KEYWORDS = {  # column: keyword, fixed values
    "exposure_s": "EXPTIME",
    "gain": "GAIN",
    "offset": "OFFSET",
    "camera": "INSTRUME",
    "object": "OBJECT",
    "date_obs": "DATE-OBS",
    "frame_number": "FRAMENUM",
    "stacked_frames": "NCOMBINE",
    "software": "SOFTWARE",
    "cfa_pattern": "BAYERPAT",
    "binning": "XBINNING",
    "temperature": "CCD-TEMP",
    "set_temp_c": "SET-TEMP",
}
HEADER_SCHEMA = (
    "path string, frame_number bigint, width int, height int, channels int, bitpix int, date_obs timestamp, "
    "exposure_s double, gain int, offset int, camera string, object string, stacked_frames bigint, software string, "
    "cfa_pattern string, binning int, temperature double, set_temp_c double, reason string"
)
FULL_SCHEMA = HEADER_SCHEMA + ", data array<double>"


def parse_card(card: str):
    key, rest = card[:8].strip(), card[10:]
    if card[8:10] != "= ":
        return key, None
    rest = rest.strip()
    if rest.startswith("'"):
        text, i = "", 1
        while i < len(rest):
            if rest[i] == "'":
                if rest[i + 1 : i + 2] == "'":
                    text, i = text + "'", i + 2
                    continue
                break
            text, i = text + rest[i], i + 1
        return key, text.rstrip()
    value = rest.split("/")[0].strip()
    if value in ("T", "F"):
        return key, value == "T"
    try:
        return key, int(value)
    except ValueError:
        try:
            return key, float(value.replace("D", "E"))
        except ValueError:
            return key, value or None


def read_header(stream) -> dict | None:
    """One header unit; None at the end of the file."""
    cards: dict = {}
    while True:
        block = stream.read(BLOCK)
        if len(block) < BLOCK:
            return None
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            if card[:8].strip() == "END":
                return cards
            key, value = parse_card(card)
            if value is not None and key not in cards:
                cards[key] = value


def data_size(h: dict) -> int:
    n = h.get("NAXIS", 0)
    if n == 0:
        return 0
    count = abs(h["BITPIX"]) // 8
    for i in range(1, n + 1):
        count *= h[f"NAXIS{i}"]
    count += h.get("PCOUNT", 0)
    return count


def shape_of(h: dict) -> tuple[int, int, int]:
    """(width, height, channels); three planes may come first or last."""
    axes = [h[f"NAXIS{i}"] for i in range(h["NAXIS"], 0, -1)]  # slowest axis first
    if len(axes) == 2:
        return axes[1], axes[0], 1
    if len(axes) == 3 and axes[0] == 3:
        return axes[2], axes[1], 3
    if len(axes) == 3 and axes[2] == 3:
        return axes[1], axes[0], 3
    raise ValueError(f"Unsupported FITS shape: {axes}")


def first_image(stream) -> dict | None:
    """Header of the first unit that holds an image; the stream stands at its data."""
    while True:
        h = read_header(stream)
        if h is None:
            return None
        if h.get("NAXIS", 0) > 0 and h.get("XTENSION", "IMAGE").strip() == "IMAGE":
            return h
        size = data_size(h)
        stream.seek(-(-size // BLOCK) * BLOCK, os.SEEK_CUR)


def decode(raw: bytes, h: dict, w: int, ht: int, ch: int) -> np.ndarray:
    """Interleaved values: integers over their full range, floats stretched to [0, 1] per file."""
    bitpix = h["BITPIX"]
    if bitpix not in (8, 16, -32, -64):
        raise ValueError(f"Unsupported FITS image type: BITPIX {bitpix}")
    n = w * ht * ch
    if len(raw) < n * abs(bitpix) // 8:
        raise ValueError(f"Expected {n * abs(bitpix) // 8} data bytes, got {len(raw)}")
    a = np.frombuffer(raw, dtype=DTYPES[bitpix], count=n).astype("float64")
    if bitpix == 8:
        a /= 255.0
    elif bitpix == 16:
        a = (a + 32768.0) / 65535.0  # signed, or unsigned stored with BZERO 32768
    else:
        low, high = a.min(), a.max()
        a = (a - low) / max(high - low, 1e-10)
    return np.ascontiguousarray(a.reshape(ch, ht, w).transpose(1, 2, 0)).reshape(-1)


def header_row(path: str, h: dict, shape: tuple[int, int, int]) -> dict:
    row = {"path": path, "width": shape[0], "height": shape[1], "channels": shape[2], "bitpix": h["BITPIX"], "reason": None}
    for column, key in KEYWORDS.items():
        row[column] = h.get(key)
    row["exposure_s"] = h.get("EXPTIME", h.get("EXPOSURE"))
    text = row["date_obs"]
    row["date_obs"] = None
    if isinstance(text, str):
        try:
            t = datetime.fromisoformat(text.replace("Z", "+00:00"))
            row["date_obs"] = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
        except ValueError:
            pass
    for c in ("exposure_s", "temperature", "set_temp_c"):
        row[c] = None if row[c] is None else float(row[c])
    for c in ("gain", "offset", "binning", "frame_number", "stacked_frames"):
        row[c] = None if row[c] is None else int(row[c])
    return row


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FitsReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path = options["path"]
        self.pixels = str(options.get("pixels", "false")).lower() == "true"
        self.per_task = int(options.get("filespertask", 16))
        self.names = names

    def partitions(self) -> list[InputPartition]:
        files = list_files(self.path, (".fits", ".fit", ".fts"))
        return [_Files(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            row: dict = {"path": path}
            try:
                with open_file(path) as stream:
                    h = first_image(stream)
                    if h is None:
                        raise ValueError("FITS file does not contain image data in any HDU")
                    shape = shape_of(h)
                    row = header_row(path, h, shape)
                    if self.pixels:
                        row["data"] = decode(stream.read(data_size(h)), h, *shape).tolist()
            except (ValueError, KeyError, OSError) as e:
                row["reason"] = str(e)
            yield tuple(row.get(n) for n in self.names)


def card(key: str, value) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{int(value):>20}"
    elif isinstance(value, float):
        text = f"{value!r:>20}".upper()
    else:
        text = "'" + str(value).replace("'", "''")[:66].ljust(8) + "'"
    return f"{key:<8}= {text}".ljust(CARD)[:CARD].encode("ascii", "replace")


def encode_fits(data: np.ndarray, w: int, h: int, ch: int, kind: str, meta: dict) -> bytes:
    """One file: ``raw`` stores unsigned 16 bit (BZERO 32768), ``stacked`` 32-bit floats."""
    planes = np.asarray(data, dtype="float64").reshape(h, w, ch).transpose(2, 0, 1)
    raw = kind == "raw"
    if raw:
        levels = np.floor(np.clip(planes, 0.0, 1.0) * 65535.0 + 0.5).astype("int64") - 32768
        body = levels.astype(">i2").tobytes()
    else:
        body = planes.astype(">f4").tobytes()
    cards = [card("SIMPLE", True), card("BITPIX", 16 if raw else -32), card("NAXIS", 2 if ch == 1 else 3), card("NAXIS1", w), card("NAXIS2", h)]
    if ch > 1:
        cards.append(card("NAXIS3", ch))
    cards += [card("BSCALE", 1.0), card("BZERO", 32768.0 if raw else 0.0)]
    for column, key in KEYWORDS.items():
        value = meta.get(column)
        if value is None:
            continue
        if isinstance(value, datetime):
            value = value.strftime("%Y-%m-%dT%H:%M:%S.%f")
        cards.append(card(key, value))
        if column == "exposure_s":
            cards.append(card("EXPOSURE", value))
        if column == "binning":
            cards.append(card("YBINNING", value))
    cards.append(b"END".ljust(CARD))
    header = b"".join(cards)
    pad = lambda b, fill: b + fill * (-len(b) % BLOCK)
    return pad(header, b" ") + pad(body, b"\0")


class FitsWriter(DataSourceWriter):
    """One file per row: session, frame_id, width, height, channels, data, optional header columns."""

    def __init__(self, options: dict, names: list[str]):
        self.path, self.kind, self.names = options["path"], options.get("kind", "raw"), names

    def write(self, iterator) -> WriterCommitMessage:
        for row in iterator:
            r = row.asDict() if hasattr(row, "asDict") else dict(zip(self.names, row))
            folder = os.path.join(self.path, str(r["session"]))
            os.makedirs(folder, exist_ok=True)
            body = encode_fits(np.asarray(r["data"]), r["width"], r["height"], r["channels"], self.kind, r)
            target = os.path.join(folder, f"{self.kind}_{int(r['frame_id']):08d}.fits")
            # a retried task writes the same name; the rename makes it appear whole
            with open(f"{target}.{os.getpid()}.tmp", "wb") as f:
                f.write(body)
            os.replace(f"{target}.{os.getpid()}.tmp", target)
        return WriterCommitMessage()


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_frames"

    def schema(self) -> str:
        return FULL_SCHEMA if str(self.options.get("pixels", "false")).lower() == "true" else HEADER_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FitsReader(dict(self.options), schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FitsWriter(dict(self.options), schema.fieldNames())


def fits_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header catalogue; no pixel block is read."""
    spark.dataSource.register(FitsSource)
    return spark.read.format("fits_frames").option("path", path).load()


def _frame_id() -> "F.Column":
    return F.xxhash64("path")


def fits_frames(spark: SparkSession, path: str, session: str = "fits") -> tuple[DataFrame, DataFrame]:
    """(frames with ``data``, rejects with ``reason``). frame_id is a hash of the path."""
    spark.dataSource.register(FitsSource)
    rows = spark.read.format("fits_frames").option("path", path).option("pixels", "true").load()
    rows = rows.select(F.lit(session).alias("session"), _frame_id().alias("frame_id"), "*")
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL").select("path", "reason")


def write_fits(frames: DataFrame, path: str, kind: str = "raw") -> None:
    """One FITS file per frame row (``data`` interleaved) under ``path``/session."""
    frames.sparkSession.dataSource.register(FitsSource)
    frames.write.format("fits_frames").option("path", path).option("kind", kind).mode("append").save()
