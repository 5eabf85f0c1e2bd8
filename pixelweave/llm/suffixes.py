"""Suffix-array dedup on bytes: remove every byte of a string of 200 bytes that also starts elsewhere.

Spark counts the 32-byte grams at content-chosen positions and the hashes of the stretches that hold them; unique
ones leave (`passages`). Positions of equal gram go to one shard, and prefix doubling runs in numpy inside each shard:
the pairs (rank at i, rank at i + h) are sorted and re-ranked for h = 32, 64, 128 and past the threshold; positions of
unique rank leave at every round. Grams beyond the shard bound are not doubled: their windows are counted by 128-bit
fingerprints (`_counted`). Spark does not sort or re-rank positions itself.

Null or empty text: nothing to remove, zero bytes. Texts under the threshold are kept. Repeated rows of at least
that length repeat each other and are removed whole. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .passages import Kind, covered, unpack, with_spans
from .winnow import gram_hashes

THRESHOLD = 200
FIRST = 32
SHARD_ROWS = 20_000


def _ranks(values: np.ndarray) -> np.ndarray:
    """Rank of each value among the repeated ones, -1 where it is unique; by one sort."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    alone = new & np.concatenate((new[1:], [True]))
    rank = np.cumsum(new) - 1
    out = np.empty(len(values), np.int64)
    out[order] = np.where(alone, -1, rank)
    return out


def doubled(stretches: list[bytes], size: int, first: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """First and last start, within each stretch, of a window that occurs twice in all stretches (else -1)."""
    codes = np.frombuffer(b"".join(stretches), np.uint8)
    ends = np.cumsum([len(s) for s in stretches])
    limit = np.repeat(ends, np.diff(ends, prepend=0))
    h = min(first, 1 << (size.bit_length() - 1))
    rank = np.full(len(codes), -1, np.int64)
    at = np.flatnonzero(np.arange(len(codes)) + h <= limit)
    rank[at] = _ranks(gram_hashes(codes, h)[at])
    while h < size:
        step = min(h, size - h)  # the last step overlaps, so that it ends at the threshold
        at = at[(rank[at] >= 0) & (at + h + step <= limit[at])]
        at = at[rank[at + step] >= 0]
        pair = rank[at] << 32 | rank[at + step]
        rank = np.full(len(codes), -1, np.int64)
        if len(at):
            rank[at] = _ranks(pair)
        h += step
    at = at[rank[at] >= 0]
    begin = np.concatenate(([0], ends[:-1]))
    row = np.searchsorted(ends, at, side="right")
    low = np.full(len(stretches), -1, np.int64)
    high = low.copy()
    low[row[::-1]] = (at - begin[row])[::-1]
    high[row] = at - begin[row]
    return low, high


def _codes(text: str):
    data = text.encode("utf-8", "surrogateescape")
    return np.frombuffer(data, np.uint8), lambda a, b: data[a:b]


def kind(threshold: int = THRESHOLD, first: int = FIRST, shard_rows: int = SHARD_ROWS) -> Kind:
    return Kind(_codes, threshold, first, doubled, shard_rows)


def _cut(z: bytes, packed) -> tuple[bytes, bytes, int]:
    data = unpack(z).encode()
    b, e = covered([] if packed is None else packed, len(data))
    kept, at = [], 0
    for i, j in zip(b.tolist(), e.tolist()):
        kept.append(data[at:i])
        at = j
    kept.append(data[at:])
    return data, b"".join(kept), len(b)


def removals(docs: DataFrame, how: Kind | None = None, **columns: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for z, packed in zip(batch.z, batch.spans):
                data, kept, n = _cut(z, packed)
                rows.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", batch.doc_id.astype("Int64"))
            yield out

    joined = with_spans(texts(docs, **columns), how or kind())
    return joined.select("doc_id", "z", "spans").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Kind | None = None) -> DataFrame:
    """`docs` with the repeated bytes taken out of the text; a character of which only some bytes are left goes too.

    Rows and their other columns stay as they are; a null text stays null.
    """
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), docs[text_col].isNull().alias("none"), F.struct(*[docs[f"`{c}`"].alias(c) for c in rest]).alias("rest")
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [None if none.as_py() else _cut(z.as_py(), p.as_py())[1].decode("utf-8", "ignore") for z, p, none in zip(batch.column("z"), batch.column("spans"), batch.column("none"))]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(out, pa.string())], ["rest", "kept"])

    joined = with_spans(rows, how or kind()).select("z", "spans", "none", "rest")
    cut = joined.mapInArrow(run, f"rest {rows.schema['rest'].dataType.simpleString()}, kept string")
    return cut.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
