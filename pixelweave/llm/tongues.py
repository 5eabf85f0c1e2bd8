"""Language of a text by bit-sliced Bloom filters of letter n-grams.

1. Learning: about `PER_LANGUAGE` documents of each language (all where it has fewer; a hash of the id decides, so
   reruns agree). n-grams of letters inside a word, its borders included, are counted per language. A language holds an
   n-gram whose share among its own n-grams is at least `RARE` and at least `TYPICAL` of the largest share any
   language gives it. So a language holds at most 1 / RARE n-grams, whatever the corpus.
2. The filter has `POSITIONS` positions, each a bitmask with one bit per language (64 to a slice, as many slices as
   needed). An n-gram sets its languages' bits at `PROBES` positions; the AND over its positions returns all
   languages that hold it at once.
3. A text: the masks of all its n-grams are counted per language (popcounts over the bit slices). With f the chance
   that unset n-grams answer for a language (its fill to the power of the probes), hits become (hits - n f) / (1 - f).
   The largest count decides; ties: the language with more learned documents, then by code point.

score: the winner's share of all languages' corrected hits, 0 where none has any. A text without a hit gets the
language with most learned documents. Null texts, texts without letters, and all texts when nothing could be learned:
`und` with score 0. Null ids are hashed as an empty string and are held out unless its remainder is not 0. Whole
texts are read, in slices of bounded size. Repeated rows are each judged. Empty table: no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .places import stored

# bound of the labelled sample the filter is learned from, in documents per language
PER_LANGUAGE = 4_000
SIZES = (2, 3, 4)
RARE = 1e-5
TYPICAL = 0.3
POSITIONS = 1 << 21
PROBES = 3
# characters of one slice of texts
SLICE = 1 << 20


@cache
def letters() -> np.ndarray:
    """Lower-case letter of each code point, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit mix with wrapping products."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def slices(column: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, row of each) in pieces of about SLICE characters; a longer text goes over several pieces.

    A piece begins with the last code points of the one before where it cuts a text, so n-grams across the cut are
    seen once: `grams` counts a gram in the piece that holds its end.
    """
    held, rows, size = [], [], 0
    for k, text in enumerate(column):
        if not text:
            continue
        at = 0
        while at < len(text):
            part = text[at : at + SLICE - size]
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            held.append(codes)
            rows.append(np.full(len(codes), k, np.int64))
            at += len(part)
            size += len(part)
            if size >= SLICE:
                yield np.concatenate(held), np.concatenate(rows)
                held, rows, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(rows)


class Grams:
    """n-grams of consecutive slices; carries the last characters over a cut text."""

    def __init__(self) -> None:
        self.tail = np.zeros(0, np.uint32)
        self.row = -1

    def of(self, codes: np.ndarray, rows: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, rows) of the n-grams that end in this slice; `last`: no text goes on after it."""
        low = letters()[codes]
        carried = self.tail if len(rows) and rows[0] == self.row else np.zeros(0, np.uint32)
        first, end = (rows[0], rows[-1]) if len(rows) else (0, 0)
        # a border between rows, and before and after everything
        cuts = np.flatnonzero(np.diff(rows)) + 1
        low = np.insert(low, cuts, 0)
        rows = np.insert(rows, cuts, rows[cuts])
        lead = carried if len(carried) else np.zeros(1, np.uint32)
        n = len(lead)
        low = np.concatenate((lead, low, np.zeros(1 if last else 0, np.uint32)))
        rows = np.concatenate((np.full(n, first), rows, np.full(1 if last else 0, end)))
        # runs of non-letters count as one border
        keep = np.r_[True, (low[1:] != 0) | (low[:-1] != 0)]
        keep[:n] = True
        low, rows = low[keep], rows[keep]
        fresh = np.arange(len(low)) >= n
        found, owner = [], []
        for size in SIZES:
            if len(low) < size:
                continue
            count = len(low) - size + 1
            key = np.zeros(count, np.uint64)
            inner = np.ones(count, bool)
            for k in range(size):
                c = low[k : k + count]
                key = key * np.uint64(1_114_117) + c.astype(np.uint64)
                if 0 < k < size - 1:
                    inner &= c != 0
            ends = fresh[size - 1 : size - 1 + count]
            inner &= ends
            found.append(_mixed(key[inner] ^ np.uint64(size << 60)))
            # a gram that ends at a border belongs to the letter before it
            owner.append(np.where(low[size - 1 :] != 0, rows[size - 1 :], rows[size - 2 : -1])[inner])
        self.tail = low[-(max(SIZES) - 1) :]
        self.row = -1 if last else end
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(owner)


def grams(column: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, rows) of the n-grams of texts, slice by slice."""
    reader, waiting = Grams(), None
    for piece in slices(column):
        if waiting is not None:
            # a text goes on where the next slice begins with the row this one ends with
            yield reader.of(*waiting, last=bool(waiting[1][-1] != piece[1][0]))
        waiting = piece
    if waiting is not None:
        yield reader.of(*waiting, last=True)


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


@dataclass(frozen=True)
class Filter:
    languages: list[str]  # by falling number of learned documents, then code point
    table: np.ndarray  # POSITIONS x slices of uint64
    false: np.ndarray  # chance of a false answer per language


def _positions(h: np.ndarray) -> list[np.ndarray]:
    """The probe positions of hashes: double hashing with an odd step."""
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(POSITIONS - 1)).astype(np.int64) for k in range(PROBES)]


def learn(train: DataFrame, per_language: int = PER_LANGUAGE) -> Filter | None:
    """The filter from rows of doc_id, text, lang; None where no row has both a text and a language."""
    train = train.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return None
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    index = {x: i for i, x in enumerate(languages)}
    spark = train.sparkSession
    listed = spark.createDataFrame([(x, i, min(1.0, per_language / sizes[x])) for x, i in index.items()], "lang string, which int, part double")
    # the part of a language that is read is a hash of the row, so the sample is spread and reruns agree
    chance = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    chosen = train.join(F.broadcast(listed), "lang").filter(chance < F.col("part")).select("which", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column("which").to_numpy()
            for h, rows in grams(batch.column("text").to_pylist()):
                if not len(h):
                    continue
                lang = which[rows].astype(np.uint16)
                order = np.lexsort((h, lang))
                h, lang = h[order], lang[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang[new].astype(np.int32)), pa.array(h[new].view(np.int64)), pa.array(np.diff(np.r_[new, len(h)]))], ["which", "gram", "n"]
                )

    counted = stored(chosen.mapInArrow(count, "which int, gram long, n long").groupBy("gram", "which").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("which").agg(F.sum("n").alias("all"))
    shares = counted.join(F.broadcast(totals), "which").withColumn("share", F.col("n") / F.col("all")).filter(F.col("share") >= RARE)
    # at most one row a language in a group, so the window and the list are small
    held = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("which", "share")).alias("of"))
    own = held.select("gram", F.explode("of").alias("o"), "top").filter("o.share >= top * %r" % TYPICAL)
    masks = own.groupBy("gram", F.floor(F.col("o.which") / 64).cast("int").alias("part")).agg(F.bit_or(F.expr("shiftleft(1L, o.which % 64)")).alias("mask"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("gram").to_numpy().view(np.uint64)
            for at in _positions(h):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("part"), batch.column("mask")], ["at", "part", "mask"])

    bits = masks.mapInArrow(probe, "at int, part int, mask long").groupBy("at", "part").agg(F.bit_or("mask").alias("mask"))
    found = bits.toArrow()  # at most POSITIONS rows a slice
    table = np.zeros((POSITIONS, (len(languages) + 63) // 64), np.uint64)
    table[found.column("at").to_numpy(), found.column("part").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Filter(languages, table, fill**PROBES)


def popcounts(column: list[str | None], model: Filter) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams per text, hits per text and language)."""
    n = np.zeros(len(column), np.int64)
    hits = np.zeros((len(column), len(model.languages)), np.int64)
    for h, rows in grams(column):
        if not len(h):
            continue
        at = _positions(h)
        mask = model.table[at[0]]
        for p in at[1:]:
            mask &= model.table[p]
        n += np.bincount(rows, minlength=len(column))
        for i in range(len(model.languages)):
            bit = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[:, i] += np.bincount(rows[bit.astype(bool)], minlength=len(column))
    return n, hits


def decide(n: np.ndarray, hits: np.ndarray, model: Filter) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, -1 without n-grams; score)."""
    f = model.false
    real = np.maximum(0.0, (hits - n[:, None] * f) / np.maximum(1 - f, 1e-9))
    best = real.argmax(axis=1)  # the first of equals
    total = real.sum(axis=1)
    top = real[np.arange(len(n)), best]
    return np.where(n > 0, best, -1), np.where(total > 0, top / np.where(total > 0, total, 1), 0.0)


def predict(docs: DataFrame, model: Filter | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; only the text is looked at."""
    rows = texts(docs, id_col, text_col)
    schema = "doc_id long, lang_pred string, score double"
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.false))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(*shared.value)
        names = pa.array([*own.languages, "und"])
        for batch in batches:
            best, score = decide(*popcounts(batch.column("text").to_pylist(), own), own)
            which = np.where(best < 0, len(own.languages), best)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names.take(pa.array(which)), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows whose remainder is not 0."""
    train = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).filter(remainder(F.col("doc_id"), folds) != 0)
    out = predict(docs, learn(train), id_col, text_col)
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score")
