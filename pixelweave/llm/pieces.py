"""SentencePiece encoding and decoding with an existing vocabulary.

An Aho-Corasick automaton over the pieces reads a text once; at each position its output links give every piece
that ends there, longest first, and each relaxes the best score at that position (Viterbi). A character without a
piece of its own falls back to its UTF-8 byte pieces.

Spaces become ``▁`` and one ``▁`` is put before the text. No piece holds a ``▁`` behind another character, so the
best path is the best paths of the stretches that begin at each run of ``▁``; frequent stretches are remembered, in
a table of bounded size. A ``▁`` that stands in the text itself is written as bytes, so decoding is exact.

Null text: as empty, no ids. Repeated rows: each is encoded. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
REMEMBERED = 200_000
# added to the least score of a one-character piece, for each byte of a character without a piece
UNKNOWN = -10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id (None: not a text piece), their scores, and the ids of the 256 byte pieces."""

    pieces: tuple[str | None, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]


def load(path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model file; the size is that of the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    text = [None if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) else model.id_to_piece(i) for i in range(n)]
    byte = {model.id_to_piece(i): i for i in range(n) if model.is_byte(i)}
    if len(byte) != 256:
        raise ValueError("the vocabulary has no byte pieces to fall back to")
    if any(SPACE in p.lstrip(SPACE) for p in text if p):
        raise ValueError("a piece crosses the start of a word")
    return Vocabulary(tuple(text), tuple(model.get_score(i) for i in range(n)), tuple(byte[f"<0x{b:02X}>"] for b in range(256)))


def automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    """Matcher whose outputs are (length, score, id)."""
    found = ahocorasick.Automaton()
    for i, piece in enumerate(vocabulary.pieces):
        if piece:
            found.add_word(piece, (len(piece), vocabulary.scores[i], i))
    found.make_automaton()
    return found


STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Coder:
    """Encoder and decoder of one process."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.matcher = automaton(vocabulary)
        self.single = {p for p in vocabulary.pieces if p and len(p) == 1}
        self.fallback = min(s for s, p in zip(vocabulary.scores, vocabulary.pieces) if p and len(p) == 1) + UNKNOWN
        # ids as little-endian 32-bit numbers, and the score, of a stretch
        self.known: dict[str, tuple[bytes, float]] = {}
        spelled = [b"" if p is None else p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            spelled[i] = bytes([b])
        self.spelled = spelled
        self.mark = np.array([vocabulary.byte_ids[b] for b in SPACE.encode()], "<i4").tobytes()

    def best(self, stretch: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation."""
        n = len(stretch)
        score = [0.0] + [-math.inf] * n
        start, which = [0] * (n + 1), [-1] * (n + 1)
        if self.single.issuperset(stretch):
            for at, (length, piece_score, piece) in self.matcher.iter(stretch):
                s = score[at + 1 - length] + piece_score
                if s > score[at + 1]:
                    score[at + 1], start[at + 1], which[at + 1] = s, at + 1 - length, piece
        else:
            # a character without a piece is spelled out before anything that ends behind it is relaxed
            done = 0
            for at, output in (*self.matcher.iter(stretch), (n, None)):
                for q in range(done + 1, at + 1):
                    c = stretch[q - 1]
                    if c not in self.single:
                        s = score[q - 1] + self.fallback * len(c.encode("utf-8", "surrogatepass"))
                        if s > score[q]:
                            score[q], start[q], which[q] = s, q - 1, -1
                done = max(done, at)
                if output is not None:
                    length, piece_score, piece = output
                    s = score[at + 1 - length] + piece_score
                    if s > score[at + 1]:
                        score[at + 1], start[at + 1], which[at + 1] = s, at + 1 - length, piece
        ids: list[int] = []
        q = n
        while q:
            p, piece = start[q], which[q]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.vocabulary.byte_ids[b] for b in reversed(stretch[p:q].encode("utf-8", "surrogatepass"))]
            q = p
        ids.reverse()
        return ids, score[n]

    def stretch(self, text: str) -> tuple[bytes, float]:
        """Packed ids and score of a stretch, remembered if it is short."""
        found = self.known.get(text)
        if found is None:
            ids, score = self.best(text)
            found = struct.pack(f"<{len(ids)}i", *ids), score
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(text) <= 64:
                self.known[text] = found
        return found

    def packed(self, text: str) -> tuple[bytes, float]:
        """Ids as little-endian 32-bit numbers, and the score, of a text."""
        if not text:
            return b"", 0.0
        out: list[tuple[bytes, float]] = []
        known = self.known.get
        # the text's own marks are set apart and written as bytes
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out.append((self.mark, self.fallback * 3))
            line = (SPACE if k == 0 else "") + part.replace(" ", SPACE)
            stretches = STRETCH.findall(line)
            found = list(map(known, stretches))
            if None in found:
                found = list(map(self.stretch, stretches))
            out += found
        return b"".join([f[0] for f in out]), math.fsum([f[1] for f in out])

    def encode(self, text: str) -> tuple[list[int], float]:
        ids, score = self.packed(text)
        return np.frombuffer(ids, "<i4").tolist(), score

    def spell(self, ids: list[int]) -> bytes:
        """The UTF-8 bytes that the ids stand for, with the space put before the text."""
        return b"".join(map(self.spelled.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.spell(ids).decode("utf-8", "surrogatepass")[1:]


def digests(docs: DataFrame, model: str = MODEL, **columns: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, score, ids_sha256 (ids as little-endian 32-bit) and decoded_sha256 per document."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Coder(shared.value)
        for batch in batches:
            rows = []
            for text in batch.text:
                ids, score = own.packed(text)
                back = own.spell(np.frombuffer(ids, "<i4").tolist())[1:]
                rows.append((len(text), len(ids) // 4, score, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_chars", "n_tokens", "score", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch.doc_id.astype("Int64"))
            yield out

    return texts(docs, **columns).mapInPandas(run, "doc_id long, n_chars long, n_tokens long, score double, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Coder(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                yield pd.DataFrame({"doc_id": part.doc_id.astype("Int64"), "ids": [np.frombuffer(own.packed(t)[0], "<i4") for t in part.text]})

    return texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text from the rows of `encoded`."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Coder(shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "text": [own.decode([] if i is None else list(i)) for i in batch.ids]})

    return rows.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
