"""Document fingerprints as Merkle trees: root, sections, paragraphs, pieces of sentences.

A piece is a clause or at most 64 characters of one; a paragraph ends at a line break; a section ends at a blank
line or at a paragraph whose digest ends it, so equal stretches give equal sections wherever they stand. The
written form is ``root;section=paragraph,paragraph;...`` where a paragraph lists its pieces as digest-length pairs
joined by dots. Roots are equal for equal texts only; where sections differ their paragraphs say which were edited.

Null or empty text: the tree of no section. Repeated rows follow each other in the order and are each other's
next. The order is by id, nulls first, then by text hash. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import texts
from .passages import squeezed, unpack
from .places import stored

PIECE = re.compile(r"[^.,;:!?\n]{1,64}[.,;:!?]*|[.,;:!?]+")
PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+")


def fingerprint(text: str) -> str:
    """The written tree of a text."""
    whole = blake2b(digest_size=16)
    sections: list[str] = []
    section, paragraphs = blake2b(digest_size=8), []

    def close():
        nonlocal section, paragraphs
        digest = section.digest()
        whole.update(digest)
        sections.append(f"{digest[:4].hex()}={','.join(paragraphs)}")
        section, paragraphs = blake2b(digest_size=8), []

    for paragraph in PARAGRAPH.findall(text):
        node, pieces = blake2b(digest_size=8), []
        for piece in PIECE.findall(paragraph):
            leaf = blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            node.update(leaf)
            pieces.append(f"{leaf[:4].hex()}-{len(piece):x}")
        node.update(b"\n" if paragraph.endswith("\n") else b"")
        digest = node.digest()
        section.update(digest)
        paragraphs.append(".".join(pieces))
        if not pieces or digest[0] & 7 == 0:
            close()
    if paragraphs:
        close()
    return ";".join([whole.hexdigest(), *sections])


def _weights(sections: list[str]) -> Counter:
    found: Counter = Counter()
    for section in sections:
        for paragraph in section.partition("=")[2].split(","):
            for piece in paragraph.split("."):
                if piece:
                    found[piece] += int(piece.partition("-")[2], 16)
    return found


def likeness(a: str, b: str) -> float:
    """Share of characters in equal pieces, 0 to 1. Equal roots and equal sections need no comparison below."""
    root_a, *sections_a = a.split(";")
    root_b, *sections_b = b.split(";")
    if root_a == root_b:
        return 1.0
    same = Counter(sections_a) & Counter(sections_b)
    equal = sum(_weights(list(same.elements())).values())
    rest_a = _weights(list((Counter(sections_a) - same).elements()))
    rest_b = _weights(list((Counter(sections_b) - same).elements()))
    total = 2 * equal + sum(rest_a.values()) + sum(rest_b.values())
    return (2 * equal + 2 * sum((rest_a & rest_b).values())) / total if total else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of `a` that `b` does not hold; equal sections are passed by."""
    known = set(b.split(";")[1:])
    held = {p for s in known for p in s.partition("=")[2].split(",")}
    return [
        (i, j)
        for i, s in enumerate(a.split(";")[1:])
        if s not in known
        for j, p in enumerate(s.partition("=")[2].split(","))
        if p not in held
    ]


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, tree: str, following: str, next_tree: str) -> tuple:
    edited = edited_text(text, following)
    own = fingerprint(edited)
    return (doc_id, len(text), sha256(edited.encode()).hexdigest(), tree, own, likeness(tree, own), likeness(tree, next_tree))


def with_next(docs: DataFrame, **columns: str) -> DataFrame:
    """The columns of OUT for every document, where the next is the following id (after the last: the first).

    Texts are put in order by one range exchange. Each partition compares neighbours as they stream by and hands out
    its first and last row; only those rows, two per partition, are joined across partitions.
    """
    t = texts(docs, **columns).withColumn("h", F.xxhash64("text"))
    lined = squeezed(t).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").withColumn("part", F.spark_partition_id())

    def frame(rows: list[tuple], part: int) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*(c.split()[0] for c in OUT.split(", ")), "edge", "text"])
        out["doc_id"] = out.doc_id.astype("Int64")
        out["n_chars"] = out.n_chars.astype("Int64")
        return out.assign(part=part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, part = None, 0
        for batch in batches:
            rows = []
            for doc_id, z, part in zip(batch.doc_id, batch.z, batch.part):
                text = unpack(z)
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                tree = fingerprint(text)
                if before is None:
                    rows.append((doc_id, None, None, None, None, None, None, "first", text))
                else:
                    rows.append((*_row(*before, text, tree), None, None))
                before = (doc_id, text, tree)
                if len(rows) >= 2000:
                    yield frame(rows, part)
                    rows = []
            yield frame(rows, part)
        if before is not None:
            yield frame([(before[0], None, None, None, None, None, None, "last", before[1])], part)

    names = [c.split()[0] for c in OUT.split(", ")]
    done = stored(lined.select("doc_id", "z", "part").mapInPandas(run, f"{OUT}, edge string, text string, part int"))
    firsts = done.filter("edge = 'first'").select("part", F.col("text").alias("following"))
    # partition numbers only; one row per partition
    order = Window.orderBy("part")
    follows = settle(firsts.select("part", F.lead("part").over(order).alias("next"), F.min("part").over(Window.partitionBy()).alias("start"))).select("part", F.coalesce("next", "start").alias("next"))
    ends = done.filter("edge = 'last'").select("part", "doc_id", "text").join(follows, "part").join(firsts.withColumnRenamed("part", "next"), "next")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_row(None if pd.isna(d) else int(d), a, fingerprint(a), b, fingerprint(b)) for d, a, b in zip(batch.doc_id, batch.text, batch.following)]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "n_chars": "Int64"})

    return done.filter("edge is null").select(*names).unionByName(ends.select("doc_id", "text", "following").mapInPandas(close, OUT))
