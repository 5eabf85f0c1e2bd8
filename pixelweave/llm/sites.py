"""Quality by hierarchical empirical Bayes: document evidence on top of host and path posteriors.

1. Evidence: words and shapes that tell junk or toxic documents from good ones are found by counting, per class, the
   labelled documents that hold them (at most ``LABELLED`` rows, least hash of the id first; the bound makes the
   fit a fixed cost). A logistic model with a class each for good, junk and toxic is fitted on these signs.
2. Sites: the documents' expected bad shares are added up per host and per path. A host's posterior shrinks to the
   global rate, a path's to its host's; the strengths come from the spread between hosts and between paths (method
   of moments), so a sparse site stays close to its parent.
3. A document is rejected where evidence and path posterior together make it more likely bad than good.

Null text: as empty; null host or path: a site of its own. Label rows with a null id or quality are not used; of
repeated label rows for one id the worst counts. No labels: no evidence, every document is kept. Repeated rows:
each is judged. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import packed, small
from .places import stored

LABELLED = 20_000
# signs kept, by strength of association; with the classes this bounds the model
SIGNS = 20_000
# documents of a class that must hold a sign, and standard errors its rate must differ by
LEAST_HELD = 4
LEAST_Z = 4.0
# signs of documents that the fit adds up at once
SUMMED = 65_536

UPPER = bytes(range(65, 91))
SYMBOLS = b"#*$%&|<>!"
STEPS = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])


def signs(text: str) -> set[str]:
    """Words (lower case) and shapes of a text; a shape is a measure and each step it passes."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.lower().split()
    n = len(words)
    found = set(words)
    size = max(len(data), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    shapes = (
        (size - len(data.translate(None, UPPER))) / size,
        (size - len(data.translate(None, SYMBOLS))) / size,
        sum(map(eq, words, words[1:])) / max(n, 1),
        data.count(b"!") / max(n, 1),
        1 - len(set(lines)) / max(len(lines), 1),
    )
    # a space cannot be in a word
    out = {w.decode("utf-8", "replace") for w in found}
    for k, step in enumerate(np.searchsorted(STEPS, shapes).tolist()):
        out.update(f" {k} {s}" for s in range(step))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def summed(keys: np.ndarray, picks: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function of x: the sums of the rows x[picks] that have each of the n ascending keys. Some SUMMED rows are gathered at once, so that
    they stay in a core's cache and what is held beside the keys and picks stays small."""
    present, first = np.unique(keys, return_index=True)
    picks = picks.astype(np.int32)
    cuts = np.r_[0, 1 + np.flatnonzero(np.diff(first // SUMMED)), len(present)] if len(present) else np.zeros(1, int)
    ends = np.r_[first, len(keys)]
    parts = [(present[a:b], first[a:b] - first[a], picks[first[a] : ends[b]]) for a, b in zip(cuts, cuts[1:])]

    def of(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, x.shape[1]))
        for k in range(x.shape[1]):
            column = np.ascontiguousarray(x[:, k])
            for have, begin, some in parts:
                out[have, k] = np.add.reduceat(column[some], begin)
        return out

    return of


def logistic(rows: np.ndarray, columns: np.ndarray, kinds: np.ndarray, n_columns: int, rounds: int = 300, rate: float = 0.05, ridge: float = 2e-4) -> np.ndarray:
    """Weights (columns + 1 x 3, the last row the constants) of a three-class model on present signs, by Adam steps
    over all rows. ``rows`` ascend."""
    n = len(kinds)
    want = np.eye(3)[kinds]
    w = np.zeros((n_columns + 1, 3))
    m, v = np.zeros_like(w), np.zeros_like(w)
    by_row = summed(rows, columns, n)
    order = np.argsort(columns, kind="stable")
    by_column = summed(columns[order], rows[order], n_columns)
    del order
    for step in range(1, rounds + 1):
        error = (_softmax(by_row(w) + w[-1]) - want) / n
        g = np.vstack((by_column(error) + ridge * w[:-1], error.sum(axis=0)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """(sign: weights for good, junk and toxic; constants; share of bad documents among the labelled)."""
    toxic = F.coalesce(labels["toxic"], F.lit(0)) > 0
    kind = F.when(toxic, 2).when(labels["quality"] < 1, 1).when(labels["quality"].isNotNull(), 0)
    rows = labels.select(labels["doc_id"].cast("long").alias("id"), kind.alias("kind")).dropna().groupBy("id").agg(F.max("kind").alias("kind"))
    # at most `bound` rows, so the broadcast is bounded
    chosen = F.broadcast(rows.orderBy(F.xxhash64("id"), "id").limit(bound))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [Counter(), Counter(), Counter()]
            for text, k in zip(batch.text, batch.kind.tolist()):
                held[k].update(signs(text))
                held[k][""] += 1
            names = list(set().union(*held))
            yield pd.DataFrame({"sign": names, **{f"n{k}": np.array([h[s] for s in names], np.int64) for k, h in enumerate(held)}})

    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    labelled = stored(texts.join(chosen, "id").select("id", "text", "kind"))
    totals = stored(labelled.select("text", "kind").mapInPandas(count, "sign string, n0 long, n1 long, n2 long").groupBy("sign").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(3)]))
    size = totals.filter("sign = ''").first()
    if size is None or not size.n0 or not size.n1 + size.n2:
        return {}, np.array([0.0, -50.0, -50.0]), 0.0
    n = [size.n0, size.n1, size.n2]

    def strength(k: int) -> Column:
        pooled = (F.col("n0") + F.col(f"n{k}")) / (n[0] + n[k])
        return F.when(F.greatest("n0", f"n{k}") >= LEAST_HELD, F.abs(F.col("n0") / n[0] - F.col(f"n{k}") / n[k]) / F.sqrt(pooled * (1 - pooled + 1e-9) * (1 / n[0] + 1 / n[k])))

    z = F.greatest(*[F.coalesce(strength(k), F.lit(0.0)) for k in (1, 2) if n[k]], F.lit(0.0))
    best = totals.filter("sign <> ''").withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "sign").limit(SIGNS)
    names = {r.sign: i for i, r in enumerate(best.select("sign").collect())}  # at most SIGNS rows
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            held = [np.array(sorted(known[s] for s in signs(t) & known.keys()), np.int32) for t in batch.text]
            yield pd.DataFrame({"id": batch.id, "kind": batch.kind, "held": held})

    # at most `bound` labelled rows (times the rows that repeat an id)
    sample = labelled.mapInPandas(pick, "id long, kind int, held array<int>").toPandas().sort_values("id", kind="stable")
    length = np.array([len(h) for h in sample.held], int)
    columns = np.concatenate([np.asarray(h, np.int32) for h in sample.held]) if len(sample) else np.empty(0, np.int32)
    kinds = sample.kind.to_numpy(int)
    del sample
    w = logistic(np.repeat(np.arange(len(kinds), dtype=np.int32), length), columns, kinds, len(names))
    return {s: w[i] for s, i in names.items()}, w[-1], (n[1] + n[2]) / sum(n)


def evidence(docs: DataFrame, fitted: tuple[dict[str, np.ndarray], np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """u1, u2, doc_id, host, path and the log odds of bad against good, less those of the labelled documents."""
    model, constants, bad = fitted
    bad = min(max(bad, 1e-6), 1 - 1e-6)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for text in batch.text:
                z = constants + sum(known[s] for s in signs(text) & known.keys())
                out.append(float(np.logaddexp(z[1], z[2]) - z[0]))
            out = np.array(out) - math.log(bad / (1 - bad))
            yield batch.drop(columns="text").assign(evidence=out, doc_id=batch.doc_id.astype("Int64"))

    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
        F.coalesce(F.concat(F.lit("h"), docs[host_col]), F.lit("")).alias("host"),
        F.coalesce(F.concat(F.lit("p"), docs[path_col]), F.lit("")).alias("path"),
    )
    rows = rows.withColumns({"u1": F.coalesce("doc_id", F.lit(-1)), "u2": F.xxhash64(F.col("doc_id").isNull(), "text", "host", "path")})
    return rows.mapInPandas(run, "doc_id long, host string, path string, u1 long, u2 long, evidence double")


def _strength(parts: DataFrame, n: str, rate: str, centre: str) -> float:
    """Prior weight, in documents, of a parent's rate for its parts: the spread of the parts' rates beyond what
    counting alone gives. Large where the parts agree."""
    row = parts.agg(
        F.sum(F.col(n)),
        F.sum(F.col(n) * (F.col(rate) - F.col(centre)) ** 2),
        F.sum(F.col(rate) * (1 - F.col(rate))),
        F.avg(F.col(centre) * (1 - F.col(centre))),
    ).first()
    if not row[0]:
        return 1.0
    between = (row[1] - row[2]) / row[0]
    return max(1.0, min(1e6, row[3] / between - 1)) if between > 1e-12 else 1e6


def judge(scored: DataFrame, bad: float) -> DataFrame:
    """The rows of `evidence` (stored) with host_posterior, path_posterior, p_bad and kept."""
    prior = min(max(bad, 1e-6), 1 - 1e-6)
    p = 1 / (1 + F.exp(-(F.col("evidence") + math.log(prior / (1 - prior)))))
    paths = stored(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("bad")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("bad").alias("host_bad"))
    row = hosts.agg(F.sum("host_bad"), F.sum("host_n")).first()
    rate = min(max((row[0] or 0.0) / (row[1] or 1), 1e-6), 1 - 1e-6)
    hosts = hosts.withColumn("rate", F.col("host_bad") / F.col("host_n")).withColumn("centre", F.lit(rate))
    k = _strength(hosts, "host_n", "rate", "centre")
    hosts = hosts.withColumn("host_posterior", (F.col("host_bad") + k * rate) / (F.col("host_n") + k))
    sites = paths.join(hosts.select("host", "host_posterior"), "host").withColumn("path_rate", F.col("bad") / F.col("n"))
    k = _strength(sites, "n", "path_rate", "host_posterior")
    sites = sites.select("host", "path", "host_posterior", ((F.col("bad") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior"))
    joined = scored.join(small(settle(sites)), ["host", "path"])
    odds = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_posterior")))
    p_bad = 1 / (1 + F.exp(-(F.col("evidence") + F.log(odds / (1 - odds)))))
    return joined.withColumn("p_bad", p_bad).withColumn("kept", F.col("p_bad") <= 0.5)


def verdicts(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """u1, u2, doc_id, evidence, host_posterior, path_posterior, p_bad, kept of every document."""
    own = {k: v for k, v in columns.items() if k in ("id_col", "text_col")}
    fitted = fit(docs, labels, **own)
    return judge(stored(evidence(docs, fitted, **columns)), fitted[2])


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The documents that are not rejected, as they are."""
    keep = verdicts(docs, labels, id_col=id_col, text_col=text_col, host_col=host_col, path_col=path_col).filter("kept").select("u1", "u2").distinct()
    r = F.col("row")
    none = r[id_col].isNull()
    host = F.coalesce(F.concat(F.lit("h"), r[host_col]), F.lit(""))
    path = F.coalesce(F.concat(F.lit("p"), r[path_col]), F.lit(""))
    rows = packed(docs).withColumns({"u1": F.coalesce(r[id_col].cast("long"), F.lit(-1)), "u2": F.xxhash64(none, F.coalesce(r[text_col], F.lit("")), host, path)})
    return rows.join(keep, ["u1", "u2"], "left_semi").select("row.*")
