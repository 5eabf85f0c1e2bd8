"""Language-model scores from a subword lattice.

Words are written in the pieces of an existing vocabulary; every segmentation counts, weighted by the pieces'
probabilities, and a forward recursion in log space adds them up: the marginal probability of the word. The
vocabulary file's scores are the first weights (log probabilities where it has such, else ranks, as 1 / (rank + 5));
they are refined on the distinct training words by expected counts, with a little of every piece left over so that
all texts have a probability. A character without a piece of its own is spelled in byte pieces.

The lattice probability is the base of the word distribution: a word seen c times has (c + a * lattice) / (N + a),
where a is the number of words seen once. A document draws from an urn of ``URN`` such words to which each word
drawn is added again, so its own words become more likely. There is one such model per class (the languages of the
training documents, at most ``CLASSES`` of them and one for the rest); a document's probability is the sum over the
classes, by their shares. Only its text is used for that, never its own language column.

Words are aggregated over the whole corpus before the lattice is run, once per distinct word. Documents look up the
frequent words in a broadcast table (words of at least 1 / 2**20 of all tokens, so at most 2**20 of them); the
others are joined by word, none of which is frequent.

Null text: as empty, one token (the end). Null id: hashed as empty text. Repeated rows: each is scored and, in
training, counted. Empty table: no rows. No training documents: the lattice alone, with the first weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MODEL, SPACE, Vocabulary, load
from .places import stored

FOLDS, HELD_OUT = 7, 2
ITERATIONS = 2
URN = 3000.0
CLASSES = 8
FREQUENT_SHARE = 1 / 2**20
# words to a lattice
AT_ONCE = 20_000
# pseudo-count of every piece
LEFT_OVER = 0.05


class Lattice:
    """Sums over all segmentations of many words at once: the edges of all words are laid out by the place where they
    end, and each place takes the log sum of what reaches it."""

    def __init__(self, vocabulary: Vocabulary):
        self.byte_ids = np.array(vocabulary.byte_ids)
        self.matcher = ahocorasick.Automaton()
        self.single = set()
        for i, piece in enumerate(vocabulary.pieces):
            if piece and not piece.isspace():
                self.matcher.add_word(piece, (len(piece), i))
                if len(piece) == 1:
                    self.single.add(piece)
        self.matcher.make_automaton()

    def read(self, words: list[str]) -> None:
        """Find the edges of the words."""
        lines = [SPACE + w for w in words]
        line = "\n".join(lines)
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.ends = np.cumsum(size + 1) - 1
        self.begins = self.ends - size
        found = np.array([(at + 1, n, i) for at, (n, i) in self.matcher.iter(line)], np.int64).reshape(-1, 3)
        other = sorted(set(line) - self.single - {"\n"})
        if other:
            at = np.array([k for k, c in enumerate(line) if c not in self.single and c != "\n"], np.int64)
            # a spelled character is one edge; its id points behind the pieces
            names = {c: k for k, c in enumerate(other)}
            spelled = np.array([[k + 1, 1, -1 - names[line[k]]] for k in at.tolist()], np.int64)
            found = np.concatenate((found, spelled))
        self.spelling = [self.byte_ids[list(c.encode("utf-8", "surrogatepass"))] for c in other]
        word = np.searchsorted(self.ends, found[:, 0])
        level = found[:, 0] - self.begins[word]
        order = np.lexsort((found[:, 0], level))
        self.to, self.piece = found[order, 0], found[order, 2]
        self.start = self.to - found[order, 1]
        self.levels = np.flatnonzero(np.diff(level[order], prepend=-1))
        self.places = len(line) + 1

    def weights(self, log_p: np.ndarray) -> np.ndarray:
        """Log weight of each edge; one column per column of log_p."""
        if self.spelling:
            spelled = np.array([log_p[b].sum(axis=0) for b in self.spelling])
            return np.concatenate((log_p, spelled))[np.where(self.piece >= 0, self.piece, len(log_p) - 1 - self.piece)]
        return log_p[self.piece]

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Log probability of all ways from a word's begin to each place."""
        reach = np.full((self.places, *weight.shape[1:]), -np.inf)
        reach[self.begins] = 0.0
        for a, b in zip(self.levels, [*self.levels[1:], len(self.to)]):
            to = self.to[a:b]
            head = np.flatnonzero(np.diff(to, prepend=-1))
            reach[to[head]] = np.logaddexp.reduceat(reach[self.start[a:b]] + weight[a:b], head)
        return reach

    def log_probabilities(self, log_p: np.ndarray) -> np.ndarray:
        return self.forward(self.weights(log_p))[self.ends] if len(self.ends) else np.empty(0)

    def add_expected(self, log_p: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
        """Add each word's expected uses of the pieces, `times` over."""
        weight = self.weights(log_p)
        ahead = self.forward(weight)
        # backwards the edges are laid out by the place they leave
        from_end = np.searchsorted(self.ends, self.to)
        left = self.ends[from_end] - self.start
        order = np.lexsort((self.start, left))
        back = np.full(self.places, -np.inf)
        back[self.ends] = 0.0
        cuts = np.flatnonzero(np.diff(left[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            e = order[a:b]
            start = self.start[e]
            head = np.flatnonzero(np.diff(start, prepend=-1))
            back[start[head]] = np.logaddexp.reduceat(weight[e] + back[self.to[e]], head)
        share = np.exp(ahead[self.start] + weight + back[self.to] - ahead[self.ends][from_end]) * times[from_end]
        real = self.piece >= 0
        counts += np.bincount(self.piece[real], weights=share[real], minlength=len(counts))
        for k in range(len(self.spelling)):
            np.add.at(counts, self.spelling[k], share[self.piece == -1 - k].sum())


def first_weights(vocabulary: Vocabulary) -> np.ndarray:
    """Probabilities from the vocabulary's own scores."""
    used = np.array([bool(p) for p in vocabulary.pieces])
    used[list(vocabulary.byte_ids)] = True
    score = np.array(vocabulary.scores)
    plain = score[[i for i, p in enumerate(vocabulary.pieces) if p]]
    if len(plain) and float(np.median(np.abs(plain - np.round(plain)))) > 1e-6:
        p = np.exp(np.maximum(score, -50.0))  # log probabilities
    else:
        p = 1.0 / (5.0 + np.minimum(-score, 1e9))  # ranks
    p[list(vocabulary.byte_ids)] = p[used & (score > -1e8)].min()
    p[~used] = 0.0
    return p / p.sum()


def _words(batch_text: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(row of each word, the words as a dictionary array): lower-case A-Z, split at ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(batch_text.cast(pa.large_string())))
    rows = pc.list_parent_indices(lists)
    words = pc.list_flatten(lists)
    real = pc.not_equal(words, "")
    return pc.filter(rows, real).to_numpy(zero_copy_only=False).astype(np.int64), pc.filter(words, real).dictionary_encode()


def _slices(batches, most: int):
    """The batches in pieces of at most `most` bytes of text (or one row), so that a task's memory is bounded."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, done + most, side="right")))
            # copied, not sliced: nested arrays over a slice lose its offset
            yield batch.take(pa.array(np.arange(begin, end)))
            begin = end


def word_counts(docs: DataFrame, classes: int) -> DataFrame:
    """word, n (all documents), c0, c1, ... (training documents of each class), added up per batch before the exchange."""

    def count(batches):
        for batch in _slices(batches, 16 << 20):
            rows, words = _words(batch.column("text"))
            kind = batch.column("kind").to_numpy(zero_copy_only=False)  # -1: held out
            codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            k = len(words.dictionary)
            own = kind[rows]
            table = np.bincount(codes[own >= 0] * classes + own[own >= 0], minlength=k * classes).reshape(k, classes)
            yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), pa.array(np.bincount(codes, minlength=k), pa.int64()), *(pa.array(np.ascontiguousarray(table[:, z]), pa.int64()) for z in range(classes))], names)

    names = ["word", "n", *(f"c{z}" for z in range(classes))]
    counted = docs.select("text", "kind").mapInArrow(count, "word string" + "".join(f", {c} long" for c in names[1:]))
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in names[1:]])


def refined(words: DataFrame, vocabulary: Vocabulary, classes: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Log probabilities of the pieces in each class (pieces x classes) after EM on the distinct training words."""
    p = np.repeat(first_weights(vocabulary)[:, None], classes, axis=1)
    usable = p > 0
    names = [f"c{z}" for z in range(classes)]
    train = words.filter(F.greatest(*names, F.lit(0)) > 0).select("word", *names)
    for _ in range(iterations):
        shared = words.sparkSession.sparkContext.broadcast((vocabulary, np.log(np.where(usable, p, 1.0))))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vocabulary, log_p = shared.value
            lattice = Lattice(vocabulary)
            counts = np.zeros(log_p.shape)
            for batch in batches:
                for z, name in enumerate(names):
                    own = batch.word[batch[name] > 0].tolist()
                    for at in range(0, len(own), AT_ONCE):
                        lattice.read(own[at : at + AT_ONCE])
                        column = np.zeros(len(counts))
                        lattice.add_expected(log_p[:, z], np.ones(len(lattice.ends)), column)
                        counts[:, z] += column
            piece, kind = np.nonzero(counts)
            yield pd.DataFrame({"piece": piece, "kind": kind, "n": counts[piece, kind]})

        # one row a piece and class: the vocabulary bounds it
        found = train.mapInPandas(expect, "piece long, kind long, n double").groupBy("piece", "kind").agg(F.sum("n").alias("n")).toPandas()
        counts = np.where(usable, LEFT_OVER, 0.0)
        counts[found.piece.to_numpy(int), found.kind.to_numpy(int)] += found.n.to_numpy()
        p = counts / counts.sum(axis=0)
    with np.errstate(divide="ignore"):
        return np.where(usable, np.log(np.where(usable, p, 1.0)), -700.0)


def _urn_steps(g: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Log of (e**g) (e**g + 1) ... (e**g + times - 1), by row; g has a column per class."""
    out = g.copy()
    more = np.flatnonzero(times > 1)
    j = 1
    while len(more):
        out[more] += np.log(np.exp(g[more]) + j)
        j += 1
        more = more[times[more] > j]
    return out


def scores(docs: DataFrame, model: str = MODEL, iterations: int = ITERATIONS, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    label = docs[class_col].cast("string") if class_col in docs.columns else F.lit(None).cast("string")
    t = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), label.alias("label"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    t = t.withColumn("held_out", fold % FOLDS == HELD_OUT)
    trained = t.filter("not held_out")
    common = trained.filter("label is not null").groupBy("label").count().orderBy(F.desc("count"), "label").limit(CLASSES).collect()
    names = [r["label"] for r in common]
    number = F.lit(len(names))
    for z, name in enumerate(names):
        number = F.when(F.col("label") == name, z).otherwise(number)
    t = t.withColumn("kind", F.when(F.col("held_out"), -1).otherwise(F.coalesce(number, F.lit(len(names)))).cast("int"))
    sizes = {r["kind"]: r["count"] for r in t.filter("not held_out").groupBy("kind").count().collect()}
    classes = len(names) + 1
    per_class = np.array([sizes.get(z, 0) for z in range(classes)], float)
    documents = int(per_class.sum())
    share = per_class / documents if documents else np.eye(classes)[0]

    vocabulary = load(model)
    counted = stored(word_counts(t, classes))
    total = sum((F.col(f"c{z}") for z in range(classes)), F.lit(0))
    row = counted.agg(
        F.sum(total), F.count(F.when(total > 0, 1)), F.sum("n"), *[F.sum(f"c{z}") for z in range(classes)], *[F.count(F.when(F.col(f"c{z}") == 1, 1)) for z in range(classes)]
    ).first()
    row = [x or 0 for x in row]
    train_tokens, kinds = row[0] + documents, row[1] + (documents > 0)
    below = math.log10(train_tokens + kinds + 1)
    words_of = np.array(row[3 : 3 + classes], float) + per_class
    once = np.maximum(np.array(row[3 + classes :], float), 1.0)
    log_p = refined(counted, vocabulary, classes, iterations)
    shared = spark.sparkContext.broadcast((vocabulary, log_p))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, log_p = shared.value
        lattice = Lattice(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part = batch.iloc[at : at + AT_ONCE]
                lattice.read(part.word.tolist())
                c = part[[f"c{z}" for z in range(classes)]].to_numpy(float)
                with np.errstate(divide="ignore"):
                    g = np.logaddexp(np.log(c), np.log(once) + lattice.log_probabilities(log_p)) - np.log(words_of + once) + math.log(URN)
                yield pd.DataFrame({"word": part.word, "n": part.n, "c": c.sum(axis=1).astype(np.int64), **{f"g{z}": g[:, z] for z in range(classes)}})

    # the lattice runs once per distinct word; g is the log of its share of the urn, in words
    g_names = [f"g{z}" for z in range(classes)]
    weighed = stored(counted.mapInPandas(weigh, "word string, n long, c long" + "".join(f", {g} double" for g in g_names)))
    least = max(2, math.ceil(row[2] * FREQUENT_SHARE))
    often = weighed.filter(F.col("n") >= least).toArrow()  # at most 2**20 rows
    frequent = spark.sparkContext.broadcast((often.column("word").combine_chunks(), often.column("c").to_numpy(), np.column_stack([often.column(g).to_numpy() for g in g_names])))

    def look_up(batches):
        words, c, g = frequent.value
        words = words.cast(pa.large_string())
        base, known = np.log10(c + 1.0) - below, (c > 0).astype(np.int64)
        for batch in _slices(batches, 2 << 20):
            n = batch.num_rows
            rows, own = _words(batch.column("text"))
            k = max(len(own.dictionary), 1)
            place = pc.index_in(own.dictionary, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens = np.bincount(rows, minlength=n) + 1
            pair, times = np.unique(rows * k + own.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            r, code = np.divmod(pair, k)
            at = place[code] if len(code) else np.empty(0, np.int64)
            here = at >= 0
            steps = _urn_steps(g[at[here]], times[here])
            sums = [np.bincount(r[here], weights=v[at[here]] * times[here], minlength=n) for v in (known, base)]
            urn = [np.bincount(r[here], weights=steps[:, z], minlength=n) for z in range(steps.shape[1])]
            filled = np.array([math.lgamma(URN + x) - math.lgamma(URN) for x in tokens.tolist()])
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            totals = pa.StructArray.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(tokens, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1], pa.float64()), *(pa.array(u - filled, pa.float64()) for u in urn)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", *g_names],
            )
            layout = pa.schema([("uid", pa.int64()), ("word", pa.string()), ("times", pa.int64()), ("doc", totals.type)])
            # the row of the document itself joins no word: a space is in none
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array([f" {u}" for u in uid], pa.string()), pa.array(np.zeros(n, np.int64)), totals], schema=layout)
            yield pa.RecordBatch.from_arrays([pa.array(uid[r[~here]], pa.int64()), own.dictionary.take(pa.array(code[~here], pa.int64())).cast(pa.string()), pa.array(times[~here], pa.int64()), pa.nulls(int((~here).sum()), totals.type)], schema=layout)

    # the number names a row for the sums below; texts are read once, so it is given once
    doc_type = "struct<doc_id:long, held_out:boolean, n_tokens:long, n_known:long, base:double" + "".join(f", {g}:double" for g in g_names) + ">"
    looked = t.select("doc_id", "held_out", "text").withColumn("uid", F.monotonically_increasing_id()).mapInArrow(look_up, f"uid long, word string, times long, doc {doc_type}")
    rare = weighed.filter(F.col("n") < least).select("word", "c", *g_names)
    c, times = F.col("c"), F.col("times")

    def steps(g: str):
        later = F.aggregate(F.sequence(F.lit(1), times - 1), F.lit(0.0), lambda a, j: a + F.log(F.exp(g) + j))
        return F.coalesce(F.sum(F.col(g) + F.when(times > 1, later).otherwise(0.0)), F.lit(0.0))

    parts = looked.join(rare, "word", "left").groupBy("uid").agg(
        F.max("doc").alias("doc"),
        F.coalesce(F.sum(F.when(c > 0, times)), F.lit(0)).alias("known"),
        F.coalesce(F.sum(times * (F.log10(c + 1.0) - below)), F.lit(0.0)).alias("base"),
        *[steps(g).alias(g) for g in g_names],
    )
    end_base = math.log10(documents + 1) - below
    # the end is one more word of the urn; without training it takes an even share with one word
    ends = np.where(per_class > 0, per_class, 0.0) if documents else np.ones(classes)
    logs = [F.col(f"doc.g{z}") + F.col(f"g{z}") + math.log(share[z]) + math.log(URN * ends[z] / (words_of[z] + once[z])) for z in range(classes) if share[z] > 0]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    score = (top + F.log(sum((F.exp(x - top) for x in logs), F.lit(0.0)))) / math.log(10)
    return parts.select(
        "doc.doc_id",
        "doc.held_out",
        "doc.n_tokens",
        (F.col("doc.n_known") + F.col("known") + (1 if documents else 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("doc.base") + F.col("base") + end_base).alias("base_score"),
        score.alias("score"),
    )
