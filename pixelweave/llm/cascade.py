"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule's cost (seconds per row) and selectivity (share of rows it rejects) are measured on a sample, and the
rules run in the order of rejection per cost. A CASE expression stops at the first rule that rejects a row, so the
later rules are not evaluated for it. The order changes the time only: a row is kept where no rule rejects it.

Null or empty text: no words, fails the base rule. Repeated rows: each is judged. Empty table: no rows; the order
is then the order of listing.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SAMPLE_ROWS = 2000

# thresholds of the quality rules (fixed values)
MIN_WORDS = 50
MAX_REPEAT_SHARE = 0.5
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINE_SHARE = 0.3
MEAN_WORD_LENGTH = (2.0, 15.0)
MAX_SHOUTS_PER_WORD = 0.2
MIN_ALPHA_WORD_SHARE = 0.7
MAX_ELLIPSIS_SHARE = 0.3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` bound to a name, so that it is computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more: equal windows become neighbours by sorting, the
    starts of the repeated ones are put in order, and each adds the words not covered by the one before."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.struct(F.concat_ws(" ", words[i - 1], words[i], words[i + 1]).alias("w"), i.alias("i")),
    )

    def starts(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        same = F.transform(
            ordered,
            lambda x, k: F.when(
                ((k > 0) & (F.get(ordered, k - 1)["w"] == x["w"])) | ((k < last) & (F.get(ordered, k + 1)["w"] == x["w"])),
                x["i"],
            ),
        )
        return F.array_sort(F.array_compact(same))

    covered = lambda at: F.aggregate(
        at,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, p: F.struct((p + 3).alias("end"), (s["n"] + p + 3 - F.greatest(s["end"], p)).alias("n")),
    )["n"]
    return F.when(n >= 6, _let(F.array_sort(windows), lambda s: covered(starts(s)))).when(n >= 4, _let(F.array_sort(windows), lambda s: covered(starts(s)))).otherwise(0).cast("long")


def measures(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, text, words and the base counts of each document."""
    t = texts(docs, **columns)
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        t.withColumn("words", words)
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)))
        .withColumn("n_symbols", F.regexp_count("text", F.lit(SYMBOLS)).cast("long"))
        .withColumn("lines", lines)
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("n_repeat_words", repeat_words(F.col("words")))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEAT_SHARE * F.col("n_words")))
    )


def rules() -> dict[str, Column]:
    """Each rule is true where it rejects. A rule may be replaced or added by the caller."""
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / per_word
    return {
        "symbols": F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines"),
        "word_length": ~mean.between(*MEAN_WORD_LENGTH),
        "shouting": F.regexp_count("text", F.lit("!")) > MAX_SHOUTS_PER_WORD * F.col("n_words"),
        "no_letters": F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))) < MIN_ALPHA_WORD_SHARE * F.col("n_words"),
        "ellipsis": F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))) > MAX_ELLIPSIS_SHARE * F.col("n_lines"),
        "filler": F.col("text").rlike(r"(?i)lorem ipsum|javascript is (?:disabled|required)"),
    }


def measured_order(sample: DataFrame, candidates: dict[str, Column], clock: Callable[[], float] = time.perf_counter) -> list[tuple[str, float, float]]:
    """(rule, seconds per row, share rejected), best rejection per cost first.

    The sample is a small number of rows, taken once; each rule is timed alone over it, less the time of an
    empty pass.
    """
    held = sample.persist()
    try:
        total = held.count()

        def timed(rule: Column) -> tuple[float, int]:
            begin = clock()
            hits = held.agg(F.sum(F.coalesce(rule, F.lit(False)).cast("long"))).first()[0] or 0
            return clock() - begin, hits

        empty, _ = timed(F.lit(False))
        found = []
        for name, rule in candidates.items():
            seconds, hits = timed(rule)
            found.append((name, max(seconds - empty, 1e-4) / max(total, 1), hits / max(total, 1)))
    finally:
        held.unpersist()
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(measured: DataFrame, order: list[str], candidates: dict[str, Column]) -> Column:
    """Number of the first rule in `order` that rejects the row (from 1), or null; evaluation stops there."""
    step = None
    for k, name in enumerate(order, 1):
        hit = F.coalesce(candidates[name], F.lit(False))
        step = F.when(hit, F.lit(k)) if step is None else step.when(hit, F.lit(k))
    return step if step is not None else F.lit(None).cast("int")


def judge(docs: DataFrame, candidates: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS, **columns: str) -> DataFrame:
    """Counts, base_failed and kept for every document."""
    candidates = rules() if candidates is None else candidates
    counted = measures(docs, **columns)
    # a share of the rows drawn where they are read; a limit would send that many rows of every partition to one task
    share = min(1.0, sample_rows / max(docs.count(), 1))
    order = [name for name, _, _ in measured_order(measures(docs.sample(share, 42), **columns), candidates)]
    verdict = F.when(F.col("base_failed"), F.lit(0)).otherwise(cascade(counted, order, candidates))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.isNull().alias("kept")
    )
