"""Language filters, the prefix trie and whitening against brute force and held-out labels, with awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, duck
from pixelweave.llm import prefixes, tongues, whitening

SF = "/root/testdata/sf0.001"

# ---- languages -----------------------------------------------------------------------


def plain_grams(text):
    """n-grams by the definition: letters in lower case, other runs one border, no border inside."""
    low = "".join(chr(tongues.letters()[ord(c)]) if tongues.letters()[ord(c)] else " " for c in text)
    low = " " + " ".join(low.split()) + " " if low.strip() else ""
    return [low[i : i + n] for n in tongues.SIZES for i in range(len(low) - n + 1) if " " not in low[i + 1 : i + n - 1] and low[i : i + n].strip()]


def test_grams_of_slices_equal_the_definition(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abÉß日 .\n9") for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None, " . ", "x"]
    for size in (7, 16, 1 << 20):
        monkeypatch.setattr(tongues, "SLICE", size)
        count = np.zeros(len(texts), int)
        seen = defaultdict(list)
        for h, rows in tongues.grams(texts):
            np.add.at(count, rows, 1)
            for a, b in zip(h.tolist(), rows.tolist()):
                seen[b].append(a)
        assert count.tolist() == [len(plain_grams(t or "")) for t in texts]
        if size > 16:
            whole = {k: sorted(v) for k, v in seen.items()}
        else:
            parts = {k: sorted(v) for k, v in seen.items()}
    assert parts == whole


def lang_rows():
    rng = random.Random(5)
    syllables = {"aa": ["ka", "lo", "ki"], "bb": ["sch", "ung", "ver"], "cc": ["日本", "語の"]}
    rows = []
    for i in range(240):
        lang = ("aa", "aa", "aa", "bb", "bb", "cc")[i % 6]
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 30)))
        rows.append((i, text, lang, "s", "x", "y"))
    rows += [(900, None, "aa", None, "x", "y"), (901, "", None, None, "x", "y"), (902, " 12 .!", "bb", None, "x", "y"), (903, "kalo", None, None, "x", "y")]
    rows += [(None, "schung verung", "bb", None, "x", "y"), rows[0], rows[0], (904, "kalo " * 300_000, "aa", None, "x", "y")]
    return rows


def test_language_of_held_out_documents(spark):
    docs = spark.createDataFrame(lang_rows(), "doc_id long, text string, lang string, source string, which string, part string")
    got = tongues.identify(docs).collect()
    assert len(got) == len(lang_rows())
    want = {r[0]: r[2] for r in lang_rows() if r[1] and r[0] not in (901, 902, 903)}
    for r in got:
        assert 0.0 <= r.score <= 1.0
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id in want:
            assert r.lang_pred == want[r.doc_id] and r.score > 0.5
    # nothing to learn from, an empty table
    assert {r.lang_pred for r in tongues.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert tongues.identify(docs.filter("false")).collect() == []


def test_label_source_and_id_are_no_inputs(spark):
    docs = spark.createDataFrame(lang_rows(), "doc_id long, text string, lang string, source string, which string, part string")
    model = tongues.learn(docs.filter("doc_id < 200"))
    held = docs.filter("doc_id >= 200 OR doc_id IS NULL")
    changed = held.withColumns({"lang": F.lit("zz"), "source": F.lit("q")})
    assert sorted(map(str, tongues.predict(held, model).collect())) == sorted(map(str, tongues.predict(changed, model).collect()))


def test_filter_finds_all_languages_and_counts_are_corrected(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("abab", "x"), ("abab", "y"), ("cdcd", "x"), ("efef", "y")] * 8)], "doc_id long, text string, lang string")
    model = tongues.learn(docs)
    n, hits = tongues.popcounts(["abab", "cdcd", "efef", "", "zz"], model)
    size = len(plain_grams("abab"))
    x, y = model.languages.index("x"), model.languages.index("y")
    assert n.tolist() == [size, size, size, 0, len(plain_grams("zz"))]
    assert hits[0, x] == hits[0, y] == size and (hits[1, x], hits[2, y]) == (size, size)
    noisy = tongues.Filter(model.languages, model.table, np.array([0.5, 0.0]))
    best, score = tongues.decide(np.array([10]), np.array([[6, 3]]), noisy)  # (6 - 5) / 0.5 = 2 against 3
    assert best[0] == 1 and score[0] == pytest.approx(0.6)


def test_more_languages_than_bits_of_a_word(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(70)]
    docs = spark.createDataFrame([(i, " ".join([w] * 5), f"l{k:02d}") for k, w in enumerate(names) for i in (2 * k, 2 * k + 1)], "doc_id long, text string, lang string")
    model = tongues.learn(docs)
    assert model.table.shape[1] == 2
    got = {r.doc_id // 2: r.lang_pred for r in tongues.predict(docs, model).collect()}
    assert got == {k: f"l{k:02d}" for k in range(70)}


def test_registered_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op11_language_id"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    row = got.join(truth, "doc_id").filter("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert row[1] > 150 and row[0] >= 0.99


# ---- prefix trie ---------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r[2], r[3]) for r in sorted(v, key=lambda r: r[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    member = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            member[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in member:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(member, key=len, reverse=True):
        saved[p] = (len(member[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
    out = []
    for p, m in member.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(member[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TALK = "conv_id long, turn long, role string, text string, k1 string, depth string"


def talk(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "k", "d") for r in rows], TALK).repartition(parts)


def check(spark, rows):
    got = prefixes.trie(talk(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_trie_of_awkward_conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 60), 100, 101, 105, 150, 205, 206, 207, -3, -250]:
        n = rng.choice([0, 1, 1, 2, 3, 5, 8, 9])
        for t in range(n):
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice(["hello", "", None, "naïve 日本", f"own {rng.randrange(3)}"])))
        if n and rng.random() < 0.3:
            rows.append((c, None, "system", "first"))
    # copies, a conversation whose every turn comes from its base, rows without a conversation
    rows += [(c, t, "user", f"copy {t}") for c in (301, 302, 303, 304) for t in range(9)]
    rows += [(None, 0, "user", "lost"), (400, 7, "user", "only"), (401, 1, "user", "x")]
    check(spark, rows)


def test_trie_of_one_long_conversation_over_all_partitions(spark):
    """A third of the rows in one conversation, and a second one that leaves it after a while."""
    rows = [(17, t, "user", f"turn {t % 7}") for t in range(1500)]
    rows += [(18, t, "user", f"turn {t % 7}") for t in range(900)] + [(18, 900 + t, "user", "apart") for t in range(3)]
    rows += [(c, t, "user", f"turn {t}") for c in range(200, 320) for t in range(6)]
    check(spark, rows)


def test_trie_with_hot_groups_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "HOT", 40)
    rows = [(c, t, "user", "same" if c % 3 else f"t{t}") for c in range(1, 400) for t in range(8)]
    check(spark, rows)


def test_colliding_hashes_are_found_and_rehashed(spark, monkeypatch):
    """With the first seed every turn hashes alike; the check against the stored turns must see it."""
    real = prefixes.turn_rows

    def weak(conversations, seed=0):
        out = real(conversations, seed)
        return out.withColumns({"k1": F.lit(5).cast("long"), "k2": F.lit(6).cast("long")}) if seed == 0 else out

    monkeypatch.setattr(prefixes, "turn_rows", weak)
    check(spark, [(c, t, "user", f"{c % 3} {t}") for c in range(1, 30) for t in range(7)])


def test_trie_of_an_empty_table(spark):
    assert prefixes.trie(talk(spark, [])).collect() == []
    check(spark, [(7, 1, "user", "alone")])


def test_registered_trie_equals_its_sql(spark):
    out = entry.queries()["op12_prefix_trie"](spark, SF)
    assert compare("op12_prefix_trie", out, duck(SF), entry.oracle_sql()["op12_prefix_trie"]).startswith("ok")


# ---- whitening -----------------------------------------------------------------------


def turned(values, seed=0):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    a = (q * values) @ q.T
    return ((a + a.T) / 2).astype(np.longdouble)


@pytest.mark.parametrize(
    "values",
    [np.linspace(1, 9, 24), np.r_[np.ones(12), np.full(12, 5.0)], np.r_[1 + 1e-9 * np.arange(12), 5 + 1e-7 * np.arange(12)], np.r_[1 + 1e-13 * np.arange(12), 2 + 1e-5 * np.arange(12)], 10.0 ** -np.arange(24.0), np.zeros(5), np.ones(1)],
    ids=["apart", "equal", "clusters", "tight", "graded", "zero", "one"],
)
def test_eigenpairs_beyond_double_precision(values):
    a = turned(values)
    found, x = whitening.eigenpairs(a)
    assert np.abs(a @ x - x * found).max() < 1e-15 * max(1.0, float(np.abs(a).max()))
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-17
    assert np.allclose(np.sort(found.astype(float)), np.sort(values), rtol=0, atol=1e-14)


def brute_whitening(vectors, k=8):
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(d)] for r in x])
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return y @ u / np.sqrt(e), e / np.trace(cov), [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]


VECTORS = "vec_id long, embedding array<float>, label int, v string, n string"


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    good = (rng.normal(size=(80, 10)) * np.linspace(0.1, 2, 10) + 3).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1, "v", "n") for i, v in enumerate(good)]
    rows += [(100, None, 1, "v", "n"), (101, [float("nan")] * 10, 1, "v", "n"), (102, [float("inf")] + [0.0] * 9, 1, "v", "n"), (103, [None] + [0.0] * 9, 1, "v", "n")]
    rows += [rows[3], (None, rows[4][1], 1, "v", "n")]
    used = [r for r in rows if r[0] is None or r[0] < 100]
    want, shares, deviations = brute_whitening([r[1] for r in used])
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    assert len(got) == 8 * len(used)
    at = defaultdict(list)
    for r in got:
        at[r.vec_id, r.component].append(r)
    sign = {c: np.sign(at[0, c][0].whitened * want[0][c - 1]) for c in range(1, 9)}
    for i, r in enumerate(used):
        for c in range(1, 9):
            for g in at[r[0], c]:
                assert (g.n, g.deviation) == (len(used), deviations[i])
                assert g.whitened == pytest.approx(sign[c] * want[i][c - 1], abs=1e-10)
                assert g.explained == pytest.approx(shares[c - 1], rel=1e-10)
                assert g.identity_error < 1e-10
    assert len(at[3, 1]) == 2 and len(at[None, 1]) == 1


def test_whitening_of_large_entries_is_exact(spark):
    """Entries beyond one exact product are split; deviations that pass a long are null."""
    rng = np.random.default_rng(2)
    big = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(30, 3)) * 1e6]
    want, shares, deviations = brute_whitening(big, 3)
    got = whitening.whiten(spark.createDataFrame([(i, v, 0, "", "") for i, v in enumerate(big)], VECTORS)).collect()
    for r in got:
        assert r.deviation == (deviations[r.vec_id] if deviations[r.vec_id] < 2**63 else None)
        assert abs(r.whitened) == pytest.approx(abs(want[r.vec_id][r.component - 1]), abs=1e-9)
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-10)


def test_whitening_of_degenerate_tables(spark):
    table = lambda rows: spark.createDataFrame([(i, v, 0, "", "") for i, v in enumerate(rows)], VECTORS)
    assert whitening.whiten(table([])).collect() == []
    assert whitening.whiten(table([None, None])).collect() == []
    one = whitening.whiten(table([[0.5, 0.25]])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, 0.0), (2, 0, None, 0.0)]
    # no variance in the second dimension, a short and an empty vector count as zeros
    flat = whitening.whiten(table([[1.0, 0.0], [2.0, 0.0], [3.0], []])).collect()
    assert sorted((r.component, r.vec_id, None if r.whitened is None else round(abs(r.whitened), 6)) for r in flat) == [
        (1, 0, 0.447214), (1, 1, 0.447214), (1, 2, 1.341641), (1, 3, 1.341641), (2, 0, None), (2, 1, None), (2, 2, None), (2, 3, None)]


def test_registered_whitening_spreads_evenly(spark):
    out = entry.queries()["op13_whitening"](spark, SF).toPandas()
    assert len(out) == 8 * out.vec_id.nunique() and out.identity_error.max() < 1e-10
    w = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(w.T @ w / len(w), np.eye(8), atol=1e-10)
