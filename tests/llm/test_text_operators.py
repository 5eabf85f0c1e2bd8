"""Text operators against brute force, round trips and held-out labels, on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, duck
from pixelweave.llm import automata, cascade, lattice, merkle, mixing, pieces, simhash, sites, suffixes, warc
from pixelweave.llm.places import fresh_folder
from pixelweave.llm.winnow import anchors

SF = "/root/testdata/sf0.001"
# extra columns carry names that the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, u1 string, u2 string, word string, kind string, z string, size string, key string, g string"


def awkward_rows():
    rng = random.Random(7)
    words = ["the", "of", "ßau", "naïve", "Élan", "x,", "ab#c", "日本", "▁odd", "don't", "…", "A1"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = line(90)
    long = " ".join(line(40) + "\n" for _ in range(80))
    texts = [line(60), line(60), shared, line(20) + " " + shared, shared + "\n\n" + line(30), "", None, " \t\n ", "one", "a a a a a a a a a a a a", "x" * 700, "x" * 700 + "y", long, long, long[:2000] + "changed " + long[2000:], "\u0000 odd \u0085 text", "tab\tand\x0bvt"]
    rows = [(i, t, "en" if i % 2 else "fr", None if i % 5 == 4 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(None, shared, None, None), (None, None, None, None), rows[2], rows[2], (3, "other text under a used id", "en", "s0")]
    return [(*r, 1, "r", "a", "b", "w", "k", "z", "9", "key", "g") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).checkpoint() if spark.sparkContext.getCheckpointDir() else spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def covered(sequences, size):
    count = collections.Counter(s[i : i + size] for s in sequences for i in range(len(s) - size + 1))
    out = []
    for s in sequences:
        mask = bytearray(len(s))
        for i in range(len(s) - size + 1):
            if count[s[i : i + size]] > 1:
                mask[i : i + size] = b"\1" * size
        out.append(mask)
    return out


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_anchors_own_each_window_once():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 4, 3000).astype(np.uint64)
    a, first, last, _ = anchors(codes, 50, 8)
    assert [i for f, e in zip(first, last) for i in range(f, e + 1)] == list(range(len(codes) - 49))
    assert ((a >= last) & (a + 8 <= first + 50)).all()


@pytest.mark.parametrize("shard_rows", [0, 20_000])
def test_repeated_bytes(docs, shard_rows):
    got = bag(suffixes.removals(docs, suffixes.kind(shard_rows=shard_rows)).collect())
    rows = pairs(docs)
    data = [t.encode() for _, t in rows]
    want = []
    for (i, _), s, mask in zip(rows, data, covered(data, 200)):
        runs = sum(1 for k in range(len(s)) if mask[k] and (k == 0 or not mask[k - 1]))
        want.append((i, len(s), sum(mask), runs, hashlib.sha256(bytes(b for b, m in zip(s, mask) if not m)).hexdigest()))
    assert got == bag(want)


@pytest.mark.parametrize("shard_rows", [0, 1000])
def test_repeated_words(docs, shard_rows):
    got = bag(automata.removals(docs, automata.kind(shard_rows=shard_rows)).collect())
    rows = pairs(docs)
    data = [tuple(t.encode().split()) for _, t in rows]
    want = [(i, len(s), sum(m), hashlib.sha256(b" ".join(w for w, x in zip(s, m) if not x)).hexdigest()) for (i, _), s, m in zip(rows, data, covered(data, 35))]
    assert got == bag(want)


def test_documents_without_repeats_keep_their_columns(docs):
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("text is null").count() == docs.filter("text is null").count()
    assert out.filter("doc_id = 0").first().text == docs.filter("doc_id = 0").first().text


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_archives_round_trip(spark, size):
    rows = [(1, "a" * 5000), (2, "a" * 5000), (3, None), (4, ""), (5, "Ünï\r\n\r\nWARC/1.1\r\n0\r\n\r\n"), (None, "null id"), (7, "b"), (7, "b"), (8, "c\u0000d")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns({"body": F.lit("x"), "uid": F.lit(1), "key": F.lit("k")})
    path = f"{fresh_folder(spark)}/archives"
    warc.write(warc.classify(pages), path, segment_bytes=size)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    assert bag((r.page_id, r.record_type, r.refers_to) for r in got) == bag(
        [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "response", None), (7, "response", None), (7, "response", None), (8, "response", None)]
    )
    text = {r.page_id: bytes(r.payload).decode() for r in got if r.payload is not None}
    assert text[2] == "a" * 5000 and text[5] == rows[4][1] and text[8] == "c\u0000d"
    assert all(r.payload_digest == warc.base32_sha1((dict(rows)[r.page_id] or "").encode()) and r.payload_bytes == len((dict(rows)[r.page_id] or "").encode()) for r in got)


def test_segments_that_do_not_fit_are_reported(spark):
    block = warc.HTTP_HEAD + warc.chunked(b"payload")
    part = lambda k, total, b: ("o", k, total, "response" if k == 1 else "continuation", 1, None, None, None, b)
    whole = lambda parts: warc.decode(warc.reassemble(spark.createDataFrame(parts, warc.SEGMENT))).first().complete
    assert whole([part(2, len(block), block[9:]), part(1, None, block[:9])])
    assert not whole([part(1, None, block[:9]), part(3, len(block), block[9:])])
    assert not whole([part(1, None, block[:9]), part(2, len(block) + 1, block[9:])])
    assert warc.dechunked(b"3\r\nabc\r\n") is None and warc.dechunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_archives_of_no_pages(spark):
    path = f"{fresh_folder(spark)}/archives"
    warc.write(warc.classify(spark.createDataFrame([], "page_id long, html string")), path)
    assert warc.read(spark, path).count() == 0


def test_mix_reaches_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * (1 + k % 3) for k in range(rng.randrange(0, 400))), ["big"] * 6 + ["mid", "tiny", None] and rng.choice(["big"] * 8 + ["mid", None, "tiny"])) for i in range(600)]
    rows += [(None, None, "mid"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = mixing.mix_documents(docs, shard_tokens=5000).collect()
    assert bag((r.doc_id, r.size) for r in got) == bag((i, len((t or "").split())) for i, t, _ in rows)
    totals, target, taken = collections.Counter(), {}, collections.Counter()
    for r in got:
        totals[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.source_size >= r.size
    order = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, open_, want = sum(totals.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * totals[s]}
        if not full:
            break
        for s in full:
            want[s] = 3 * totals[s]
            left -= want[s]
        open_ -= full
    want |= {s: level * weight[s] for s in open_}
    assert all(abs(target[s] - want[s]) < 1e-6 for s in order)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 3 * mixing.BLOCK for s in order)
    assert bag(got) == bag(mixing.mix_documents(docs, shard_tokens=5000).collect())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() > 0


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(5)
    votes = {f"p{k}": rng.randrange(1, 10_000) for k in range(30)}
    for seats in (0, 1, 7, 100, 5000):
        parties = spark.createDataFrame([(1, k, v, seats) for k, v in votes.items()], "all int, p string, v long, seats long")
        got = {r.p: r.won for r in mixing.apportion(parties, ["all"], "p", "v", "seats").collect()}
        want = collections.Counter({k: 0 for k in votes})
        for _ in range(seats):
            want[max(sorted(votes), key=lambda k: votes[k] / (2 * want[k] + 1))] += 1
        assert sum(got.values()) == seats and all(abs(got[k] - want[k]) <= 1 for k in votes) and sum(got[k] != want[k] for k in votes) <= 2


def test_fingerprints_and_links(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    rows = pairs(docs)

    def reference(text):
        words = text.encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    prints = [reference(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    assert bag(got) == bag((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 2 or doc_id is null").count() <= 2


def test_one_of_each_class_of_near_copies(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, family = [], {}
    for k in range(60):
        base = [word() for _ in range(rng.randrange(150, 600))]
        for c in range(rng.choice((1, 1, 4, 12))):
            copy = list(base)
            for _ in range(len(base) // 100 if c else 0):  # a changed word touches 5 shingles: some 0.9 are shared
                copy[rng.randrange(len(copy))] = word()
            family[len(rows)] = k
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    assert kept == sorted({k: i for i, k in reversed(family.items())}.values())
    # parts dealt into blocks give the same classes
    prints = simhash.distinct_prints(simhash.wide_fingerprints(docs, 5), "words", "keys")
    got = simhash.named_classes(prints, simhash.wide_links(prints, shard_size=3))
    assert {r.component_id for r in got.collect()} == set(kept)


def test_wide_links_of_a_crowded_part(spark):
    # one key holds far more fingerprints than a shard, in pairs of near copies that share no other key
    rng = np.random.default_rng(5)
    words = rng.integers(-(2**63), 2**63 - 1, (2500, simhash.WORDS))
    near = words.copy()
    near[:, 0] ^= 7
    both = np.concatenate((words, near)).tolist()
    df = spark.createDataFrame([(i, (w, [1])) for i, w in enumerate(both)], "fp long, first struct<words: array<long>, keys: array<long>>")
    for size in (512, simhash.SHARD_SIZE):  # both below the 5,000 of the part
        got = {(r.fp, r.root) for r in simhash.wide_links(df, shard_size=size).collect()}
        assert {tuple(sorted(p)) for p in got} == {(i, i + 2500) for i in range(2500)}


def test_samples_meet_in_the_tree(spark):
    # sample fingerprints two bits apart meet as equal ones do, three bits apart they do not
    rng = np.random.default_rng(6)
    words = rng.integers(-(2**63), 2**63 - 1, (300, simhash.WORDS)).tolist()
    keys = rng.integers(-(2**63), 2**63 - 1, 300)
    rows = [(i, (words[i % 300], [int(keys[i % 300] ^ (0 if i < 300 else 0b11 if i % 2 else 0b111))])) for i in range(600)]
    df = spark.createDataFrame(rows, "fp long, first struct<words: array<long>, keys: array<long>>")
    got = {(r.fp, r.root) for r in simhash.wide_links(df, shard_size=50).collect()}
    assert {tuple(sorted(p)) for p in got} == {(i, i + 300) for i in range(1, 300, 2)}
    # a sample's fingerprint is the majority of its shingles' hashes
    least = rng.integers(0, 2**63, simhash.BANDS * simhash.ROWS, np.uint64)
    mixed = simhash._mixed(simhash._mixed(least).reshape(simhash.BANDS, simhash.ROWS) * simhash.MIX)
    assert simhash.sample_fingerprints(least).tolist() == [simhash.majority(m) for m in mixed]


def test_classes_by_the_similarity_of_the_shingles(spark):
    # pairs a little above and a little below 0.8: a changed word in the middle touches 5 shingles
    rng = random.Random(21)
    rows, want = [], set()
    for k in range(120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(604)]
        changed = 12 if k % 2 else 18  # 540 of 660 shingles shared, 0.818, or 510 of 690, 0.739
        copy = list(base)
        for i in range(changed):
            copy[20 + 30 * i] = f"v{k}_{i}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        want |= {2 * k} if k % 2 else {2 * k, 2 * k + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == want
    # parts dealt into blocks give the same classes
    prints = simhash.distinct_prints(simhash.wide_fingerprints(docs, 5), "words", "keys", "size")
    all_one = spark.createDataFrame([(r.fp, 0) for r in prints.collect()], "fp long, root long")
    links = simhash.similar_links(docs, prints, all_one, 5, shard_size=60)
    assert {r.component_id for r in simhash.named_classes(prints, links).collect()} == want


def test_a_repeated_shingle_does_not_merge_documents(spark):
    # one token repeated makes up over half of each text; the rest of the words differ
    rows = [(k, "0 " * 200 + " ".join(f"w{k}_{i}" for i in range(120))) for k in range(6)]
    rows.append((6, rows[5][1] + " more"))  # a near copy of a later one
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [0, 1, 2, 3, 4, 5]


def test_tree_finds_all_links(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(-(2**63), 2**63 - 1, 900)
    near = centres[rng.integers(0, 60, 1500)] ^ (np.int64(1) << rng.integers(0, 63, 1500)) ^ (np.int64(1) << rng.integers(0, 63, 1500))
    fps = np.unique(np.concatenate((centres, near)))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in enumerate(fps):
        for g in fps[:i][np.bitwise_count((fps[:i] ^ f).view(np.uint64)) <= 2]:
            a, b = find(int(f)), find(int(g))
            root[max(a, b)] = min(a, b)
    got = {r.fp: r.root for r in simhash.components(simhash.links(df, shard_size=100, sample_size=300)).collect()}
    assert {f: find(f) for f in root if find(f) != f} == {f: r for f, r in got.items() if f != r}


def brute_measures(text):
    words = text.encode().split()
    w3 = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(w3)
    hit = {k for i, g in enumerate(w3) if count[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_rule_cascade(docs):
    got = cascade.judge(docs).collect()
    want = []
    for i, t in pairs(docs):
        m = brute_measures(t)
        want.append((i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert bag(tuple(r)[:7] for r in got) == bag(want)
    assert not any(r.kept and r.base_failed for r in got)


def test_cascade_verdict_does_not_depend_on_order(docs):
    rules = cascade.rules()
    m = cascade.measures(docs)
    some = m.select([cascade.cascade(m, order, rules).isNull().alias(f"k{i}") for i, order in enumerate([list(rules), list(rules)[::-1]])]).collect()
    assert all(a == b for a, b in some)
    ticks = iter(range(1000))
    order = cascade.measured_order(m, {"never": F.lit(False), "always": F.lit(True)}, clock=lambda: next(ticks))
    assert [o[0] for o in order] == ["always", "never"]


def test_trees_and_next(docs):
    got = merkle.with_next(docs).collect()
    rows = pairs(docs)
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id", F.xxhash64("text")).collect()
    want = []
    for a, b in zip(ordered, [*ordered[1:], ordered[0]]):
        edited = a.text[: len(a.text) - len(a.text) // 2] + b.text[: len(a.text) // 2]
        want.append((a.doc_id, len(a.text), hashlib.sha256(edited.encode()).hexdigest()))
    assert bag(tuple(r)[:3] for r in got) == bag(want) and len(got) == len(rows)
    prints = collections.defaultdict(set)
    for i, t in rows:
        prints[t].add(merkle.fingerprint(t))
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_edits_are_located():
    text = "First line here.\nSecond line, longer.\n\nThird one.\nFourth one.\n"
    changed = text.replace("Third", "3rd")
    a, b = merkle.fingerprint(text), merkle.fingerprint(changed)
    assert merkle.likeness(a, a) == 1.0 and 0.5 < merkle.likeness(a, b) < 1.0 and merkle.likeness(a, merkle.fingerprint("")) == 0.0
    assert len(merkle.edits(a, b)) == 1 and merkle.edits(a, a) == []


def test_piece_round_trip(docs, spark):
    decoded = pieces.decoded(pieces.encoded(docs))
    assert bag(decoded.collect()) == bag(pairs(docs))
    got = pieces.digests(docs).collect()
    assert bag((r.doc_id, r.decoded_sha256) for r in got) == bag((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in pairs(docs))


def test_best_segmentation():
    own = pieces.Coder(pieces.load())
    scores = {p: s for p, s in zip(own.vocabulary.pieces, own.vocabulary.scores) if p}
    for word in ("▁the", "▁internationalen", "▁zzqx", "▁naïve日本", "▁x\u0085", "☃▁"):
        best = [0.0] + [-math.inf] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                s = scores.get(word[i:j])
                if s is None and j - i == 1:
                    s = own.fallback * len(word[i:j].encode())
                if s is not None and best[i] + s > best[j]:
                    best[j] = best[i] + s
        ids, score = own.best(word)
        assert score == pytest.approx(best[-1])
        assert own.decode([*ids]) == word.replace("▁", " ")[1:]


def test_lattice_sums_all_segmentations():
    rng = np.random.default_rng(4)
    vocabulary = pieces.Vocabulary((*(None,) * 256, "▁", "a", "b", "ab", "▁a", "aba", "ba"), (0.0,) * 263, tuple(range(256)))
    log_p = np.log(rng.dirichlet(np.ones(263)))
    table = {p: log_p[i] for i, p in enumerate(vocabulary.pieces) if p}

    def total(s):
        if not s:
            return 1.0
        out = sum(math.exp(table[s[:k]]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in table)
        return out + (0 if s[0] in table else math.exp(sum(log_p[b] for b in s[0].encode())) * total(s[1:]))

    words = ["a", "ab", "ababa", "aßb", "bbbb", ""]
    own = lattice.Lattice(vocabulary)
    own.read(words)
    assert np.allclose(np.exp(own.log_probabilities(log_p)), [total("▁" + w) for w in words])
    counts = np.zeros(263)
    own.add_expected(log_p, np.ones(len(words)), counts)
    # every segmentation spells each character once
    spelled = sum(c * (len(p) if p else 0.5) for c, p in zip(counts, vocabulary.pieces))
    assert spelled == pytest.approx(sum(len(w) + 1 for w in words))


def test_base_scores_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("word", F.lit("x"))
    got = lattice.scores(docs).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(count.values()) + ends, len(count) + 1
    want = {i: (held(i), len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))) for i, ws in rows}
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and r.base_score == pytest.approx(want[r.doc_id][4])
        assert math.isfinite(r.score) and r.score < 0
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_scores_of_awkward_rows(docs, empty):
    got = lattice.scores(docs).collect()
    assert bag((r.doc_id, r.n_tokens) for r in got) == bag((i, len(t.encode().split()) + 1) for i, t in pairs(docs))
    assert all(math.isfinite(r.score) for r in got)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.filter("doc_id % 5 <> 1")
    test = labels.filter("doc_id % 5 = 1").select("doc_id", F.expr("quality = 1 and coalesce(toxic, 0) = 0").alias("good"))
    got = sites.verdicts(docs, train).join(test, "doc_id").groupBy("good", "kept").count().collect()
    n = {(r.good, r.kept): r["count"] for r in got}
    assert n[(True, True)] / (n[(True, True)] + n.get((True, False), 0)) > 0.97
    assert n[(False, False)] / (n[(False, False)] + n.get((False, True), 0)) > 0.9


def test_sites_shrink_to_their_parents(spark):
    rows = [("a", "x", 5.0)] * 50 + [("b", "x", -5.0)] * 400 + [("c", "x", 5.0)]
    scored = spark.createDataFrame(rows, "host string, path string, evidence double")
    got = {r.host: r for r in sites.judge(scored, 0.5).select("host", "host_posterior", "path_posterior").distinct().collect()}
    assert got["b"].host_posterior < got["c"].host_posterior < got["a"].host_posterior


def test_quality_of_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, None), (None, 1, 1), (2, None, 0), (0, 0, 1)], "doc_id long, quality int, toxic int")
    assert sites.verdicts(docs, labels).count() == docs.count()
    kept = sites.kept_documents(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        lattice.scores(empty), suffixes.removals(empty), automata.removals(empty), mixing.mix_documents(empty), mixing.mixed(empty), sites.verdicts(empty, labels),
        simhash.near_duplicates(empty), simhash.one_of_each(empty), cascade.judge(empty), merkle.with_next(empty), pieces.digests(empty), suffixes.without_repeats(empty),
    ):
        assert out.count() == 0


@pytest.mark.parametrize("name", sorted(entry.text_queries.ORACLES))
def test_query_matches_oracle(spark, name):
    assert compare(name, entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name]).startswith("ok")


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF).persist()
        if k < 4:
            assert docs.columns == columns
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
    assert docs.columns == ["doc_id", "ids"] and docs.count() == before.count()


def test_small_batches_walk_the_tree_together(spark):
    # one row leaves for each shard, not one set of rows for each shard and batch
    rng = np.random.default_rng(8)
    fps = rng.integers(-(2**63), 2**63 - 1, 20_000)
    nodes = simhash.grow_tree(fps[:2000], 50)
    out = list(simhash.sent(iter(np.array_split(fps, 200)), nodes))
    assert len(out) == 1 and len(out[0]) == out[0].shard.nunique() <= len(nodes) + 1
    got = {s: set(np.frombuffer(x, "<i8").tolist()) for s, x in zip(out[0].shard, out[0].fps)}
    assert got == {s: set(fps[rows].tolist()) for s, rows in simhash.shards_of(fps, nodes)}
    assert len(list(simhash.sent(iter(np.array_split(fps, 200)), nodes, at_once=5000))) == 4


def test_local_links_of_sparse_and_dense_shards():
    rng = np.random.default_rng(11)
    # over RUN fingerprints share each block of bits in the dense ones
    for n, centres, limit in ((0, 1, 2), (1, 1, 2), (700, 700, 2), (600, 3, 2), (900, 60, 2), (400, 9, 0), (400, 9, 4)):
        fps = rng.integers(-(2**63), 2**63 - 1, centres)[rng.integers(0, centres, n)]
        for _ in range(4):
            fps = fps ^ np.where(rng.random(n) < 0.6, np.int64(1) << rng.integers(0, 63, n), 0)
        fps = np.unique(fps)
        a, b = np.nonzero(np.triu(np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= limit, 1))
        root = simhash._join(len(fps), a, b)
        for found in (simhash.local_links, simhash.split_links):
            member, least = found(fps, limit)
            again = simhash._join(len(fps), np.searchsorted(fps, least), np.searchsorted(fps, member))
            assert (again == root).all() and (least < member).all()


def test_a_shingle_hash_depends_on_its_words_alone():
    text = "The the  cat\tsat on a mat the cat sat on a mat " + "ä " * 9
    words = text.encode().lower().split()
    grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    found = simhash.shingle_set(text, 5)
    assert len(found) == len(grams) and (np.diff(found.astype(object)) > 0).all()
    assert set(simhash.shingle_set("a mat the cat sat on", 5).tolist()) <= set(found.tolist())
    assert [len(simhash.shingle_set(t, 5)) for t in ("", " \n", "a", "a b c", "a a a a a a")] == [0, 0, 1, 1, 1]
    assert simhash.shingle_set("c", 5).tolist() != simhash.shingle_set("c c", 5).tolist()


def test_keys_of_one_document_do_not_travel(spark):
    # a part is compared only where two documents share a key; one document that has a key twice shares it with nobody
    words = [[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4]]
    rows = [(0, (words[0], [10, 1 << 40])), (1, (words[1], [1 << 40, -7])), (2, (words[2], [99, 99]))]
    df = spark.createDataFrame(rows, "fp long, first struct<words: array<long>, keys: array<long>>")
    assert [tuple(r) for r in simhash.wide_links(df).collect()] == [(1, 0)]


def test_logistic_adds_up_by_keys():
    rng = np.random.default_rng(4)
    keys, picks, x = np.sort(rng.integers(0, 50, 900)), rng.integers(0, 30, 900), rng.normal(size=(30, 3))
    keys[keys == 7] = 8  # a key without a row
    want = np.zeros((50, 3))
    np.add.at(want, keys, x[picks])
    for at_once in (1, 64, 65_536):
        old, sites.SUMMED = sites.SUMMED, at_once
        try:
            assert np.allclose(sites.summed(keys, picks, 50)(x), want)
        finally:
            sites.SUMMED = old
    assert (sites.summed(keys[:0], picks[:0], 4)(x) == 0).all()
