"""Resampling, periodic runs and nearest neighbours against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import fingerprint, neighbours, queries, resample, runs, simhash
from lodestar.llm.common import persist


def words_of(text):
    return (text or "").encode().translate(resample.FOLD).split()


def grams(text, longest):
    words = words_of(text)
    return [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    some = [" ".join(rng.choice(["Ab", "ab", "c-d", "é", "日本", "x1", "the", "of"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return [(i, t) for i, t in enumerate(some)] + [(100, None), (101, ""), (102, "- -"), (None, "ab " * 30), (103, some[7]), (7, some[7]), (104, "ab " * 4000)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resample_against_brute_force(spark, texts, longest, monkeypatch):
    monkeypatch.setattr(resample, "STEP", 300)
    aims = ["the of ab", None, "x1 x1 é"]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("weight", F.lit("clash")).repartition(3)
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in aims], "text string"), longest, 50, percent=30, least_words=10, seed=7).collect()
    s = Counter(zlib.crc32(g) % 50 for _, t in texts for g in grams(t, longest))
    t = Counter(zlib.crc32(g) % 50 for a in aims for g in grams(a, longest))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)]
    want = []
    for i, text in texts:
        weight = sum(gain[zlib.crc32(g) % 50] for g in grams(text, longest))
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(words_of(text)), len(grams(text, longest)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((w for w in want if w[1] >= 10), key=lambda w: (-w[4], w[0] is None, w[0] or 0))
    drawn = Counter(w[:1] + w[4:] + (n + 1,) for n, w in enumerate(fit[: 30 * len(fit) // 100]))
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    mine = Counter((r.doc_id, r.score, r["rank"]) for r in got if r["rank"] is not None)
    assert {k[1:] for k in mine} == {k[1:] for k in drawn} and sum(mine.values()) == sum(drawn.values())


def test_resample_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    (row,) = resample.resample(some, none.select("text"), least_words=1, percent=100).collect()
    assert row.n_features == 2 and row["rank"] == 1
    assert {r.gain for r in resample.gains(resample.bucket_counts(none), resample.bucket_counts(none), 9).collect()} == {0}


def plain_runs(words, least=12, exponent=2):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def periodic_texts():
    rng = random.Random(3)
    made = [None, "", " \t\n", "a", "a b " * 6, "a " * 500]
    for _ in range(120):
        words = [str(rng.randint(0, rng.choice([1, 2, 40]))) for _ in range(rng.randint(1, 90))]
        if rng.random() < 0.5:
            a = rng.randrange(len(words))
            p = 1 + (len(words) - a) // rng.randint(2, 6)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        made.append(rng.choice([" ", "\t", "\n "]).join(words))
    return list(enumerate(made)) + [(3, "a"), (None, "x y z " * 9)]


@pytest.mark.parametrize("work", [runs.WORK, 200])  # whole texts, and ranges of lags
def test_runs_against_brute_force(spark, work):
    rows = periodic_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("period", F.lit("clash")).repartition(2)
    outputs = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")
    got = Counter()
    for r in runs.collapse(docs, outputs=outputs, work=work).collect():
        assert r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest() and r.n_runs == len(r.runs)
        got[(r.doc_id, r.text, tuple((x.start, x.length, x.period) for x in r.runs), r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed)] += 1
    want = Counter()
    for i, text in rows:
        words = (text or "").split()
        found = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        lost = {j for a, n, q in found for j in range(a + q, a + n)}
        told = hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        want[(i, text, tuple(found), *best, best[1] * 1000 // best[2] if found else None, told, " ".join(w for j, w in enumerate(words) if j not in lost))] += 1
    assert got == want


def test_runs_of_a_third_power():
    words = [b"a", b"b"] * 5 + [b"c"] + [b"d", b"e"] * 8
    assert runs.find_runs([words], least=4, exponent=3) == [[(0, 10, 2), (11, 16, 2)]] == [plain_runs(words, 4, 3)]


def test_runs_query_plants_periods(spark, tmp_path):
    """The query's own rule, on a fixture written as the table is."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))) if i % 9 else None) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            planted += 1
        found = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
        lost = {j for a, m, q in found for j in range(a + q, a + m)}
        assert got[i].n_runs == len(found) and got[i].collapsed_sha256 == hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in lost).encode()).hexdigest()
    assert planted > 5 and len(got) == len(rows)


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 12)) * rng.uniform(0.1, 3, size=(1500, 1))  # of unlike lengths
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(x.astype(np.float32))]
    rows += [(3000 + i, rows[0][1]) for i in range(40)] + [(4000, None), (4020, [1.0, None] * 6), (4040, [float("nan")] * 12), (4060, [0.0] * 12), (4080, [1.0, 2.0]), (4081, [2.0, 1.0]), (None, rows[1][1]), (4100, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=20, shard_rows=400).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, v) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    met = every = 0
    assert got.keys() == {i for i, v in good if i % 20 == 0}
    for q, v in good:
        if q % 20 == 0:
            plain = {i: sum(a * b for a, b in zip(v, w)) for i, w in good if i != q and len(w) == len(v)}
            want = sorted(plain, key=lambda i: (-plain[i], i))[:20]
            mine = [i for _, i, _ in sorted(got[q])]
            assert len(mine) == len(want) and all(abs(plain[i] - s) < 1e-12 for _, i, s in got[q])
            assert mine == sorted(mine, key=lambda i: (-plain[i], i))
            met, every = met + len(set(mine) & set(want)), every + len(want)
    assert met / every >= 0.95
    assert neighbours.nearest(table.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_index_holds_every_row(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(rng.normal(size=(700, 6)))]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index = persist(neighbours.build_index(vectors, shard_rows=200), "index")
    ids = [i for r in index.collect() for i in np.frombuffer(r.ids, np.int64).tolist()]
    assert sorted(ids) == list(range(700)) and index.count() == 4
    for r in index.collect():
        low = np.frombuffer(r.graphs[0], np.int32).reshape(r.n, neighbours.LINKS)
        assert low.max() < r.n and ((low >= 0).sum(1) > 0).all()


def plain_chunks(raw):
    """The chunks of a text, byte by byte: (digest, length)."""
    mask, out, start = (1 << 64) - 1, set(), 0
    power = lambda n: pow(fingerprint.BASE, n, 1 << 64)
    gear = [int(x) for x in fingerprint.GEAR]
    rolled = [sum(gear[raw[i - k]] << k for k in range(min(fingerprint.WINDOW, i + 1))) & 0xFFFF for i in range(len(raw))]
    while start < len(raw):
        end = start + fingerprint.LEAST
        while end < len(raw) and end < start + fingerprint.GREATEST:
            bits = fingerprint.STRICT if end < start + fingerprint.USUAL else fingerprint.LOOSE
            if rolled[end - 1] & int(bits) == 0:
                break
            end += 1
        end = min(end, len(raw))
        digest = sum((b + 1) * power(i) for i, b in enumerate(raw[start:end])) & mask
        digest = (digest ^ (digest >> 31)) * 0x94D049BB133111EB & mask
        out.add((digest >> 32, end - start))
        start = end
    return out


def told(chunks):
    return "".join(f"{d:08x}{n - 1:02x}" for d, n in sorted(chunks))


def inside(a, b):
    weight = lambda x: sum(n for _, n in x)
    return float(a == b) if not a or not b else weight(a & b) / weight(a)


def test_fingerprints_against_a_plain_chunker(spark):
    rng = random.Random(6)
    base = " ".join(rng.choice(["ab", "cé", "日本", "text", "of", "9"]) for _ in range(300))
    rows = [(i, base[: rng.randint(0, len(base))] + "".join(rng.choice("abc é") for _ in range(rng.randint(0, 200)))) for i in range(25)] + [(30, None), (31, ""), (32, "x"), (33, "y" * 500), (34, base), (35, base)]
    got = {r.doc_id: r for r in fingerprint.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 3
        own, edited, following = (plain_chunks(x.encode()) for x in (text, text[: len(text) - cut] + after[:cut], after))
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (told(own), told(edited))
        assert (r.near_edited, r.near_next) == pytest.approx((inside(own, edited), inside(own, following)))


def test_near_copies_of_a_table_against_all_pairs(spark):
    """Every pair of texts with 0.8 of their five-word shingles in common, found through their rare shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(docs, 5, 0.8).collect()}
    fold, of = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)), {}
    for r in docs.collect():
        w = (r.text or "").encode().translate(fold).split()
        of.setdefault(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)]), []).append(r.doc_id)
    sets, held = list(of), {}
    for i, s in enumerate(sets):
        for g in s:
            held.setdefault(g, []).append(i)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        rare = sorted(s, key=lambda g: (len(held[g]), g))[: len(s) - math.ceil(0.8 * len(s)) + 1]
        for j in {j for g in rare for j in held[g] if j < i}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                root[find(i)] = find(j)
    classes = {}
    for i, s in enumerate(sets):
        classes.setdefault(find(i), []).extend(of[s])
    assert got == {d: min(c) for c in classes.values() for d in c}
