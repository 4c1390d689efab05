"""The corpus operators against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import bpe, chat, fingerprint, lexicon, lm, mixing, pii, quality, queries, simhash, substrings, topk
from lodestar.llm.suffixes import common_prefixes, suffix_array

WORDS = "the of and nding erat onre thea sh lyst café über 日本 ab.c".split()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randint(0, 9))]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    shared = prose("shared", 120)
    found = [None, "", " ", "a", "De " * 300, "x" * 3000, prose(1, 20_000), prose(2, 200), prose(2, 200), prose(2, 199) + " else"]
    found += [prose(i, 60) + shared + prose(-i, 60) for i in range(3, 9)]
    return list(enumerate(found)) + [(7, prose(2, 200))]  # one row twice


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_bpe_as_tiktoken(spark, docs, none, texts):
    ranks = bpe.read_ranks(queries.RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    named = docs.withColumn("n_tokens", F.lit("clash"))
    got = bpe.encode(named, ranks, public_tokenizers.PATTERN, outputs=("ids", "n_tokens", "decoded")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == known.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) and bytes(r.decoded).decode() == (r.text or "")
    back = bpe.decode(spark.createDataFrame([(1, None), (2, [0, 1])], "doc_id long, ids array<int>"), ranks).orderBy("doc_id").collect()
    assert bytes(back[0].decoded) == b"" and len(back[1].decoded) == 2
    assert bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0


def test_chat_round_trip(spark):
    odd = "<|turn|>a<\\|text|>b<\\\\|end|><<|end|>|"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd + "<"), (2, 0, "assistant", "x"), (3, 0, "system", None), (3, 1, "user", "q"), (3, 2, "assistant", ""), (4, 0, None, "t"), (4, 0, None, "t"), (None, 0, "user", "u")]
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", odd), ("assistant", odd + "<")] and back[1].loss_text == odd + "<"
    assert {k: r.valid for k, r in back.items()} == {1: True, 2: False, 3: True, 4: False, None: False}
    assert len(back[4].turns) == 2 and back[3].turns[0].text == ""
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    with pytest.raises(ValueError):
        chat.Template(turn="<|x|>", text="[y]")


def test_top_k_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([1, 30])]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2050, [float("nan")] * 8), (2100, [1.0, 2.0]), (2102, [3.0, 1.0]), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:5]
        mine = sorted(got.get(q, []))
        if q != 50:  # its row stands twice, so each of its answers may
            assert mine == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def accepted(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        sums = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(sums) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def test_pii_spans(spark, docs, none):
    odd = ["a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004", "+1 (555) 555-5555. +12 ", "4111 1111 1111 1111 and 4111-1111-1111-1112", "é@x.y 日本a.b@c-d.e", "", " " + "9" * 3000, "x@y.z " * 300, None, "+1" + "2" * 14 + "( +1 2 3 4 5 6 7 8 9 0 1"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    for r in pii.find(df).collect():
        text = odd[r.doc_id] or ""
        want = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if accepted(k, m.group()))
        assert [(s.start, s.kind_no, s.end, s.kind) for s in r.base] == want
    assert pii.find(none).count() == 0
    assert pii.sanitise(docs).filter("doc_id = 7").count() == 2


def test_pii_disclosing_terms(spark):
    rows = [(i, f"mail bob@x.org or ask zebrafish about {i}\nplain words here {i}") for i in range(6)]
    rows += [(100 + i, f"some other words here {i} about mail or ask\nmore") for i in range(300)]
    made = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert made[0] == "mail [EMAIL] or ask [TERM] about 0\nplain words here 0"
    assert made[100] == rows[6][1]


def test_pii_terms_by_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(500):
        said = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"w{rng.randrange(900)}"]) for _ in range(6)) for _ in range(3)]
        if i % 9 == 0:
            said[1] += f" u{i}@h{i % 4}.org code{i % 4} x{i}x."
        rows.append((i, "\n".join(said) if i % 2 else ". ".join(said)))
    rows.append((None, None))
    met, with_entity, pairs, n = Counter(), Counter(), Counter(), 0
    split = lambda t: [u for u in re.split(pii.UNIT, t or "") if u.strip()]
    cut = lambda u: {w for w in re.split(r"[^a-z0-9]+", u.lower()) if len(w) >= 3}
    for _, t in rows:
        for u in split(t):
            n += 1
            met.update(cut(u))
            mails = re.findall(PATTERNS["email"].replace("(", "(?:"), u)
            found = {e for m in mails for e in (m, m.split("@")[1])}
            with_entity.update(found)
            pairs.update((e, w) for e in found for w in cut(re.sub("|".join(map(re.escape, mails)) or "$^", " ", u)))
    good = {p for p, k in pairs.items() if math.log2(k * n / ((met[p[1]] + 1) * with_entity[p[0]])) / math.log2(n / with_entity[p[0]]) >= pii.THRESHOLD}
    assert any(e.startswith("u") for e, _ in good) and any(e.startswith("h") for e, _ in good) and len(good) < len(pairs)
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r.doc_id] or ""
        mails = [m.span() for m in re.finditer(PATTERNS["email"], text)]
        own = {e for a, b in mails for e in (text[a:b], text[a:b].split("@")[1])}
        terms = {w for e, w in good if e in own}
        want = [m.span() for m in re.finditer("[a-z0-9]+", text) if m.group() in terms and not any(a < m.end() and m.start() < b for a, b in mails)]
        assert [(x.start, x.end) for x in r.spans if x.kind == "term"] == want


def test_mixing_follows_the_rates(spark, none):
    rows = [(i, f"text {i}", "a" if i % 3 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("clash"))
    table = spark.createDataFrame([("a", 0.5), (None, 40.0)], "source string, rate double")
    got = mixing.mix(df, table).collect()
    counts = Counter(r.source for r in got)
    assert abs(counts["a"] / 2000 - 0.5) < 0.08 and abs(counts[None] / 1000 - 40) < 1
    assert [r.mix_key for r in got] == sorted(r.mix_key for r in got)
    assert got == mixing.mix(df, table).collect()
    odd = spark.createDataFrame([(None, None, "a"), (None, "x", "a"), (1, "", "a"), (1, "", "a")], df.select("doc_id", "text", "source").schema)
    told = Counter((r.doc_id, r.text) for r in mixing.mix(odd, spark.createDataFrame([("a", 30.0)], "source string, rate double")).collect())
    assert len(told) == 3 and told[1, ""] % 2 == 0 and told[None, None] != told[None, "x"]
    empty = none.withColumn("source", F.lit("a"))
    assert mixing.mix(empty, mixing.rates(mixing.sizes(empty), mixing.tempered(mixing.sizes(empty)))).count() == 0


@pytest.mark.parametrize("mean", [0.3, 40.0, 700.0, 5000.0])
def test_poisson_counts(spark, mean):
    """The least count whose probability sum is above u, against sums in log space; mean and variance."""
    drawn = spark.range(4000).select(mixing.uniform(F.lit("7"), F.col("id").cast("string")).alias("u")).select("u", mixing.poisson(F.lit(mean), F.col("u")).alias("k")).collect()
    top = int(mean + 14 * math.sqrt(mean) + 20)
    sums = np.cumsum([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(top)])
    want = np.searchsorted(sums, [r.u for r in drawn], "right")
    got = np.array([r.k for r in drawn])
    assert (got == want).mean() > 0.999 and np.abs(got - want).max() <= 1
    assert abs(got.mean() / mean - 1) < 0.06 and abs(got.var() / mean - 1) < 0.12


def test_quality_keeps_prose_and_drops_junk(spark, none):
    good = [(i, prose(i, 150), "en") for i in range(300)]
    junk = [(1000 + i, " ".join(w.upper() + "###" for w in prose(i, 80).split()), "en") for i in range(20)]
    odd = [(2000, None, "en"), (2001, "", None), (0, good[0][1], "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(250)] + [(1000, 0, 1), (None, 1, 0), (0, 1, 0), (99999, 1, None)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(good + junk + odd, "doc_id long, text string, lang string").withColumn("keep", F.lit(1))
    got = quality.classify(df, labels).collect()
    assert len(got) == len(good) + len(junk) + len(odd)
    assert all(r.keep for r in got if r.doc_id < 1000 or r.doc_id >= 2000) and not any(r.keep for r in got if 1000 <= r.doc_id < 2000)
    assert all(r.keep for r in quality.classify(df, labels.filter("false")).collect())
    model = quality.train(df.filter("doc_id < 20").select(F.col("text").cast("binary").alias("raw")))
    both = [quality.score(df.select("doc_id", "text").filter("doc_id between 40 and 60 or doc_id >= 1000"), model, broadcast=x).collect() for x in (True, False)]
    a, b = ({r.doc_id: r.perplexity for r in x} for x in both)
    assert a[2000] is None and b[2001] is None and a.keys() == b.keys()
    assert quality.classify(none.withColumn("lang", F.lit("en")), labels).count() == 0 and quality.classify(df, labels.limit(0)).count() == len(got)
    assert all(abs(a[k] - b[k]) < 1e-5 * a[k] for k in a if k < 2000)


def kneser_ney(good, bad):
    """log10 probabilities of words in context, and each word's contrast, plainly."""
    runs = lambda ts: [["<s>", "<s>", *t.split(), "</s>"] for t in ts]
    uvw = Counter(tuple(r[i - 2 : i + 1]) for r in runs(good) for i in range(2, len(r)))
    vw, w = Counter(g[1:] for g in uvw), Counter()
    w.update(g[1] for g in vw)

    def cuts(counts):
        r = [sum(n == i for n in counts.values()) for i in (1, 2, 3, 4)]
        if not all(r):
            return [0.5, 0.75, 0.9]
        y = r[0] / (r[0] + 2 * r[1])
        return [min(max(i + 1 - (i + 2) * y * r[i + 1] / r[i], 0.0), i + 1.0) for i in range(3)]

    def order(counts, context):
        d, totals, left = cuts(counts), Counter(), Counter()
        for g, n in counts.items():
            totals[context(g)] += n
            left[context(g)] += d[min(n, 3) - 1]
        return (lambda g: (counts[g] - d[min(counts[g], 3) - 1]) / totals[context(g)] if counts[g] else 0.0), (lambda c: left[c] / totals[c] if totals[c] else 1.0)

    a3, b3 = order(uvw, lambda g: g[:2])
    a2, b2 = order(vw, lambda g: g[:1])
    a1, b1 = order(w, lambda g: ())
    p1 = lambda x: a1(x) + b1(()) / (len(w) + 1)
    p2 = lambda v, x: a2((v, x)) + b2((v,)) * p1(x)
    p3 = lambda u, v, x: a3((u, v, x)) + b3((u, v)) * p2(v, x)
    z = Counter(x for _, x in {tuple(r[i - 1 : i + 1]) for r in runs(bad) for i in range(2, len(r))})
    az, bz = order(z, lambda g: ())
    return p3, lambda x: math.log10(az(x) + bz(()) / (len(z) + 1)) - math.log10(p1(x)) if z[x] else -math.inf


def test_quality_by_plain_kneser_ney(spark):
    good, bad = [prose(i, 60) for i in range(30)], [prose(100 + i, 30) + " blot blot2 blot" * (i % 3) for i in range(9)]
    asked = [prose(200, 50), "the of and", "unseen words only", "blot the blot", good[0]]
    p3, apart = kneser_ney(good, bad)
    raw = lambda ts: spark.createDataFrame([(t,) for t in ts], "text string").select(F.col("text").cast("binary").alias("raw"))
    model = quality.train(raw(good), raw(bad))
    for way in (True, False):
        for r in quality.score(spark.createDataFrame([(t,) for t in asked], "text string"), model, broadcast=way).collect():
            run = ["<s>", "<s>", *r.text.split(), "</s>"]
            logs = [math.log10(p3(*run[i - 2 : i + 1])) for i in range(2, len(run))]
            assert math.isclose(r.perplexity, 10 ** (-sum(logs) / len(logs)), rel_tol=1e-5)
            assert math.isclose(r.contrast, max(map(apart, run[2:])), abs_tol=1e-5)


def test_quality_learns_from_every_labelled_document(spark):
    """Over 4,000 documents of either half: each is scored by all trusted and all bad ones of the other half."""
    texts = {i: prose(i, 4) + (f" blot{i % 7}" if i % 9 == 8 else "") for i in range(10_000)}
    df = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 9 < 8), 0) for i in range(9_900)], "doc_id long, quality int, toxic int")
    half = {r.doc_id: r.h for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("h")).collect()}
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert got.keys() == texts.keys()
    for h in (0, 1):
        other = [i for i in range(9_900) if half[i] != h]
        good, bad = ([texts[i] for i in other if (i % 9 < 8) == kind] for kind in (True, False))
        assert len(good) > 4_000
        p3, apart = kneser_ney(good, bad)
        for i in [i for i in texts if half[i] == h and i % 97 < 2]:
            run = ["<s>", "<s>", *texts[i].split(), "</s>"]
            logs = [math.log10(p3(*run[j - 2 : j + 1])) for j in range(2, len(run))]
            assert math.isclose(got[i].perplexity, 10 ** (-sum(logs) / len(logs)), rel_tol=1e-5)
            assert math.isclose(got[i].contrast, max(map(apart, run[2:])), abs_tol=1e-5)


def test_quality_packs_rare_words_tightly(spark):
    """Words are those of bytes.split(), and a place of a rare word, which goes to up to two shards, takes few bytes."""
    texts = [b"", b" ", b"a b\x0b\xff\x1cc", b"x" * 2000, b"abcdefgh abcdefghi", b"abcdefgh\0", "ä\u2003b ä".encode(), b""]
    hashes, sizes = lexicon.word_hashes(pa.array([b"left out", *texts]).slice(1))
    words = [w for t in texts for w in t.split()]
    assert sizes.tolist() == [len(t.split()) for t in texts]
    assert len(set(words)) == len(set(hashes.tolist())) == len(set(zip(words, hashes.tolist())))
    r = random.Random(5)
    rows = [(i, i % 2, quality.SCORED, " ".join(f"w{r.getrandbits(40):x}" for _ in range(200)).encode()) for i in range(500)]
    df = spark.createDataFrame(rows, "key long, half int, use int, raw binary").coalesce(1)
    size, n = (sum(f(r.packed) for r in quality._places(df, 2).collect()) for f in (len, lambda v: len(quality.unpacked(v)["v"])))
    assert n == 500 * 202 and size < 18.2 * n


def test_quality_drops_documents_with_few_bad_words(spark):
    rows = [(i, prose(i, 150), "en", 1, 0) for i in range(400)]
    rows += [(1000 + i, prose(1000 + i, 70) + f" swine{i % 3} " + prose(2000 + i, 70), "en", 1, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int")
    kept = {r.doc_id for r in quality.classify(df.select("doc_id", "text", "lang"), df.filter("doc_id < 300 OR doc_id >= 1000").select("doc_id", "quality", "toxic")).filter("keep").collect()}
    assert not kept & set(range(1000, 4000)) and len(kept) >= 0.97 * 400


def test_simhash_classes(spark, docs, none, texts, monkeypatch):
    known = {i: t or "" for i, t in texts}
    prints = {}
    for i, t in known.items():
        w = t.encode().lower().split()
        found = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 3]), 42) for j in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    for most in (simhash.MAX_SHARD, 1):
        monkeypatch.setattr(simhash, "MAX_SHARD", most)
        got = simhash.classes(docs.withColumn("fingerprint", F.lit("clash"))).collect()
        assert len(got) == len(texts)
        assert {r.doc_id: (r.fingerprint & (2**64 - 1), r.component_id) for r in got} == {i: (prints[i], root[i]) for i in prints}
    assert simhash.classes(none).count() == 0


def test_near_copies_leave_one(spark, docs, none):
    left = [r.doc_id for r in simhash.deduplicate(docs).collect()]
    assert len(left) == len(set(left)) and 7 in left and not {8, 9} & set(left)
    assert {3, 4, 5, 6} <= set(left) and 0 in left and not {1, 2} & set(left)  # 0, 1 and 2 have no words
    assert simhash.deduplicate(none).count() == 0


def jaccard(a, b):
    a, b = (set(simhash.hashes(t.lower().encode().split(), 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def brute_classes(rows, least):
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if jaccard(a, b) >= least:
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return {i: top(i) for i in root}


def changed(seed, n=300, edits=6):
    """A text and a copy with a few new words: just over 0.8 alike."""
    rng = random.Random(seed)
    one = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    two = list(one)
    for at in rng.sample(range(4, n - 4), edits):
        two[at] = "new"
    return " ".join(one), " ".join(two)


@pytest.mark.parametrize("most", [2048, 1])
def test_near_copies_of_any_member(spark, monkeypatch, most):
    # each version is like the next one, not like those further on
    rows = []
    for family in range(4):
        rng = random.Random(family)
        text = [f"w{rng.randrange(10**6)}" for _ in range(700)]
        for version in range(9):
            rows.append((100 * family + version, " ".join(text)))
            at = 70 * version
            text[at : at + 35] = [f"v{rng.randrange(10**6)}" for _ in range(35)]
    # pairs that share one band or two
    for seed in range(2000):
        pair = changed(seed)
        (a, p), (b, q) = (simhash.sketch(np.unique(simhash.hashes(t.encode().split(), 5))) for t in pair)
        if len(np.intersect1d(p, q)) in (1, 2) and simhash.similarity(a, b) >= 0.8 and jaccard(*pair) >= 0.8:
            rows += [(10_000 + 2 * seed, pair[0]), (10_001 + 2 * seed, pair[1])]
    assert len(rows) >= 36 + 4
    want = brute_classes(rows, 0.8)
    assert len(set(want.values())) == 4 + (len(rows) - 36) // 2
    monkeypatch.setattr(simhash, "MAX_SHARD", most)
    got = simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_copies_by_exact_share(spark):
    # around the limit, where sketches alone go wrong both ways
    rows = [(2 * i + j, t) for i in range(60) for j, t in enumerate(changed(5000 + i, 1200, 25 + i % 6))]
    want = brute_classes(rows, 0.8)
    shares = [jaccard(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2)]
    assert sum(0.78 < x < 0.8 for x in shares) > 5 and sum(0.8 <= x < 0.82 for x in shares) > 5
    got = simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        text = bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(1, 60)))
        order = suffix_array(text, 1000)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        for shared, a, b in zip(common_prefixes(text, order, 1000), order, order[1:]):
            x, y = text[a:], text[b:]
            assert shared == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


@pytest.mark.parametrize("group", [substrings.GROUP, 1])
def test_repeats_removed(spark, docs, none, texts, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    raws = [(i, (t or "").encode()) for i, t in texts]
    starts = Counter(r[i : i + 400] for _, r in raws for i in range(len(r) - 399))
    want = []
    for i, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for j in range(len(r) - 399):
            if starts[r[j : j + 400]] > 1:
                gone[j : j + 400] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        want.append((i, len(r), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), sha(kept)))
    got = [tuple(r) for r in substrings.remove_repeats(docs, 400, keep=("doc_id",), with_text=False).collect()]
    assert sorted(got) == sorted(want)
    assert substrings.remove_repeats(none, 400, keep=("doc_id",)).count() == 0


def test_fingerprints(spark, docs, none, texts):
    got = fingerprint.edited(docs).collect()
    order = sorted(texts, key=lambda r: (-r[0], r[1] or ""))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        cut = len(t) // 3
        want.append((i, len(t), sha(t[: len(t) - cut] + after[:cut])))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by = {r.doc_id: r for r in got}
    assert by[7].fingerprint == by[8].fingerprint and by[8].near_next == 1.0 and 0.55 < by[6].near_edited < 0.8
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert fingerprint.edited(none).count() == 0
    assert fingerprint.fingerprints(docs.withColumn("fingerprint", F.lit(1))).count() == len(texts)


def test_lm_scores(spark, none):
    texts = [(i, prose(i, 300)) for i in range(60)] + [(100, None), (101, ""), (3, prose(3, 300))]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    count = Counter(w for i, t in texts if not held(i) for w in words(t))
    n, least = sum(count.values()), math.log10(sum(count.values()) + 0.5 * (len(count) + 1))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = lm.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in texts)
    by = dict(texts)
    for r in got:
        w = words(by[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10(count[x] + 0.5) - least for x in w), rel_tol=1e-9) and r.score < 0
    assert lm.score(none, F.lit(False)).count() == 0


def test_lm_score_word_by_word(spark):
    """The score against plain sums over each word's context, from the same weights."""
    texts = [(i, prose(i, 200)) for i in range(40)] + [(50, None), (51, "x " * 3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = lm.train(df, F.col("doc_id") % 5 == 1)
    counts, w = model.counts, lm.Weights(model.counts.features, model.weights)
    assert np.abs(model.weights).max() > 0.01
    place = {int(h): i for i, h in enumerate(counts.hashes)}
    c = {np.uint64(r.hash & (2**64 - 1)): r.n for r in model.table.collect()}
    half = counts.features // 2
    row = lambda *parts: int(lm.mixed(*(np.array([x], np.uint64) for x in parts))[0] % np.uint64(half))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    want = {}
    for i, text in texts:
        before, total = [lm.CLASSES] * 3, 0.0
        for word in [*(text or "").encode().lower().split(), b"\n"]:
            h = xxhash.xxh3_64_intdigest(word)
            at = place.get(h, 10**9)
            kind = at if at < counts.single else lm.ending(word)
            back = [row((before[-k] + 1000 * k) % 2**64) for k in (1, 2, 3)]
            rows = [*back, row(before[-1], before[-2]) + half]
            g, k = divmod(kind, lm.GROUPS)
            total += np.log10(soft(counts.bias_group + sum(w.group[r] for r in rows).astype(float))[g])
            total += np.log10(soft(counts.bias_class[g] + sum(w.inner[r * lm.GROUPS + g] for r in rows).astype(float))[k])
            if at >= counts.single:
                total += np.log10(c.get(np.uint64(h), 0) + 0.5) - counts.within[kind]
            before.append(h if at < counts.features // lm.ROWS_A_WORD else lm.ending(word))
        want[i] = total
    got = {r.doc_id: r.score for r in lm.score(df, F.col("doc_id") % 5 == 1, model=model).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-4) for i in want)


def test_lm_learns_what_follows_what(spark):
    """Held-out texts of a fixed order of words are likelier than their words alone."""
    ring = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join((ring * 3)[i * 7 % 300 :][:400])) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    held = [r for r in lm.score(df, F.col("doc_id") % 5 == 1).collect() if r.held_out]
    assert held and all(r.score > r.base_score for r in held)


def test_lm_step_by_finite_differences():
    rng = np.random.default_rng(1)
    counts = lm.Counts(np.array([5, 9], np.uint64), np.array([0, 1]), np.array([7, 3]), 2, (np.ones(lm.CLASSES), np.ones(lm.CLASSES)), 10, 5)
    features, classes = rng.integers(0, 9, (4, 50)), rng.integers(0, lm.CLASSES, 50)
    start = rng.normal(size=len(lm.Weights(counts.features).flat)).astype(np.float32)
    w, seen = lm.Weights(counts.features, start), lm.Weights(counts.features)
    lm.learn(w, seen, counts, features, classes)

    def loss(flat):
        v = lm.Weights(counts.features)
        v.group, v.inner = flat[: v.group.size].reshape(v.group.shape), flat[v.group.size :].reshape(v.inner.shape)
        a, b = lm.predicted(v, counts, features, classes // lm.GROUPS)
        each = np.arange(len(classes))
        return -np.log(a[each, classes // lm.GROUPS]).sum() - np.log(b[each, classes % lm.GROUPS]).sum()

    for at in [*range(0, 9 * lm.GROUPS, 7), *(w.group.size + np.arange(0, 9 * lm.CLASSES, 97))]:
        up, down = start.astype(float), start.astype(float)
        up[at] += 1e-4
        down[at] -= 1e-4
        slope = (loss(up) - loss(down)) / 2e-4
        assert math.isclose(start[at] - w.flat[at], lm.RATE * slope / math.sqrt(slope * slope + 1), rel_tol=2e-2, abs_tol=2e-4)


def test_feature_rows_grow():
    assert [lm.feature_rows(n) for n in (0, 4_000_000, 64_000_000, 5_000_000_000)] == [4096, 4096, 16384, 131072]


def test_probabilities_add_up():
    counts = lm.Counts(np.array([5, 9], np.uint64), np.array([0, 1]), np.array([7, 3]), 2, (np.ones(lm.CLASSES), np.ones(lm.CLASSES)), 10, 5)
    w = lm.Weights(counts.features)
    w.flat[:] = np.random.default_rng(0).normal(size=len(w.flat))
    features = np.arange(12).reshape(4, 3)
    total = np.zeros(3)
    for g in range(lm.GROUPS):
        a, b = lm.predicted(w, counts, features, np.full(3, g))
        total += a[:, g] * b.sum(1)
    assert np.allclose(total, 1, atol=1e-5)
