"""The reference's own cases as rows, and every query against its SQL on the smallest tables."""

import base64
import hmac
import json
import math
import random
from datetime import UTC, datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar import catalog
from lodestar.functions import personal
from lodestar.functions import text as t
from lodestar.functions.vector import cosine
from lodestar.operators import governance, ingest, search, state
from lodestar.sources import tables
from lodestar.sources.tables import Tenant

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return f"{float(value):.9g}" if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", [*sorted(catalog.ORACLE_SQL), *sorted(catalog.CASES)])
def test_query_equals_sql(spark, name):
    query, sql = catalog.CASES.get(name) or (catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    if not Path(FOLDER).is_dir():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.sql(sql).to_arrow_table().to_pylist()
    df = query(spark, FOLDER)
    got = df.toArrow().to_pylist()
    row = lambda r: repr([(c, plain(r[c])) for c in sorted(r)])
    assert sorted(map(row, got)) == sorted(map(row, want))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cosine_of_nothing_is_zero(spark):
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 1.0


def test_citation_lists_are_taken_apart(spark):
    assert one(spark, t.citations(F.lit("a [2, 1] b [2]"))) == [1, 2]
    assert one(spark, t.citations(F.lit("none"))) == []
    assert one(spark, t.citations(F.lit("(0, 1] and [see 1, 2] and [3 ,4]"))) == [3, 4]
    assert one(spark, t.normalised(F.lit("a [1, 2] (0, 1] [see 1, 2] [3]"))) == "a [1][2] (0, 1] [see 1, 2] [3]"


def test_name_keeps_its_extension(spark):
    assert one(spark, t.clean_name(F.lit("a/b\\c​  d.txt"))) == "c d.txt"
    long = one(spark, t.clean_name(F.lit("x" * 300 + ".md")))
    assert len(long) == 200 and long.endswith(".md")


def test_windows_end_at_the_last_token(spark):
    assert [tuple(w) for w in one(spark, t.windows(F.lit(600)))] == [(0, 510), (446, 600)]
    assert one(spark, t.windows(F.lit(0))) == []


def test_missing_tenant_or_user_sees_nothing(spark):
    rows = spark.createDataFrame([("a", "u", 1), ("b", "u", 2), (None, "u", 3)], "tenant_id string, user string, x int")
    assert [r.x for r in Tenant("a").rows(rows).collect()] == [1]
    assert Tenant(None).rows(rows).count() == 0
    assert Tenant("a").rows(rows, owner="user").count() == 0
    with pytest.raises(Exception, match="another tenant"):
        Tenant("a").checked(rows).collect()


def test_refused_requests_add_nothing(spark):
    rows = spark.createDataFrame([("k", i, c) for i, c in enumerate([60.0, 50.0, 40.0, 1.0])], "k string, n int, cost double")
    told = state.quota(rows, 100.0, ["k"], ["n"], "cost").orderBy("n").collect()
    assert [r.accepted for r in told] == [True, False, True, False]


def test_sliding_window_ignores_refused(spark):
    rows = spark.createDataFrame([("k", i, float(s)) for i, s in enumerate([0, 1, 2, 11, 12])], "k string, n int, at double")
    told = state.sliding_window(rows, 2, 10.0, ["k"], "at", ["n"]).orderBy("n").collect()
    assert [r.accepted for r in told] == [True, True, False, True, True]


def test_chain_breaks_where_changed(spark):
    rows = spark.createDataFrame([("a", i, f"p{i}") for i in range(5)], "k string, n int, payload string")
    chained = state.chain(rows, ["k"], ["n"], "payload")
    assert state.verify(chained, "k", ["n"], "payload").first().first_broken is None
    changed = chained.withColumn("payload", F.when(F.col("n") == 3, "other").otherwise(F.col("payload")))
    assert state.verify(changed, "k", ["n"], "payload").first().first_broken == 3


def test_empty_retrieval(spark):
    chunks = spark.createDataFrame([], "id long, text string, embedding array<float>")
    asked = spark.createDataFrame([(0, "word", [1.0])], "qid long, question string, vector array<double>")
    assert search.hybrid(chunks.select("id", "text"), chunks.select("id", "embedding"), asked).count() == 0


def test_stop_words_ask_for_nothing(spark):
    chunks = spark.createDataFrame([(1, "the value of the catch"), (2, "of the")], "id long, text string")
    asked = spark.createDataFrame([(0, "what is the"), (1, "The VALUE, of it")], "qid long, question string")
    assert [(r.qid, r.id, r.hits) for r in search.sparse(chunks, asked).collect()] == [(1, 1, 1)]


def test_oversized_line_is_cut(spark):
    docs = spark.createDataFrame([(1, "a b\n" + "w " * 12 + "\nc\nd"), (2, None), (3, " ")], "doc_id long, text string")
    assert [tuple(r) for r in ingest.packed(docs, 10).collect()] == [(1, 4, 4, 2)]  # 2, then 10 + 2, then 2


def chunks_of(spark, text, most):
    rows = ingest.chunked(spark.createDataFrame([(1, text)], "doc_id long, text string"), most).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    return [(r.heading_path, r.token_count, r.text) for r in rows]


def test_chunks_of_sections(spark):
    assert chunks_of(spark, "", 400) == [] and chunks_of(spark, " \n \n", 400) == [] and chunks_of(spark, None, 400) == []
    assert chunks_of(spark, "Plain text.", 400) == [([], 2, "Plain text.")]
    nested = "intro\n# A\none\n## B\ntwo\n\nthree\n### C\n## D\nfour\n# E\n\nfive"
    assert chunks_of(spark, nested, 400) == [([], 1, "intro"), (["A"], 1, "one"), (["A", "B"], 2, "two\n\nthree"), (["A", "D"], 1, "four"), (["E"], 1, "five")]
    many = chunks_of(spark, "# H\n\n" + "\n\n".join(f"para {i} has five words" for i in range(50)), 30)
    assert len(many) == 9 and all(n <= 30 for _, n, _ in many) and sum(n for _, n, _ in many) == 250
    long = chunks_of(spark, "before\n\n" + " ".join(f"w{i}" for i in range(2000)) + "\n\nafter", 100)
    assert [n for _, n, _ in long] == [1] + [100] * 20 + [1] and "".join(x for _, _, x in long[1:-1]).split() == [f"w{i}" for i in range(2000)]
    assert [n for _, n, _ in chunks_of(spark, "a b c\n\nd e\n\nf", 5)] == [5, 1]  # exactly the budget fits
    assert chunks_of(spark, "***\n\n# ##\n---", 5) == [([], 1, "***"), (["##"], 1, "---")]  # no words: one token


def test_content_is_new_by_tenant(spark):
    stored = spark.createDataFrame([("a", "x")], "tenant_id string, text string").select("tenant_id", t.content_hash(F.col("text")).alias("content_hash"))
    batch = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("b", 3, "x"), ("a", 4, "call tel 555-0100-22"), ("a", 5, None), ("a", 6, " "), ("a", 7, "\n\n".join("abcd"))], "tenant_id string, doc_id long, text string")
    got = ingest.ingested(batch, stored, most_tokens=1, most_chunks=3).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.pii_types, r.text) for r in got] == [(2, None, "x"), (4, ["PHONE_NUMBER"], "call <"), (4, ["PHONE_NUMBER"], "PHONE_NUMBER>")]


@pytest.mark.parametrize("said, want", [("tel: 07700 900123 x", "<PHONE_NUMBER> x"), ("dial no. #0207-946-0958", "<PHONE_NUMBER>"), ("phone +1-555-0100", "<PHONE_NUMBER>"), ("30 days, 2024-1234, 3.2.1", "30 days, 2024-1234, 3.2.1"), ("reach us at 555-0100", "reach us at 555-0100")])
def test_phone_cue_redacts(spark, said, want):
    assert one(spark, personal.redacted(F.lit(said))) == want


@pytest.mark.parametrize("said, want", [
    ("pay GB29NWBK60161331926819 by 2024-01-30", "pay <IBAN_CODE> by <DATE_TIME>"), ("on March 15, 2024 or 03/15/2024.", "on <DATE_TIME> or <DATE_TIME>."),
    ("within 30 days, in March, 1/2", "within 30 days, in March, 1/2"), ("see https://a.b/2024-01-30", "see <URL>"), (None, None), ("", ""),
])
def test_accounts_and_dates_are_redacted(spark, said, want):
    assert one(spark, personal.redacted(F.lit(said).cast("string"))) == want


def test_canonical_json_as_python_writes_it(spark):
    data = {"b": "é 日 😀 \" \\ /", "a": None, "c": {"k": 1}}
    made = t.canonical({"b": F.lit(data["b"]), "a": F.lit(None).cast("string"), "c": F.struct(F.lit(1).alias("k"))})
    assert one(spark, made) == json.dumps(data, sort_keys=True, separators=(",", ":"))
    times = [datetime(2024, 1, 2, 3, 4, 5, n, UTC) for n in (0, 7, 120_000)]
    rows = spark.createDataFrame([(x,) for x in times], "x timestamp").select(t.iso(F.col("x")).alias("iso")).collect()
    assert [r.iso for r in rows] == [x.isoformat() for x in times]


def test_signatures(spark):
    key, message = b"k" * 20, "päyload"
    good = base64.b64encode(hmac.digest(key, message.encode(), "sha256")).decode()
    for signature, want in ((good, True), (good[:-4] + "AAA=", False), ("###", False), (None, False), ("", False)):
        assert one(spark, t.signed(F.lit(signature).cast("string"), key, F.lit(message))) is want


def test_bearer_and_acronyms(spark):
    assert [one(spark, t.bearer(F.lit(x).cast("string"))) for x in ("Bearer  a ", "Bearer ", "bearer a", None)] == ["a", None, None, None]
    assert [one(spark, t.is_acronym(F.lit(x))) for x in ("RAG", "Rag", "R2", "É")] == [True, False, False, True]


def test_zip_needs_equal_lengths(spark):
    with pytest.raises(Exception, match="as many vectors"):
        one(spark, ingest.zipped(F.array(F.lit("a")), F.array(F.lit(1), F.lit(2))))


def test_nearest_rank_by_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), float(rng.choice([1, 1, 1, 5, rng.randrange(500)]))) for _ in range(3000)] + [("one", 4.0), ("none", None), (None, 2.0)]
    got = {r.g: (r.n, r.p50, r.p95) for r in governance.nearest_rank(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    want = {}
    for g in ("a", "b", "c", "one", None):
        xs = sorted(x for h, x in rows if h == g)
        want[g] = (len(xs), *(xs[math.ceil(p * len(xs) / 100) - 1] for p in (50, 95)))
    assert got == want


def test_vendor_answers(spark):
    good = [i != 7 for i in range(20)]
    r = one(spark, governance.vendor_score(F.array(*map(F.lit, good))))
    assert (r.raw, r.normalised, r.tier, r.flagged) == (107, 100, "low_risk", [])
    r = one(spark, governance.vendor_score(F.array(*(F.lit(not x) for x in good))))
    assert (r.raw, r.tier, len(r.flagged)) == (0, "high_risk", 20)
    with pytest.raises(Exception, match="expected 20"):
        one(spark, governance.vendor_score(F.array(F.lit(True))))


def test_folds_take_nulls(spark):
    rows = spark.createDataFrame([("k", 0, None), ("k", 1, 100.0), (None, 0, 1.0)], "k string, n int, cost double")
    assert [r.accepted for r in state.quota(rows, 100.0, ["k"], ["n"], "cost").collect()] == [True] * 3
    chained = state.chain(rows.select("k", "n", F.lit(None).cast("string").alias("p")), ["k"], ["n"], "p")
    assert all(r.first_broken is None for r in state.verify(chained, "k", ["n"], "p").collect())


def test_cache_as_state(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(0, False, a), (1, False, a), (2, False, b), (3, False, b), (11, False, a), (12, False, a), (13, True, None), (14, False, a), (15, False, None), (16, False, [0.0, 0.0])]
    df = spark.createDataFrame([("x", *r) for r in rows] + [("y", 1, False, a)], "tenant_id string, at long, invalidates boolean, v array<double>")
    got = {(r.tenant_id, r.at): (r.hit_at, r.held) for r in state.cached(df, ["tenant_id"], "at", "v", 0.9, 10, 50).collect()}
    want = {0: (None, 1), 1: (0, 1), 2: (None, 2), 3: (2, 2), 11: (0, 2), 12: (None, 1), 13: (None, 0), 14: (None, 1), 15: (None, 1), 16: (None, 2)}
    assert got == {("x", k): v for k, v in want.items()} | {("y", 1): (None, 1)}  # at 12, ten after the store at 2
    many = spark.createDataFrame([("x", i, False, [math.cos(i), math.sin(i)]) for i in range(55)], df.schema)
    assert max(r.held for r in state.cached(many, ["tenant_id"], "at", "v", 0.999999999, 1e9, 50).collect()) == 50


def test_unacknowledged_messages_come_first(spark):
    rows = [(0, "publish", "m1"), (1, "publish", "m2"), (2, "call", None), (3, "call", None), (4, "ack", "m2"), (5, "call", None), (7, "call", None), (12, "call", None), (17, "call", None), (30, "call", None)]
    df = spark.createDataFrame([("r", float(x), *y) for x, *y in rows], "r string, at double, kind string, msg string")
    got = [(r.at, r.given, r.tries, r.dead) for r in state.consumed(df, ["r"], "at", []).filter("kind = 'call'").orderBy("at").collect()]
    assert got == [(2, "m1", 1, False), (3, "m2", 1, False), (5, None, None, False), (7, "m1", 2, False), (12, "m1", 3, False), (17, "m1", 3, True), (30, None, None, False)]


def test_files_by_their_first_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n123")
    (tmp_path / "c.pdf").write_bytes(b"junk %PDF-1.7")
    assert [r.text for r in tables.text_documents(spark, str(tmp_path / "a.txt")).collect()] == ["one\ntwo"]
    assert sorted((r.source_path[-5:], r.family) for r in tables.binary_documents(spark, str(tmp_path)).collect()) == [("a.txt", None), ("b.png", "png"), ("c.pdf", "pdf")]


def test_sinks_and_hours(spark, tmp_path):
    from lodestar.streaming import stateful

    rows = spark.createDataFrame([(1, "acked"), (2, "invalid_signature"), (3, "max_delivery_attempts")], "id int, outcome string")
    for _ in range(2):  # a batch that runs again replaces its files
        stateful.split_sinks(rows, 4, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/dead_letters")).count() == 2 and spark.read.parquet(str(tmp_path / "out/messages")).count() == 1




def test_reserve_waits_or_refuses(spark):
    asked = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([0, 1, 2, 30, 40, 100])] + [(2, 9, 5.0)], "k int, id int, at double")
    got = {r.id: (r.accepted, r.start) for r in state.reserve(asked, 2, 60, 30, ["k"], "at", ["id"]).collect()}
    assert got == {0: (True, 0.0), 1: (True, 1.0), 2: (False, None), 3: (True, 60.0), 4: (True, 61.0), 5: (True, 120.0), 9: (True, 5.0)}


def test_slots_belong_to_their_holder(spark):
    rows = [(0, "a", False), (1, "b", False), (2, "c", False), (3, "c", True), (4, "a", True), (5, "c", False), (62, "d", False)]
    asked = spark.createDataFrame([(1, i, float(x), h, r) for i, (x, h, r) in enumerate(rows)], "k int, id int, at double, holder string, release boolean")
    got = [(r.granted, r.held) for r in state.slots(asked, 2, 60, ["k"], "at", ["id"]).orderBy("id").collect()]
    assert got == [(True, 1), (True, 2), (False, 2), (False, 2), (True, 1), (True, 2), (True, 2)]
    assert state.slots(asked.limit(0), 2, 60, ["k"], "at", ["id"]).count() == 0
