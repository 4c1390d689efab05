"""Stored tables: races, repeats, chains that go on, deletes, caches, postings, stems."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestar.functions.stem import stem, stemmed
from lodestar.operators import postings, search, state, stored
from lodestar.sources.store import Lost, Versioned


@pytest.fixture
def make(spark, tmp_path):
    return lambda name, *by: Versioned(spark, str(tmp_path / name), by)


def docs(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, content_hash string, doc_id long")


def test_a_batch_is_written_once(spark, make):
    t = make("t")
    assert t.version() == 0 and t.read() is None
    for _ in range(2):
        assert stored.insert_documents(t, "one", docs(spark, [("a", "x", 2), ("a", "x", 1), ("b", "x", 3)])) == 1
    assert stored.insert_documents(t, "two", docs(spark, [("a", "x", 9), ("a", "y", 8)])) == 2
    assert sorted(r.doc_id for r in t.read().collect()) == [1, 3, 8]
    assert sorted(r.doc_id for r in t.read(1).collect()) == [1, 3]  # an older version reads on


def test_only_one_writer_makes_a_version(spark, make):
    t = make("t")
    t.commit(0, "x int", [], [])
    with pytest.raises(Lost):
        t.commit(0, "x int", [], [])
    assert t.version() == 1 and t.read().count() == 0


def test_two_batches_race(spark, make):
    """Both see an empty table; the loser works its rows out anew on the winner's."""
    t, first = make("t"), threading.Barrier(2)
    seen = []

    def insert(name, i):
        def rows(held):
            seen.append((name, held is None))
            if held is None:
                first.wait(60)
            from lodestar.operators import ingest
            from lodestar.sources.store import latest

            batch = docs(spark, [("a", "x", i), ("a", name, 10 + i)])
            return ingest.not_stored(batch, latest(held, batch))

        t.write(name, rows)

    threads = [threading.Thread(target=insert, args=(n, i)) for i, n in enumerate("pq")]
    [x.start() for x in threads]
    [x.join(120) for x in threads]
    got = t.read().collect()
    assert t.version() == 2 and sorted(r.content_hash for r in got) == ["p", "q", "x"]
    assert sum(1 for _, empty in seen if not empty) == 1
    assert t.vacuum() == []  # the loser's files are gone already


def test_chains_go_on_from_what_is_stored(spark, make):
    log = make("log")
    rows = [("k", i, f"p{i}") for i in range(6)] + [("m", 0, None), ("n", 5, "q")]
    df = spark.createDataFrame(rows, "k string, i int, p string")
    for name, part in (("a", "i < 2"), ("b", "i >= 2 AND i < 5"), ("b", "i >= 2 AND i < 5"), ("c", "i >= 5")):
        stored.append_entries(log, name, df.filter(part), "k", ["i"], "p")
    whole = {(r.k, r.i): (r.prev_hash, r.entry_hash) for r in state.chain(df, ["k"], ["i"], "p").collect()}
    got = log.read().collect()
    assert {(r.k, r.i): (r.prev_hash, r.entry_hash) for r in got} == whole and sorted(r.n for r in got if r.k == "k") == [1, 2, 3, 4, 5, 6]
    assert all(r.first_broken is None for r in state.verify(log.read(), "k", ["n"], "p").collect())


def test_delete_takes_children_and_the_tenants_cache(spark, make):
    documents, children, log, cache = make("d"), make("c"), make("l"), make("cache")
    documents.append("x", docs(spark, [("a", "h1", 1), ("a", "h2", 2), ("b", "h3", 1)]))
    children.append("x", spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 2, 0), ("b", 1, 0)], "tenant_id string, document_id long, i int"))
    stored.store_answers(cache, "x", spark.createDataFrame([("a", 1.0, [1.0], "r"), ("b", 2.0, [1.0], "r")], "tenant_id string, at double, vector array<double>, response string"))
    gone = spark.createDataFrame([("a", 1), ("a", 77), ("b", 2)], "tenant_id string, doc_id long")
    for _ in range(2):
        stored.delete_documents(documents, [(children, "document_id")], log, cache, "del", gone.filter("tenant_id = 'a'"))
    assert sorted((r.tenant_id, r.doc_id) for r in documents.read().collect()) == [("a", 2), ("b", 1)]
    assert sorted((r.tenant_id, r.document_id) for r in children.read().collect()) == [("a", 2), ("b", 1)]
    assert [(r.tenant_id, r.event_data, r.n) for r in log.read().collect()] == [("a", '{"document_id":1}', 1)]  # only what was there
    assert [r.tenant_id for r in cache.read().collect()] == ["b"]
    assert documents.read(1).count() == 3 and len(documents.vacuum()) == 1


def test_a_store_renews_the_whole_list(spark, make):
    cache = make("cache")
    row = lambda t, at: (t, float(at), [1.0], "r")
    put = lambda name, rows: stored.store_answers(cache, name, spark.createDataFrame(rows, "tenant_id string, at double, vector array<double>, response string"), keep=3)
    put("one", [row("a", i) for i in range(5)] + [row("b", 0)])
    put("two", [row("a", 100)])
    assert sorted(r.at for r in cache.read().filter("tenant_id = 'a'").collect()) == [3, 4, 100]
    assert sorted((r.tenant_id, r.at) for r in stored.living(cache.read(), 150, 60).collect()) == [("a", 3), ("a", 4), ("a", 100)]  # b's list has ended


def test_index_equals_a_scan_and_prunes(spark, make):
    texts = [(i, " ".join(["common", f"w{i % 7}", f"v{i}", "the"] * (1 + i % 3))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    asked = spark.createDataFrame([(0, "common w3"), (1, "the v5 unknown"), (2, "the"), (3, None)], "qid int, question string")
    index = make("postings", "bucket")
    for i in (0, 1, 1):
        postings.add(index, f"b{i}", df.filter(F.col("id") % 2 == i))
    rows = lambda x: sorted((r.qid, r["rank"], r.id, r.hits) for r in x.collect())
    assert rows(postings.sparse(index, asked)) == rows(search.sparse(df, asked))
    plan = postings.matches(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(lexeme" in plan
    wanted = postings.matches(index, spark.createDataFrame([(0, "v5")], "qid int, question string"))
    assert len({f.split("bucket=")[1].split("/")[0] for f in index.read().inputFiles()}) > 20 and wanted.count() == 1


def test_stems_find_other_forms(spark, make):
    df = spark.createDataFrame([(1, "consistently knitting"), (2, "knocks"), (3, "knits, Knitted consistency")], "id long, text string")
    index = make("postings", "bucket")
    postings.add(index, "b", df, stems=True)
    got = postings.sparse(index, spark.createDataFrame([(0, "consist knitting")], "qid int, question string"), stems=True).collect()
    assert sorted((r.id, r.hits) for r in got) == [(1, 2), (3, 3)]


# Pairs of the algorithm's published sample vocabulary.
SAMPLE = """consign consign consigned consign consistency consist consistently consist consolatory consolatori consolidated consolid conspicuous conspicu conspiracy conspiraci conspirators conspir
constables constabl constancy constanc knackeries knackeri knaves knave knavish knavish kneading knead kneels kneel knightly knight knitted knit knives knive knocker knocker knopp knopp generously generous
skies sky dying die news news inning inning proceed proceed cats cat gas gas this this kiwis kiwi cries cri ties tie hopping hop hoping hope relational relat rational ration electricity electr hopeful hope goodness good formative format
adjustable adjust controlling control rolled roll rate rate cease ceas apology apolog happily happili say say sayings say luxuriated luxuri agreed agre feed feed université université it's it 'twas twas""".split()


def test_stems_of_the_sample(spark):
    words, want = SAMPLE[::2], SAMPLE[1::2]
    assert [(w, stem(w)) for w in words] == list(zip(words, want))
    df = spark.createDataFrame([(i, w) for i, w in enumerate([*words, None])], "i int, w string").select("i", stemmed(F.col("w")).alias("s"))
    assert [r.s for r in df.orderBy("i").collect()] == [*want, None]
