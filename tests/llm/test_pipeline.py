"""The pipeline's stages on a small corpus, each against what it must keep."""

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from lodestar.llm import bpe, queries

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.columns == list(corpus_pipeline.COLUMNS)
        a, b = (x.select("doc_id").distinct() for x in (before, after))
        assert b.join(a, "doc_id", "left_anti").count() == 0
        if name == "near_copies":
            assert before.select("text").distinct().count() >= after.count()
        before = after
    encoded = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.RANKS), special_tokens={})
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in encoded.select("doc_id", "ids").collect():
        assert r.ids == known.encode_ordinary(texts[r.doc_id] or "")
    assert encoded.filter(F.col("n_tokens").isNull()).count() == 0


def odd_rows(spark):
    said = " ".join(f"word{i % 17} of{i % 5} thing{i}" for i in range(60))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t", None, "b"), (4, said, "en", None), (5, said, "en", "b"), (5, said, "en", "b"), (6, said.replace("word3", "other", 2), "en", "b"), (7, "mail x@y.org or 10.0.0.9", "de", "b"), (8, "short text", "de", "b")]
    rows = [(*r, len(r[1] or ""), "clash", 1) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, copy int").withColumns({c: F.lit("clash") for c in ("keep", "spans", "component_id", "__n", "n_tokens")})


def test_stages_take_odd_and_no_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns with clashing names, and a table without rows."""
    spark.createDataFrame([(4, 1, 0), (8, 1, None), (None, 0, 1), (99, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_rows(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, str(tmp_path))
        kept[name] = rows.collect()
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and none.columns == rows.columns
        if name != "encoding":
            assert rows.columns == list(corpus_pipeline.COLUMNS)
    ids = {name: sorted(r.doc_id for r in rows) for name, rows in kept.items()}
    assert {1, 2, 3} <= set(ids["quality"]) and len(ids["encoding"]) == docs.count() == len(ids["personal_data"])
    assert ids["near_copies"] == [1, 4, 7, 8]  # no words: 1; copies and a near copy: 4
    hidden = {r.doc_id: r for r in kept["personal_data"]}
    assert hidden[7].text == "mail [EMAIL] or [IP]" and hidden[7].n_chars == len(hidden[7].text) and hidden[1].text is None and hidden[2].text == ""
    assert {r.doc_id: list(r.ids) for r in kept["encoding"]}[1] == []
    assert all(r.text is not None or r.doc_id == 1 for r in kept["mixing"])
