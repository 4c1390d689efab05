"""From a tenant's document to its chunks."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.personal import accepted, rebuilt, resolved, types_of
from lodestar.functions.text import action, content_hash, injected, injection_score
from lodestar.operators.state import ordered_fold


def bounds(text: Column, most: int = 100_000) -> Column:
    """accepted, or why a text is not."""
    return (
        F.when(text.isNull(), "missing_text")
        .when(~text.rlike(r"\S"), "blank")
        .when(F.length(text) > most, "too_long")
        .otherwise("accepted")
    )


def first_of_content(docs: DataFrame) -> DataFrame:
    """tenant_id, content_hash, doc_id (the smallest), copies."""
    hashed = docs.select("tenant_id", content_hash(F.col("text")).alias("content_hash"), "doc_id")
    return hashed.groupBy("tenant_id", "content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def not_stored(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the batch whose content is new to their tenant, one for each
    content: what another tenant holds neither hides it nor shows. Both:
    tenant_id, content_hash; batch: doc_id."""
    content = ["tenant_id", "content_hash"]
    new = batch.join(stored.select(*content), content, "left_anti")
    first = F.row_number().over(Window.partitionBy(*content).orderBy("doc_id"))
    return new.withColumn("__n", first).filter("__n = 1").drop("__n")


#: Headings of Markdown: level marks and title.
HEADING = r"(?md)^(#{1,6})\s+(.*)$"


def tokens(text: Column) -> Column:
    """The text cut before each word (runs of ASCII letters, digits, underscores; a
    text without words is one token): joined, they are the text again."""
    return F.regexp_extract_all(text, F.lit(r"(?:^\W+)?\w+\W*|^\W+$"), F.lit(0))


def n_tokens(text: Column) -> Column:
    """How many tokens the text has."""

    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        words = pc.count_substring_regex(texts.cast(pa.string()), r"\w+").cast(pa.int32())
        least = pc.min_element_wise(pc.binary_length(texts), 1, skip_nulls=False).cast(pa.int32())
        return pc.max_element_wise(words, least, skip_nulls=False)

    return run(text)


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, level, title, body: the text before the first heading (level
    0; left out if blank) and what follows each heading."""
    may, none = F.contains("text", F.lit("#")), F.array().cast("array<string>")
    marks, titles = (F.when(may, F.regexp_extract_all("text", F.lit(HEADING), F.lit(i))).otherwise(none) for i in (1, 2))
    split = F.struct(marks.alias("marks"), titles.alias("titles"), F.when(may, F.split("text", HEADING, -1)).otherwise(F.array("text")).alias("bodies"))
    each = docs.select("doc_id", split.alias("s")).select("doc_id", "s.marks", "s.titles", F.posexplode("s.bodies").alias("section", "body"))
    level = F.coalesce(F.length(F.get("marks", F.col("section") - 1)), F.lit(0))
    made = each.select("doc_id", "section", level.alias("level"), F.trim(F.get("titles", F.col("section") - 1)).alias("title"), "body")
    return made.filter((F.col("level") > 0) | F.col("body").rlike(r"\S"))


def heading_paths(headed: DataFrame) -> DataFrame:
    """headed (doc_id, section, level, title) with heading_path: of each level, the last
    heading above, unless one of the same or a higher rank came after it."""
    w = Window.partitionBy("doc_id").orderBy("section")
    last = {f"__{i}": F.max(F.when(F.col("level") == i, F.struct("section", "title"))).over(w) for i in range(1, 7)}
    placed = headed.withColumns(last)
    above = [F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(F.col(f"__{j}.section"), F.lit(-1)) for j in range(1, i))) for i in range(1, 7)]
    parts = [F.when((F.col("level") > 0) & (F.col(f"__{i}.section") > above[i - 1]), F.col(f"__{i}.title")) for i in range(1, 7)]
    return placed.withColumn("heading_path", F.array_compact(F.array(*parts))).drop(*last)


def paragraphs(body: Column) -> Column:
    """What blank lines part, without the white space around it."""
    bare = F.transform(F.split(body, r"\n\s*\n"), lambda p: F.btrim(p, F.lit(" \t\n\x0b\f\r")))
    return F.filter(bare, lambda p: p != "")


def pieces(paragraph: Column, most: int) -> Column:
    """A paragraph in windows of `most` tokens: array of (n, text)."""
    windows = lambda ts: F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(ts) - 1, F.lit(0)) / most).cast("int")),
        lambda i: F.struct(F.least(F.lit(most), F.size(ts) - i * most).alias("n"), F.array_join(F.slice(ts, i * most + 1, F.lit(most)), "").alias("text")),
    )
    return F.flatten(F.transform(F.array(tokens(paragraph)), windows))


def zipped(left: Column, right: Column) -> Column:
    """Array of (left, right) by place; arrays of different lengths are an error."""
    same = F.when(F.size(left) == F.size(right), left).otherwise(F.raise_error(F.lit("as many vectors as chunks are needed")))
    return F.zip_with(same, right, lambda x, y: F.struct(x.alias("left"), y.alias("right")))


def chunked(docs: DataFrame, most: int = 400) -> DataFrame:
    """doc_id, chunk_index, heading_path, token_count, text: paragraphs of a section
    packed while they hold at most `most` tokens (words) together; one that alone
    holds more is cut into windows, each a chunk. docs: doc_id, text.

    Paragraphs become rows, and a stream over a document's rows numbers the chunks."""
    each = heading_paths(sections(docs)).select("doc_id", "section", "heading_path", F.posexplode(paragraphs(F.col("body"))).alias("place", "paragraph"))
    sized = each.withColumn("n", n_tokens(F.col("paragraph")))
    whole = F.array(F.struct("n", F.col("paragraph").alias("text")))  # only a paragraph of more tokens is cut into them
    windows = F.when(F.col("n") > most, pieces(F.col("paragraph"), most)).otherwise(whole)
    cut = sized.select("doc_id", "section", "heading_path", "place", F.posexplode(windows).alias("piece", "p"), (F.col("n") > most).alias("alone"))
    rows = cut.select("doc_id", "section", "place", "piece", "heading_path", "alone", F.col("p.n").alias("n"), F.col("p.text").alias("text"))

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        last, section, held = state  # number of the last chunk, and where it may grow: its section and tokens
        grows = not row["alone"] and held is not None and section == row["section"] and held + row["n"] <= most
        last += not grows
        return (last, row["section"], None if row["alone"] else (held if grows else 0) + row["n"]), (last,)

    numbered = ordered_fold(rows, ["doc_id"], ["section", "place", "piece"], lambda: (-1, None, None), step, "chunk_index int", {"chunk_index": pa.int32()}, ["section", "alone", "n"])
    parts = F.array_sort(F.collect_list(F.struct("section", "place", "piece", "text")))
    made = numbered.groupBy("doc_id", "chunk_index").agg(F.first("heading_path").alias("heading_path"), F.sum("n").alias("token_count"), parts.alias("parts"))
    return made.select("doc_id", "chunk_index", "heading_path", "token_count", F.array_join(F.transform("parts", lambda p: p.text), "\n\n").alias("text"))


def ingested(batch: DataFrame, stored: DataFrame, most_chars: int = 100_000, most_tokens: int = 400, most_chunks: int = 200) -> DataFrame:
    """What a batch adds: tenant_id, doc_id, content_hash, pii_types and the chunks
    (as of chunked) of texts that are within bounds, new to their tenant, and not of
    too many chunks. The hash is of the text as sent; chunks are of the redacted text.
    Texts that the firewall does not allow are refused: what is stored is read again.
    batch: tenant_id, doc_id, text; stored: tenant_id, content_hash."""
    allowed = action(injected(F.col("text")), injection_score(F.col("text"))) == "allow"
    fit = batch.filter((bounds(F.col("text"), most_chars) == "accepted") & allowed).withColumn("content_hash", content_hash(F.col("text")))
    new = not_stored(fit.select("tenant_id", "doc_id", "content_hash", "text"), stored)
    found = new.select("tenant_id", "doc_id", "content_hash", "text", accepted(F.col("text")).alias("spans"))
    made = found.select("tenant_id", "doc_id", "content_hash", types_of(F.col("spans")).alias("pii_types"), rebuilt(F.col("text"), resolved(F.col("spans"))).alias("text"))
    chunks = chunked(made.select("doc_id", "text"), most_tokens)
    few = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks")).filter(F.col("n_chunks") <= most_chunks)
    return made.drop("text").join(few, "doc_id").join(chunks, "doc_id")


def packed(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, n_paragraphs, n_chunks, last_tokens: lines packed in order while
    their tokens (words) fit; a line over the budget is cut into windows of `most`,
    each a chunk. The fold holds three numbers a document."""
    lines = F.filter(F.split("text", "\n"), lambda p: F.length(F.trim(p)) > 0)
    sized = F.transform(lines, lambda p: F.size(F.regexp_extract_all(p, F.lit(r"\w+"), F.lit(0))))
    start = F.struct(F.lit(0).alias("chunks"), F.lit(0).alias("held"), F.lit(False).alias("grows"))

    def pack(state: Column, n: Column) -> Column:
        over, fits = n > most, state.grows & (state.held + n <= most)
        windows = F.ceil(n / most).cast("int")
        return F.struct(
            (state.chunks + F.when(over, windows).when(fits, 0).otherwise(1)).alias("chunks"),
            F.when(over, n - (windows - 1) * most).when(fits, state.held + n).otherwise(n).alias("held"),
            (~over).alias("grows"),
        )

    made = docs.select("doc_id", sized.alias("sizes")).filter(F.size("sizes") > 0)
    return made.select("doc_id", F.size("sizes").alias("n_paragraphs"), F.aggregate("sizes", start, pack).alias("s")).select("doc_id", "n_paragraphs", F.col("s.chunks").alias("n_chunks"), F.col("s.held").alias("last_tokens"))
