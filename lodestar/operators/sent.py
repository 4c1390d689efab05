"""Server-sent events out of fragments that a network cut anywhere.

Fragments of a short range are joined, and the piece is told apart into lines by itself;
only numbers and its last character pass to its neighbours. Lines that several pieces share come together by their
number, and events by the number of blank lines before them, counted in ranges of
lines, so that a long stream is no single task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.store import written

#: Characters of an event's data, or of a line, that are too many; a stream ends there.
MOST = 1_000_000
#: Neighbouring fragments that are joined before lines are looked for.
JOINED = 256
#: Lines whose blank ones are counted together.
RANGE = 4096


def parsed(fragments: DataFrame, most: int = MOST) -> DataFrame:
    """stream, n (from 1), event, data, error: the finished events of each stream in order; an
    event or line that is too large gives one row with an error and ends its stream.
    fragments: stream, seq, text (null: empty).

    CR, LF or both end a line, also where a cut parts them; lines that open with a colon are
    comments; an event without data is none, but ends the name given before it; what no
    blank line ends is not finished, nor is a line that ends in the stream's last CR."""
    told = F.array_sort(F.collect_list(F.struct("seq", "text")))
    near = fragments.filter(F.length("text") > 0).groupBy("stream", F.floor(F.col("seq") / JOINED).alias("seq")).agg(told.alias("told"))
    pieces = written(near.select("stream", "seq", F.array_join(F.transform("told", lambda x: x.text), "").alias("text")), "pieces")
    small = pieces.select("stream", "seq", F.expr("right(text, 1)").alias("last"))
    ordered = Window.partitionBy("stream").orderBy("seq")
    around = small.select("stream", "seq", F.lag("last").over(ordered).alias("before"), F.lead("last").over(ordered).isNull().alias("final"))
    joined = pieces.join(around, ["stream", "seq"])
    whole = F.when((F.col("before") == "\r") & F.col("text").startswith("\n"), F.expr("substring(text, 2)")).otherwise(F.col("text"))
    shown = F.when(F.col("final"), F.regexp_replace("bare", "\r\\z", "")).otherwise(F.col("bare"))
    parts = F.split(F.regexp_replace(shown, "\r\n?", "\n"), "\n", -1)
    cut = joined.withColumn("bare", whole).select("stream", "seq", parts.alias("parts"))
    counted = cut.select("stream", "seq", (F.size("parts") - 1).cast("long").alias("ends"))
    offsets = counted.select("stream", "seq", (F.sum("ends").over(ordered) - F.col("ends")).alias("offset"))
    total = counted.groupBy("stream").agg(F.sum("ends").alias("total"))
    each = cut.join(offsets, ["stream", "seq"]).select("stream", "seq", "offset", F.posexplode("parts").alias("i", "part")).withColumn("line_no", F.col("offset") + F.col("i"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x.part), "")
    lines = each.groupBy("stream", "line_no").agg(text.alias("line")).join(total, "stream").filter("line_no < total").drop("total")
    # events by blank lines before: those of earlier ranges, and those of the same range
    lines = written(lines.withColumn("range", F.floor(F.col("line_no") / RANGE)).withColumn("blank", (F.col("line") == "").cast("long")), "lines")
    blanks = lines.groupBy("stream", "range").agg(F.sum("blank").alias("blanks"))
    earlier = blanks.select("stream", "range", (F.sum("blanks").over(Window.partitionBy("stream").orderBy("range")) - F.col("blanks")).alias("earlier"))
    finished = blanks.groupBy("stream").agg(F.sum("blanks").alias("finished"))
    within = F.sum("blank").over(Window.partitionBy("stream", "range").orderBy("line_no")) - F.col("blank")
    numbered = lines.withColumn("within", within).join(earlier, ["stream", "range"]).withColumn("block", F.col("within") + F.col("earlier")).filter("blank = 0")
    field = F.regexp_extract("line", r"^([^:]*)", 1)
    value = F.regexp_replace("line", r"^[^:]*:? ?", "")
    told = numbered.select("stream", "block", "line_no", F.when(F.length("line") > most, F.lit("frame too large")).alias("huge"), field.alias("field"), value.alias("value"))
    data = F.array_sort(F.collect_list(F.when(F.col("field") == "data", F.struct("line_no", "value"))))
    made = told.groupBy("stream", "block").agg(
        F.max_by("value", F.when(F.col("field") == "event", F.col("line_no"))).alias("name"), data.alias("data"),
        F.sum(F.when(F.col("field") == "data", F.length("value")).otherwise(0)).alias("size"), F.max("huge").alias("huge"),
    )
    error = F.coalesce(F.col("huge"), F.when(F.col("size") > most, F.lit("event too large")))
    judged = made.join(finished, "stream").withColumn("error", error)
    end = F.min(F.when(F.col("error").isNotNull(), F.col("block"))).over(Window.partitionBy("stream"))
    kept = judged.withColumn("end", end).filter("(block < finished OR error IS NOT NULL) AND (end IS NULL OR block <= end) AND (size(data) > 0 OR error IS NOT NULL)")
    name = F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, "message").otherwise(F.col("name"))
    place = F.row_number().over(Window.partitionBy("stream").orderBy("block"))
    good = F.col("error").isNull()
    return kept.select("stream", place.alias("n"), F.when(good, name).alias("event"), F.when(good, F.array_join(F.transform("data", lambda x: x.value), "\n")).alias("data"), "error")
