"""Personal data: four patterns, and terms that the corpus ties to what they protect.

Spans of emails, addresses, cards and phones are found in place. Protected
entities are the values found and their classes (an email's domain, the first
digits of the others). For each term met with an entity in one unit (a line, or a
sentence of it), the share of the entity's information that the term gives away
is PMI(term, entity) / IC(entity), with probabilities over all units of the
corpus. A term counts as met SMOOTH times more, without the entity, than it was,
so that one meeting says little in a small corpus; values met once count too.
Terms above the threshold are spans too, in the documents that hold the entity:
elsewhere there is nothing that they give away. Spans are generalised (their kind
in brackets) or removed. DataFrame functions only.

Defined cases: a null text is empty and has no spans; spans of different kinds
may overlap, and what is sanitised is their union, named after the first; a term
span that meets a base span is left to it; the units of repeated rows count each;
a null id is an id; an empty table gives an empty table; columns named like the
added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import is_small, persist, text_or_empty

# What counts as each kind. A match starts where a run of the
# pattern's first characters starts, or where the match before ended, so that
# long runs are read once; the quantifiers that cannot give back are possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": None, "card": None, "phone": "+"}

#: Meetings without the entity added to those of each term.
SMOOTH = 1
#: Ends of a unit.
UNIT = r"\n|(?<=[.!?])[ \t]+"
#: Share of an entity's information that a term may give away.
THRESHOLD = 0.9
#: Shortest term.
TERM_CHARS = 3
#: Candidate terms up to this number are broadcast.
BROADCAST_TERMS = 200_000
#: Values of an array summed together in a prefix scan.
SCAN = 64


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    each = F.split(F.reverse(digits(x)), "")

    def value(d: Column, i: Column) -> Column:
        n = F.coalesce(d.try_cast("int"), F.lit(0))
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(each, value), F.lit(0), lambda s, n: s + n) % 10 == 0


def _small_parts(x: Column) -> Column:
    def small(part: Column) -> Column:
        rest = F.regexp_replace(part, "^0+", "")
        return (F.length(rest) <= 3) & (F.coalesce(rest.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(x, r"\."), small)


ACCEPTS: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": _small_parts,
    "card": lambda x: F.length(digits(x)).between(14, 19) & _luhn(x),
    "phone": lambda x: F.length(digits(x)).between(10, 15),
}


def prefix(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each place, the values before it merged; in two levels, so that the
    work on n values is near n * SCAN."""
    fold = lambda xs: F.aggregate(xs, zero, merge)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / SCAN).cast("int")),
        lambda b: fold(F.slice(values, b * SCAN + 1, F.lit(SCAN))),
    )

    def at(firsts: Column) -> Column:
        return F.transform(
            values,
            lambda x, i: merge(
                F.element_at(firsts, F.floor(i / SCAN).cast("int") + 1),
                fold(F.slice(values, (F.floor(i / SCAN) * SCAN).cast("int") + 1, (i % SCAN).cast("int"))),
            ),
        )

    return _let(_let(blocks, lambda bs: F.transform(bs, lambda x, i: fold(F.slice(bs, F.lit(1), i)))), at)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def located(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, match) of the pattern, in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"))

    def place(p: Column) -> Column:
        lengths = F.transform(p.found, lambda m, i: F.length(F.element_at(p.gaps, i + 1)) + F.length(m))
        before = prefix(lengths, F.lit(0), lambda a, b: a + b)

        def span(m: Column, i: Column, starts: Column) -> Column:
            start = F.element_at(starts, i + 1) + F.length(F.element_at(p.gaps, i + 1))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"))

        return _let(before, lambda starts: F.transform(p.found, lambda m, i: span(m, i, starts)))

    return _let(parts, lambda p: F.when(F.size(p.found) > 0, place(p)).otherwise(F.array().cast(SPANS)))


SPANS = "array<struct<start:int,end:int,match:string>>"
KINDED = "array<struct<start:int,kind_no:int,end:int,kind:string,match:string>>"


def base_spans(text: Column) -> Column:
    """All accepted base spans: array of (start, kind_no, end, kind, match), by
    start, then kind."""
    return F.array_sort(F.concat(*(_kind_spans(text, no, kind) for no, kind in enumerate(KINDS))))


def _kind_spans(text: Column, no: int, kind: str) -> Column:
    hint = HINTS[kind]
    may = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9]")
    kept = F.filter(located(text, PATTERNS[kind]), lambda s: ACCEPTS[kind](s.match))
    named = F.transform(
        kept,
        lambda s: F.struct(
            s.start.alias("start"), F.lit(no).alias("kind_no"), s.end.alias("end"), F.lit(kind).alias("kind"), s.match.alias("match")
        ),
    )
    return F.when(may, named).otherwise(F.array().cast(KINDED)).cast(KINDED)


def entities(spans: Column) -> Column:
    """Distinct names of what the spans hold: the values, however written, and their classes."""

    def named(s: Column) -> Column:
        value = F.when(s.kind.isin("card", "phone"), digits(s.match)).otherwise(F.lower(s.match))
        wider = (
            F.when(s.kind == "email", F.substring_index(value, "@", -1))
            .when(s.kind == "ip", F.substring_index(value, ".", 2))
            .otherwise(F.substring(value, 1, 6))
        )
        return F.array(F.concat_ws(":", s.kind, value), F.concat_ws(":", F.lit("class"), s.kind, wider))

    return F.array_distinct(F.flatten(F.transform(spans, named)))


def units(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select(F.explode(F.split(text, UNIT)).alias("unit")).filter(F.trim("unit") != "")


def words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) >= TERM_CHARS)


def disclosing_terms(docs: DataFrame, spanned: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """entity, term, share: terms that give away at least threshold of an
    entity's information. spanned: docs that have spans, with doc_id, text, spans."""
    held = units(spanned, F.col("text")).filter(F.col("unit").rlike("[0-9]|@")).select("unit", base_spans(F.col("unit")).alias("spans")).filter(F.size("spans") > 0)
    # the values themselves are no terms
    bare = F.aggregate("spans", F.col("unit"), lambda rest, s: F.replace(rest, s.match, F.lit(" ")))
    held = persist(held.select(entities(F.col("spans")).alias("entities"), words(bare).alias("terms")), "held")
    with_entity = held.select("terms", F.explode("entities").alias("entity"))
    of_entity = with_entity.groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = persist(with_entity.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te")), "pairs")
    terms = persist(pairs.select("term").distinct(), "terms")
    every = units(docs, text_or_empty())
    total = every.agg(F.count("*").alias("n_units"))
    met = every.select(F.explode(words(F.col("unit"))).alias("term"))
    if is_small(terms, BROADCAST_TERMS):
        met = met.join(F.broadcast(terms), "term")
    counts = met.groupBy("term").agg(F.count("*").alias("n_t"))
    scored = pairs.join(of_entity, "entity").join(counts, "term").join(F.broadcast(total))
    information = -F.log2(F.col("n_e") / F.col("n_units"))
    pmi = F.log2(F.col("n_te") * F.col("n_units") / ((F.col("n_t") + SMOOTH) * F.col("n_e")))
    share = F.when(information > 0, pmi / information).otherwise(F.lit(0.0))
    return scored.select("entity", "term", share.alias("share")).filter(F.col("share") >= threshold)


def _term_spans(text: Column, terms: Column) -> Column:
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.transform(
        located(text, pattern),
        lambda s: F.struct(s.start.alias("start"), F.lit(len(KINDS)).alias("kind_no"), s.end.alias("end"), F.lit("term").alias("kind"), s.match.alias("match")),
    )


def sanitised(text: Column, spans: Column, generalise: bool = True) -> Column:
    """The text with the union of the spans (in order) replaced."""

    def rebuild(reach: Column) -> Column:
        # a span opens an island where it starts at or after all earlier ends
        opens = F.filter(F.transform(spans, lambda s, i: F.struct(s.start.alias("start"), F.element_at(reach, i + 1).alias("reach"), s.kind.alias("kind"))), lambda o: o.start >= o.reach)
        end = F.array_max(F.transform(spans, lambda s: s.end))

        def pieces(o: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                said = F.concat(F.lit("["), F.upper(x.kind), F.lit("]")) if generalise else F.lit("")
                return F.concat(text.substr(x.reach + 1, x.start - x.reach), said)

            return F.concat(F.array_join(F.transform(o, piece), ""), text.substr(end + 1, F.length(text) - end))

        return _let(opens, pieces)

    reach = prefix(F.transform(spans, lambda s: s.end), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, _let(reach, rebuild)).otherwise(text)


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with base (base spans) and spans (these and disclosing terms)."""
    names = [c for c in docs.columns if c not in ("base", "spans")]
    text = text_or_empty()
    based = docs.select(*names, base_spans(text).alias("base"))
    # the few documents with spans, without the rest of the corpus
    hits = persist(
        docs.select("doc_id", text.alias("text")).filter(text.rlike("[0-9]|@")).select("doc_id", "text", base_spans(F.col("text")).alias("spans")).filter(F.size("spans") > 0),
        "hits",
    )
    terms = persist(disclosing_terms(docs, hits, threshold), "disclosing")
    if is_small(terms, 0):
        return based.withColumn("spans", F.col("base"))
    has = hits.select("doc_id", F.explode(entities(F.col("spans"))).alias("entity")).distinct()
    of = has.join(terms, "entity").groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_set("term")).alias("__terms"))
    of = persist(of, "terms-of")
    of = F.broadcast(of) if is_small(of, BROADCAST_TERMS // 10) else of
    both = based.join(of, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    apart = F.filter(_term_spans(text, F.col("__terms")), lambda t: ~F.exists("base", lambda b: (b.start < t.end) & (t.start < b.end)))
    every = F.when(F.col("__terms").isNotNull() & (F.size("base") > 0), F.array_sort(F.concat("base", apart.cast(KINDED)))).otherwise(F.col("base"))
    return both.select(*names, "base", every.alias("spans"))


def sanitise(docs: DataFrame, generalise: bool = True) -> DataFrame:
    """The documents with their spans generalised or removed; n_chars follows."""
    found = find(docs)
    made = found.withColumn("text", F.when(F.col("text").isNotNull(), sanitised(F.col("text"), F.col("spans"), generalise)))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return made.select(*docs.columns)
