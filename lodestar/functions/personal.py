"""Personal data as spans: every pattern proposes, checks accept, and what is kept is
replaced in one pass.

A span is (start, end, score, type) in code points, end exclusive. Of the accepted
spans, one that lies within another is dropped (of two with the same ends the
lower score, then the later name); of two that overlap in part the earlier ends
where the later starts, so that nothing accepted stays readable. Durations are
proposed as dates and refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import DURATION, MONTHS, PHONE_CUE

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
HEDGE = r"(?:(?:up\s+to|at\s+least|no\s+more\s+than|within|about|approximately|roughly|over|under|nearly|almost)\s+)?"
UNIT = r"(?:days?|weeks?|months?|years?|hours?|minutes?)"


def digits(value: Column) -> Column:
    """The digits of a text as numbers."""
    return F.transform(F.filter(F.split(value, ""), lambda c: c.rlike("[0-9]")), lambda c: c.cast("int"))


def luhn(value: Column) -> Column:
    """Whether the digits end in the right check digit (every second one from the
    right doubled)."""
    reverse = F.reverse(digits(value))
    parts = F.transform(reverse, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x) % 10 == 0


def iban(value: Column) -> Column:
    """Whether country and check digits, put last, leave 1 modulo 97 (letters count from 10)."""
    moved = F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))
    worth = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + worth(c)) % 97)
    return rest == 1


def dea(value: Column) -> Column:
    """Whether a prescriber's number ends in its check digit."""
    d = digits(F.substring(value, 3, 7))
    at = lambda i: F.get(d, F.lit(i))
    return (at(0) + at(2) + at(4) + 2 * (at(1) + at(3) + at(5))) % 10 == at(6)


@dataclass(frozen=True)
class Entity:
    """group: of the pattern, the value that is personal; it must end the match.
    hints: lower-case texts of which each match holds one, looked for first."""

    name: str
    pattern: str
    score: float
    group: int = 0
    check: Callable[[Column], Column] | None = None
    hints: tuple[str, ...] = ()


ENTITIES = (
    Entity("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 1.0, hints=("@",)),
    Entity("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 1.0, check=iban),
    Entity("CREDIT_CARD", r"\b[0-9](?:[ -]?[0-9]){12,18}\b", 1.0, check=luhn),
    Entity("MEDICAL_LICENSE", r"\b[ABFGMPRX][A-Z9][0-9]{7}\b", 1.0, check=dea),
    Entity("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.85),
    Entity("IP_ADDRESS", rf"\b(?:{OCTET}\.){{3}}{OCTET}\b", 0.6),
    Entity("URL", r"https?://[^\s)\]]+", 0.6, hints=("://",)),
    Entity("PHONE_NUMBER", r"\+[0-9][0-9 ().-]{8,18}[0-9]|(?i:" + PHONE_CUE.removeprefix("(?i)") + ")", 0.6),
    Entity("DATE_TIME", rf"\b(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|(?:{MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}|(?i:{HEDGE}[0-9]+[\s-]*{UNIT}))\b", 0.6, check=lambda x: ~x.rlike(DURATION)),
    Entity("US_BANK_NUMBER", r"(?i:\b(?:bank|account|acct)(?:\s+(?:number|no\.?))?\s*[:#]?\s*)([0-9]{8,17})\b", 0.4, 1, hints=("bank", "acc")),
    Entity("US_PASSPORT", r"(?i:\bpassport(?:\s+(?:number|no\.?))?\s*[:#]?\s*)([A-Z]?[0-9]{8,9})\b", 0.4, 1, hints=("passport",)),
    Entity("US_DRIVER_LICENSE", r"(?i:\b(?:driver'?s?\s+licen[cs]e|driving\s+licen[cs]e|permit)(?:\s+(?:number|no\.?))?\s*[:#]?\s*)([A-Z][0-9]{5,12})\b", 0.4, 1, hints=("licen", "permit")),
)
SPANS = "array<struct<start:int,end:int,score:double,type:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _proposed(text: Column, entity: Entity) -> Column:
    """Accepted spans of one type, in order."""
    pattern = F.lit(entity.pattern)
    found = F.struct(F.split(text, entity.pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"), F.regexp_extract_all(text, pattern, F.lit(entity.group)).alias("value"))

    def placed(f: Column) -> Column:
        # lengths first, so that the fold carries numbers
        steps = F.transform(f.whole, lambda m, i: F.struct((F.length(F.get(f.gaps, i)) + F.length(m)).alias("to_end"), F.get(f.value, i).alias("value")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<end:int,value:string>>").alias("out"))
        ends = F.aggregate(steps, start, lambda s, x: F.struct((s.at + x.to_end).alias("at"), F.concat(s.out, F.array(F.struct((s.at + x.to_end).alias("end"), x.value.alias("value")))).alias("out")), lambda s: s.out)
        kept = F.filter(ends, lambda x: entity.check(x.value)) if entity.check else ends
        return F.transform(kept, lambda x: F.struct((x.end - F.length(x.value)).alias("start"), x.end.alias("end"), F.lit(entity.score).alias("score"), F.lit(entity.name).alias("type")))

    may = text.rlike(entity.pattern)
    if entity.hints:
        hinted = [F.contains(F.lower(text), F.lit(h)) for h in entity.hints]
        may = reduce(lambda a, b: a | b, hinted) & may
    return F.when(may, bound(found, placed)).otherwise(F.array().cast(SPANS))


def accepted(text: Column) -> Column:
    """All spans that patterns find and checks accept, in order of start; a null text has none."""
    every = F.concat(*(_proposed(text, e) for e in ENTITIES))
    order = F.array_sort(F.transform(every, lambda x: F.struct(x.start.alias("start"), (-x.end).alias("end"), (-x.score).alias("score"), x.type.alias("type"))))
    return F.coalesce(F.transform(order, lambda x: F.struct(x.start.alias("start"), (-x.end).alias("end"), (-x.score).alias("score"), x.type.alias("type"))), F.array().cast(SPANS))


def resolved(spans: Column) -> Column:
    """What is replaced: spans in order without those within another, each ending
    where the next starts at the latest."""
    begin = F.struct(F.lit(0).alias("reach"), F.array().cast(SPANS).alias("out"))
    outer = F.aggregate(spans, begin, lambda s, x: F.when(x.end > s.reach, F.struct(x.end.alias("reach"), F.concat(s.out, F.array(x)).alias("out"))).otherwise(s), lambda s: s.out)
    cut = lambda o: F.transform(o, lambda x, i: F.struct(x.start.alias("start"), F.least(x.end, F.coalesce(F.get(o, i + 1).start, x.end)).alias("end"), x.score.alias("score"), x.type.alias("type")))
    return bound(outer, cut)


def types_of(spans: Column) -> Column:
    """Sorted types; null, not empty, where there is none."""
    return F.when(F.size(spans) > 0, F.array_sort(F.array_distinct(F.transform(spans, lambda x: x.type))))


def rebuilt(text: Column, spans: Column) -> Column:
    """The text with each of the resolved spans replaced by its type."""
    before = lambda o, i: F.coalesce(F.get(o, i - 1).end, F.lit(0))
    made = lambda o: F.concat(
        F.array_join(F.transform(o, lambda x, i: F.concat(text.substr(F.when(i > 0, before(o, i)).otherwise(0) + 1, x.start - F.when(i > 0, before(o, i)).otherwise(0)), F.lit("<"), x.type, F.lit(">"))), ""),
        text.substr(F.element_at(o, -1).end + 1, F.length(text)),
    )
    return F.when(F.size(spans) > 0, bound(spans, made)).otherwise(text)


def entity_types(text: Column) -> Column:
    return bound(accepted(text), types_of)


def redacted(text: Column) -> Column:
    return bound(accepted(text), lambda s: rebuilt(text, bound(s, resolved)))
