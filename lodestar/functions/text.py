"""Text functions as column expressions."""

from __future__ import annotations

import functools

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark an injected instruction.
INJECTIONS = (
    r"ignore (all )?(previous|prior|above) instructions",
    r"disregard (all )?(previous|prior|above)",
    r"you are now (in )?(developer|admin|god|dan) mode",
    r"system\s*:\s*",
    r"new instructions?\s*:",
    r"reveal (your |the )?(system prompt|instructions)",
    r"forget (everything|all) (you|above)",
    r"\[?end of (context|document|data)\]?.{0,20}(system|assistant|instruction)",
)
INJECTION = "(?i)(" + "|".join(INJECTIONS) + ")"
# Fixed value: a date-like span that is only a duration.
DURATION = (
    r"(?i)^\s*(?:up\s+to|at\s+least|no\s+more\s+than|within|about|approximately|"
    r"roughly|over|under|nearly|almost)?\s*\d+[\s-]*"
    r"(day|days|week|weeks|month|months|year|years|hour|hours|minute|minutes)\s*$"
)
# Fixed value: a number is a phone number after a word that says so.
PHONE_CUE = (
    r"(?i)\b(?:phone|tel|telephone|mobile|cell|fax|call|dial)\b"
    r"(?:\s+(?:number|no\.?))?\s*[:#-]?\s*"
    r"\+?\d[\d\s().-]{5,18}\d"
)
# English words that search passes over.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
URL = r"https?://[^\s)\]]+"
CITATION = r"\[([0-9]+)\]"
#: One number, or several with commas between them, in brackets.
CITATIONS = r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"

def lexemes(text: Column) -> Column:
    """Lower-cased runs of letters and digits, one element per occurrence."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def split_lexemes(lowered: pa.Array) -> pa.ListArray:
    """In a task: the lexemes of lower-case texts, with empty ones where a text begins or ends in other letters."""
    return pc.split_pattern_regex(lowered.cast(pa.string()), r"[^\p{L}\p{N}]+")


def asked(question: Column) -> Column:
    """The distinct lexemes that a question searches for: none, if it holds stop words only."""
    return F.array_except(lexemes(question), F.array(*map(F.lit, STOP_WORDS)))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


#: Lower-case texts of which each marked instruction holds one, looked for first.
HINTS = ("ignore ", "disregard ", "you are now ", "system", "new instruction", "reveal ", "forget ", "end of ")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text, in lower case, holds any of the words."""
    any_of = lambda low: functools.reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    return F.element_at(F.transform(F.array(F.lower(text)), any_of), 1)  # in lower case once


def injected(text: Column) -> Column:
    return F.coalesce(holds(text, HINTS) & text.rlike(INJECTION), F.lit(False))


#: Words of which several together make a text suspect.
SUSPECT = ("ignore", "instructions", "system", "prompt", "reveal", "override", "pretend", "password", "secret", "jailbreak")


def injection_score(text: Column) -> Column:
    """From 0 to 1: a fifth for each suspect word that the text holds; 1 where a phrase
    marks an injected instruction."""
    held = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b(?:" + "|".join(SUSPECT) + r")\b"), F.lit(0)))
    counted = F.round(F.least(F.lit(1.0), F.coalesce(F.size(held), F.lit(0)) * 0.2), 6)
    return F.when(injected(text), 1.0).when(holds(text, SUSPECT), counted).otherwise(0.0)


#: Score from which the firewall flags a text; below, and so without a marked instruction, it allows it.
FLAGGED = 0.60


def action(hit: Column, score: Column) -> Column:
    """block, flag or allow: what the firewall does."""
    return F.when(hit | (score >= 0.95), "block").when(score >= FLAGGED, "flag").otherwise("allow")


def citations(answer: Column) -> Column:
    """Distinct cited numbers, in order of size. [1, 2] counts as [1][2]; a list
    in brackets that holds anything else cites nothing, nor does a number too large
    for any list of parents."""
    groups = F.regexp_extract_all(answer, F.lit(CITATIONS), F.lit(1))
    each = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*")))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(each, lambda x: x.try_cast("int")))))


def normalised(answer: Column) -> Column:
    """The answer with one number to a bracket."""
    gaps, groups = F.split(answer, CITATIONS, -1), F.regexp_extract_all(answer, F.lit(CITATIONS), F.lit(1))
    apart = F.transform(groups, lambda g, i: F.concat(F.get(gaps, i), F.lit("["), F.regexp_replace(g, r"\s*,\s*", "]["), F.lit("]")))
    return F.concat(F.array_join(apart, ""), F.element_at(gaps, -1))


def grounding(cited: Column, total: Column) -> Column:
    """Reasons to look at an answer that cites too little."""
    return F.when(cited == 0, F.array(F.lit("no_citations"))).when(cited / total < 0.5, F.array(F.lit("low_grounding"))).otherwise(F.array().cast("array<string>"))


def canaries(text: Column, registry: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(UUID), F.lit(0)), lambda x: F.lower(x))
    return F.array_sort(F.array_intersect(found, registry))


def title(question: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(question, r"\s+", " ")), 1, 60)


def clean_name(path: Column) -> Column:
    """Last segment, without control and direction marks, at most 200 code
    points, keeping the extension."""
    last = F.regexp_extract(path, r"([^/\\]*)$", 1)
    bare = F.trim(F.regexp_replace(F.regexp_replace(last, r"[\x{0000}-\x{001f}\x{007f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}]", ""), r"\s+", " "))
    extension = F.regexp_extract(bare, r"(\.[A-Za-z0-9]{1,10})$", 1)
    return F.when(F.length(bare) > 200, F.concat(bare.substr(F.lit(1), 200 - F.length(extension)), extension)).otherwise(bare)


def windows(n: Column, size: int = 510, overlap: int = 64, most: int = 64) -> Column:
    """(first, last) of overlapping windows over n tokens, the last ending at
    the last token (end exclusive)."""
    step = size - overlap
    count = F.least(F.lit(most), F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1))
    return F.when(n > 0, F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct((i * step).cast("int").alias("first"), F.least(n, i * step + size).cast("int").alias("last")),
    )).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def ascii_json(text: Column) -> Column:
    """JSON text with \\uXXXX (surrogate pairs beyond the basic plane) for what is not ASCII."""

    def told(c: Column) -> Column:
        n = F.ascii(c)
        four = lambda x: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(x)), 4, "0"))
        high = F.floor((n - 0x10000) / 0x400) + 0xD800
        return F.when(n < 128, c).when(n < 0x10000, four(n)).otherwise(F.concat(four(high), four((n - 0x10000) % 0x400 + 0xDC00)))

    return F.when(text.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(text, ""), told), "")).otherwise(text)


def canonical(entry: dict[str, Column]) -> Column:
    """JSON of an object with its keys in order, no spaces, ASCII only; nulls stay."""
    ordered = F.struct(*(entry[k].alias(k) for k in sorted(entry)))
    return ascii_json(F.to_json(ordered, {"ignoreNullFields": "false"}))


def iso(time: Column) -> Column:
    """A time in UTC as ISO 8601; microseconds only where there are any."""
    micros = F.pmod(F.unix_micros(time.cast("timestamp")), F.lit(1_000_000))
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def bearer(header: Column) -> Column:
    """The token of an authorization header; null without one."""
    return F.when(header.startswith("Bearer "), F.nullif(F.trim(F.substring(header, 8, 2**31 - 1)), F.lit("")))


def is_acronym(span: Column) -> Column:
    """A lone word in capitals, which a recogniser of persons mistakes for a name."""
    return span.rlike(r"^\p{Lu}+$")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex digest; the key is at most 64 bytes."""
    pad = lambda x: F.lit(bytes(b ^ x for b in key.ljust(64, b"\0")))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))), 256)


def signed(signature: Column, key: bytes, message: Column) -> Column:
    """Whether base64 text is the message's signature; malformed text or none is not."""
    return F.coalesce(F.lower(F.hex(F.try_to_binary(signature, F.lit("base64")))) == hmac_sha256(key, message), F.lit(False))


def server_events(sent: Column) -> Column:
    """Array of (event, data) of server-sent text: CR, LF or both end a line, a
    blank line ends an event, lines that open with a colon are comments, data lines
    are joined, and an event without data is none."""
    blocks = F.split(F.regexp_replace(sent, r"\r\n?", "\n"), r"\n\n+")

    def values(block: Column, field: str) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(f"^{field}(:|$)"))
        return F.transform(lines, lambda x: F.regexp_replace(x, f"^{field}:? ?", ""))

    made = F.transform(blocks, lambda b: F.struct(F.coalesce(F.try_element_at(values(b, "event"), F.lit(-1)), F.lit("message")).alias("event"), values(b, "data").alias("lines")))
    return F.transform(F.filter(made, lambda e: F.size(e.lines) > 0), lambda e: F.struct(e.event.alias("event"), F.array_join(e.lines, "\n").alias("data")))
