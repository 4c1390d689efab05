"""English stems by the published Porter2 rules (Snowball, English)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"
# Words with stems of their own, and words that the first step leaves as they are.
WHOLE = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes", "dying": "die", "lying": "lie", "tying": "tie",
}
AFTER_S = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Endings and what stands for them, the longest that fits counts.
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    found = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)
    return found.end() if found else len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(re.search(f"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", word) or re.fullmatch(f"[{VOWELS}][^{VOWELS}]", word))


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and words with other than
    ASCII letters and apostrophes stay as they are."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = word.removeprefix("'")
    word = re.sub(f"^y|(?<=[{VOWELS}])y", "Y", word)
    found = re.match("gener|commun|arsen", word)
    r1 = found.end() if found else _region(word, 0)
    r2 = _region(word, r1)
    word = re.sub("('s'|'s|')$", "", word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{VOWELS}].", word[:-1]):
        word = word[:-1]
    if word in AFTER_S:
        return word
    # past and progressive forms
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and re.search(f"[{VOWELS}]", word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif _short_end(word) and r1 >= len(word):
            word += "e"
    if re.search(f"[^{VOWELS}][yY]$", word) and len(word) > 2:
        word = word[:-1] + "i"
    # derived forms
    ending = _longest(word, SECOND)
    if ending and len(word) - len(ending) >= r1:
        base = word[: -len(ending)]
        if ending == "ogi":
            word = word[:-1] if base.endswith("l") else word
        elif ending == "li":
            word = base if base and base[-1] in "cdeghkmnrt" else word
        else:
            word = base + SECOND[ending]
    ending = _longest(word, THIRD)
    if ending and len(word) - len(ending) >= r1 and (ending != "ative" or len(word) - len(ending) >= r2):
        word = word[: -len(ending)] + THIRD[ending]
    ending = _longest(word, FOURTH)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[: -len(ending)].endswith(("s", "t"))):
        word = word[: -len(ending)]
    # last letters
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stemmed(word: Column) -> Column:
    @F.arrow_udf("string")
    def run(words: pa.Array) -> pa.Array:
        return pa.array([None if w is None else stem(w) for w in words.to_pylist()], pa.string())

    return run(word)
