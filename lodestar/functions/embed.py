"""Vectors of texts without a model: signed counts of hashed lexemes, of unit length.

A lexeme's MD5 names its place (first eight hex digits, modulo the number of places)
and its sign (the ninth digit: minus from 8 on). Texts that share lexemes are near each
other; a text without lexemes has the zero vector.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import split_lexemes

PLACES = 256


def place(lexeme: str, places: int) -> tuple[int, int]:
    if not lexeme:
        return 0, 0  # between marks there is none
    digest = hashlib.md5(lexeme.encode()).hexdigest()
    return int(digest[:8], 16) % places, -1 if digest[8] >= "8" else 1


def hashed(words: pa.Array, places: int) -> np.ndarray:
    """A row for each list of lexemes. Each different lexeme of the batch is hashed once."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    flat = words.flatten().dictionary_encode()
    where = np.array([place(x, places) for x in flat.dictionary.to_pylist()], np.int64).reshape(-1, 2)
    of = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(words)), lengths)
    sums = np.bincount(rows * places + where[of, 0], weights=where[of, 1], minlength=len(words) * places).reshape(-1, places)
    length = np.sqrt((sums * sums).sum(1, keepdims=True))
    return sums / np.where(length == 0, 1, length)


def embedded(text: Column, places: int = PLACES) -> Column:
    """The text's vector, an array of double; of a null text the zero vector."""

    @F.arrow_udf("array<double>")
    def run(lowered: pa.Array) -> pa.Array:
        made = hashed(split_lexemes(lowered), places)
        return pa.ListArray.from_arrays(np.arange(0, made.size + 1, places, dtype=np.int32), made.ravel())

    return run(F.lower(F.coalesce(text, F.lit(""))))
