"""Text expressions: built-in where they are exact, Arrow-batched where Spark has no equal (NFKC, case folding, JSON text)."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalized(text: str) -> str:
    """NFKC, case folding, white space collapsed."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def canonical_json(value) -> str:
    """Sorted keys, a space after separators, Unicode kept."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(", ", ": "))


@F.pandas_udf(T.StringType())
def normalize_text(text: pd.Series) -> pd.Series:
    """``normalized`` of each text; null stays null."""
    return text.map(normalized, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_all(texts: pd.Series) -> pd.Series:
    """``normalized`` of each element."""
    return texts.map(lambda values: [None if v is None else normalized(v) for v in values], na_action="ignore")


def _shingles(text: str, size: int) -> list[str]:
    words = text.casefold().split()
    if not words:
        return []
    return sorted({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))})


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 hashes of the text's ``shingles``, sorted; null and empty texts have none."""
    found = _shingles(text or "", size)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed) for s in found), dtype=np.uint64, count=len(found)))


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` case-folded words; a shorter text is one run, an empty one none."""
    return F.pandas_udf(lambda s: s.map(lambda t: _shingles(t, size), na_action="ignore"), "array<string>")(text)


def line_ends(text: Column) -> Column:
    """CRLF and CR as LF: the canonical form of a text state."""
    return F.regexp_replace(text, "\r\n?", "\n")


def escape(text: Column) -> Column:
    """``&``, ``<`` and ``>`` as entities, in that order."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def tokens(text: Column) -> Column:
    """Runs of word characters (Unicode) in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def hashed_grams(text: Column, buckets: int = 1 << 14) -> Column:
    """Sorted distinct buckets of the text's tokens and token pairs, by the first 32 bits of MD5."""
    bucket = lambda g: (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long") % buckets).cast("int")
    words = F.transform(F.array(tokens(text)), lambda w: w)  # computed once, then bound
    pairs = lambda w: F.transform(F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda b, i: F.concat_ws(" ", F.element_at(w, i + 1), b))
    return F.element_at(F.transform(words, lambda w: F.sort_array(F.array_distinct(F.transform(F.array_distinct(F.concat(w, pairs(w))), bucket)))), 1)


def id_parts(value: Column) -> tuple[Column, Column]:
    """Before and after the last hyphen."""
    return F.regexp_extract(value, "^(.*)-([^-]*)$", 1), F.regexp_extract(value, "^(.*)-([^-]*)$", 2)


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def mask_prefix(text: Column, prefix: str, mask: str = "~") -> Column:
    """Paths under ``prefix`` (such as a home folder) with the prefix masked."""
    return F.when(text.startswith(prefix), F.concat(F.lit(mask), F.substring(text, len(prefix) + 1, 1 << 30))).otherwise(text)
