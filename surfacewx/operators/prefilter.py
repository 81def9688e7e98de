"""A key filter that goes before the shuffle of a large selective join.

The keys of a dimension too large to broadcast still fit a Bloom filter. It is
built as a grouped aggregate: each key sets four bits of one 64-bit word, and
``bit_or`` merges words map-side, so tasks exchange words and no keys. The
words are a broadcast table of at most ``MAX_WORDS`` rows; a fact row looks up
the one word of its key and stays if it has all four bits. Rows without a
partner then mostly drop out where they are read, before the exchange of the
join that follows. Everything is column expressions, inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 64-bit words of a filter at most: some 60 MB as a broadcast table.
MAX_WORDS = 1 << 20
#: Distinct keys a word is meant for, and with which a filter still pays (one stranger in six passes).
KEYS_PER_WORD, KEYS_AT_MOST = 4, 16

_HASHED_ALIKE = (T.StringType, T.BinaryType, T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _word(key: str, words: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(words - 1))


def _mask(key: str) -> Column:
    """Four bits, from other parts of the hash than the word's number."""
    out = F.lit(0).cast("long")
    for shift in (40, 46, 52, 58):
        bit = F.shiftrightunsigned(F.xxhash64(key), shift).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def words_for(n: int) -> int:
    """Words of a filter for ``n`` keys: a power of two, ``MAX_WORDS`` at most."""
    return min(MAX_WORDS, 1 << max(0, -(-n // KEYS_PER_WORD) - 1).bit_length())


def can_prefilter(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, n: int) -> bool:
    """Whether a filter of ``n`` keys pays and both keys hash alike: of one type,
    compared byte by byte."""
    kind = fact.schema[fact_key].dataType
    return kind == dim.schema[dim_key].dataType and isinstance(kind, _HASHED_ALIKE) and n <= MAX_WORDS * KEYS_AT_MOST


def key_words(dim: DataFrame, key: str, n: int) -> DataFrame:
    """``(_word long, _bits long)``: the filter of the non-null keys of ``dim``, which has about ``n``."""
    keys = dim.filter(F.col(key).isNotNull())
    return keys.groupBy(_word(key, words_for(n)).alias("_word")).agg(F.bit_or(_mask(key)).alias("_bits"))


def prefilter(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, n: int) -> DataFrame:
    """The rows of ``fact`` whose key may be among those of ``dim``: all that
    are, and few others. A null key may pass or not; no join matches it."""
    words = key_words(dim, dim_key, n)
    near = fact.join(F.broadcast(words), _word(fact_key, words_for(n)) == words["_word"])
    mask = _mask(fact_key)
    return near.filter(words["_bits"].bitwiseAND(mask) == mask).select(*[fact[f"`{c}`"] for c in fact.columns])
