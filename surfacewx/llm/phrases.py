"""Collocations: phrases of 2 to 5 words, mined best first.

A phrase that starts with word w scores at most ``1000 * n / f(w)``: its first
part has at least its own count, and so has the rest. First words are thus
expanded in the order of this bound, rarest first, in ``WAVES`` waves that
each take a larger share of a language's words. A wave reads the corpus once
and grows every phrase to the right of its first words, as far as words and
pairs can be frequent; its exact counts are the prefix counts that bound the
phrase's own score. Only survivors whose bound reaches the least score known
to be among the ``top`` have the counts of their rests read, in one more pass.
A language is settled when no word left has a bound that reaches its
``top``-th score, ties included.

Fixed-size maps, broadcast, tell which words, pairs and phrases may be
frequent or wanted. They let through a little too much and nothing too
little; counts are exact sums over all texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surfacewx.llm.common import mapped, slices, written
from surfacewx.llm.sketch import Counts, bitmap, has, summed

#: Shares of a language's words (by occurrences) whose phrases are grown up to the end of each wave.
WAVES = (1 / 8, 1 / 2, 1.0)
#: Bits of the maps of words and phrases (8 MB each) and counters of the map of pairs (8 Mi).
MAP_BITS, PAIR_BITS = 26, 23
LONGEST = 5
_SALTS = 64
_SEPARATORS = ".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(46 if chr(b) in _SEPARATORS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: White space to bytes.split() that is part of words here: none is left by the table above.
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased, with ``.`` between pieces."""
    return text.translate(_TABLE).replace(b".", b" . ").split() if text else []


class Tokens:
    """The words of a slice of rows: hashes of (language, word), and for each
    place how many words follow it in its piece (itself included, 0 between)."""

    def __init__(self, langs: list[str], texts: list[bytes | None]):
        self.langs, self.words, keys, lang = langs, [], [], []
        for k, (name, text) in enumerate(zip(langs, texts, strict=True)):
            words = words_of(text)
            self.words += words
            self.words.append(b".")
            keys.append(xxhash.xxh3_64_intdigest(name.encode()))
            lang.append(len(words) + 1)
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        gap = own == np.uint64(xxhash.xxh3_64_intdigest(b"."))
        self.row = np.repeat(np.arange(len(langs)), lang)
        self.key = _mixed(own * _MULT + np.repeat(np.array(keys, np.uint64), lang)) | np.uint64(1)
        ends = np.flatnonzero(gap)
        at = np.arange(len(own))
        self.room = np.where(gap, 0, ends[np.searchsorted(ends, at)] - at)
        self.left = np.where(np.concatenate([[True], gap[:-1]]), np.uint64(0), np.concatenate([[np.uint64(0)], self.key[:-1]]))

    def hashes(self, size: int) -> np.ndarray:
        """For each place the hash of the ``size`` words from it on (of use where there is room)."""
        made = np.full(len(self.key), size, np.uint64)
        for k in range(size):
            made = made * _MULT + np.concatenate([self.key[k:], np.zeros(k, np.uint64)])
        return _mixed(made)

    def phrase(self, at: int, size: int) -> str:
        return b" ".join(self.words[at : at + size]).decode()

    def counted(self, at: np.ndarray, size: int) -> tuple[list, ...]:
        """The distinct phrases at these places: language, phrase, count, least and largest word before it (0: none)."""
        order = at[np.argsort(self.hashes(size)[at], kind="stable")]
        h = self.hashes(size)[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if not len(first):
            return [], [], [], [], []
        n, before = np.diff(np.append(first, len(h))), self.left[order].view(np.int64)
        spots = order[first]
        rows = self.row[spots].tolist()
        return [self.langs[r] for r in rows], [self.phrase(p, size) for p in spots.tolist()], n.tolist(), np.minimum.reduceat(before, first).tolist(), np.maximum.reduceat(before, first).tolist()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _phrase_bucket(rows: DataFrame) -> DataFrame:
    """``(bucket)`` in a map of phrases for ``rows(lang, phrase)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for lang, phrase in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = Tokens([lang], [None])
                t.words = [w.encode() for w in phrase.split(" ")]
                own = np.fromiter(map(xxhash.xxh3_64_intdigest, t.words), np.uint64, len(t.words))
                t.key = _mixed(own * _MULT + np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))) | np.uint64(1)
                out.append(int(t.hashes(len(t.words))[0] >> np.uint64(64 - MAP_BITS)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["bucket"])

    return mapped(rows.select("lang", "phrase"), run, "bucket long")


def _scanned(texts: DataFrame, found: Callable[[Tokens], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """``(lang, phrase, n, low, high)``: counts of the phrases at the places ``found`` gives for each size, a row a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "n", "low", "high"]
        for b in slices(batches):
            tokens = Tokens(b.column(0).to_pylist(), b.column(1).to_pylist())
            for size, at in found(tokens):
                cols = tokens.counted(at, size)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)

    return mapped(texts, run, "lang string, phrase string, n long, low long, high long")


def _word_counts(texts: DataFrame, least: int) -> tuple[DataFrame, np.ndarray]:
    """``(lang, phrase, f)`` of every word, and the map of pairs that may have ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, pairs = ["lang", "phrase", "n", "part", "payload"], Counts(PAIR_BITS)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary())
        for b in slices(batches):
            t = Tokens(b.column(0).to_pylist(), b.column(1).to_pylist())
            pairs.add(t.hashes(2)[t.room > 1] >> np.uint64(64 - PAIR_BITS))
            lang, word, n, _, _ = t.counted(np.flatnonzero(t.room), 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((lang, word, n, [None] * len(n), [None] * len(n)), kinds, strict=True)], names=names)
        parts = pairs.parts()
        none = [None] * len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((none, none, none, range(len(parts)), parts), kinds, strict=True)], names=names)

    made = written(mapped(texts, run, "lang string, phrase string, n long, part int, payload binary"), "words")
    counts = made.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    often = summed(made.filter("part IS NOT NULL").select("part", "payload"), PAIR_BITS, lambda n: n >= least)
    return written(counts, "counts"), np.packbits(often.astype(bool))


def _grown(texts: DataFrame, heads: DataFrame, frequent: np.ndarray, pairs: np.ndarray, least: int) -> DataFrame:
    """``(lang, phrase, size, f, low, high)``: all phrases that start with ``heads(lang, phrase)`` and occur ``least`` times."""
    spark = texts.sparkSession
    start, often, two = (spark.sparkContext.broadcast(x) for x in (bitmap(_phrase_bucket(heads), MAP_BITS), frequent, pairs))

    def found(t: Tokens) -> Iterator[tuple[int, np.ndarray]]:
        word = t.hashes(1) >> np.uint64(64 - MAP_BITS)
        usual = has(often.value, word) & (t.room > 0)
        linked = np.append(usual[:-1] & usual[1:], False) & (t.room > 1) & has(two.value, t.hashes(2) >> np.uint64(64 - PAIR_BITS))
        at = np.flatnonzero(linked & has(start.value, word))
        for size in range(2, LONGEST + 1):
            if size > 2:
                at = at[(t.room[at] >= size)]
                at = at[linked[at + size - 2]]
            yield size, at

    made = _scanned(texts, found).groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.min("low").alias("low"), F.max("high").alias("high"))
    made = made.filter(F.col("f") >= least).withColumn("size", F.size(F.split("phrase", " ")))
    return made.select("lang", "phrase", "size", "f", "low", "high")


def _rests(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(lang, phrase, f)``: the counts of the phrases ``wanted(lang, phrase)``, of 2 words or more."""
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(_phrase_bucket(wanted), MAP_BITS))

    def found(t: Tokens) -> Iterator[tuple[int, np.ndarray]]:
        for size in range(2, LONGEST):
            yield size, np.flatnonzero((t.room >= size) & has(bits.value, t.hashes(size) >> np.uint64(64 - MAP_BITS)))

    counts = _scanned(texts, found).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return counts.join(wanted, ["lang", "phrase"])


def _part(first: Column, last: Column) -> Column:
    """The words of ``phrase`` from ``first`` (1 on) to ``last``."""
    return F.array_join(F.slice(F.split("phrase", " "), first, last - first + 1), " ")


def _score(a: str, n: str, left: str, right: str) -> Column:
    """``floor(1000 * a * n / (left * right))`` in whole numbers of up to 38 digits."""
    a, n, left, right = (f"CAST({c} AS DECIMAL({d}, 0))" for c, d in ((a, 15), (n, 18), (left, 18), (right, 18)))
    return F.expr(f"({a} * 1000 * {n}) div ({left} * {right})")


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank. Salts first keep
    ``top`` each, so a language's survivors are never in one task."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).drop("salt")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z are lower-cased, texts are split into pieces at ``.,;:!?`` and line
    ends and these into words at spaces and tabs. Per language, n counts all
    word occurrences and f a phrase's occurrences within pieces, overlaps
    included. Candidates have 2 to 5 words and ``a = f >= least``. Cut after
    its first k words, a candidate has the score ``floor(1000 * a * n / (l * r))``
    with the counts l and r of its parts; the lowest-scoring cut counts, of
    equal ones the first. A candidate that lies inside a longer one as frequent
    is dropped. Order: score and a descending, then the phrase in byte order.

    A null language is ``und``. Null and empty texts have no words; long ones
    are read whole. Rows repeated count as often. Ties at the end are broken
    by the phrase. Fewer than ``top`` survivors are all given; an empty table
    or one without candidates gives an empty result. Other columns are not
    read, whatever their names.
    """
    texts = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    counts, pairs = _word_counts(texts, least)
    totals = written(counts.groupBy("lang").agg(F.sum("f").cast("long").alias("n")), "totals")
    words = counts.filter(F.col("f") >= least)
    # A word's wave follows from its count's quarter octave: the sums of a few hundred steps a language order the words.
    step = F.floor(4 * F.log2("f")).alias("step")
    steps = words.groupBy("lang", step).agg(F.sum("f").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("lang").orderBy("step"))
    share = F.col("upto") / F.sum("m").over(Window.partitionBy("lang"))
    wave = F.when(share <= WAVES[0], 0).when(share <= WAVES[1], 1).otherwise(2)
    steps = steps.withColumn("upto", upto).withColumn("wave", wave).select("lang", "step", "wave")
    words = words.withColumn("step", step).join(F.broadcast(steps), ["lang", "step"]).join(F.broadcast(totals), "lang")
    words = written(words.select("lang", "phrase", "f", "wave", F.expr("1000 * n div f").alias("bound")), "heads")
    frequent = bitmap(_phrase_bucket(words), MAP_BITS)

    known = words.select("lang", "phrase", "f")
    grown, result = None, None
    floors = totals.select("lang", F.lit(0).cast("long").alias("floor"))
    for k in range(len(WAVES)):
        heads = words.filter(F.col("wave") == k).join(F.broadcast(floors), "lang").filter("bound >= floor").select("lang", "phrase")
        if k and not heads.limit(1).count():
            continue
        more = _grown(texts, heads, frequent, pairs, least)
        grown = written(more if grown is None else grown.unionByName(more).dropDuplicates(["lang", "phrase"]), "grown")
        result, known = _settled(texts, grown, words, known, totals, top)
        floors = result.groupBy("lang").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("low"))
        floors = written(totals.join(floors, "lang", "left").select("lang", F.when(F.col("m") >= top, F.col("low")).otherwise(0).alias("floor")), "floors")
    return result.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _settled(texts: DataFrame, grown: DataFrame, words: DataFrame, known: DataFrame, totals: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """The best of the phrases grown so far, with exact scores, and all counts known by now."""
    longer = grown.filter("size > 2").groupBy("lang", _part(F.lit(1), F.col("size") - 1).alias("phrase")).agg(F.max("f").alias("next"))
    alive = grown.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.col("next") < F.col("f"), F.lit(True)))
    # The word before is the same everywhere: a phrase longer by it is as frequent.
    alive = alive.filter((F.col("size") == LONGEST) | (F.col("low") == 0) | (F.col("low") != F.col("high"))).join(F.broadcast(totals), "lang")
    cuts = alive.select("lang", "phrase", F.col("f").alias("a"), "n", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = written(cuts.select("lang", "phrase", "a", "n", "size", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("size")).alias("rest")), "cuts")

    def scored(counts: DataFrame) -> DataFrame:
        left, right = counts.toDF("lang", "first", "l"), counts.toDF("lang", "rest", "r")
        made = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"], "left")
        return made.withColumn("score", F.when(F.col("r").isNotNull(), _score("a", "n", "l", "r")))

    def lowest(made: DataFrame) -> DataFrame:
        low = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
        return made.filter("score IS NOT NULL").groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.count(F.lit(1)).alias("m"), F.first("size").alias("size"), low.alias("cut"))

    counts = written(known.unionByName(grown.select("lang", "phrase", "f")).dropDuplicates(["lang", "phrase"]), "known")
    part = written(scored(counts), "scored")
    bounds = written(lowest(part).select("lang", "phrase", "a", "m", "size", F.col("cut.score").alias("score")), "bounds")
    full = _best(bounds.filter("m = size - 1").select("lang", "phrase", "a", "score"), top)
    floors = full.groupBy("lang").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("low")).filter(F.col("m") >= top).select("lang", "low")
    able = bounds.join(F.broadcast(floors), "lang", "left").filter(F.col("score") >= F.coalesce("low", F.lit(0))).select("lang", "phrase")
    open_cuts = part.filter("score IS NULL").join(able, ["lang", "phrase"], "left_semi")
    wanted = written(open_cuts.select("lang", F.col("rest").alias("phrase")).distinct(), "wanted")
    if wanted.limit(1).count():
        counts = written(counts.unionByName(_rests(texts, wanted).select("lang", "phrase", "f")), "known")
    final = lowest(scored(counts)).filter("m = size - 1")
    best = _best(final.select("lang", "phrase", "a", "n", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")), top)
    return written(best, "best"), counts
