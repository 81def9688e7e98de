"""SimHash near-duplicate detection by a byte-position inverted index.

A fingerprint of 64 bits has 8 positional bytes. Two that differ in at most
``d`` bits agree in at least ``8 - d`` bytes: the guaranteed minimum. Posting
lists of one positional byte would hold 1/256 of all fingerprints each, so
an index key joins several: the positions form two halves, and any five
shared positions put three into one half, so the eight triples inside the
halves (24 bits each) meet every pair. Within a posting list the shared
positional bytes of each pair are tallied, pairs below the minimum are
dropped, and the others are verified by their bit distance. Above
``WIDE_INDEX`` fingerprints the keys are all sets of ``8 - d`` positions,
which keeps lists short; either index finds every pair.

Equal fingerprints are one entry, whatever the number of documents. Lists
above ``BLOCK`` entries are split into blocks, and each pair of blocks is a
task's work of its own. A list gives a spanning forest of its links, not
all of them, so output stays linear while no connection is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfacewx.llm.common import components, fresh, join_unique, mapped, quoted, slices, wider, written

BLOCK = 4096
MAX_BLOCKS = 256
WIDE_INDEX = 1 << 26
_CHUNK = 1 << 16
#: Up to so many 64-bit words of kept rows (16 bytes each with its number) are broadcast.
MAP_WORDS = 1 << 21


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> bytes:
    """The 8 bytes (high byte first) of a text's SimHash over word shingles.

    A-Z are lower-cased; words are runs without ASCII white space. Repeated
    shingles count each time; a text of fewer words is one shingle, and null
    or a text without words gives zero. A bit is 1 if over half the XXH64
    values of the shingles have it.
    """
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return bytes(8)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(tokens) > words:
        starts, ends = starts[: -words + 1 or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist(), strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(starts)).tobytes()


def with_fingerprint(df: DataFrame, id_col: str, text_col: str, words: int = 3, seed: int = 42) -> DataFrame:
    """``(id_col, fp long)``: the fingerprint of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = b"".join([fingerprint(t, words, seed) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], names=[id_col, "fp"])

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp long"
    return mapped(df.select(id_col, text_col), run, schema)


def index_sets(min_matches: int, groups: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any ``min_matches`` of the 8 positions
    contain one of them: all sets of ceil(min_matches / groups) positions
    within each of ``groups`` equal groups."""
    size = -(-min_matches // groups)
    return [c for g in range(groups) for c in combinations(range(g * 8 // groups, (g + 1) * 8 // groups), size)]


def tallied(a: np.ndarray, b: np.ndarray, same: bool, min_matches: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``a`` and ``b`` (later ones of ``b`` if ``same``) that
    share at least ``min_matches`` positional bytes, in order: the index hits
    of each pair are counted position by position, and only pairs that reach
    the minimum come out."""
    left, right = a.view(np.uint8).reshape(-1, 8), np.ascontiguousarray(b.view(np.uint8).reshape(-1, 8).T)
    step = max(1, (1 << 20) // len(b))
    for s in range(0, len(a), step):
        rows = left[s : s + step]
        tally = np.zeros((len(rows), len(b)), np.uint8)
        for p in range(8):
            tally += rows[:, p, None] == right[p]
        if same:
            tally[np.arange(len(b))[None, :] <= np.arange(s, s + len(rows))[:, None]] = 0
        i, j = np.nonzero(tally >= min_matches)
        yield s + i, j


def _links(a: np.ndarray, b: np.ndarray, same: bool, t: int, first: np.ndarray, min_matches: int, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``a`` the indices in ``b`` (later ones if ``same``) that
    reach the tally, are verified to lie within the distance and have ``t`` as
    the first index set they share."""
    weights = (1 << np.arange(8)).astype(np.int64)
    for i, j in tallied(a, b, same, min_matches):
        x = a[i] ^ b[j]
        near = np.bitwise_count(x) <= distance
        i, j, x = i[near], j[near], x[near]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0) @ weights  # bit p: byte p (from the low end) agrees
        here = first[shared] == t
        i, j = i[here], j[here]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for at, end in zip(starts, [*starts[1:], len(i)], strict=False):
            yield int(i[at]), j[at:end]


def _forest(own: np.ndarray, fps: np.ndarray, i: int, j: int, t: int, first: np.ndarray, min_matches: int, distance: int) -> list[tuple[int, int]]:
    """Links that connect what the links of one posting list (or of two blocks of it) connect."""
    left, right = (np.arange(len(fps)), np.arange(len(fps))) if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
    if not len(left) or not len(right):
        return []
    label, out = np.arange(len(fps)), []
    bits = fps.view(np.uint64)
    for r, found in _links(bits[left], bits[right], i == j, t, first, min_matches, distance):
        u, vs = left[r], right[found]
        others, at = np.unique(label[vs], return_index=True)
        new = others != label[u]
        if new.any():
            out += [(int(fps[u]), int(fps[v])) for v in vs[at[new]]]
            label[np.isin(label, others)] = label[u]
    return out


def links(fps: DataFrame, n: int, distance: int = 3) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fps(fp long)`` that
    connect exactly those joined by chains of at most ``distance`` bits.

    ``n``, their number, chooses the index and which lists are hot: lists with
    a large share of all entries are cut where they are, by broadcast of their
    keys. ``distance`` 0 to 7."""
    min_matches = 8 - distance
    groups = 2 if n <= WIDE_INDEX and min_matches > 1 else 1
    sets = index_sets(min_matches, groups)
    first = np.full(256, len(sets), np.int64)
    for t in reversed(range(len(sets))):
        first[[m for m in range(256) if all(m >> p & 1 for p in sets[t])]] = t

    def byte(p: int):
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    def key(t: int):
        parts = [F.lit(t).cast("long"), *(byte(p) for p in sets[t])]
        out = parts[0]
        for x in parts[1:]:
            out = F.shiftleft(out, 8).bitwiseOR(x)
        return out

    posted = fps.select("fp", F.explode(F.array(*[key(t) for t in range(len(sets))])).alias("k"))
    long_lists = written(posted.groupBy("k").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BLOCK), "lists")
    blocks = F.least(F.ceil(F.coalesce("m", F.lit(1)) / BLOCK), F.lit(MAX_BLOCKS)).cast("int")
    placed = join_unique(posted, long_lists, "k", "m", n * len(sets), "left").select("k", "fp", blocks.alias("nb"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    tiles = placed.select("k", "fp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    size = len(sets[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        rest = None
        for b in _with_end(batches):
            cols = [np.zeros(0, np.int64)] * 5 if b is None else [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols, strict=True)]
            k, fp, own, i, j = cols
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            bounds = np.concatenate([[0], cuts, [len(k)] if b is None else []]).astype(np.int64)
            out = []
            for at in np.flatnonzero(np.diff(bounds) > 1):
                s, e = bounds[at], bounds[at + 1]
                out += _forest(own[s:e], fp[s:e], i[s], j[s], int(k[s]) >> 8 * size, first, min_matches, distance)
            rest = [c[bounds[-1] :].copy() for c in cols]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    dealt = tiles.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "fp")
    return mapped(dealt, run, "u long, v long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _components_of(rows: DataFrame, id_col: str, distance: int) -> tuple[DataFrame, int]:
    """``(fp, n, root, component_id)`` for each distinct fingerprint of ``rows(id_col, fp)``, and the number of rows."""
    classes = written(rows.groupBy("fp").agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("n")), "classes")
    total, distinct = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    roots = components(links(classes.select("fp"), distinct, distance)).select(F.col("node").alias("fp"), "root")
    rooted = written(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    lowest = written(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("size")), "lowest")
    return written(join_unique(rooted, lowest, "root", "size", distinct).select("fp", "n", "root", "component_id"), "components"), total


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row of ``df``.

    Rows whose fingerprints differ in at most ``distance`` bits are linked;
    ``component_id`` is the smallest id that a row reaches through links,
    its own included. Null and empty texts have fingerprint zero and link
    like any other. Repeated rows come back as often as they stand in ``df``;
    a null id is the smallest only if all ids of its component are null.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = written(with_fingerprint(df, id_col, text_col, words, seed), "fingerprints")
    lookup, total = _components_of(rows, id_col, distance)
    out = join_unique(rows, lookup, "fp", "n", total)
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """One row of each component of :func:`near_duplicates`, with all columns
    of ``df``: a row with the component's smallest id. Where several rows of
    a component have this id, one of those with the smallest fingerprint stays.

    Survivors are chosen on narrow rows and come back as a bit map over row
    numbers, broadcast while it is at most ``MAP_WORDS`` words, so texts are
    not shuffled; beyond that rows are joined by number. Nulls, empty texts
    and an empty table as in :func:`near_duplicates`."""
    print_col, row_col, word_col, bits_col = (fresh(df, c) for c in ("simhash_fp", "simhash_row", "simhash_word", "simhash_bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = b"".join([fingerprint(t, words, seed) for t in b.column(text_col).to_pylist()])
            yield b.append_column(print_col, pa.array(np.frombuffer(fps, ">i8").astype(np.int64)))

    made = mapped(df, run, wider(df, **{print_col: "long"}))
    full = written(made.withColumn(row_col, F.monotonically_increasing_id()), "printed")
    rows = full.select(F.col(id_col).alias("id"), F.col(print_col).alias("fp"), F.col(row_col).alias("row"))
    lookup, total = _components_of(rows, "id", distance)
    lowest = join_unique(rows, lookup, "fp", "n", total).filter(F.col("id").eqNullSafe(F.col("component_id")))
    kept = lowest.groupBy("root").agg(F.min(F.struct("fp", "row"))["row"].alias("row"))
    # Row numbers run on within a written partition, so the kept ones are dense bits of few words.
    word, bit = F.shiftrightunsigned("row", 6), F.col("row").bitwiseAND(F.lit(63)).cast("int")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    maps = written(kept.groupBy(word.alias(word_col)).agg(bits.alias(bits_col)), "kept")
    if maps.count() <= MAP_WORDS:  # texts stay where they are
        out = full.withColumn(word_col, F.shiftrightunsigned(row_col, 6)).join(F.broadcast(maps), word_col)
        out = out.filter(F.call_function("getbit", F.col(bits_col), F.col(row_col).bitwiseAND(F.lit(63)).cast("int")) == 1)
    else:
        numbers = maps.select(word_col, F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"), bits_col).filter(F.call_function("getbit", F.col(bits_col), F.col("at")) == 1)
        out = full.join(numbers.select((F.shiftleft(word_col, 6) + F.col("at")).alias(row_col)), row_col, "left_semi")
    return out.select(*[F.col(quoted(c)) for c in df.columns])
