"""N-gram Jaccard join by grouped prefixes.

Every distinct set of word shingles is one class, whatever the number of
documents that have it. Shingles are ordered by rarity (a sketch of their
counts over the whole table, then their hash; any order gives the same
links). Two sets that reach the threshold share a shingle of their prefixes,
and classes with the same size and prefix are collapsed into one group.

1. Groups meet in the lists of their prefix shingles. Length and positional
   bounds filter group pairs; entries that meet no other group drop out.
   Then a third bound: each set has a parity bit map about twice its size, and
   the bits in which two differ are a lower bound of the shingles that only
   one of them has. A group carries the map of its first member and how far
   its others are from it.
2. A first pass takes of each list only a spanning forest of its groups, the
   most alike pairs, and each group's members against its first. They are
   verified, and what they link gets one label.
3. The second pass takes every group pair left that is not of one label (other
   links would not change the components), expands it into members of
   different labels and verifies these.

Lists above ``BLOCK`` entries are split into blocks and each pair of blocks
is a group of its own; hot shingles, hot hubs and hot classes are split too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfacewx.llm.common import components, join_unique, mapped, slices, written
from surfacewx.llm.sketch import Counts, bitmap, has, summed

BLOCK = 2048
MAX_BLOCKS = 256
#: Counters of the rarity sketch: 4 Mi, broadcast as a byte each.
RARITY_BITS = 22
#: Bits of the map that tells which rows hold candidates: 4 MB.
ROW_BITS = 25
#: A shingle with more than 1/HOT of all classes' count, by the sketch, has its list split into HOT_SALTS.
HOT, HOT_SALTS = 1024, 64
#: Bits of a parity map at most: 512 bytes.
MAX_PARITY = 4096
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingles of ``words`` words of a UTF-8 text, as sorted
    64-bit hashes. A-Z are lower-cased; words are runs without ASCII white
    space. A text of fewer words is one shingle; null or no words: none."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    made = np.full(len(tokens) - size + 1, size, np.uint64)
    for k in range(size):
        made = made * _MULT + hashes[k : len(tokens) - size + 1 + k]
    made ^= made >> np.uint64(32)
    made *= _MIX
    made ^= made >> np.uint64(32)
    return np.unique(made)


def parity(shingles: np.ndarray) -> np.ndarray:
    """A set's parity bit map as 64-bit words: bit b tells whether an odd
    number of shingles falls on it. About two bits a shingle, 64 to MAX_PARITY."""
    bits = min(max(64, 1 << int(2 * len(shingles) - 1).bit_length()), MAX_PARITY)
    at, n = np.unique(shingles & np.uint64(bits - 1), return_counts=True)
    odd = np.zeros(bits, bool)
    odd[at[n % 2 == 1].astype(np.int64)] = True
    return np.packbits(odd).view(np.int64)


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` of which one at least is shared with any set that reaches the threshold."""
    return n - (percent * n + 99) // 100 + 1


def _rarity(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """A class of rarity, 0 to 255, for each bucket of shingles: 4 log2 of the documents that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counts(RARITY_BITS)
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                seen.add(shingle_set(text, words) >> np.uint64(64 - RARITY_BITS))
        parts = seen.parts()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "payload"])

    made = mapped(docs.select(F.col(text_col).cast("binary").alias("text")), run, "part int, payload binary")
    return summed(made, RARITY_BITS, lambda n: np.minimum(4 * np.log2(n + 1), 255))


def _prefixes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, rarity: np.ndarray) -> DataFrame:
    """``(id, n, digest, alike, prefix, map)`` of every row: the size and digest
    of its set, the digest of size and prefix, the prefix, rarest first, and
    the parity map."""
    order = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, words)
                if len(s):
                    rank = np.argsort(order.value[(s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)], kind="stable")
                    prefix = s[rank[: prefix_size(len(s), percent)]].tobytes()
                    out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), xxhash.xxh3_128_digest(len(s).to_bytes(8, "little") + prefix), prefix, parity(s)))
                else:
                    out.append((0, None, None, None, None))
            n, digest, alike, prefix, bits = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(alike, pa.binary()), pa.array(prefix, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], names=["id", "n", "digest", "alike", "prefix", "map"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), run, f"id {kind}, n long, digest binary, alike binary, prefix binary, map array<long>")


def _lists(groups: DataFrame, n_classes: int, rarity: np.ndarray) -> DataFrame:
    """``(token, g, n, pos)``: the entries of the lists of prefix shingles that more than one group has."""
    order = groups.sparkSession.sparkContext.broadcast(rarity)
    hot = min(255, int(4 * np.log2(n_classes / HOT + 1))) if n_classes > HOT else 255

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=1 << 20):
            if not b.num_rows:
                continue
            tokens = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            sizes = np.array([len(t) for t in tokens])
            token = np.concatenate(tokens)
            g, n = (np.repeat(b.column(k).to_numpy(), sizes) for k in (0, 1))
            pos = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            common = order.value[(token >> np.uint64(64 - RARITY_BITS)).astype(np.int64)] >= hot
            salt = np.where(common, 1 + g % HOT_SALTS, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token.view(np.int64), salt, g, n.astype(np.int32), pos.astype(np.int32))], names=["token", "salt", "g", "n", "pos"])

    made = mapped(groups.select("g", "n", "prefix"), post, "token long, salt int, g long, n int, pos int")
    beside = Window.partitionBy("token", "salt").orderBy("g")
    listed = made.select("*", F.lag("g").over(beside).alias("before"), F.lead("g").over(beside).alias("after"))
    return listed.filter("salt > 0 OR before IS NOT NULL OR after IS NOT NULL").select("token", "g", "n", "pos")


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """``(c, shingles)`` for the classes ``wanted(c, digest, pick)``: the texts
    stay where they are; a bit map of the hashed ids of one row of each class
    tells which of them to read, and the digest confirms the class."""
    picked = bitmap(wanted.select(F.pmod("pick", F.lit(1 << ROW_BITS)).alias("bucket")), ROW_BITS)
    rows = docs.sparkSession.sparkContext.broadcast(picked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy() & ((1 << ROW_BITS) - 1)
            for part in slices(iter([b.filter(pa.array(has(rows.value, at)))])):
                made = [shingle_set(t, words).tobytes() for t in part.column(1).to_pylist()]
                made = {xxhash.xxh3_128_digest(s): s for s in made if s}
                yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.binary()), pa.array(list(made.values()), pa.binary())], names=["digest", "shingles"])

    texts = docs.select(F.xxhash64(F.col(id_col)).alias("pick"), F.col(text_col).cast("binary").alias("text"))
    found = mapped(texts, run, "digest binary, shingles binary").groupBy("digest").agg(F.first("shingles").alias("shingles"))
    return found.join(wanted.select("c", "digest"), "digest").select("c", "shingles")


def _plausible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(u, v)`` whose parity maps, ``maps(c, n, map)``, allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in [b.slice(k, 4096) for k in range(0, b.num_rows, 4096)]:
                u, v, n, m = (c.to_numpy() for c in part.columns[:4])
                held = np.array([*map(_words, part.column(4)), *map(_words, part.column(5)), None], object)[:-1]
                apart = _differ(held, np.arange(len(u)), np.arange(len(u)) + len(u))
                near = (100 + percent) * apart <= (100 - percent) * (n + m)
                yield pa.RecordBatch.from_arrays([pa.array(u[near]), pa.array(v[near])], names=["u", "v"])

    both = pairs.join(maps.toDF("u", "n", "a"), "u").join(maps.toDF("v", "m", "z"), "v")
    return mapped(both.select("u", "v", "n", "m", "a", "z"), run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs(u, v)`` whose sets reach the threshold.
    A class with many partners is repeated for every ``BLOCK`` of them."""
    pairs = written(pairs, "pairs")
    load = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
    load = load.withColumn("parts", F.least(F.ceil(F.col("k") / BLOCK), F.lit(MAX_BLOCKS)).cast("int"))
    total = pairs.count()
    dealt = join_unique(pairs, load, "u", "k", total).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    there = dealt.join(sets.withColumnRenamed("c", "v"), "v").select("u", "part", "v", "shingles")
    own = load.join(sets.withColumnRenamed("c", "u"), "u").select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, at = None, None
        for b in batches:
            out = []
            for u, part, v, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if v is None:
                    at, hub = (u, part), s
                elif at == (u, part):
                    spot = np.searchsorted(hub, s)
                    shared = int((hub[np.minimum(spot, len(hub) - 1)] == s).sum())
                    if 100 * shared >= percent * (len(hub) + len(s) - shared):
                        out.append((u, v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])

    both = own.unionByName(there).repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    return written(mapped(both, run, "u long, v long"), "links")


def _tiles(lists: DataFrame, spread: DataFrame) -> DataFrame:
    """The entries of lists that hold more than one label, with the blocks (i, j) they meet in."""
    known = lists.select("token", "g", "n", "pos").join(spread, "g")
    mixed = known.groupBy("token").agg(F.min("low").alias("a"), F.max("high").alias("z"), F.count(F.lit(1)).alias("m")).filter("a < z")
    placed = join_unique(known, mixed, "token", "m", lists.count()).withColumn("parts", F.least(F.ceil(F.col("m") / BLOCK), F.lit(MAX_BLOCKS)).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("g"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return placed.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "g", "n", "pos", "low", "high", "far")


def _by_tile(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """The columns of each tile of sorted rows; with 11 columns the last holds parity maps."""
    rest = None
    for b in _with_end(batches):
        if b is None:
            cols = [c[:0] for c in rest] if rest is not None else [np.zeros(0, np.int64)] * width
        else:
            cols = [c.to_numpy().astype(np.int64) for c in b.columns[:10]] + [np.array([*map(_words, c), None], object)[:-1] for c in b.columns[10:]]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        token, i, j = cols[:3]
        cuts = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        bounds = np.concatenate([[0], cuts, [len(token)] if b is None else []]).astype(np.int64)
        for at in np.flatnonzero(np.diff(bounds) > 1):
            yield [c[bounds[at] : bounds[at + 1]] for c in cols]
        rest = [c[bounds[-1] :].copy() for c in cols]


def _meeting(lists: DataFrame, spread: DataFrame, percent: int) -> DataFrame:
    """The entries ``(token, g, n, pos)`` that meet one of another label within the bounds: as many rows at most as there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, i, j, own, g, n, pos, low, high, far in _by_tile(batches, 10):
            met = np.zeros(len(g), bool)
            for x, y in _tile(int(i[0]), int(j[0]), own, g, n, pos, low, high, percent):
                met[x] = met[y] = True
            if met.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in (token, g, n.astype(np.int32), pos.astype(np.int32))], names=["token", "g", "n", "pos"])

    dealt = _tiles(lists, spread).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return mapped(dealt, run, "token long, g long, n int, pos int").distinct()


def _rest(lists: DataFrame, spread: DataFrame, maps: DataFrame, percent: int, forest: bool) -> DataFrame:
    """The group pairs of the lists that pass the bounds and are not known to
    lie within one label. ``spread(g, low, high, far)``: the least and the
    largest label of a group's members and how far a member's map is from the
    group's in ``maps(g, map)``. With ``forest``, of each list or pair of
    blocks only as many as would join its labels, the most alike first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, own, g, n, pos, low, high, far, bits in _by_tile(batches, 11):
            found = _near(_tile(int(i[0]), int(j[0]), own, g, n, pos, low, high, percent), bits, far, n, percent)
            for x, y in _forest(found, low) if forest else ((x, y) for x, y, _ in found):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(g[x], g[y])), pa.array(np.maximum(g[x], g[y]))], names=["g1", "g2"])

    dealt = _tiles(lists, spread).join(maps, "g").select("token", "i", "j", "own", "g", "n", "pos", "low", "high", "far", "map")
    return mapped(dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j"), run, "g1 long, g2 long").distinct()


def _words(bits: pa.Scalar) -> np.ndarray:
    return bits.values.to_numpy().view(np.uint64)


def _differ(maps: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the maps of each pair differ, the wider one folded to the other's width."""
    out, width = np.zeros(len(x), np.int64), np.array([len(m) for m in maps])
    least = np.minimum(width[x], width[y])
    for w in np.unique(least):
        chosen = np.flatnonzero(least == w)
        spots, at = np.unique(np.concatenate([x[chosen], y[chosen]]), return_inverse=True)
        rows = np.stack([np.bitwise_xor.reduce(maps[k].reshape(-1, w), axis=0) for k in spots])
        a, b = at[: len(chosen)], at[len(chosen) :]
        out[chosen] = np.bitwise_count(rows[a] ^ rows[b]).sum(axis=1)
    return out


def _tile(i: int, j: int, own: np.ndarray, g: np.ndarray, n: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of two blocks of a list, or of one, that are not of one label and pass the bounds on size and place."""
    left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j))
    if not len(left) or not len(right):
        return
    step = max(1, (1 << 17) // len(right))
    for s in range(0, len(left), step):
        a, b = left[s : s + step, None], right[None, :]
        ok = (low[a] != high[b]) | (high[a] != low[b])
        few, many = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        ok &= (100 * few >= percent * many) & ((100 + percent) * np.minimum(n[a] - pos[a], n[b] - pos[b]) >= percent * (few + many))
        if i == j:
            ok &= g[a] < g[b]
        x, y = np.nonzero(ok)
        if len(x):
            yield a[x, 0], right[y]


def _near(pairs: Iterator[tuple[np.ndarray, np.ndarray]], maps: np.ndarray, far: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs whose parity maps allow the threshold, and in how many bits these differ."""
    for x, y in pairs:
        apart = _differ(maps, x, y)
        near = (100 + percent) * (apart - far[x] - far[y]) <= (100 - percent) * (n[x] + n[y])
        if near.any():
            yield x[near], y[near], apart[near]


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of pairs ``(x, y, apart)`` a spanning forest of the labels they join, nearest first."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for x, y, apart in pairs:
        a, b = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        order = np.lexsort((apart, b, a))
        first = order[np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])]
        for u, v, *pair in zip(a[first].tolist(), b[first].tolist(), apart[first].tolist(), x[first].tolist(), y[first].tolist(), strict=True):
            best[u, v] = min(best.get((u, v), tuple(pair)), tuple(pair))
    up: dict[int, int] = {}

    def root(k: int) -> int:
        while up.setdefault(k, k) != k:
            up[k] = k = up[up[k]]
        return k

    out = []
    for (u, v), (_, x, y) in sorted(best.items(), key=lambda e: e[1]):
        if root(u) != root(v):
            up[root(u)] = root(v)
            out.append((x, y))
    if out:
        x, y = np.array(out, np.int64).T
        yield x, y


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` for every row of ``docs``.

    Two rows are linked when their sets of distinct shingles of ``words``
    words have ``100 * intersection >= percent * union``; ``component_id`` is
    the smallest id that a row reaches through links, its own included. A text
    of fewer words is one shingle. Null and empty texts and texts without
    words have an empty set and are linked with nothing, not with each other.
    Equal texts are one class and linked. Repeated rows come back as often as
    they stand in ``docs``; a null id is the smallest only if all ids of its
    component are null. Long texts are read whole. Other columns are not read,
    whatever their names. An empty table gives an empty result. ``percent`` is
    1 to 100. Shingles are told apart by 64-bit hashes.
    """
    docs = docs.select(id_col, text_col)
    rarity = _rarity(docs, text_col, words)
    rows = written(_prefixes(docs, id_col, text_col, words, percent, rarity), "prefixes")
    full = rows.filter("n > 0")
    classes = full.groupBy("digest").agg(
        F.first("n").alias("n"), F.first("alike").alias("alike"), F.first("map").alias("map"),
        F.min("id").alias("id"), F.min(F.xxhash64("id")).alias("pick"), F.count(F.lit(1)).alias("size"),
    )
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    n_classes, total = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = full.groupBy("alike").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    groups = written(groups.withColumn("g", F.monotonically_increasing_id()), "groups")
    hubs = classes.groupBy("alike").agg(F.min("c").alias("hub"), F.min_by("map", "c").alias("first_map"), F.count(F.lit(1)).alias("m"))
    hubs = written(hubs.join(groups.select("alike", "g"), "alike"), "hubs")
    members = join_unique(classes.select("c", "digest", "pick", "n", "alike", "map"), hubs, "alike", "m", n_classes)
    apart = F.aggregate(F.zip_with("map", "first_map", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    members = written(members.select("c", "digest", "pick", "n", "g", "hub", apart.alias("far")), "members")
    lists = written(_lists(groups, n_classes, rarity), "lists")

    def expanded(classes_of: DataFrame) -> DataFrame:
        wanted = members.join(classes_of.select(F.explode(F.array("u", "v")).alias("c")).distinct(), "c")
        return _sets(docs, id_col, text_col, words, wanted.select("c", "digest", "pick"))

    maps, first_maps, hubs = classes.select("c", "n", "map"), hubs.select("g", F.col("first_map").alias("map")), hubs.select("g", "hub")
    # First pass: each group has a label of its own.
    spread = members.groupBy("g").agg(F.min("hub").alias("low"), F.min("hub").alias("high"), F.max("far").cast("long").alias("far"))
    spread = written(spread, "spread")
    lists = written(_meeting(lists, spread, percent), "meeting")
    across = _rest(lists, spread, first_maps, percent, forest=True).join(hubs.toDF("g1", "x"), "g1").join(hubs.toDF("g2", "y"), "g2")
    inside = members.filter(F.col("c") != F.col("hub")).filter((100 + percent) * F.col("far") <= 2 * (100 - percent) * F.col("n"))
    pairs = across.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).unionByName(inside.select(F.col("hub").alias("u"), F.col("c").alias("v")))
    pairs = written(pairs, "candidates")
    links = _verified(pairs, written(expanded(pairs), "sets"), percent)
    # Second pass: all that is left between labels.
    roots = components(links).select(F.col("node").alias("c"), "root")
    labels = written(members.select("g", "c", "far").join(roots, "c", "left").select("g", "c", "far", F.coalesce("root", "c").alias("label")), "labels")
    spread = written(labels.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("far").cast("long").alias("far")), "spread")
    rest = _rest(lists, spread, first_maps, percent, forest=False).unionByName(spread.filter("low < high").select(F.col("g").alias("g1"), F.col("g").alias("g2")))
    left, right = labels.select("g", "c", "label").toDF("g1", "u", "a"), labels.select("g", "c", "label").toDF("g2", "v", "z")
    pairs = rest.join(left, "g1").join(right, "g2").filter("a <> z AND (g1 <> g2 OR u < v)").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = written(_plausible(pairs, maps, percent), "candidates")
    more = _verified(pairs, written(expanded(pairs), "sets"), percent)
    links = roots.toDF("u", "v").unionByName(more)
    roots = components(links).select(F.col("node").alias("c"), "root")
    rooted = written(classes.select("digest", "c", "id", "size").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")), "rooted")
    lowest = written(rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("k")), "lowest")
    lookup = written(join_unique(rooted.select("digest", "size", "root"), lowest, "root", "k", n_classes).select("digest", "size", "component_id"), "lookup")
    linked = join_unique(full.select("id", "n", "digest"), lookup, "digest", "size", total).select("id", "n", "component_id")
    alone = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).toDF(id_col, "n_shingles", "component_id")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None
