"""Benchmark decontamination by a prefix-filtered set join.

The records of the join are windows: ``size`` consecutive words of a
benchmark item (a shorter item is one window), as sets of word shingles.
Shingles are ordered by rarity, their number of occurrences in all documents.
A window must be contained whole, so the necessary prefix is one shingle, the
rarest: a document without it cannot hold the window. Where a document holds
a prefix shingle at position ``i`` and the window has it at offset ``o``, the
window can only start at ``i - o`` (positional bound) and must fit between
the document's ends (length bound); then its words are compared one by one.

The benchmark is read in blocks of at most ``BLOCK_WINDOWS`` windows on
average, each broadcast in turn: one pass over the documents per block counts
shingles, one marks. A window of more than ``WINDOW_ITEMS`` items is broadcast
with its number only. Documents that hold such windows, and no others, are
joined afterwards with the items of the sets of windows found.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfacewx.llm.common import ascii_words, fresh, join_unique, mapped, slices, wider, written
from surfacewx.operators.joins import dimension_join, salted_join

BLOCK_WINDOWS = 200_000
SHINGLE = 3
#: Windows of up to so many items are broadcast with their items.
WINDOW_ITEMS = 64


def windows(benchmark: DataFrame, size: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(window string, item string)``: the distinct windows of each item.
    Null and wordless texts have none; a null id is the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, found = [], []
            for item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = ascii_words(text)
                for s in range(max(1, len(words) - size + 1) if words else 0):
                    ids.append(item)
                    found.append(b" ".join(words[s : s + size]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], names=["item", "window"])

    texts = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string"))
    return mapped(texts, run, "item string, window string").distinct()


def numbered(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Of ``pairs(window, item)``: ``(window, win, items)`` with a number per
    window and the items of windows of at most ``most`` (else null); ``(win,
    item)`` of the other windows; how many windows there are of each kind.
    No window's items are gathered beyond ``most``."""
    pairs = written(pairs, "pairs")
    sizes = written(pairs.groupBy("window").agg(F.count(F.lit(1)).alias("n")).withColumn("win", F.monotonically_increasing_id()), "sizes")
    is_light = F.col("n") <= most
    n, n_light = sizes.agg(F.count(F.lit(1)), F.count_if(is_light)).first()
    placed = join_unique(pairs, sizes, "window", "n", pairs.count())
    lists = placed.filter(is_light).groupBy("win").agg(F.collect_list("item").alias("items"))
    found = sizes.join(lists, "win", "left").select("window", "win", "items")
    return written(found, "windows"), placed.filter(~is_light).select("win", "item"), n, n - n_light


def _shingles(words: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    n = min(SHINGLE, len(words))
    return [words[o : o + n] for o in range(len(words) - n + 1)]


def _at(words: list[bytes], by_head: dict) -> Iterator[tuple[int, tuple]]:
    """Positions and shingles of ``words`` that are among those of ``by_head`` (first word to shingle set)."""
    for i in [i for i, w in enumerate(words) if w in by_head]:
        for n, some in by_head[words[i]]:
            if (s := tuple(words[i : i + n])) in some:
                yield i, s


def _by_head(shingles) -> dict:
    out: dict = defaultdict(lambda: defaultdict(set))
    for s in shingles:
        out[s[0]][len(s)].add(s)
    return {w: sorted(v.items()) for w, v in out.items()}


def _occurrences(docs: DataFrame, text_col: str, shingles: set) -> Counter:
    """How often each of the (boundedly many) shingles occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(_by_head(shingles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                seen.update(s for _, s in _at(ascii_words(text), sent.value))
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(s).decode() for s in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["s", "n"])

    counts = mapped(docs.select(text_col), run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return Counter({tuple(r.s.encode().split(b" ")): r.n for r in counts.toLocalIterator()})


def _prefix_index(block: dict[tuple, tuple[int, list[str] | None]], rarity: Counter) -> dict:
    """Prefix shingle to its windows: (offset, window, number, items if listed)."""
    out = defaultdict(list)
    for window, (number, items) in block.items():
        o, s = min(enumerate(_shingles(window)), key=lambda x: (rarity[x[1]], x[1], x[0]))
        out[s].append((o, window, number, items))
    return dict(out)


def _with_items_of(out: DataFrame, heavy: DataFrame, wins_col: str, items_col: str) -> DataFrame:
    """``out`` with the items ``heavy(win, item)`` of the windows numbered in
    ``wins_col`` added to ``items_col``. Each distinct set of numbers is looked
    up once; documents without one pass by."""
    some = F.size(wins_col) > 0
    sets = written(out.filter(some).select(F.col(wins_col).alias("wins")).distinct(), "sets")
    listed = salted_join(heavy, sets.select("wins", F.explode("wins").alias("number")), "win", "number", salt_cols=["item"])
    listed = written(listed.groupBy("wins").agg(F.collect_set("item").alias("more")), "items")
    names = fresh(out, "wins_of_items"), fresh(out, "more_items")
    fact = out.filter(some).withColumn(items_col, F.coalesce(items_col, F.array().cast("array<string>")))
    more = dimension_join(fact, listed.toDF(*names), wins_col, names[0], "left", salt_cols=[items_col])
    more = more.withColumn(items_col, F.array_sort(F.array_union(items_col, F.col(names[1]))))
    return out.filter(~some).unionByName(more.drop(*names))


def mark(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS, window_items: int = WINDOW_ITEMS, into: tuple[str, str, str, str] = ("n_words", "n_hit", "hits", "items")) -> DataFrame:
    """``docs`` with four columns named by ``into``: the number of words, the
    number of hit words, the hit spans of words (array of ``struct<first,
    last>``, joined where they overlap or touch) and the sorted ids of the
    items with an occurring window.

    Words: A-Z lower-cased runs of digits, letters and non-ASCII characters;
    a null text has none. Repeated rows are marked alike. An empty benchmark
    marks nothing. Columns of ``docs`` that are named like the new ones give way
    to them; all others stay as they are. Texts of any length are read whole.
    Where a window of more than ``window_items`` items occurs, ``docs`` is read
    once more, to join the items of these windows.
    """
    docs = docs.drop(*into)
    found, heavy, n, n_heavy = numbered(windows(benchmark, size, item_col, item_text_col), window_items)
    blocks = max(1, -(-n // block_windows))
    n_words_col, n_hit_col, hits_col, items_col = into
    wins_col = fresh(docs, "wins")
    while wins_col in into:
        wins_col += "_"
    schema = wider(docs, **{n_words_col: "int", wins_col: "array<long>", hits_col: "array<struct<first:int,last:int>>", items_col: "array<string>"})
    out = docs.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[-4:]])
    spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for k in range(blocks):
        rows = found.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).collect()
        block = {tuple(r.window.encode().split(b" ")): (r.win, r["items"]) for r in rows}
        index = _prefix_index(block, _occurrences(docs, text_col, {s for w in block for s in _shingles(w)}))
        sent = docs.sparkSession.sparkContext.broadcast((index, _by_head(index)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, by_head = sent.value
            for b in slices(batches):
                n_words, wins, hits, items = [], [], [], []
                before = (c.to_pylist() for c in b.columns[-3:])
                for text, numbers, old, listed in zip(b.column(text_col).to_pylist(), *before, strict=True):
                    words = ascii_words(text)
                    at, who, which = [(x["first"], x["last"]) for x in old or ()], set(listed or ()), set(numbers or ())
                    for i, s in _at(words, by_head):
                        for o, window, number, ids in index[s]:
                            start = i - o
                            if start >= 0 and start + len(window) <= len(words) and tuple(words[start : start + len(window)]) == window:
                                at.append((start, start + len(window) - 1))
                                if ids is None:
                                    which.add(number)
                                else:
                                    who.update(ids)
                    joined: list[list[int]] = []
                    for first, last in sorted(at):
                        if joined and first <= joined[-1][1] + 1:
                            joined[-1][1] = max(joined[-1][1], last)
                        else:
                            joined.append([first, last])
                    n_words.append(len(words))
                    wins.append(sorted(which))
                    hits.append([{"first": x, "last": y} for x, y in joined])
                    items.append(sorted(who))
                new = [pa.array(n_words, pa.int32()), pa.array(wins, pa.list_(pa.int64())), pa.array(hits, spans), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-4], *new], names=b.schema.names)

        out = mapped(out, run, schema)
    if n_heavy:
        out = _with_items_of(out, heavy, wins_col, items_col)
    n_hit = F.aggregate(hits_col, F.lit(0), lambda a, x: a + x["last"] - x["first"] + 1).cast("long")
    return out.select(*docs.columns, F.col(n_words_col).cast("long").alias(n_words_col), n_hit.alias(n_hit_col), hits_col, items_col)
