"""Prefix trie of conversations by the Euler-tour technique.

Every distinct sequence of first turns is a node. A node's identity is its
depth and two 64-bit keys, the running XOR of hashes of (place, turn), so
prefixes come from a scan and not from growing strings. Nodes are numbered in
the order of their parents, which makes siblings neighbours. Each node has an
arc that enters it and one that leaves it, and the arc after each is known
from its own row: the first child, the next sibling, or the parent's exit.

The tour is ranked in two steps. Within a partition (arcs of one conversation
and stretch of depths lie together) chains are contracted by local pointer
jumping; pointer jumping over the rest takes as many rounds as the logarithm
of their number. The weights that are summed along (leaves, savings) are thus
known at every arc's place, and a subtree's share is the difference between
its two arcs. No step gathers a conversation, a node's members or children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surfacewx.llm.common import drop_written, join_unique, mapped, written
from surfacewx.operators.sort import number_rows

#: Turns of a conversation that are scanned in one window.
STRETCH = 4096
#: Depths of a conversation's arcs that are ranked in one partition.
DEPTHS = 256
#: Arcs in a partition, about.
ARCS = 1 << 18
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, pos, t1, t2, size, len)`` for every row of ``df`` with a conversation:
    its place from 1, two hashes of role and text, the text's UTF-8 bytes, and
    the conversation's number of rows.

    Turns come in the order of ``turn_col``, null first; rows of equal turn in
    that of their hashes, and equal rows follow each other. Null roles and
    texts are empty. The hashes stand for the texts, which do not travel.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    told = df.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(7), text, role).alias("t2"), F.octet_length(text).cast("long").alias("size"),
    ).filter("conv IS NOT NULL")
    told = written(told.withColumn("row", F.monotonically_increasing_id()), "turns")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2"), F.col("row")]
    placed = number_rows(told.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = written(placed, "placed")
    starts = placed.groupBy("conv").agg(F.min("position").alias("start"), F.count(F.lit(1)).alias("len"))
    out = join_unique(placed, written(starts, "starts"), "conv", "len", placed.count())
    return out.select("conv", (F.col("position") - F.col("start") + 1).alias("pos"), "t1", "t2", "size", "len")


def with_borrowed_heads(turns: DataFrame, donor: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are replaced: each takes the first
    ``head`` turns (at most ``most``) of the conversation ``donor``, all if it
    has fewer, none if there is no such, then its own after its first ``head``.

    ``turns`` is what :func:`numbered_turns` gives; ``donor`` and ``head`` are
    expressions of ``conv``. Returns the turns with their new places and
    lengths, and ``(conv, len)`` of every conversation, turnless ones included.
    """
    turns = written(turns, "told")
    lens = turns.groupBy("conv").agg(F.max("len").alias("len"))
    plan = lens.select("conv", "len", donor.alias("donor"), head.cast("long").alias("head"))
    plan = plan.join(lens.toDF("donor", "there"), "donor", "left").withColumn("given", F.least("head", F.coalesce("there", F.lit(0))))
    plan = written(plan.withColumn("now", F.col("given") + F.greatest(F.col("len") - F.col("head"), F.lit(0))), "plan")
    heads = turns.filter(F.col("pos") <= most).select(F.col("conv").alias("donor"), "pos", "t1", "t2", "size")
    lent = plan.select("conv", "donor", "head", "now").join(heads, "donor").filter("pos <= head").select("conv", "pos", "t1", "t2", "size", F.col("now").alias("len"))
    own = join_unique(turns.drop("len"), plan, "conv", "len", turns.count()).filter("pos > head")
    own = own.select("conv", (F.col("given") + F.col("pos") - F.col("head")).alias("pos"), "t1", "t2", "size", F.col("now").alias("len"))
    return lent.unionByName(own), plan.select("conv", F.col("now").alias("len"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """``(conv, pos, len, size, k1, k2, p1, p2)``: each turn's prefix key and that of the prefix before it."""
    one = turns.withColumns({"h1": F.xxhash64("pos", "t1", "t2"), "h2": F.xxhash64("pos", "t2", "t1", F.lit(3)), "part": F.expr(f"(pos - 1) div {STRETCH}")})
    inside = Window.partitionBy("conv", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    scanned = one.select("conv", "pos", "len", "size", "h1", "h2", "part", F.bit_xor("h1").over(inside).alias("x1"), F.bit_xor("h2").over(inside).alias("x2"))
    # Only conversations above a stretch have a part after the first, and so need what came before.
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = one.filter(F.col("len") > STRETCH).groupBy("conv", "part").agg(F.bit_xor("h1").alias("y1"), F.bit_xor("h2").alias("y2"))
    parts = parts.select("conv", "part", F.bit_xor("y1").over(before).alias("z1"), F.bit_xor("y2").over(before).alias("z2"))
    made = scanned.join(parts, ["conv", "part"], "left")
    k1, k2 = (F.col(f"x{i}").bitwiseXOR(F.coalesce(f"z{i}", F.lit(0))) for i in (1, 2))
    return made.select("conv", "pos", "len", "size", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("h1")).alias("p1"), k2.bitwiseXOR(F.col("h2")).alias("p2"))


def _key(depth: str | Column, k1: str, k2: str) -> Column:
    return F.struct(F.col(depth).alias("d") if isinstance(depth, str) else depth.alias("d"), F.col(k1).alias("a"), F.col(k2).alias("b"))


def _nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """The numbered nodes with their children and parents."""
    key = ["pos", "k1", "k2"]
    nodes = prefixes.groupBy(*key).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("size").alias("size"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    nodes = nodes.unionByName(root.withColumns({c: zero for c in ("pos", "k1", "k2", "p1", "p2", "size")}))
    nodes = written(nodes, "nodes")
    order = ["pos", "p1", "p2", "k1", "k2"]
    nodes = number_rows(nodes.repartitionByRange(*order).sortWithinPartitions(*order), "id")
    nodes = nodes.withColumns({"key": _key("pos", "k1", "k2"), "up": _key(F.col("pos") - 1, "p1", "p2")})
    nodes = written(nodes.select("id", "key", "up", "conv_id", "n_convs", "size"), "numbered")
    kids = nodes.filter("key.d > 0").groupBy("up").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(kids.withColumnRenamed("up", "key"), "key", "left").fillna(0, ["n_children"]), "families")
    above = nodes.filter("n_children > 0").select(F.col("key").alias("up"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("first").alias("eldest"), F.col("n_children").alias("siblings"))
    known = join_unique(nodes.filter("key.d > 0"), above, "up", "siblings", nodes.count())
    none = F.lit(None).cast("long")
    alone = nodes.filter("key.d = 0").withColumns({"parent": none, "parent_conv_id": none, "eldest": none, "siblings": none})
    return written(known.unionByName(alone).drop("up"), "trie")


def _arcs(nodes: DataFrame) -> DataFrame:
    """``(arc, next, leaves, saved, owner, part)``: node v is entered by arc 2v and left by arc 2v + 1."""
    v = F.col("id")
    enter = F.when(F.col("n_children") > 0, 2 * F.col("first")).otherwise(2 * v + 1)
    last = v == F.col("eldest") + F.col("siblings") - 1
    leave = F.when(F.col("parent").isNull(), F.lit(None)).when(last, 2 * F.col("parent") + 1).otherwise(2 * v + 2)
    leaf, saved, none = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size"), F.lit(0).cast("long")
    both = F.array(
        F.struct((2 * v).alias("arc"), enter.alias("next"), leaf.alias("leaves"), saved.alias("saved")),
        F.struct((2 * v + 1).alias("arc"), leave.alias("next"), none.alias("leaves"), none.alias("saved")),
    )
    return nodes.select(F.inline(both), F.col("conv_id").alias("owner"), F.expr(f"key.d div {DEPTHS}").alias("part"))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every arc of a partition with the first arc after it that lies elsewhere and the sums up to there."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by("arc")
    arc, leaves, saved = (table.column(c).to_numpy() for c in ("arc", "leaves", "saved"))
    leaves, saved, steps = leaves.copy(), saved.copy(), np.ones(len(arc), np.int64)
    after = table.column("next").fill_null(-1).to_numpy().copy()
    while True:
        spot = np.minimum(np.searchsorted(arc, after), len(arc) - 1)
        here = np.flatnonzero(arc[spot] == after)
        if not len(here):
            break
        to = spot[here]
        # All sums of this round are read before any is changed: each arc jumps over as many as its next one knows.
        more = leaves[to], saved[to], steps[to], after[to]
        leaves[here] += more[0]
        saved[here] += more[1]
        steps[here] += more[2]
        after[here] = more[3]
    for s in range(0, len(arc), 1 << 16):
        e = s + (1 << 16)
        yield pa.RecordBatch.from_arrays([pa.array(arc[s:e]), pa.array(after[s:e], mask=after[s:e] < 0), *(pa.array(x[s:e]) for x in (steps, leaves, saved))], names=["arc", "next", "steps", "leaves", "saved"])


def _ranked(arcs: DataFrame, n_arcs: int) -> DataFrame:
    """``(arc, steps, leaves, saved)``: the sums over the tour from each arc to its end."""
    parts = max(1, -(-n_arcs // ARCS))
    chains = written(mapped(arcs.repartition(parts, "owner", "part").drop("owner", "part"), _contracted, "arc long, next long, steps long, leaves long, saved long"), "chains")
    heads = chains.join(chains.filter("next IS NOT NULL").select(F.col("next").alias("arc")).distinct(), "arc", "left_semi")
    heads = written(heads, "heads")
    sums = ["steps", "leaves", "saved"]
    while heads.filter("next IS NOT NULL").limit(1).count():
        beyond = heads.toDF("next", "then", *[f"{c}_" for c in sums])
        jumped = heads.join(beyond, "next", "left").select("arc", F.col("then").alias("next"), *[(F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in sums])
        jumped = written(jumped, "heads")
        drop_written(heads)
        heads = jumped
    beyond = heads.drop("next").toDF("next", *[f"{c}_" for c in sums])
    return chains.join(beyond, "next", "left").select("arc", *[(F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in sums])


def _digests(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of ``ends(d, a, b, conv)``: a node's ids are hashed as they stream by in order, never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for *now, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            if out:
                yield _digest_batch(out)
        if key is not None:
            yield _digest_batch([(*key, state.hexdigest())])

    dealt = ends.repartition("d", "a", "b").sortWithinPartitions("d", "a", "b", "conv")
    made = mapped(dealt, run, "d long, a long, b long, ends_sha256 string")
    return made.select(F.struct("d", "a", "b").alias("key"), "ends_sha256")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["d", "a", "b", "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of conversations, a row each.

    ``turns(conv, pos, t1, t2, size, len)`` holds the turns, ``pos`` from 1 to
    ``len``; ``convs(conv, len)`` every conversation once, turnless ones
    included. Columns: ``conv_id``, the smallest member; ``depth``;
    ``parent_conv_id``, that of the parent (null for the root); ``n_convs``,
    members; ``n_children``; ``n_leaves``, childless nodes in the subtree, the
    node included; ``saved_tokens``, the sum over the subtree of (members - 1)
    times the bytes of the last text; ``ends_sha256``, the SHA-256 of the ids
    of the members that end here, ascending, comma-joined.

    The root, without text, stands for all conversations. Without any there
    is no root, and an empty table gives an empty result. Equal conversations
    share all their nodes. Long texts count with all their bytes. Turns are
    told apart by 128 bits of hashes. The digest of a node reads its ids in
    one task, streamed, since SHA-256 is sequential.
    """
    prefixes = written(_prefixes(turns), "prefixes")
    convs = written(convs, "convs")
    nodes = _nodes(prefixes, convs)
    ranks = written(_ranked(_arcs(nodes), 2 * nodes.count()), "ranks")
    enter = ranks.filter("arc % 2 = 0").select(F.expr("arc div 2").alias("id"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    leave = ranks.filter("arc % 2 = 1").select(F.expr("arc div 2").alias("id"), F.col("leaves").alias("later"), F.col("saved").alias("later_saved"))
    zero = F.lit(0).cast("long")
    ends = prefixes.filter("pos = len").select(F.col("pos").alias("d"), F.col("k1").alias("a"), F.col("k2").alias("b"), "conv")
    ends = ends.unionByName(convs.filter("len = 0").select(zero.alias("d"), zero.alias("a"), zero.alias("b"), "conv"))
    full = nodes.join(enter, "id").join(leave, "id").join(_digests(ends), "key", "left")
    return full.select(
        "conv_id", F.col("key.d").alias("depth"), "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") - F.col("later")).alias("n_leaves"),
        (F.col("saved_tokens") - F.col("later_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
