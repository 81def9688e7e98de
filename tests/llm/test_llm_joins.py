"""The Jaccard join, phrase mining and the prefix trie against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfacewx.llm import jaccard, phrases, trie
from surfacewx.llm.sketch import Counts, has

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# ---- sketches and parity maps


def test_parity_maps_bound_the_difference():
    rnd = np.random.default_rng(5)
    for _ in range(50):
        base = rnd.integers(0, 1 << 63, int(rnd.integers(1, 3000)), dtype=np.uint64)
        a = np.unique(base[: max(1, int(len(base) * rnd.random()))])
        b = np.unique(np.concatenate([base[int(len(base) * rnd.random()) :], rnd.integers(0, 1 << 63, 9, dtype=np.uint64)]))
        maps = np.array([jaccard.parity(a).view(np.uint64), jaccard.parity(b).view(np.uint64), None], object)[:-1]
        bits = jaccard._differ(maps, np.array([0]), np.array([1]))[0]
        # Folding a wider map adds shingles up modulo 2 as well, so the bound holds at either width.
        assert bits <= len(np.setxor1d(a, b))


def test_prefixes_of_linked_sets_meet():
    for n in range(1, 200):
        least = next(o for o in range(n + 1) if 100 * o >= 85 * n)
        assert jaccard.prefix_size(n, 85) == n - least + 1


def test_counts_and_bit_maps():
    seen = Counts(8)
    seen.add(np.array([1, 1, 200], np.uint64))
    seen.add(np.array([1], np.uint64))
    assert len(seen.parts()) == 64 and seen.counts[1] == 3 and seen.counts[200] == 1
    bits = np.packbits(np.arange(16) % 3 == 0)
    assert has(bits, np.arange(16)).tolist() == [k % 3 == 0 for k in range(16)]


# ---- Jaccard join


def _jaccard(rows, words, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)].append(i)
    return sorted(((i, len(sets[k]), min(low[find(k)], default=None)) for k, (i, _) in enumerate(rows)), key=str)


def test_jaccard_join_against_brute_force(spark):
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(4000)}"
    common = " ".join(word() for _ in range(30))
    rows = [(None, "a b c d e f"), (5, "A b\tc D e\nf"), (6, None), (7, ""), (8, " \t\n"), (9, "one two"), (10, "One  TWO"), (11, "one"), (12, "x" * 70_000), (13, "x" * 70_000), (14, "one two"), (14, "one two")]
    base = [word() for _ in range(60)]
    for k in range(20, 90):  # near copies of one text, in all grades around the threshold
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(60)] = word()
        rows.append((k, " ".join(w)))
    rows += [(k, common + " " + " ".join(word() for _ in range(rnd.randrange(1, 40)))) for k in range(100, 140)]  # a passage that many share
    rows += [(k, " ".join(base[:40])) for k in range(200, 260)]  # a third are one text
    long = [word() for _ in range(6000)]
    rows += [(300, " ".join(long)), (301, " ".join(long[:5400])), (302, " ".join(long[:5000]))]
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, N_SHINGLES int, component_id string")
    got = sorted((tuple(r) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == _jaccard(rows, 4, 85)


def test_jaccard_join_of_an_empty_table(spark):
    out = jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


def test_a_list_in_blocks_finds_the_same_pairs():
    rnd = np.random.default_rng(3)
    n = rnd.integers(80, 120, 40)
    pos, g = rnd.integers(0, 12, 40), np.arange(40)
    low = high = rnd.integers(0, 9, 40)
    whole = {(x, y) for a, b in jaccard._tile(0, 0, g * 0, g, n, pos, low, high, 85) for x, y in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())}
    own = g % 3
    blocks = set()
    for i in range(3):
        for j in range(i, 3):
            for a, b in jaccard._tile(i, j, own, g, n, pos, low, high, 85):
                blocks |= {(x, y) for x, y in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())}
    assert whole == blocks and whole


# ---- phrases


def _collocations(rows, least, top):
    by = defaultdict(list)
    for lang, text in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER)):
            by["und" if lang is None else lang].append(re.findall(rb"[^\x20\x09]+", piece))
    out = []
    for lang, pieces in by.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, 6) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inside = {part for g, a in often.items() if len(g) > 2 for part in (g[1:], g[:-1]) if often[part] == a}
        scored = []
        for g, a in often.items():
            if g not in inside:
                score, k = min((1000 * a * n // (f[g[:c]] * f[g[c:]]), c) for c in range(1, len(g)))
                scored.append((-score, -a, b" ".join(g), f[g[:k]], f[g[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("top", [6, 5000])
def test_phrases_against_brute_force(spark, top):
    rnd = random.Random(12)
    zipf = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(30_000)]
    rows = [(None, "en de EN de. en de"), ("en", None), ("", ""), ("de", "x" * 70_000), ("en", " \t\n.,;")]
    rows += [(rnd.choice(["en", "de", "en", "en", None]), " ".join(zipf[k : k + 50])) for k in range(0, 30_000, 50)]
    rows += [("en", "New York city, Rare Pair one two three. " + " ".join(rnd.choice(["a", "b"]) for _ in range(9))) for _ in range(60)]
    rows += [("de", "de en de en! en\x0bde"), ("en", "de en de en! en\x0cde")] * 30
    df = spark.createDataFrame([(t, x, 1) for x, t in rows], "text string, lang string, SCORE int")
    got = sorted(tuple(r) for r in phrases.collocations(df, least=20, top=top).collect())
    assert got == _collocations(rows, 20, top) and got


def test_phrases_of_an_empty_table_and_exact_scores(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    rows = [(10**13, 10**14, 10**13, 10**13 + 7), (123456789, 10**12 + 1, 987654321, 123456790)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(phrases._score("a", "n", "l", "r")).collect()
    assert [r[0] for r in got] == [1000 * a * n // (x * y) for a, n, x, y in rows]


# ---- trie


def _trie(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    conv = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in conv.items()}
    made = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = conv.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += kids[p] == 0
        saved[p] += (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = {p: ",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)) for p, m in members.items()}
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()), key=str
    )


def _rebuilt(df):
    c = F.col("conv")
    return trie.with_borrowed_heads(trie.numbered_turns(df), c - c % 5, F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(9)), 8)


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 16)
    monkeypatch.setattr(trie, "DEPTHS", 8)
    monkeypatch.setattr(trie, "ARCS", 64)
    rnd = random.Random(13)
    rows = [(None, 0, "user", "lost"), (3, None, "user", "first"), (3, 0, None, None), (3, 1, "user", "é" * 5000)]
    for c in range(10, 70):  # many with the same first turns, some alike in full
        seed = random.Random(c % 4)
        n = rnd.randrange(1, 12)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"t{seed.randrange(3)}") for t in range(n)]
    rows += [(100, t, "user", f"long {t % 3}") for t in range(300)] + [(105, t, "user", f"long {t % 3}") for t in range(120)]  # a third of all rows are one conversation
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, POS int")
    turns, convs = _rebuilt(df)
    got = sorted((tuple(r) for r in trie.prefix_trie(turns, convs).collect()), key=str)
    assert got == _trie(rows)


def test_trie_of_repeated_rows_and_of_an_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    turns, convs = _rebuilt(spark.createDataFrame([], schema))
    assert trie.prefix_trie(turns, convs).count() == 0
    told = trie.numbered_turns(spark.createDataFrame([(1, 0, "user", "a")] * 3 + [(1, 1, "user", "b"), (1, 1, "user", "c")], schema)).collect()
    assert sorted(r.pos for r in told) == [1, 2, 3, 4, 5] and {r.len for r in told} == {5}
    assert len({(r.t1, r.t2) for r in told if r.pos <= 3}) == 1
