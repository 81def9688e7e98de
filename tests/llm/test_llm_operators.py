"""Each operator against a brute-force version, an exact round trip or held-out labels."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import re
import time
import zipfile
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surfacewx.llm import ann, bpe, chat, common, decontam, html, quality, queries, sharding, simhash, toxicity, warc
from surfacewx.llm.common import components, join_unique, shared_path, slices

DOC = "doc_id long, text string"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- helpers


@pytest.mark.parametrize("split_from", [1 << 20, 0])
def test_components_match_union_find(spark, monkeypatch, split_from):
    monkeypatch.setattr(common, "SPLIT_FROM", split_from)
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for u, v in edges if u != v for x in (u, v)}
    got = {r.node: r.root for r in components(table(spark, edges, "u long, v long")).collect()}
    assert got == want
    assert components(table(spark, [], "u long, v long")).count() == 0


def test_join_unique_keeps_every_row_of_a_hot_key(spark):
    rows = table(spark, [(1 if k % 3 == 0 else k, k) for k in range(3000)], "k long, x long")
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"))
    out = join_unique(rows, lookup, "k", "n", 3000)
    assert out.count() == 3000 and out.select("x").distinct().count() == 3000
    assert out.filter("k = 1").agg(F.min("low")).first()[0] == 0


def test_join_unique_keeps_rows_without_a_match_if_asked(spark):
    rows = table(spark, [(1 if k % 3 == 0 else k % 50, k) for k in range(3000)], "k long, x long")
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k < 20")
    out = join_unique(rows, lookup, "k", "n", 3000, "left")
    assert out.count() == 3000 and out.filter("n is null").count() == rows.filter("k >= 20").count()


def test_slices_bound_rows_and_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 1000, "c"] * 10})
    got = list(slices(iter([batch]), rows=7, size=1500))
    assert pa.Table.from_batches(got) == pa.Table.from_batches([batch])
    assert max(b.num_rows for b in got) <= 7 and len(got) > 6


# ---- 1 chat


def brute_windows(turns, budget, history, most):
    """Windows of one conversation by going through its turns one by one."""

    def esc(s):
        return re.sub(chat.CONTROL, lambda m: m[1] + "\\" + m[2], s.replace("\\", "\\\\"))

    shown = [(role, f"{chat.START}{esc(role)}{chat.SEP}", esc(text)) for role, text in turns]
    cost = [-(-(len((h + b).encode()) + len(chat.END)) // 4) for _, h, b in shown]
    system = shown[0][0] == "system"
    room = max(budget - (cost[0] if system else 0), 2)
    wins, at = {}, 0
    begin = []
    for k in range(len(shown)):
        begin.append(at)
        lead = system and k == 0
        wins.setdefault(0 if lead else at // (room // 2), []).append(k)
        at += 0 if lead else cost[k]
    out = []
    for w, own in sorted(wins.items()):
        past = []
        if w > 0:
            spare = min(history, room - sum(cost[k] for k in own))
            past = [k for k in range(max(own[0] - most, 1 if system else 0), own[0]) if begin[own[0]] - begin[k] <= spare]
            past = ([0] if system else []) + past
        text, spans = chat.OPEN, []
        for k in past + own:
            text += shown[k][1]
            if k in own and shown[k][0] == "assistant":
                spans.append((len(text), len(text) + len(shown[k][2])))
            text += shown[k][2] + chat.END
        out.append((w, text + chat.CLOSE, spans, len(past), len(own)))
    return out


def test_chat_windows_match_brute_force_and_read_back(spark):
    rnd = random.Random(5)
    bits = ["hello ", "</s>", "[INST]", "\\", "\\\\<s>", "<|im_end|>", "é😀\n", "<\\/s>", "word " * 20]
    talks = {}
    for c in range(25):
        roles = (["system"] if c % 2 else []) + [["user", "assistant"][k % 2] for k in range(rnd.randrange(1, 14))]
        talks[c] = [(r, "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 8)))) for r in roles]
    talks[99] = [("user" if k % 2 else "assistant", f"t{k}") for k in range(700)]  # several chunks of turn numbers
    rows = [(c, k, r, t, "x") for c, talk in talks.items() for k, (r, t) in enumerate(talk)]
    made = chat.format_windows(table(spark, rows, "conv_id long, turn long, role string, text string, window string"), 60, 20, 3)
    made = made.select("*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for c, talk in talks.items():
        got = sorted((r for r in made if r.conv_id == c), key=lambda r: r.window)
        assert [(r.window, r.formatted, [tuple(s) for s in r.loss_spans], r.n_repeated, r.n_new) for r in got] == brute_windows(talk, 60, 20, 3)
        assert [tuple(t) for r in got for t in r.turns[r.n_repeated :]] == talk
        assert "".join(r.loss for r in got) == "".join(t for r, t in talk if r == "assistant")
    assert len([r for r in made if r.conv_id == 99]) > 10 and any(r.n_repeated for r in made)


def test_chat_nulls_ties_and_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 0, "user", None), (None, None, None, "first"), (1, 3, "user", "b"), (1, 3, "user", "a"), (1, 3, "user", "a")]
    made = chat.format_windows(table(spark, rows, schema)).select("conv_id", chat.parse_turns(F.col("formatted")).alias("t")).collect()
    got = {r.conv_id: [tuple(x) for x in r.t] for r in made}
    assert got == {None: [("", "first"), ("user", "")], 1: [("user", "a"), ("user", "a"), ("user", "b")]}
    assert chat.format_windows(table(spark, [], schema)).count() == 0


def test_one_conversation_of_null_turns_is_dealt_to_many_chunks(spark, monkeypatch):
    """A third of the rows and more in one conversation, all with a null turn number."""
    told = [(None, None, "user", f"text {k:04d}") for k in range(600)] + [(k, 1, "user", "x") for k in range(900)]
    tables, before = {}, spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    monkeypatch.setattr(chat, "written", lambda df, name: tables.setdefault(name, common.written(df, name)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = chat.format_windows(table(spark, told, "conv_id long, turn long, role string, text string"), 60, 20, 3).filter("conv_id is null").orderBy("window").collect()
        most = tables["ranges"].groupBy("conv", "chunk").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert most <= 450  # of 600: range partitions hold about 1500 / 8 rows
    talk = [("user", f"text {k:04d}") for k in range(600)]
    assert [(r.window, r.formatted, [tuple(s) for s in r.loss_spans], r.n_repeated, r.n_new) for r in made] == brute_windows(talk, 60, 20, 3)


def test_chat_query_runs_no_python(spark, sf_small):
    plan = queries.op1_chat_formatting(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- 2 BPE


@pytest.fixture(scope="module")
def vocabulary():
    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def test_bpe_equals_the_library(vocabulary):
    library = Tokenizer.from_file(queries.vocabulary_path())
    rnd = random.Random(1)
    letters = "  \t\n\r\x1c\x1f\x85 　aabcdeETé日本語😀'’123٣!?\x00​﻿²Ⅷ"
    bits = ["the", " in", "ing", "'s", "<|endoftext|>", "\n\n", " ", "ZZ", "12", "é", "<|endoftext", "tion", "tation"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["".join(rnd.choice(bits) for _ in range(30)) for _ in range(1500)]
    texts += ["", "a" * 50_000, "<|endoftext|>" * 3, " " * 2000, "don't I'LL we've", "0123456789abcdef" * 4000]
    ids = vocabulary.encode(texts)
    for text, got, want in zip(texts, ids, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got == np.array(want.ids, "<u4").tobytes(), text[:50]
        assert vocabulary.decode(got) == text
    broken = np.array([rnd.randrange(50257) for _ in range(2000)], "<u4")  # not the encoding of anything
    assert vocabulary.decode(broken.tobytes()) == library.decode(broken.tolist(), skip_special_tokens=False)


def test_long_words_do_not_stay(vocabulary):
    rnd = random.Random(2)
    long = ["".join(rnd.choice("abcdefgh") for _ in range(200_000)) for _ in range(60)]
    want = [vocabulary.encode([x])[0] for x in long[:2]]
    for x in long:
        vocabulary.encode([x])
    assert sum(map(len, vocabulary.words)) <= bpe.CACHED_CHARS + 400_000 and [vocabulary.encode([x])[0] for x in long[:2]] == want
    words = toxicity.Words()
    first = toxicity.hashed(["a short text", long[0]], words)
    for x in long:
        toxicity.hashed([x], words)
    assert sum(map(len, words)) == words.held <= toxicity.CACHED_BYTES + 200_000
    again = toxicity.hashed(["a short text", long[0]], words)
    assert all((a == b).all() for a, b in zip(first, again, strict=True))


def test_bpe_rows(spark):
    df = table(spark, [(1, None, 5), (2, "", 6), (3, "same text", 7), (3, "same text", 7)], "doc_id long, text string, ids int")
    got = bpe.encode_decode(df, queries.vocabulary_path()).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in got) == [(1, 0, ""), (2, 0, ""), (3, 2, "same text"), (3, 2, "same text")]
    assert bpe.encode_decode(df.limit(0), queries.vocabulary_path()).count() == 0


# ---- 3 WARC


def test_archives_round_trip(spark):
    rows = [(k, f"http://a.org/{k}", ["<p>one</p>", "é" * 5000, ""][k % 3]) for k in range(1, 40)]
    rows += [(None, None, "<p>one</p>"), (90, "http://x\r\ny", None), (1, "http://a.org/again", "é" * 5000), (95, "u", "alone")]
    df = table(spark, [(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    manifest = warc.write_archives(df, shared_path(spark, "warc"), archive_bytes=20_000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(manifest, payloads=True).collect()
    first = {}
    for page, _, text in rows:
        first[text or ""] = min(x for x in (first.get(text or ""), page) if x is not None) if page is not None or text in first else None
    first["<p>one</p>"] = 3
    assert len(got) == len(rows)
    for r in got:
        same = [t or "" for p, _, t in rows if p == r.page_id and len((t or "").encode()) == r.payload_bytes]
        assert same and r.payload_digest == warc.payload_digest(same[0].encode())
        head = first[same[0]]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == head else ("revisit", head))
        assert r.payload == (same[0].encode() if r.record_type == "response" else None)
    low = warc.read_archives(warc.write_archives(df, shared_path(spark, "warc"), min_payload=11)).filter("record_type = 'revisit'")
    assert {r.payload_bytes for r in low.collect()} == {10_000}
    assert warc.archive_pages(df.limit(0)).count() == 0


def reader(content):
    return warc.StoredZip(lambda at, n: content[at : at + n], len(content))


def test_zip_directories_of_both_kinds(monkeypatch):
    content = warc.pack([(k, warc.record(k, "u", b"x" * k, None, False, "d")) for k in range(5)])
    z = reader(content)
    assert set(z.members) == {warc.DATA, warc.INDEX, warc.PACKAGE}
    start, length = z.range_of(warc.DATA)
    with zipfile.ZipFile(io.BytesIO(content)) as own:
        assert own.read(warc.DATA) == content[start : start + length] and own.read(warc.INDEX) == z.read(warc.INDEX)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)  # writes sizes, offsets and end records of 64 bits
    large = warc.pack([(k, warc.record(k, "u", b"x" * k, None, False, "d")) for k in range(5)])
    assert warc.END64_SIGN in large and reader(large).read(warc.INDEX) == z.read(warc.INDEX)
    assert warc.parse_record(gzip.decompress(reader(large).read(warc.DATA)))["page_id"] == 0
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr(warc.DATA, b"a" * 1000)
        f.comment = b"PK\x05\x06 a comment that looks like an end record"
    with pytest.raises(ValueError, match="not stored"):
        reader(out.getvalue()).read(warc.DATA)
    with pytest.raises(ValueError, match="no end record"):
        reader(content[:-5])


# ---- 4 sharding


def test_lookup_table_is_filled_in_turns():
    names = [f"s{k}" for k in range(7)]
    got = sharding.lookup_table(names, 101)
    # Brute force: each shard's whole order of slots, and turns over sets of free slots.
    orders = []
    for s in names:
        offset, step = sharding._draw(s, "offset") % 101, sharding._draw(s, "step") % 100 + 1
        orders.append([(offset + j * step) % 101 for j in range(101)])
    want, free = [None] * 101, set(range(101))
    for turn in range(101):
        slot = next(x for x in orders[turn % 7] if x in free)
        free.remove(slot)
        want[slot] = turn % 7
    assert got == want
    counts = np.bincount(sharding.lookup_table(names, 65537))
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 65537)
    moved = sum(a != b for a, b in zip(sharding.lookup_table(names, 65537), fewer, strict=True) if a != 6) / 65537
    assert moved < 0.15  # most rows of the shards that stay, stay
    for bad in ((names, 100), (["a", "a"], 101), ([], 101), (names, 5)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_columns_named_like_the_new_ones_in_another_case(spark):
    df = table(spark, [(1, "a b", "x", 7), (2, None, "y", 8)], "doc_id long, Text string, Slot string, N_TOKENS int")
    placed = sharding.place(df, ["s1", "s2"], key_cols=["slot"])
    assert placed.columns == ["doc_id", "Text", "N_TOKENS", "slot", "shard"]
    assert dict(placed.dtypes)["slot"] == "int" and placed.count() == 2
    want = df.select(F.pmod(F.xxhash64("Slot"), F.lit(sharding.SLOTS)).cast("int")).collect()
    assert sorted(r.slot for r in placed.collect()) == sorted(r[0] for r in want)
    assert sharding.place(df.limit(0), ["s1"]).count() == 0
    coded = bpe.encode_decode(df, queries.vocabulary_path(), text_col="text")
    assert coded.columns == ["doc_id", "Slot", "n_tokens", "ids", "decoded"]
    assert [r.decoded for r in coded.orderBy("doc_id").collect()] == ["a b", ""]
    dotted = df.withColumnRenamed("Slot", "a.b")
    assert sharding.place(dotted, ["s1"]).columns[2] == "a.b"
    model = toxicity.Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    assert [r.score for r in toxicity.score(df, model).collect()] == [0.5, 0.5]
    graded = quality.score(df, quality.fit([], 3))
    assert graded.columns == [*df.columns, "expected_grade", "tail_prob"] and graded.count() == 2


def test_placement(spark, tmp_path):
    df = table(spark, [(k % 50 if k % 7 else None, "old", k) for k in range(500)], "doc_id long, shard string, x long")
    names = ["a", "b", "c"]
    placed = sharding.place(df, names, slots=101)
    rows = placed.collect()
    assert placed.columns == ["doc_id", "x", "slot", "shard"] and len(rows) == 500
    owner = sharding.lookup_table(names, 101)
    assert all(r.shard == names[owner[r.slot]] for r in rows)
    assert len({(r.doc_id, r.slot) for r in rows}) == len({r.doc_id for r in rows})
    assert "BroadcastHashJoin" in placed._jdf.queryExecution().executedPlan().toString()
    sharding.write_shards(placed, str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500
    assert sharding.place(df.limit(0), names).count() == 0


# ---- 5 toxicity


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    made = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in made)
    good = [r.score for r in made if r.toxic == 0]
    bad = [r.score for r in made if r.toxic == 1]
    auc = np.mean([[b > g for g in good] for b in bad])
    assert auc > 0.95 and np.mean([s >= toxicity.THRESHOLD for s in good]) < 0.005 and np.mean([s >= toxicity.THRESHOLD for s in bad]) > 0.65


def test_toxicity_model_is_sparse_and_takes_any_text(spark):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(30)) + (" nasty" if k % 4 == 0 else ""), k % 4 == 0) for k in range(600)]
    docs = table(spark, [(k, t, "s", 9.0) for k, t, _ in rows] + [(None, None, "s", 1.0), (700, "", "s", 1.0), (701, "nasty " * 50_000, "s", 1.0)], "doc_id long, text string, lang string, score double")
    labels = table(spark, [(k, int(y)) for k, _, y in rows] + [(5, None), (None, 1), (6, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert 0 < len(model.index) < 200
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[701] > 0.7 and got[None] == got[700] < 0.5 and all((got[k] >= 0.7) == y for k, _, y in rows)
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


# ---- 6 page text


def test_common_subsequence():
    def length(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    rnd = np.random.default_rng(0)
    for _ in range(300):
        a, b = (rnd.integers(0, 6, rnd.integers(0, 25)).astype(np.uint64) for _ in range(2))
        mask = html.shared(a, b)
        kept, at = a[mask].tolist(), iter(b.tolist())
        assert all(x in at for x in kept) and len(kept) == length(a, b)


def test_common_subsequence_of_long_pages():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 50, 6000).astype(np.uint64)
    b = np.delete(a, rnd.choice(6000, 1500, replace=False))
    assert html.shared(a, b).sum() == len(b)  # beyond the table size, split in halves


PAGE = "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li>Menu<li>Home</ul></nav>"


def test_page_text(spark):
    def page(body):
        return PAGE + body + "<footer>&copy; us</footer></body></html>"

    rows = [
        (1, "http://a.org/1", page("<article><h1>One &amp; only</h1><p>Some  <b>bold</b>er\ntext<br>next<p>quoted line</article>")),
        (2, "http://a.org/2", page("<article><h1>Two</h1><p>quoted line</p><div class='comments'>me first</div><aside>x</aside></article><p>outside</p>")),
        (3, "http://b.org/x/1", page("<div>Shared top</div><p>first own<p>more own<div>Shared end</div>")),
        (4, "http://b.org/x/2", page("<div>Shared top</div><p>second own<div>Shared end</div>")),
        (5, "http://c.org/", page("<div>alone on its host</div>")),
        (6, None, None), (7, "http://a.org/7", ""), (8, "no url", "plain &lt; text"), (8, "no url", "plain &lt; text"),
        (9, "http://d.org/", "<article><p>cut off &am"), (10, "http://d.org/2", "<p>deep " + "<div>" * 3000 + "end"),
    ]
    df = table(spark, [(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    want = {1: "One & only Some bolder text next quoted line", 2: "Two quoted line", 3: "first own more own", 4: "second own", 5: "alone on its host", 6: "", 7: "", 9: "cut off &am", 10: "deep end"}
    got = [tuple(r) for r in html.extract_text(df).collect()]
    assert {k: t for k, _, t in got if k != 8} == want and len(got) == len(rows)
    assert {(k, u) for k, u, _ in got} == {(k, u) for k, u, _ in rows}
    assert html.extract_text(df.limit(0)).count() == 0


def test_page_text_of_copies_and_near_copies(spark, monkeypatch):
    story = [f"a sentence of the story, the {k}th" for k in range(20)]

    def page(own, *more):
        return "".join(f"<p>{x}</p>" for x in ["Top of site", *own, *more, "End of site"])

    rows = [(0, "http://s.org/a", page(["first one"]))]
    rows += [(k, f"http://s.org/m?v={k:02d}", page(story, *[f"seen {k}"] * (k % 2))) for k in range(1, 40)]
    rows += [(40, "http://s.org/z", page(["last one"])), (41, "http://t.org/7", "<p>twice here</p>"), (42, "http://t.org/7?utm_source=feed", "<p>twice here</p>"), (43, "no url", "plain"), (43, "no url", "plain")]
    want = sorted([(0, "first one"), (40, "last one"), (41, "twice here"), (42, "twice here"), (43, "plain"), (43, "plain")] + [(k, " ".join(story + [f"seen {k}"] * (k % 2))) for k in range(1, 40)])
    df = table(spark, rows, "page_id long, url string, html string")
    for size in (2000, 7, 2):
        monkeypatch.setattr(html, "ROWS_PER_RANGE", size)
        assert sorted((r.page_id, r.text) for r in html.extract_text(df).collect()) == want


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='layout has-sidebar'><article>own</article></div>", "own"),
        ("<div class='post comments-open'><article>own</article></div>", "own"),
        ("<form id=aspnet><ul class=menu><li>Home</ul><article>own</article></form>", "own"),
        ("<div class=sidebar><article>own</article></div>", "own"),
        ("<div class=banner><main>own<nav>go</nav></main></div>", "own"),
        ("<article><div class='entry-header'>title</div><div class=header>lead</div>own</article>", "title lead own"),
        ("<article>own<form>mail me</form><div id=comments><article>me first</article></div></article><div class='related'><article>teaser</article></div>", "own"),
        ("<main>own<form>mail me</form></main><aside><article>x</article></aside><nav><form><main>y</main></form></nav>", "own"),
    ],
)
def test_article_inside_wrappers(page, text):
    assert [x for x, f in html.page_lines(page) if f == html.TEXT] == text.split()


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a <![foo]> b", "a b"),
        ("<p>a <![ b", "a"),
        ("<p>a <![ b> c <![]> d", "a c d"),
        ("<p>a <![if !IE]>b<![endif]> <![CDATA[x]]>c", "a b c"),
        ("<p>a <![cdata", "a"),
        ("<p>a <![ if]> b", "a b"),
        ("<p>a <![cdata-x[ b ]> c <![1]> d <!x> e", "a c d e"),
        ("<p>a &#" + "9" * 5000 + "; b &#" + "0" * 5000 + "65; c", "a \ufffd b A c"),
    ],
)
def test_malformed_pages(page, text):
    assert " ".join(x for x, _ in html.page_lines(page)) == text


@pytest.mark.parametrize(
    "start, unit, end",
    [
        ("", "<a ", ""),
        ("", "<a ", ">"),
        ("", "<!--", ""),
        ("", "<!--x>", ""),
        ("", "<!--", "--!>"),
        ("", "<![cdata[ x>", "]>"),
        ("", "<![if x>", ""),
        ("", "<a x='\">", ""),
        ("", "</", ""),
        ("", "<?", ""),
        ("", "&#", ""),
        ("<script>", "</", ">"),
        ("<span>" * 60_000, "<h2>x</h2>", ""),
        ("<li><div>" + "<span>" * 60_000, "<li>x</li>", ""),
        ("<td><table>" + "<b>" * 60_000, "</td>", ""),
    ],
)
def test_a_page_of_a_megabyte_takes_seconds(start, unit, end):
    page = start + unit * (-(-(1 << 20) // len(unit))) + end
    before = time.process_time()
    html.page_lines(page)
    assert time.process_time() - before < 20


def test_open_elements_are_found_as_by_a_walk():
    class Walk(html.Lines):
        def end(self, tags, stop):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in tags:
                    outside = self.open[i - 1][1:] if i else (False, 0, 0)
                    if self.state() != outside or any(x[0] in html.BLOCKS for x in self.open[i:]):
                        self.cut()
                    while len(self.open) > i:
                        self.at[self.open.pop()[0]].pop()
                    return
                if self.open[i][0] in stop:
                    return

    rnd = random.Random(5)
    tags = ["p", "div", "li", "ul", "td", "tr", "table", "span", "b", "article", "nav", "dt", "dd", "button", "form"]
    for _ in range(400):
        page = "".join(rnd.choice([f"<{t}>", f"</{t}>", f"w{k} "]) for k in range(60) for t in [rnd.choice(tags)])
        got = []
        for kind in (html.Lines, Walk):
            parser = kind()
            parser.feed(page)
            parser.close()
            parser.cut()
            got.append((parser.lines, parser.open))
        assert got[0] == got[1], page


def test_markup_decides_where_there_is_an_article():
    page = "<article><p>own</p><p>quoted</p></article><p>outside</p>"
    flags = np.array([f for _, f in html.page_lines(page)], np.uint8)
    assert flags.tolist() == [html.TEXT, html.TEXT, html.LOOSE]
    hashes = (np.arange(1, 4, dtype=np.uint64) << np.uint64(16) | np.uint64(5)).tobytes()
    one = html.Page(hashes, np.where(flags == html.TEXT, flags, html.CHROME_LINE).astype(np.uint8).tobytes(), ["own", "quoted"])
    other = html.Page(np.array([9 << 16 | 5, 2 << 16 | 5, 8 << 16 | 5, 7 << 16 | 5], np.uint64).tobytes(), bytes(4), list("abcd"))
    assert one.without([other]).lines == ["own", "quoted"]
    assert "markup replaces" in html.__doc__


def test_page_text_does_not_depend_on_the_cuts(spark, monkeypatch):
    rows = [(k, f"http://{'hot' if k % 3 else 'h%d' % (k % 9)}.org/{k // 2}", f"<div>top {k // 8}</div><p>own {k}</p><p>pair {k // 4}</p>") for k in range(300)]
    df = table(spark, rows, "page_id long, url string, html string")
    whole = {tuple(r) for r in html.extract_text(df).collect()}
    monkeypatch.setattr(html, "ROWS_PER_RANGE", 11)
    assert {tuple(r) for r in html.extract_text(df).collect()} == whole
    # Brute force: neighbours in the order of host, path and id.
    lines = {k: [x for x, _ in html.page_lines(h)] for k, _, h in rows}
    order = sorted(rows, key=lambda r: (r[1].split("/")[2], "/" + r[1].split("/", 3)[3], f"{r[0]:020d}"))
    for i, (k, u, _) in enumerate(order):
        near = [order[j] for j in (i - 1, i + 1) if 0 <= j < len(order) and order[j][1].split("/")[2] == u.split("/")[2]]
        gone = {x for n in near for x in lines[n[0]]} & set(lines[k])
        assert (k, u, " ".join(x for x in lines[k] if x not in gone)) in whole


# ---- 7 decontamination


def brute_hits(text, items, size=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, who = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        for s in range(max(1, len(w) - size + 1) if w else 0):
            win = w[s : s + size]
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    who.add(item)
    return len(words), len(hit), sorted(map(str, who))


@pytest.mark.parametrize(("block", "listed"), [(200_000, 64), (3, 64), (200_000, 1), (5, 0)])
def test_decontamination_matches_brute_force(spark, block, listed):
    rnd = random.Random(4)
    vocab = ["a", "b", "the", "É", "x1", "Zed"]

    def say(n):
        return "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "--"]) for _ in range(n))

    items = [(k, say(rnd.choice([1, 2, 4, 9, 10, 11, 14]))) for k in range(14)] + [(50, None), (51, "..."), (3, say(12)), (60, "a a a a a a a a a a a a")]
    docs = [(k, say(rnd.randrange(0, 60)) + (items[k % 14][1] if k % 2 else "") + say(5), "h") for k in range(40)] + [(100, None, "h"), (101, "", "h"), (102, "a " * 300, "h"), (None, items[0][1], "h")]
    made = decontam.mark(table(spark, docs, "doc_id long, text string, hits string"), table(spark, items, "item_id long, text string"), block_windows=block, window_items=listed)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in made.collect()}
    assert got == {k: brute_hits(t, items) for k, t, _ in docs}
    if (block, listed) == (200_000, 64):
        none = decontam.mark(made.select("doc_id", "text"), table(spark, [], "item_id long, text string"))
        assert none.agg(F.sum("n_hit")).first()[0] == 0
        assert decontam.mark(made.limit(0).select("doc_id", "text"), table(spark, items, "item_id long, text string")).count() == 0


# ---- 8 SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint():
    rnd = random.Random(6)
    for text in [None, "", " \n", "One", "one two", "one two three", "a\x85b c\xa0d e f\x1cg", *(" ".join(rnd.choice("abcdE") for _ in range(rnd.randrange(40))) for _ in range(100))]:
        assert int.from_bytes(simhash.fingerprint(text), "big") == brute_fingerprint(text)


def test_index_sets_meet_every_pair():
    from itertools import combinations

    for distance in range(8):
        for groups in (1, 2):
            sets = [set(s) for s in simhash.index_sets(8 - distance, groups)]
            assert all(any(s <= set(c) for s in sets) for c in combinations(range(8), 8 - distance))


@pytest.mark.parametrize(("block", "wide"), [(4096, 1 << 26), (16, 1 << 26), (4096, 10)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, block, wide):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "WIDE_INDEX", wide)
    rnd = random.Random(7)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:40]:
        for _ in range(8):
            fps.add(f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 7))))
    base = rnd.getrandbits(64)
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash.links(table(spark, [(signed(f),) for f in fps], "fp long"), len(fps)).collect()
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 3 for r in found)
    got = {f: f for f in fps}

    def find2(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in found:
        x, y = find2(r.u % 2**64), find2(r.v % 2**64)
        got[max(x, y)] = min(x, y)
    assert {f: find2(f) for f in fps} == {f: find(f) for f in fps}


def test_only_pairs_that_reach_the_tally_are_verified():
    rnd = np.random.default_rng(5)
    a = rnd.integers(0, 3, (300, 8), dtype=np.uint8)  # bytes of three values: many pairs share some, few share five
    b = rnd.integers(0, 3, (200, 8), dtype=np.uint8)
    left, right = (x.copy().view(np.uint64).ravel() for x in (a, b))
    want = [(i, j) for i in range(300) for j in range(200) if (a[i] == b[j]).sum() >= 5]
    got = [(int(i), int(j)) for x, y in simhash.tallied(left, right, False, 5) for i, j in zip(x, y, strict=True)]
    assert got == want and 0 < len(got) < 300 * 200 / 5
    own = [(int(i), int(j)) for x, y in simhash.tallied(left, left, True, 5) for i, j in zip(x, y, strict=True)]
    assert own == [(i, j) for i in range(300) for j in range(i + 1, 300) if (a[i] == a[j]).sum() >= 5]


def test_distances_are_taken_of_tallied_pairs_alone(monkeypatch):
    rnd = np.random.default_rng(6)
    fps = np.unique(rnd.integers(0, 1 << 63, 400, dtype=np.uint64) & np.uint64(0xFFFFFF))  # all share five bytes of zeros
    many = np.unique(rnd.integers(0, 1 << 63, 400, dtype=np.uint64))  # hardly any pair shares five
    sizes = []
    count = np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: sizes.append(x.size) or count(x))
    first = np.zeros(256, np.int64)
    for x in (fps, many):
        list(simhash._links(x, x, True, 0, first, 5, 3))
    assert sizes == [len(fps) * (len(fps) - 1) // 2, 0]


@pytest.mark.parametrize("words", [1 << 21, 0])
def test_what_stays_by_bit_map_or_by_join(spark, monkeypatch, words):
    monkeypatch.setattr(simhash, "MAP_WORDS", words)
    rows = [(k, f"alpha beta gamma delta text number {k % 90}", "x") for k in range(400)] + [(7, "alpha beta gamma delta text number 7", "y")]
    df = table(spark, rows, "doc_id long, text string, simhash_row string").repartition(5)
    want = {r.component_id for r in simhash.near_duplicates(df).collect()}
    kept = simhash.keep_one(df)
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got) == sorted(want) and kept.columns == df.columns
    if words:
        assert "SortMergeJoin" not in kept._jdf.queryExecution().toString()


def test_near_duplicates_and_what_stays(spark):
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(5, long), (3, long + " more"), (9, "short"), (10, None), (11, ""), (3, long + " more"), (None, "short"), (20, "quite another text of some words"), (12, "  \n"), (7, long.upper())]
    df = table(spark, [(*r, "x") for r in rows], "doc_id long, text string, fp string")
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in found}
    assert all(int(f, 16) in {brute_fingerprint(t) for d, t in rows if d == k} for k, f in got)
    comp = {k: c for (k, _), c in got.items()}
    assert comp == {5: 3, 3: 3, 7: 3, 9: 9, None: 9, 10: 10, 11: 10, 12: 10, 20: 20}
    kept = simhash.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9, 10, 20] and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


# ---- 9 nearest neighbours


def test_queries_of_one_id_are_dealt_to_many_chunks(spark):
    rnd = np.random.default_rng(1)
    same = [(0, [1.0, 2.0, 3.0])] * 500
    rows = [(0, rnd.normal(size=3).tolist()) for _ in range(2000)] + same + [(k, rnd.normal(size=3).tolist()) for k in range(1, 400)]
    df = table(spark, rows, "vec_id long, embedding array<double>")
    dealt = df.filter("vec_id = 0").selectExpr("vec_id id", "embedding v").distinct().groupBy(ann.chunk_of(20)).count().collect()
    assert len(dealt) == 20 and max(r[1] for r in dealt) < 200
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, k=5, query_chunk=100).collect()}
    best = sorted((-max(float(ann.products(np.array([v]), np.array([w]))[0]) for i, v in rows if i == 0), k) for k, w in rows if k)[:5]
    assert [got[0, n] for n in range(1, 6)] == [(k, -s) for s, k in best]


def test_bounds_hold():
    rnd = np.random.default_rng(0)
    for scale in (1e-30, 1.0, 1e30):
        q, x = ann.Block(np.arange(30), rnd.normal(size=(30, 64)) * scale), ann.Block(np.arange(200), rnd.normal(size=(200, 64)))
        low, high = ann.tile(q, x)
        exact = q.vectors @ x.vectors.T
        assert (low <= exact).all() and (exact <= high).all() and (high - low).max() < 0.1 * np.abs(exact).max() + 1e-300


@pytest.mark.parametrize("chunk", [8192, 4])
def test_search_matches_brute_force(spark, chunk):
    rnd = np.random.default_rng(3)
    vecs = {k: rnd.normal(size=8).astype(np.float32).tolist() for k in range(300)}
    for k in range(40, 140):
        vecs[k] = vecs[40]  # many equal vectors: ties go to the smaller id
    odd = {300: None, 320: [0.0] * 8, 340: [float("nan")] * 8, 360: [1.0] * 7 + [None], 380: [float("inf")] * 8, 400: [], 420: [1.0, 2.0], 421: [3.0, 1.0]}
    rows = list((vecs | odd).items()) + [(7, vecs[7]), (20, vecs[20]), (None, vecs[1])]
    df = table(spark, [(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in ann.search(df, query_chunk=chunk).collect())
    want = []
    for q, v in vecs.items():
        if q % 20 == 0:
            all_ = sorted((-float(ann.products(np.array([v], float), np.array([w], float))[0]), k) for k, w in vecs.items() if k != q)
            want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(all_[:20])]
    want += [(420, 1, 421, 5.0)]
    assert got == sorted(want)
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.filter("vec_id = 3")).count() == 0


# ---- 10 quality


def test_quality_on_held_out_ratings(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, queries.graded(labels.filter(~toxicity.held_out(F.col("doc_id")))), grades=3)
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality.score(docs, model).join(labels.filter(toxicity.held_out(F.col("doc_id"))), "doc_id").collect()
    good, bad = ([r.tail_prob >= 0.5 for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05
    assert np.mean([r.expected_grade for r in rows if r.quality == 1]) > 1.5


def test_cumulative_links_on_four_grades():
    rnd = np.random.default_rng(0)
    rows = []
    for _ in range(3000):
        x = rnd.normal(size=3)
        f = 2 * x[0] - x[1] + rnd.logistic()
        rows.append((np.arange(3), x, int(np.searchsorted([-2.0, 0.0, 2.0], f))))
    model = quality.fit(rows, 4, epochs=20)
    assert np.allclose(model.weights[:3], [2, -1, 0], atol=0.25) and np.allclose(model.thresholds, [-2, 0, 2], atol=0.3)
    tails = model.tails(*rows[0][:2])
    assert (np.diff(tails) < 0).all()


def test_quality_takes_any_text(spark):
    docs = table(spark, [(1, "good words here", "t"), (2, "!!! ### $$$", "t"), (3, None, "t"), (4, "", "t"), (4, "", "t"), (5, "word " * 100_000, "t")], "doc_id long, text string, tail_prob string")
    ratings = table(spark, [(1, 1), (2, 0), (None, 1), (4, 9), (2, None)], "doc_id long, grade int")
    got = [(r.doc_id, r.tail_prob) for r in quality.score(docs, quality.train(docs, ratings, grades=2)).collect()]
    prob = dict(got)
    assert len(got) == 6 and prob[1] > prob[3] == prob[4] > prob[2]
    assert quality.score(docs.limit(0), quality.train(docs, ratings.limit(0), grades=3)).count() == 0


def test_quality_reads_whole_words():
    rnd = random.Random(5)

    def text(signs):
        return "\u6c49\u5b57" * rnd.randrange(40, 60) + "".join(rnd.choice("abcdefgh") + rnd.choice(signs) for _ in range(400))

    made = [(*quality.features(text(s), quality._Words()), g) for _ in range(60) for g, s in enumerate(("#0%&", "\u3002\uff0c.,"))]
    model = quality.fit(made[:80], 2)
    assert all((model.tails(i, v)[0] > 0.5) == g for i, v, g in made[80:])
    short = "Short words, as before: 64 " + "x" * 64
    assert len(quality.features(short, quality._Words())[0]) == len(quality.features(short + " ", quality._Words())[0]) < len(quality.features(short + "y#1", quality._Words())[0])


def test_fits_leave_out_labels_without_documents(spark):
    docs = table(spark, [(k, "fine words" if k % 2 else "nasty ### words") for k in range(9000, 9060)], DOC)
    labels = table(spark, [(k, k % 2, 1 - k % 2) for k in range(10_000)], "doc_id long, grade int, toxic int")
    here = labels.filter("doc_id >= 9000 and doc_id < 9060")
    some, all_ = (toxicity.train(docs, x, fit_rows=100) for x in (labels, here))
    assert len(some.index) and some.index.tolist() == all_.index.tolist() and some.weight.tolist() == all_.weight.tolist()
    some, all_ = (quality.train(docs, x, grades=2, fit_rows=100) for x in (labels, here))
    assert some.weights.any() and some.weights.tolist() == all_.weights.tolist() and some.thresholds.tolist() == all_.thresholds.tolist()


def test_digest_columns(spark, sf_small):
    rows = {r.conv_id: r for r in queries.op1_chat_formatting(spark, sf_small).collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len(said) and rows[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
