"""The registered queries of this subpackage and their DuckDB SQL.

Each query runs an operator over its whole table with production parameters;
digest columns are derived here from the operator's outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacewx.llm import ann, bpe, chat, decontam, html, jaccard, phrases, quality, sharding, simhash, toxicity, trie, warc

VOCABULARY = "byte_bpe_50k.json"
SHARDS = [f"shard-{i:04d}" for i in range(256)]
CHAT_BUDGET, CHAT_HISTORY, CHAT_TURNS = 1024, 256, 4


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as budgeted windows, read back from the formatted text.

    The digest of a conversation needs its turns side by side, so this query,
    not the operator, gathers a conversation's windows in one row."""
    told = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    made = chat.format_windows(told.unionByName(spark.sql(planted)), CHAT_BUDGET, CHAT_HISTORY, CHAT_TURNS)
    fresh = F.slice(chat.parse_turns(F.col("formatted")), F.col("n_repeated") + 1, F.col("n_new"))
    read = made.select("conv_id", "window", fresh.alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.char_length("formatted").alias("chars"))
    one = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    one = one.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return one.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_columns(_table(spark, sf_dir, "documents"))


def bpe_columns(docs: DataFrame) -> DataFrame:
    made = bpe.encode_decode(docs, vocabulary_path(), keep=["doc_id"])
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(_table(spark, sf_dir, "pages"), min_payload=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html.extract_text(_table(spark, sf_dir, "pages"))
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = decontam.mark(docs, _table(spark, sf_dir, "benchmark"), size=10)
    return made.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, distance=3)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def graded(labels: DataFrame) -> DataFrame:
    """Graded ratings from the labels: 0 of low quality, 1 good but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2).alias("grade"))


def with_quality(docs: DataFrame, labels: DataFrame, into: tuple[str, str] = ("expected_grade", "tail_prob")) -> DataFrame:
    """``docs`` with the expected grade and the probability of not being of low quality."""
    return quality.score(docs, quality.train(docs, graded(labels), grades=3), at_least=1, into=into)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return made.select("doc_id", "expected_grade", "tail_prob", (F.col("tail_prob") >= 0.5).alias("keep"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), least=100, top=2000)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of rebuilt conversations: each begins with the first turns of the one at the multiple of five below it."""
    conv = F.col("conv")
    head = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(9))
    turns, convs = trie.with_borrowed_heads(trie.numbered_turns(_table(spark, sf_dir, "conversations")), conv - conv % 5, head, most=8)
    return trie.prefix_trie(turns, convs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_bpe_encoding, op3_warc_archives, op4_sharding, op5_toxicity, op6_html_extraction, op7_decontamination, op8_simhash, op9_nearest, op10_quality, op11_jaccard_join, op12_phrase_mining, op13_prefix_trie)
}

_CONTROL = r"([<\[])(/?s>|</?SYS>>|\|im_(?:start|sep|end)\|>|/?INST\])"
ORACLE = {
    "op1_chat_formatting": rf"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
drawn AS (
  SELECT *, '<|im_start|>' || regexp_replace(replace(role, '\', '\\'), '{_CONTROL}', '\1\\\2', 'g') || '<|im_sep|>'
    || regexp_replace(replace(text, '\', '\\'), '{_CONTROL}', '\1\\\2', 'g') || '<|im_end|>' AS shown FROM told),
priced AS (
  SELECT *, (strlen(shown) + 3) // 4 AS cost, length(shown) AS chars, row_number() OVER w AS pos,
    sum((strlen(shown) + 3) // 4) OVER w - (strlen(shown) + 3) // 4 AS sofar, first_value(role) OVER w = 'system' AS has_system,
    first_value((strlen(shown) + 3) // 4) OVER w AS lead_cost, first_value(length(shown)) OVER w AS lead_chars
  FROM drawn WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
roomy AS (
  SELECT *, has_system AND pos = 1 AS is_lead, CASE WHEN has_system THEN lead_cost ELSE 0 END AS system_cost, CASE WHEN has_system THEN lead_chars ELSE 0 END AS system_chars FROM priced),
placed AS (
  SELECT *, greatest({CHAT_BUDGET} - system_cost, 2) AS room, CASE WHEN is_lead THEN 0 ELSE sofar - system_cost END AS before_it FROM roomy),
dealt AS (SELECT *, before_it // (room // 2) AS win FROM placed),
spans AS (
  SELECT conv_id, win, min(pos) AS start, min(before_it) AS began, max(room) AS room, max(system_chars) AS system_chars,
    sum(CASE WHEN is_lead THEN 0 ELSE cost END) AS fresh, sum(chars) AS chars FROM dealt GROUP BY conv_id, win),
past AS (
  SELECT s.conv_id, s.win, sum(d.chars) AS chars FROM spans s JOIN dealt d ON s.conv_id IS NOT DISTINCT FROM d.conv_id
    AND d.pos BETWEEN s.start - {CHAT_TURNS} AND s.start - 1 AND NOT d.is_lead AND s.began - d.before_it <= least({CHAT_HISTORY}, s.room - s.fresh)
  WHERE s.win > 0 GROUP BY s.conv_id, s.win),
shown AS (
  SELECT s.conv_id, sum(7 + s.chars + coalesce(p.chars, 0) + CASE WHEN s.win > 0 THEN s.system_chars ELSE 0 END) AS formatted_chars
  FROM spans s LEFT JOIN past p ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.win = p.win GROUP BY s.conv_id),
said AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss FROM priced GROUP BY conv_id)
SELECT a.conv_id, a.n_turns, a.turns_sha256, length(a.loss) AS loss_chars, sha256(a.loss) AS loss_sha256, CAST(b.formatted_chars AS BIGINT) AS formatted_chars
FROM said a JOIN shown b ON a.conv_id IS NOT DISTINCT FROM b.conv_id""",
    "op3_warc_archives": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, unhex(sha1(payload))::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY sha1(payload)) AS lead FROM p)
SELECT page_id, payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
    + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = lead OR lead IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = lead OR lead IS NULL THEN NULL ELSE lead END AS refers_to FROM h""",
    "op7_decontamination": r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT p.r, p.n, p.s, i.item_id FROM spots p JOIN wins i ON p.n = i.n AND p.win = i.win),
hit AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS spot FROM (SELECT DISTINCT r, s, n FROM found)) GROUP BY r),
who AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (r) LEFT JOIN who USING (r)""",
    "op9_nearest": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.e, c.e)) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 20""",
    "op11_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT r, hash(array_to_string(w[s:s + 3], ' ')) AS g FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 2))) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
pairs AS (SELECT a.r AS u, b.r AS v, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN sizes a ON a.r = u JOIN sizes b ON b.r = v WHERE 100 * o >= 85 * (a.n + b.n - o)),
reach AS (SELECT r, r AS v FROM words UNION SELECT reach.r, links.v FROM reach JOIN links ON links.u = reach.v),
low AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN words ON words.r = reach.v GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM words LEFT JOIN sizes USING (r) JOIN low USING (r)""",
    "op12_phrase_mining": r"""
WITH told AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS parts FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(parts), '[^\x20\x09]+') AS w FROM told),
grams AS (
  SELECT lang, k, w[s:s + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 100),
covered AS (SELECT DISTINCT lang, part AS g, a FROM (SELECT lang, a, unnest([g[1:k - 1], g[2:k]]) AS part FROM often WHERE k > 2)),
alive AS (SELECT * FROM often o WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = o.lang AND c.g = o.g AND c.a = o.a)),
cuts AS (SELECT lang, g, a, k, c, g[1:c] AS g1, g[c + 1:k] AS g2 FROM (SELECT *, unnest(range(1, k)) AS c FROM alive)),
scored AS (
  SELECT u.lang, u.g, u.a, u.c, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * u.a * t.n // (x.f::HUGEINT * y.f)) AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.g = u.g1 JOIN f y ON y.lang = u.lang AND y.g = u.g2 JOIN totals t ON t.lang = u.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    "op13_prefix_trie": r"""
WITH told AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, octet_length(encode(coalesce(text, ''))) AS size,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL),
lens AS (SELECT c, count(*) AS len, [ascii(x) FOR x IN string_split(c::VARCHAR, '')] AS digits FROM told GROUP BY c),
plan AS (
  SELECT c, len, c - c % 5 AS donor,
    xor(list_reduce(list_concat([4294967295], flatten([[b, -1, -1, -1, -1, -1, -1, -1, -1] FOR b IN digits])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 AS h FROM lens),
given AS (SELECT p.c, p.donor, p.h, least(p.h, coalesce(d.len, 0)) AS lent, least(p.h, coalesce(d.len, 0)) + greatest(p.len - p.h, 0) AS depth FROM plan p LEFT JOIN lens d ON d.c = p.donor),
turns AS (
  SELECT g.c, t.pos, t.size, t.t FROM given g JOIN told t ON t.c = g.donor AND t.pos <= g.h
  UNION ALL SELECT g.c, g.lent + t.pos - g.h, t.size, t.t FROM given g JOIN told t ON t.c = g.c AND t.pos > g.h),
keyed AS (SELECT c, pos AS depth, size, string_agg(t, '') OVER (PARTITION BY c ORDER BY pos) AS key FROM turns),
marks AS (
  SELECT c, depth, size, sha256(key) AS key, lag(sha256(key), 1, 'root') OVER (PARTITION BY c ORDER BY depth) AS up FROM keyed
  UNION ALL SELECT c, 0, 0, 'root', NULL FROM lens),
nodes AS (SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size, max(up) AS up FROM marks GROUP BY depth, key),
kids AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.key = n.key),
sums AS (
  SELECT m.depth, m.key, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved_tokens
  FROM whole f JOIN marks m ON m.c = f.conv_id AND m.depth <= f.depth GROUP BY ALL),
ends AS (SELECT m.depth, m.key, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS ends FROM marks m JOIN given g ON g.c = m.c AND g.depth = m.depth GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM whole f JOIN sums s ON s.depth = f.depth AND s.key = f.key LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.key = f.up LEFT JOIN ends e ON e.depth = f.depth AND e.key = f.key""",
}
