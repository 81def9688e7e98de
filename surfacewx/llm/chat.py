"""Chat formatting into budgeted windows, in DataFrame functions only.

Turns are rendered as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and windows
as ``<s>`` turns ``</s>``. Control strings inside roles and texts (those of
this template and of other common ones) are escaped: backslashes double, and
a backslash goes behind a control string's first character, so that no
marker can come out of a text; dropping the escape from each backslash pair
gives the text back.

A turn costs a quarter of its rendered bytes, rounded up, in tokens. Prefix
sums of the costs choose the windows: with ``room``, the budget less the
leading system turn, a turn whose prefix sum is in the i-th half-room belongs
to window i. So windows are aligned to turns, and a window exceeds the room
only by a turn that is itself longer than half of it. Later windows repeat the
system turn and, where room is left, up to ``history_turns`` turns before
them; what is repeated is outside the loss mask.

Prefix sums are taken within chunks, which are ranges of rows in the order of
the turns, and over chunks, so a conversation that holds much of the table is
dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surfacewx.llm.common import written

START, SEP, END, OPEN, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>"
#: First character and rest of every control string.
CONTROL = r"([<\[])(/?s>|</?SYS>>|\|im_(?:start|sep|end)\|>|/?INST\])"
#: Characters of a role or text that take part in dealing rows to chunks.
DEALT = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def parse_turns(formatted: Column) -> Column:
    """The turns of a window as ``array<struct<role, text>>``, unescaped."""
    body = F.substring(formatted, F.lit(len(OPEN) + 1), F.char_length(formatted) - len(OPEN) - len(CLOSE))
    pieces = F.split(body, r"<\|im_end\|>")
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    both = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|im_sep\|>"))
    return F.transform(both, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")


def format_windows(turns: DataFrame, budget: int = 1024, history_tokens: int = 256, history_turns: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_col, window, formatted, loss_spans, n_repeated, n_new, n_tokens)``,
    one row per window.

    Every turn is new in exactly one window; the first ``n_repeated`` turns of
    a window are repeated ones. ``loss_spans`` (``array<struct<start, stop>>``,
    code points of ``formatted``) covers the texts of the new assistant turns.
    ``window`` rises within a conversation, with gaps where a turn is long.

    Null roles and texts count as empty; rows with a null conversation id
    make one conversation; a null turn number comes first. Rows with the same
    number follow in order of role and text, and all are kept. Other columns
    are not read; an empty table gives no window. Conversations are cut by rows;
    only turns of one conversation that agree in number, role and the first
    ``DEALT`` characters stay together.
    """
    c = F.col
    rows = turns.select(
        c(conv_col).alias("conv"), c(turn_col).cast("long").alias("turn"),
        F.coalesce(c(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(c(text_col).cast("string"), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(START), escape(c("role")), F.lit(SEP))
    rows = rows.select("conv", "turn", "role", "text", head.alias("head"), escape(c("text")).alias("body"))
    rows = rows.withColumn("cost", F.ceil((F.octet_length("head") + F.octet_length("body") + len(END)) / 4).cast("long"))
    # Chunks are ranges of rows in the order of the turns, whatever the turn numbers are.
    ranged = rows.repartitionByRange(c("conv").asc_nulls_first(), c("turn").asc_nulls_first(), F.left("role", F.lit(DEALT)), F.left("text", F.lit(DEALT)))
    rows = written(ranged.withColumn("chunk", F.spark_partition_id().cast("long")), "ranges")
    inside = Window.partitionBy("conv", "chunk").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumns({"nth": F.row_number().over(inside), "sofar": F.sum("cost").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - c("cost")})

    lead = F.struct("turn", "role", "head", "body", "cost")
    chunks = rows.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("total"), F.max(F.when(c("nth") == 1, lead)).alias("lead"))
    over = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.select(
        c("conv").alias("conv_"), c("chunk").alias("chunk_"), (F.sum("n").over(over) - c("n")).alias("n_before"), (F.sum("total").over(over) - c("total")).alias("cost_before"),
        F.first("lead").over(over).alias("lead"),
    )
    is_system = c("lead.role") == "system"
    chunks = chunks.withColumns({"system_cost": F.when(is_system, c("lead.cost")).otherwise(0), "system_head": F.when(is_system, c("lead.head")), "system_body": F.when(is_system, c("lead.body"))})

    room = F.greatest(F.lit(budget) - c("system_cost"), F.lit(2))
    placed = rows.join(chunks.drop("lead", "system_head", "system_body"), c("conv").eqNullSafe(c("conv_")) & (c("chunk") == c("chunk_")))
    placed = placed.withColumn("pos", c("n_before") + c("nth"))
    # The leading system turn is new in the first window and costs nothing there: its cost is taken off the room.
    leading = (c("system_cost") > 0) & (c("pos") == 1)
    before = F.when(leading, 0).otherwise(c("cost_before") + c("sofar") - c("system_cost"))
    placed = placed.withColumns({"leading": leading, "before": before, "room": room})
    placed = placed.select("conv", "chunk", "pos", "leading", "before", "room", "cost", "head", "body", (c("role") == "assistant").alias("target"), F.floor(c("before") / F.floor(c("room") / 2)).alias("window"))
    placed = written(placed, "turns")

    own = F.when(~c("leading"), c("cost")).otherwise(0)
    spans = placed.groupBy("conv", "window").agg(F.min("pos").alias("start"), F.min("before").alias("at"), F.sum(own).alias("new"), F.min("chunk").alias("chunk"), F.max("room").alias("room"))
    later = spans.filter(c("window") > 0)
    spare = F.least(F.lit(history_tokens), c("room") - c("new"))
    wanted = later.select(c("conv").alias("conv_"), c("window").alias("window_"), c("at"), spare.alias("spare"), F.explode(F.sequence(F.greatest(c("start") - history_turns, F.lit(1)), c("start") - 1)).alias("pos_"))
    piece = ["conv", "window", "pos", "repeated", "target", "head", "body", "cost"]
    fresh = placed.withColumn("repeated", F.lit(False)).select(piece)
    past = placed.drop("window").join(wanted, c("conv").eqNullSafe(c("conv_")) & (c("pos") == c("pos_")) & ~c("leading") & (c("at") - c("before") <= c("spare")))
    past = past.withColumnsRenamed({"window_": "window"}).withColumn("repeated", F.lit(True)).select(piece)
    systems = later.join(chunks.filter(c("system_cost") > 0), c("conv").eqNullSafe(c("conv_")) & (c("chunk") == c("chunk_")))
    systems = systems.select("conv", "window", F.lit(0).cast("long").alias("pos"), F.lit(True).alias("repeated"), F.lit(False).alias("target"), c("system_head").alias("head"), c("system_body").alias("body"), c("system_cost").alias("cost"))

    pieces = fresh.unionByName(past).unionByName(systems)
    out = pieces.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("pos", "repeated", "target", "head", "body", "cost"))).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["head"])
        stop = start + F.char_length(x["body"])
        marked = F.when(x["target"] & ~x["repeated"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))).otherwise(acc["spans"])
        return F.struct((stop + len(END)).alias("at"), marked.alias("spans"))

    zero = F.struct(F.lit(len(OPEN)).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    text = F.concat(F.lit(OPEN), F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), ""), F.lit(CLOSE))
    again = F.size(F.filter("p", lambda x: x["repeated"]))
    return out.select(
        c("conv").alias(conv_col), "window", text.alias("formatted"), F.aggregate("p", zero, step)["spans"].alias("loss_spans"),
        again.alias("n_repeated"), (F.size("p") - again).alias("n_new"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["cost"]).alias("n_tokens"),
    )
