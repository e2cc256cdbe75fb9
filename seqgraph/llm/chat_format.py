"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns (rows by turn; ties by role, then text) cost tokens: words and signs of the text plus a fixed
`overhead` for the markers. Prefix sums of those costs choose spans of whole turns: a span ends before the turn that
would pass what the budget leaves beside `history` and `system`, so only a turn that is larger than that stands in a
longer span of its own. Each span becomes one window: the conversation's first system turn if the window lacks it (of a
longer one, the beginning of `system` tokens), then earlier turns that began at most `history` tokens before the span,
then the span. So no window passes the budget but those of one turn that is too large. Earlier turns are repeated as
context only: the loss mask covers the texts of the span's own assistant turns, each exactly once over all windows.

Large conversations are cut into segments of `segment` budgets by prefix sums; spans never cross a segment, so no
task gathers more than a segment. Prefix sums run in two levels (blocks of `block` turn numbers, then turns), so one
conversation with a third of all rows is still dealt over many tasks.

Template: `<turn>role` LF text `</turn>` LF. In texts and roles a control string `<turn` or `</turn` gets one more
backslash after its `<` (`<` `\\`* `turn` in general), which reads back exactly. Line ends and backslashes of a role
are written `\\n` and `\\b`.

Defined results: null text and null role count as empty; null turns come first, as one block; rows with a null conv_id form one
conversation; repeated rows are turns of their own; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
OVERHEAD = 4
SYSTEM = 256
SEGMENT = 32
BLOCK = 256

_OPEN, _CLOSE = "<turn>", "</turn>\n"


def word_tokens(text: Column) -> Column:
    """Words and single signs: a tokenizer-free estimate of a text's tokens."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def _costed(turns: DataFrame, tokens, overhead: int) -> DataFrame:
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("cost", tokens(F.col("text")).cast("long") + F.lit(overhead))


def first_tokens(text: Column, n: int) -> Column:
    """The beginning of a text up to its n-th token of `word_tokens`."""
    return F.regexp_extract(text, rf"^(?:[^\p{{L}}\p{{M}}\p{{N}}\S]*(?:[\p{{L}}\p{{M}}\p{{N}}]++|[^\s\p{{L}}\p{{M}}\p{{N}}])){{0,{n}}}", 0)


def _with_prefix(rows: DataFrame, block: int, keep: int, overhead: int, cut, tokens) -> DataFrame:
    """Adds `at`, the tokens of the conversation before the row, `seq`, the turns before it, and `system`, its first system turn
    as windows repeat it; and `last`, the cost of the row before in its block.

    The system turn comes with the block's sums: rows never meet in a group of their whole conversation.
    """
    rows = rows.withColumn("_block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    within = Window.partitionBy("conv_id", "_block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum("cost").over(within), F.lit(0))).withColumn("_seq", F.count(F.lit(1)).over(within))
    rows = rows.withColumn("last", F.lag("cost").over(Window.partitionBy("conv_id", "_block").orderBy("turn", "role", "text")))
    is_system = F.col("role") == "system"
    first = F.min_by(F.when(is_system, F.struct("_seq", "text", "cost")), F.when(is_system, F.col("_seq")))
    sums = rows.groupBy("conv_id", "_block").agg(F.sum("cost").alias("_cost"), F.count(F.lit(1)).alias("_n"), first.alias("_system"))
    blocks = Window.partitionBy("conv_id").orderBy("_block")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "_block", F.coalesce(F.sum("_cost").over(before), F.lit(0)).alias("_cost"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), "_system")
    # blocks after the first system turn carry it, cut to `keep` tokens; earlier ones never repeat it
    seen = F.first(F.when(F.col("_system").isNotNull(), F.struct((F.col("_system._seq") + F.col("_n")).alias("seq"), F.col("_system.text").alias("text"), F.col("_system.cost").alias("cost"))), ignorenulls=True)
    sums = sums.withColumn("system", seen.over(blocks.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    long = F.col("system.cost") > keep
    text = F.when(long, cut(F.col("system.text"), max(0, keep - overhead))).otherwise(F.col("system.text"))
    sums = sums.withColumn("_text", text)
    sums = sums.withColumn("system", F.when(F.col("system").isNotNull(), F.struct(F.col("system.seq").alias("seq"), F.col("_text").alias("text"), F.when(long, tokens(F.col("_text")).cast("long") + overhead).otherwise(F.col("system.cost")).alias("cost"))))
    sums = sums.select(F.col("conv_id").alias("_conv"), F.col("_block").alias("_of"), "_cost", "_n", "system")
    return rows.join(sums, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_of"))).select("conv_id", "turn", "role", "text", "cost", (F.col("_at") + F.col("_cost")).alias("at"), (F.col("_seq") + F.col("_n")).alias("seq"), "last", "system")


def format_windows(
    turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM, overhead: int = OVERHEAD, tokens=word_tokens, cut=first_tokens, segment: int = SEGMENT, block: int = BLOCK,
) -> DataFrame:
    """conv_id, segment, window (numbered within the segment), formatted, own_from, loss_spans, n_turns, n_repeated, n_tokens.

    `formatted` is the window's text. The span's own turns begin at code point `own_from`; `loss_spans` holds the
    code point ranges [from, to) under the loss mask. `tokens` maps a text Column to a count Column, `cut` a text and a
    number to the beginning of that text with at most so many of these tokens.
    """
    if history < 0 or system < overhead or budget - history - system <= 0:
        raise ValueError("history and system must leave room in the budget, and system must hold a turn's overhead")
    rows = _with_prefix(_costed(turns, tokens, overhead), block, system, overhead, cut, tokens)
    # what a span may hold, the same for all of a conversation: the budget without history and without a system turn
    room = F.lit(budget - history - system)
    rows = rows.withColumn("room", room.cast("long"))
    size = F.col("room") * segment
    own = F.floor(F.col("at") / size)
    # the first row of a segment within its block is enough to carry the system turn there
    leads = F.col("last").isNull() | (F.floor((F.col("at") - F.col("last")) / size) < own)
    rows = rows.withColumn("system", F.when(leads, F.col("system")))
    near_end = F.col("at") + F.lit(history) >= (own + 1) * size
    rows = rows.withColumn("segment", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("own", F.col("segment") == own)
    turn = F.struct("seq", "at", "cost", "own", "role", "text")
    parts = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.max_by("system", F.when(F.col("system").isNotNull(), F.col("seq"))).alias("system"), F.first("room").alias("room"))
    parts = parts.withColumn("first", F.filter("turns", lambda t: t["own"])).where(F.size("first") > 0)

    # greedy spans: state = starts so far, the last one's prefix sum
    state = F.struct(F.array().cast("array<bigint>").alias("starts"), F.lit(None).cast("bigint").alias("last"))
    opened = lambda s, t: s["last"].isNull() | (t["at"] + t["cost"] - s["last"] > F.col("room"))
    step = lambda s, t: F.when(opened(s, t), F.struct(F.concat(s["starts"], F.array(t["at"])).alias("starts"), t["at"].alias("last"))).otherwise(s)
    parts = parts.withColumn("starts", F.aggregate("first", state, step, lambda s: s["starts"])).drop("first")

    def window(start: Column, i: Column) -> Column:
        stop = F.coalesce(F.get("starts", i + 1), F.lit((1 << 63) - 1))
        inside = lambda t: (t["own"] & (t["at"] >= start) & (t["at"] < stop)) | ((t["at"] < start) & (start - t["at"] <= F.lit(history)))
        return F.struct(start.alias("start"), i.alias("window"), F.filter("turns", inside).alias("turns"))

    windows = parts.select("conv_id", "segment", "system", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "segment", "system", "w.*")
    lacks = F.col("system").isNotNull() & ~F.exists("turns", lambda t: t["seq"] == F.col("system.seq"))
    # a system turn that comes later in the conversation is not moved before its time
    lacks = lacks & (F.col("system.seq") < F.element_at("turns", 1)["seq"])
    head = F.when(lacks, F.array(F.struct(F.col("system.seq").alias("seq"), F.lit(-1).cast("long").alias("at"), F.col("system.cost").alias("cost"), F.lit(False).alias("own"), F.lit("system").alias("role"), F.col("system.text").alias("text")))).otherwise(F.array().cast("array<struct<seq:bigint,at:bigint,cost:bigint,own:boolean,role:string,text:string>>"))
    windows = windows.withColumn("turns", F.concat(head, "turns"))
    marked = F.transform("turns", lambda t: F.struct((t["at"] >= F.col("start")).alias("own"), t["role"].alias("role"), t["cost"].alias("cost"), F.concat(F.lit(_OPEN), _role_out(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body")))
    windows = windows.withColumn("marked", marked)
    zero = F.struct(F.lit(0).alias("pos"), F.lit(-1).alias("own_from"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def advance(s: Column, t: Column) -> Column:
        start = s["pos"] + F.length(t["head"])
        stop = start + F.length(t["body"])
        trained = t["own"] & (t["role"] == F.lit("assistant"))
        spans = F.when(trained, F.concat(s["spans"], F.array(F.struct(start.alias("from"), stop.alias("to"))))).otherwise(s["spans"])
        return F.struct((stop + F.lit(len(_CLOSE))).alias("pos"), F.when(t["own"] & (s["own_from"] < 0), s["pos"]).otherwise(s["own_from"]).alias("own_from"), spans.alias("spans"))

    layout = F.aggregate("marked", zero, advance)
    return windows.withColumn("layout", layout).select(
        "conv_id", "segment", "window",
        F.array_join(F.transform("marked", lambda t: F.concat(t["head"], t["body"], F.lit(_CLOSE))), "").alias("formatted"),
        F.col("layout.own_from").alias("own_from"), F.col("layout.spans").alias("loss_spans"),
        F.size(F.filter("marked", lambda t: t["own"])).cast("long").alias("n_turns"),
        F.size(F.filter("marked", lambda t: ~t["own"])).cast("long").alias("n_repeated"),
        F.aggregate("marked", F.lit(0).cast("long"), lambda s, t: s + t["cost"]).alias("n_tokens"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Reads formatted windows back: conv_id, segment, window, turns (array of role and text, the span's own), targets.

    Works on `formatted`, `own_from` and `loss_spans` alone; `targets` are the unescaped texts under the loss mask.
    """
    own = F.substring("formatted", F.col("own_from") + 1, F.length("formatted"))
    pieces = F.filter(F.split(own, "</turn>\n", -1), lambda p: p != "")
    line = lambda p: F.locate("\n", p)
    turns = F.transform(pieces, lambda p: F.struct(_role_in(F.substring(p, F.lit(len(_OPEN) + 1), F.locate("\n", p) - F.lit(len(_OPEN) + 1))).alias("role"), unescaped(F.substring(p, F.locate("\n", p) + F.lit(1), F.length(p))).alias("text")))
    targets = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["from"] + F.lit(1), s["to"] - s["from"])))
    return windows.select("conv_id", "segment", "window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").cast("long").alias("chars"))
