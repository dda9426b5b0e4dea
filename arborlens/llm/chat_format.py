"""Chat formatting in budgeted windows. DataFrame functions only.

A conversation becomes windows of whole turns. Prefix sums of turn tokens choose the spans: a turn opens a new
window when the current one would exceed the budget. Each later window repeats the system turn and the last
turns before its span that fit the history budget and the window; what is repeated is left out of the loss mask, so every
assistant text is a target exactly once. A turn longer than the budget has a window of its own; nothing is cut.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Control strings inside roles and texts are escaped by
a code after ESC, and ESC itself too, so formatting can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ESC = "␛"
START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates, escaped in this order.
CONTROL = (ESC, START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Characters per token in the budget's estimate.
CHARS_PER_TOKEN = 4


def escape(col):
    for k, word in enumerate(CONTROL):
        col = F.replace(col, F.lit(word), F.lit(f"{ESC}{k}"))
    return col


def unescape(col):
    for k, word in reversed(list(enumerate(CONTROL))):
        col = F.replace(col, F.lit(f"{ESC}{k}"), F.lit(word))
    return col


def _head(role):
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(f"{ESC}9")), F.lit("\n"))


def _turns(df: DataFrame, conv_col, turn_col, role_col, text_col, budget: int, history_turns: int, history_budget: int) -> DataFrame:
    """A row per turn: its place ``i``, role and text, the lengths of its formatted head and body, its tokens ``k``, how many turns before it
    a window that begins with it repeats (``past``), whether the system turn stands before those (``keep``), and the tokens of such a beginning."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    head, body = F.length(_head(role)), F.length(escape(text))
    rows = df.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), role.alias("_role"), text.alias("_text"), head.alias("head"), body.alias("body"))
    rows = rows.withColumn("k", F.ceil((F.col("head") + F.col("body") + len(END) + 1) / CHARS_PER_TOKEN).cast("long"))
    w = Window.partitionBy("_conv").orderBy("_turn", "_role", "_text")
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "k0": F.first("k").over(w), "sys": (F.first("_role").over(w) == "system").cast("int"), **{f"sum{n}": F.sum("k").over(w.rowsBetween(-n, -1)) for n in range(1, history_turns + 1)}})
    rows = rows.withColumn("keep", F.when((F.col("sys") == 1) & (F.col("i") > 0) & (F.col("k0") + F.col("k") <= budget), 1).otherwise(0))
    own = F.col("keep") * F.col("k0") + F.col("k")
    past, spent = F.lit(0), F.lit(0).cast("long")
    for n in range(1, history_turns + 1):
        fits = (F.col("i") - F.col("sys") >= n) & (F.col(f"sum{n}") <= history_budget) & (own + F.col(f"sum{n}") <= budget)
        past, spent = F.when(fits, n).otherwise(past), F.when(fits, F.col(f"sum{n}")).otherwise(spent)
    return rows.select("_conv", "i", "_role", "_text", "head", "body", "k", past.alias("past"), "keep", (own + spent).alias("begins"))


def format_chat(df: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", budget: int = 2048, history_turns: int = 2, history_budget: int = 512) -> DataFrame:
    """(conv, window, text, n_repeated, loss array<struct<start, length>>, n_tokens), one row per window.

    ``loss`` counts code points of ``text`` from 1. ``n_repeated`` is the number of turns at the window's start that
    an earlier window holds too. No window exceeds the budget but one whose own single turn does: the history shrinks, and where
    the system turn doesn't fit beside a turn it is left out. Null roles and texts count as empty; equal turn numbers are ordered by role and
    text; repeated rows are turns of their own; a null conversation id is a conversation. A newline in a role is
    escaped. An empty table gives no window. Only the numbers of a conversation's turns meet in one row, to be cut into
    windows; texts are sorted by conversation and gathered by window. Other columns are not read.
    """
    turns = _turns(df, conv_col, turn_col, role_col, text_col, budget, history_turns, history_budget)
    numbers = turns.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("i", "k", "begins", "past", "keep"))).alias("t"))
    # Prefix sums of turn tokens: a turn opens a window where the open one can't take it.
    starts = """aggregate(if(size(t) > 1, sequence(1, size(t) - 1), cast(array() as array<int>)), struct(array(0) as starts, t[0].k as used),
        (s, i) -> if(s.used + t[i].k > {budget}, struct(concat(s.starts, array(i)) as starts, t[i].begins as used), struct(s.starts as starts, s.used + t[i].k as used)), s -> s.starts)"""
    cuts = numbers.select("_conv", F.size("t").alias("n"), "t", F.expr(starts.format(budget=budget)).alias("starts"))
    spans = cuts.selectExpr("_conv", "inline(transform(starts, (at, w) -> struct(w as window, at as at, coalesce(get(starts, w + 1), n) as to, if(w = 0, 0, t[at].past) as past, if(w = 0, 0, t[at].keep) as keep)))")
    held = spans.selectExpr("_conv as _own", "window", "at", "explode(concat(if(keep = 1, array(0), cast(array() as array<int>)), sequence(at - past, to - 1))) as place")
    # Texts travel as they are, and are formatted where their window is put together.
    rows = held.join(turns.select("_conv", "i", "_role", "_text", "head", "body", "k"), F.expr("_own <=> _conv and place = i"))
    tail = f"{END}\n"
    size = F.col("head") + F.col("body") + len(tail)
    before = F.coalesce(F.sum(size).over(Window.partitionBy("_own", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"first": before + F.col("head") + 1, "fresh": F.col("place") >= F.col("at")})
    turn = F.struct("place", "_role", "_text", (F.col("fresh") & (F.col("_role") == "assistant")).alias("loss"), "first", F.col("body").cast("long").alias("size"))
    parts = rows.groupBy("_own", "window").agg(F.array_sort(F.collect_list(turn)).alias("p"), F.sum("k").alias("n_tokens"), F.count_if(~F.col("fresh")).alias("n_repeated"))
    return parts.select(
        F.col("_own").alias(conv_col),
        F.col("window").cast("long").alias("window"),
        F.array_join(F.transform("p", lambda x: F.concat(_head(x["_role"]), escape(x["_text"]), F.lit(tail))), "").alias("text"),
        "n_repeated",
        F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["first"].alias("start"), x["size"].alias("length"))).alias("loss"),
        "n_tokens",
    )


def read_back(windows: DataFrame, *, conv_col="conv_id") -> DataFrame:
    """(conv, turns array<struct<role, text>>, loss_text, formatted_chars) from the output of ``format_chat`` alone."""
    parts = windows.select(
        F.col(conv_col).alias("_conv"),
        F.col("window"),
        F.length("text").cast("long").alias("chars"),
        # Every turn is START role \\n text END \\n; none of the marks occurs inside.
        F.expr(f"transform(slice(split(text, '<[|]im_start[|]>'), n_repeated + 2, greatest(size(split(text, '<[|]im_start[|]>')) - 1 - n_repeated, 0)), t -> substring(t, 1, length(t) - {len(END) + 1}))").alias("turns"),
        F.expr("concat_ws('', transform(loss, l -> substring(text, cast(l.start as int), cast(l.length as int))))").alias("loss_text"),
    )
    whole = parts.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("window", "chars", "turns", "loss_text"))).alias("ws"))
    whole = whole.select("_conv", F.flatten(F.transform("ws", lambda w: w["turns"])).alias("ts"), F.concat_ws("", F.transform("ws", lambda w: w["loss_text"])).alias("loss_text"), F.expr("aggregate(ws, 0L, (s, w) -> s + w.chars)").alias("formatted_chars"))
    return whole.select(
        F.col("_conv").alias(conv_col),
        F.transform("ts", lambda t: F.struct(unescape(F.replace(F.substring_index(t, "\n", 1), F.lit(f"{ESC}9"), F.lit("\n"))).alias("role"), unescape(F.substring(t, F.instr(t, "\n") + 1, F.length(t))).alias("text"))).alias("turns"),
        unescape(F.col("loss_text")).alias("loss_text"),
        "formatted_chars",
    )
