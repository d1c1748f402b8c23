r"""Operator 3, chat formatting: a template, its grammar, and a round trip that proves each output.

The grammar of a formatted conversation (nothing else is ever written):

    conversation = turn*        turn = "<s>[INST]" role "[/INST]" text "</s>"

The four control strings are `<s>`, `</s>`, `[INST]` and `[/INST]`; a role or text that holds one is no turn. A bracket, one or more backslashes and
the rest of a control string is an escaped one; reading takes away one backslash. Every turn is first
written as it is and reparsed; where the parser doesn't give back the very same role and text, one backslash
is put into everything that looks like a control string, escaped or not, and the turn is reparsed again, until
it is identical. Escaping is a bijection onto strings without control strings, so one repetition is enough; a
turn that still differed would be reported in `exact`.

Defined results: a null text or role is an empty one; rows of one conversation go by turn, then role, then
text, nulls first; repeated rows are repeated turns; a row with a null conv_id is a conversation of
its own; a conversation is one row and must fit in a task; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The control strings of the template.
START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"</?s>|\[/?INST\]"
LOOKS = r"(<(?=\\*/?s>)|\[(?=\\*/?INST\]))(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"(<(?=\\+/?s>)|\[(?=\\+/?INST\]))(\\*)\\(/?(?:s>|INST\]))"
LEARNED_ROLES = ("assistant",)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, LOOKS, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def written(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START + OPEN), role, F.lit(CLOSE), text, F.lit(END))


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted text, null in place of what the grammar doesn't allow.

    `</s>` ends a turn wherever it stands, and the first `[/INST]` of a turn ends its role; a turn begins with
    `<s>[INST]`, holds no other control string, and nothing follows the last one.
    """
    turns = F.split(formatted, END)
    body = lambda t: F.substr(t, F.lit(len(START + OPEN) + 1))
    role = lambda t: F.substring_index(body(t), CLOSE, 1)
    text = lambda t: F.substr(body(t), F.length(role(t)) + len(CLOSE) + 1)
    valid = lambda t: F.startswith(t, F.lit(START + OPEN)) & F.contains(body(t), F.lit(CLOSE)) & ~role(t).rlike(CONTROL) & ~text(t).rlike(CONTROL)
    read = lambda t: F.struct(unescaped(role(t)).alias("role"), unescaped(text(t)).alias("text"))
    last = F.size(turns) - 1
    return F.filter(F.transform(turns, lambda t, i: F.struct(((i < last) | (t != "")).alias("there"), F.when((i < last) & valid(t), read(t)).alias("turn"))), lambda x: x["there"])["turn"]


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under the mask, unescaped, one after another with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def format_chats(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: tuple[str, ...] = LEARNED_ROLES) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (parsed from formatted), loss_spans, exact.

    loss_spans: array<struct<start, length>> in code points of formatted, over the texts of learned roles,
    in order. exact: the turns parsed from formatted are the source's.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = chats.select(F.col(conv_col).alias("conv_id"), F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("own"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    # First as it is; escaped only where that does not come back as it was.
    turn = F.struct(F.col("role").alias("role"), F.col("text").alias("text"))
    rows = rows.withColumn("back", parsed(written(F.col("role"), F.col("text"))))
    rows = rows.withColumn("plain", F.coalesce(F.col("back") == F.array(turn), F.lit(False))).drop("back")
    put = lambda name: F.when(F.col("plain"), F.col(name)).otherwise(escaped(F.col(name)))
    rows = rows.withColumns({"put_role": put("role"), "put_text": put("text")}).withColumn("out", written(F.col("put_role"), F.col("put_text")))
    before = W.partitionBy("conv_id", "own").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("out")).over(before), F.lit(0)) + F.length("put_role") + len(START + OPEN + CLOSE)
    rows = rows.withColumn("start", start.cast("long"))
    one = F.struct("turn", "role", "text", "start", F.length("put_text").cast("long").alias("length"), "out")
    whole = rows.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list(one)).alias("rows"))
    whole = whole.withColumn("formatted", F.array_join(F.col("rows.out"), "")).withColumn("turns", parsed(F.col("formatted")))
    spans = F.transform(F.filter("rows", lambda t: t["role"].isin(*learned)), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    exact = F.col("turns") == F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return whole.select("conv_id", "formatted", "turns", spans.alias("loss_spans"), exact.alias("exact"))
