"""Conversations rebuilt from event logs and rendered for training.

An event belongs to a message of a conversation and has a sequence number:

* ``message`` begins the message with ``role`` and ``text``;
* ``delta`` appends its text;
* ``edit`` replaces the text so far;
* ``regenerate`` does so too and also discards the messages that were begun
  after this one up to now.

Logs are partitioned by conversation, sorted by sequence number (then message,
kind, role and text, so ties have one result) and folded by window functions.
A conversation becomes one row, so one conversation must fit in memory; the
number of conversations is not limited, and one shuffle does it all.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn. In roles and texts a
backslash is doubled, and a backslash is put behind every ``<`` and ``[``, the
first characters of the control strings of this and of other common templates
(``<|turn|>``, ``</s>``, ``[INST]``). No control string can come from a text
then, and ``unescape`` gives back the text.

Null text and null role are empty. A null conversation id is a conversation. A
message without a ``message`` event begins with its first event. Repeated rows
are events of their own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED = "assistant"


def escape(x: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("<", "<\\"), ("[", "[\\")):
        x = F.replace(x, F.lit(plain), F.lit(safe))
    return x


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"\\(\\?)", "$1")


def from_turns(conversations: DataFrame) -> DataFrame:
    """Events of a table that has one finished message per row."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    number = F.row_number().over(order).cast("bigint")
    return conversations.select(
        "conv_id", number.alias("seq"), number.alias("message"), F.lit("message").alias("kind"), "role", "text"
    )


def fold(events: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id`` and ``turns``, an array of (role, text)."""
    log = Window.partitionBy("conv_id")
    in_order = log.orderBy("seq", "message", "kind", "role", "text")
    # backwards, as a frame that only grows is computed once
    later = log.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "message")
    text, kind = F.coalesce("text", F.lit("")), F.col("kind")
    rows = events.select("conv_id", "seq", "message", "kind", "role", "text").withColumn("at", F.row_number().over(in_order))
    rows = rows.withColumns(
        {"begun": F.min("at").over(own), "reset": F.max(F.when(kind != "delta", F.col("at"))).over(own)}
    )
    rows = rows.withColumn("cut", F.min(F.when(kind == "regenerate", F.col("begun"))).over(later))
    rows = rows.where((F.col("cut").isNull() | (F.col("cut") >= F.col("begun"))))
    live = F.coalesce(F.col("at") >= F.col("reset"), F.lit(True))
    pieces = F.sort_array(F.collect_list(F.when(live, F.struct("at", text.alias("text")))))
    messages = rows.groupBy("conv_id", "message", "begun").agg(
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"),
        F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"),
    )
    turn = F.struct("begun", F.coalesce("role", F.lit("")).alias("role"), "text")
    turns = F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return messages.groupBy("conv_id").agg(turns.alias("turns"))


def render(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss``: the (start, end) of each text under the loss mask, in code points of it."""
    head = F.concat(F.lit(TURN), escape(F.col("turn.role")), F.lit(TEXT)).alias("head")
    rows = conversations.select("conv_id", F.posexplode_outer("turns").alias("at", "turn"))
    rows = rows.select("conv_id", "at", head, escape(F.col("turn.text")).alias("body"), (F.col("turn.role") == TRAINED).alias("trained"))
    earlier = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    size = (F.length("head") + F.length("body") + F.lit(len(END))).cast("long")
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(earlier), F.lit(0)) + F.length("head"))
    piece = F.struct("at", F.concat("head", "body", F.lit(END)).alias("shown"))
    span = F.struct("start", (F.col("start") + F.length("body")).alias("end"))
    whole = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("head").isNotNull(), piece))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), span))).alias("loss"),
    )
    return whole.select("conv_id", F.array_join(F.transform("pieces", lambda x: x["shown"]), "").alias("formatted"), "loss")


def parse(rendered: DataFrame) -> DataFrame:
    """The turns of ``formatted`` in order, one row each: ``conv_id``, ``at``, ``role``, ``text`` and ``trained``.

    A text is trained on if the spans of the loss mask name just its place.
    """
    turns = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")
    rows = rendered.select("conv_id", F.posexplode(turns).alias("at", "turn"))
    earlier = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum((F.length("turn") + F.lit(len(END))).cast("long")).over(earlier), F.lit(0)).alias("before")
    rows = rows.select("conv_id", "at", F.length("turn").alias("size"), F.split("turn", r"<\|text\|>").alias("halves"), before)
    head, body = F.get("halves", F.lit(0)), F.get("halves", F.lit(1))
    rows = rows.select(
        "conv_id", "at", unescape(F.substring(head, F.lit(len(TURN) + 1), F.length(head))).alias("role"), unescape(body).alias("text"),
        (F.col("before") + F.col("size") - F.length(body)).alias("start"), (F.col("before") + F.col("size")).alias("end"),
    )
    mask = rendered.select(F.col("conv_id").alias("of"), F.inline("loss").alias("loss_start", "loss_end"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("start") == F.col("loss_start")) & (F.col("end") == F.col("loss_end"))
    return rows.join(mask, same, "left").select("conv_id", "at", "role", "text", F.col("loss_start").isNotNull().alias("trained"))


def digest(rendered: DataFrame) -> DataFrame:
    """Counts and digests per conversation, read back from ``formatted`` and the loss mask."""
    joined = lambda x: F.array_join(F.transform(F.sort_array(F.collect_list(x)), lambda y: y["said"]), "")
    said = F.struct("at", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"))
    trained = F.when(F.col("trained"), F.struct("at", F.col("text").alias("said")))
    rows = parse(rendered).groupBy(F.col("conv_id").alias("of")).agg(F.count(F.lit(1)).alias("n"), joined(said).alias("said"), joined(trained).alias("trained"))
    sizes = rendered.select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"))
    text = lambda c: F.coalesce(c, F.lit(""))
    both = sizes.join(rows, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return both.select(
        "conv_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_turns"),
        F.sha2(text("said"), 256).alias("turns_sha256"),
        F.coalesce(F.length("trained"), F.lit(0)).cast("bigint").alias("loss_chars"),
        F.sha2(text("trained"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE_SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped as (
  select *, replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\') as shown,
    replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\') as who
  from said),
joined as (
  select conv_id, count(*) as n, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as trained,
    sum(length(who) + length(shown) + 23) as shown
  from escaped group by conv_id)
select conv_id, cast(n as bigint) as n_turns, sha256(turns) as turns_sha256, cast(length(trained) as bigint) as loss_chars,
  sha256(trained) as loss_sha256, cast(shown as bigint) as formatted_chars
from joined
"""
