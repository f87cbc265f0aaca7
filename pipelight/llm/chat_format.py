"""Preference formatting of conversations; DataFrame operations only.

A chosen and a rejected conversation share a prefix of turns.  The longest common turn prefix (equal
role and text, turn by turn) is rendered once as the prompt; what follows it in each conversation is
a completion.  A rendered turn is

    <|role|>\\n text <|end|>\\n

and a completion's loss mask covers the assistant's turns only: mask_chars has [start, end) spans in
code points of the rendered completion.

Conversations are paired by their opening turn: those that open alike are ranked by id within salted
buckets, so that no opening is ranked in one task, and taken two by two; what a bucket leaves over,
at most one conversation for each opening and bucket, is paired among the leftovers.  Of a pair, the
smaller id is the chosen one.  A conversation that stays alone is formatted by itself with no
rejected side, its prompt ending before its last assistant turn.

Defined results: a null role is "user", a null text is empty; turns are ordered by number, then role
and text; a null conversation id is no conversation and is left out; repeated rows of a turn are one
turn; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Conversations of one opening and bucket, about, in a group of GROUP_ROWS.
BUCKET_ROWS = 10_000
#: The number of buckets doesn't follow the table, so that conversations are paired alike at every size.
GROUP_ROWS = 40_000_000


def collected(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns): each conversation's turns in order; a conversation is one row's worth."""
    own = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("id"), F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("turn"))
    lists = own.groupBy("id").agg(F.array_sort(F.collect_set("turn")).alias("turns"))
    return lists.select("id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of turns at the start that are equal in both."""
    apart = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))  # the shorter one is padded with nulls
    first = F.array_position(apart, F.lit(True))
    return F.when(first > 0, first - 1).otherwise(F.size(apart)).cast("int")


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, _rendered))


def _rendered(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))


def mask(turns: Column) -> Column:
    """[start, end) of what the assistant says, with the end mark, in the rendered turns."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, t):
        head = state["at"] + F.length(t["role"]) + F.lit(5)  # <|role|> and a new line
        end = head + F.length(t["text"]) + F.lit(7)  # the text and <|end|>
        spans = F.when(t["role"] == "assistant", F.concat(state["spans"], F.array(F.struct(head.cast("int").alias("start"), end.cast("int").alias("end"))))).otherwise(state["spans"])
        return F.struct((end + F.lit(1)).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def pairs_by_opening(conversations: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id) of conversations (id, turns) that open alike; rejected_id may be null."""
    openings = cut(conversations.where(F.size("turns") > 0).select("id", F.xxhash64(F.col("turns")[0]["role"], F.col("turns")[0]["text"]).alias("h1"), F.xxhash64(F.lit(1), F.col("turns")[0]["text"], F.col("turns")[0]["role"]).alias("h2")), "openings")
    buckets = GROUP_ROWS // BUCKET_ROWS

    def two_by_two(rows: DataFrame, *more: str) -> DataFrame:
        order = Window.partitionBy("h1", "h2", *more).orderBy("id")
        ranked = rows.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("id").over(order))
        return ranked.where("rank % 2 = 1").select("h1", "h2", F.col("id").alias("chosen_id"), F.col("next").alias("rejected_id"))

    first = cut(two_by_two(openings.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))), "bucket"), "paired")
    second = two_by_two(first.where("rejected_id is null").select("h1", "h2", F.col("chosen_id").alias("id")))
    return first.where("rejected_id is not null").unionByName(second).select("chosen_id", "rejected_id")


def format_preferences(turns: DataFrame, pairs: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each pair: ids, number of prompt turns, prompt, and both completions with masks.

    pairs: (chosen_id, rejected_id); by default conversations are paired by their opening turn.
    """
    conversations = cut(collected(turns, conv, turn, role, text), "conversations")
    pairs = pairs_by_opening(conversations) if pairs is None else pairs.select("chosen_id", "rejected_id")
    left = conversations.select(F.col("id").alias("chosen_id"), F.col("turns").alias("chosen_turns"))
    right = conversations.select(F.col("id").alias("rejected_id"), F.col("turns").alias("rejected_turns"))
    both = pairs.join(left, "chosen_id").join(right, "rejected_id", "left")
    last = F.size("chosen_turns") - F.array_position(F.reverse(F.transform("chosen_turns", lambda t: t["role"])), "assistant")
    alone = F.when(F.exists("chosen_turns", lambda t: t["role"] == "assistant"), last).otherwise(F.size("chosen_turns")).cast("int")
    both = both.withColumn("n_prompt", F.when(F.col("rejected_id").isNull(), alone).otherwise(common_prefix(F.col("chosen_turns"), F.col("rejected_turns"))))
    rest = lambda x: F.slice(x, F.col("n_prompt") + 1, F.greatest(F.size(x) - F.col("n_prompt"), F.lit(0)))
    return (
        both.withColumn("chosen_rest", rest("chosen_turns"))
        .withColumn("rejected_rest", F.when(F.col("rejected_id").isNotNull(), rest("rejected_turns")))
        .select(
            "chosen_id",
            "rejected_id",
            F.col("n_prompt").cast("long").alias("n_prompt_turns"),
            render(F.slice("chosen_turns", F.lit(1), F.col("n_prompt"))).alias("prompt"),
            render(F.col("chosen_rest")).alias("chosen"),
            mask(F.col("chosen_rest")).alias("chosen_mask"),
            F.when(F.col("rejected_id").isNotNull(), render(F.col("rejected_rest"))).alias("rejected"),
            F.when(F.col("rejected_id").isNotNull(), mask(F.col("rejected_rest"))).alias("rejected_mask"),
        )
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_preferences(table(spark, sf_dir, "conversations"))
    spans = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", spans("chosen_mask").alias("chosen_mask"), "rejected", F.when(F.col("rejected_id").isNotNull(), spans("rejected_mask")).alias("rejected_mask"))
