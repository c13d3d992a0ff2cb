"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant, the others as named users and system messages as
system, with the spans that training should learn: the assistant's words and
their end mark.  All of it is DataFrame code.

Messages are numbered in two levels (by ranges of ``turn``, then within a
range), and a row holds at most ``CHUNK`` messages: a conversation of any
length goes on in further rows, with its place in the whole rendering, so no
group is gathered beyond that bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 512
START, END = "<|im_start|>", "<|im_end|>\n"


def perspectives(messages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, participant, part, piece, n_messages, char_start, text, spans): the renderings.

    A participant is a role other than 'system' that has a message.  text is
    the rendering of one piece; pieces in the order of (part, piece) make the
    whole, and char_start is the piece's place in it.  spans: the [start, end)
    places, in code points of text, that the mask keeps.  Messages go by turn
    (null first), role and text.  A null text is empty, a null role is the
    participant ''; a null conv_id is a conversation like any other.  Repeated
    rows are repeated messages.  A conversation of system messages only has no
    participant and gives no row, like an empty table.
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(2**62))))
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    rows = rows.withColumn("number", F.row_number().over(order) - 1).withColumn("piece", F.floor(F.col("number") / chunk))
    pieces = rows.groupBy("conv_id", "part", "piece").agg(F.array_sort(F.collect_list(F.struct("number", "role", "text"))).alias("messages"))
    speakers = rows.where("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("participant")).distinct()
    each = pieces.join(speakers, pieces.conv_id.eqNullSafe(speakers.c)).drop("c")
    header = lambda m: F.concat(F.lit(START), F.when(m["role"] == F.col("participant"), "assistant").when(m["role"] == "system", "system").otherwise(F.concat(F.lit("user name="), m["role"])), F.lit("\n"))
    each = each.withColumn("said", F.transform("messages", lambda m: F.struct(header(m).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), (m["role"] == F.col("participant")).alias("learn"))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state, m):
        start = state["at"] + F.length(m["head"])
        end = start + F.length(m["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(m["learn"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    each = each.select(
        "conv_id",
        "participant",
        F.col("part").cast("long").alias("part"),
        F.col("piece").cast("long").alias("piece"),
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("said", lambda m: F.concat(m["head"], m["body"])), "").alias("text"),
        F.aggregate("said", empty, add)["spans"].alias("spans"),
    )
    before = Window.partitionBy("conv_id", "participant").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    places = each.select("conv_id", "participant", "part", "piece", "n_messages", F.length("text").cast("long").alias("n"), "text", "spans")
    return places.select("conv_id", "participant", "part", "piece", "n_messages", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("char_start"), "text", "spans")
