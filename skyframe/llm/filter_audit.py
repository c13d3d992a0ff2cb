"""Filter interaction audit by direct relational replay.

Every document's flags (which filters it fails) are crossed with all orders of
the filters, a broadcast table of n! rows; each pair's first failing step is
read off, its steps are exploded and counted conditionally.  Partial
aggregation leaves a row per part, order and step in each task before the
only shuffle of the replay.

The flags come from one scan of the texts and are written once, as narrow rows
without text.  Repeats are found by digests: the least doc_id of every digest
that occurs more than once joins back to the rows, a join whose hot keys the
adaptive planner may split, as nothing above it needs a key's rows together.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"

#: The filters in the bit order of a mask. The first four look at the text alone; E is the repeat of a smaller doc_id's text.
FILTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """A: under 100 words. B: distinct words under 80 %. C: A-Z over 10 % of code points. D: holds a symbol.

    A text without words splits into one empty string, which fails A and not B, as no words at all do.
    """
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), WORD_BREAK)
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10,
        "D": text.rlike(SYMBOLS),
    }


def _mask(failures: list[Column]) -> Column:
    return reduce(Column.bitwiseOR, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures)])


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) for each row of ``docs``; bit i of mask is set if the row fails FILTERS[i].

    A null text is empty and a null lang the part ''. A row repeats if a
    smaller doc_id has the same text; rows with a null or the same doc_id aren't
    repeats of each other. A document is good or toxic if any of its label rows
    says 1; a null doc_id has no labels. Repeated ids count as rows each.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        _mask(list(text_failures(text).values())).alias("mask"),
    )
    rows = stored(rows, "flags")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    repeat = F.when(F.col("doc_id") > F.col("first_id"), 1 << FILTERS.index("E")).otherwise(0)
    rows = rows.join(first, "digest", "left").join(marks, "doc_id", "left")
    no = F.lit(False)
    return rows.select("part", F.col("mask").bitwiseOR(repeat).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def replayed(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, filter) of every order of ``filters``.

    ``flags``: (part, mask, good, toxic), a row per document.  Every order and
    step of each part has a row, zeros included; an empty table gives none.
    ``filters``: up to six letters, as their n! orders are broadcast.
    """
    if not 1 <= len(filters) <= 6:
        raise ValueError("between one and six filters")
    spark = flags.sparkSession
    orders = [("".join(p), [1 << filters.index(x) for x in p]) for p in permutations(filters)]
    orders = F.broadcast(spark.createDataFrame(orders, "filter_order string, bits array<int>"))
    mask, bit = F.col("mask"), F.col("bit")
    first = reduce(lambda rest, k: F.when(mask.bitwiseAND(F.get("bits", F.lit(k))) != 0, k + 1).otherwise(rest), reversed(range(len(filters))), F.lit(len(filters) + 1))
    steps = flags.crossJoin(orders).withColumn("first", first).select("part", "filter_order", "mask", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit"))
    steps = steps.withColumn("step", F.col("at") + 1)
    here = F.col("first") == F.col("step")
    counted = steps.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if((F.col("first") < F.col("step")) & (mask.bitwiseAND(bit) != 0)).alias("redundant"),
        F.count_if(mask == bit).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    own = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    counted = counted.withColumn("filter", own)
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return counted.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"), "filter")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all rows of ``docs``; see ``document_flags`` and ``replayed``."""
    return replayed(document_flags(docs, labels))
