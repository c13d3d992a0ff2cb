"""Mixing sources to target weights: Pfair scheduling of source blocks.

A source with a share w of the slots may start its block j at slot
floor(j / w) and must have it in by slot ceil((j + 1) / w).  Earliest deadline
first keeps to these windows, so after t slots a source has had between
t * w - 1 and t * w + 1 blocks.  Weights are whole numbers (of a billionth, if
given), and release times and deadlines are whole-number arithmetic on them, so
shares are not rounded and nothing drifts.  The schedule is worked out by a fold
over its slots in SQL, up to the last block of any source or until it repeats,
after as many slots as the weights' sum.  A block holds as many documents as the
caller says; where that is left open, ``BLOCK_DOCS``, or as many more as keep the
schedule within ``SLOTS`` slots.
A source that has run out leaves its slots empty; no document is dropped or
repeated.

All of it is DataFrame code.  Documents are numbered within their source in
two levels: in buckets by a prefix of the id's MD5 (null ids by their place in
the table), then by the counts of the buckets before, so a source with any share
of the rows is spread over ``16 ** DIGITS`` groups.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DOCS = 64
SLOTS = 1 << 17
#: Slots that one step of the outer fold adds.
STRETCH = 512
#: Whole numbers that a given weight of 1 stands for.
ONE = 1_000_000_000
#: Hex digits of the bucket.
DIGITS = 3


def source_units(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, n, units): each source's documents and weight, a whole number.

    ``weights``: target weights by source, kept to the billionth of 1, the least
    weight; a source without one, or with none above 0, has a thousandth of all,
    as no document is dropped.  Default: the square root of the source's number
    of documents.  A null source is a source of its own, written ''.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        return sizes.select("source", "n", F.floor(F.sqrt(F.col("n").cast("double")) * 1000).cast("long").alias("units"))
    whole = {k: max(1, round(v * ONE)) for k, v in weights.items() if v > 0}
    common = math.gcd(*whole.values()) or 1
    whole = {k: v // common for k, v in whole.items()}
    given = F.create_map(*[x for k, v in whole.items() for x in (F.lit(k), F.lit(v).cast("long"))]) if whole else F.create_map().cast("map<string,bigint>")
    least = max(1, -(-sum(whole.values()) // 1000))
    return sizes.select("source", "n", F.coalesce(given[F.col("source")], F.lit(least)).cast("long").alias("units"))


def schedule(units: DataFrame, block_docs: int | None = None, slots: int = SLOTS) -> DataFrame:
    """(source, units, total, block_docs, turn, slot): at which slots each source has its turns, by earliest deadline first.

    Ties go to the smaller source name.  One row holds the list of sources; the
    fold takes at most slots x sources steps, whatever the number of documents,
    where ``block_docs`` is left open; a given one is kept, and the fold goes on
    to the last block or the end of the weights' period.
    """
    one = units.agg(F.array_sort(F.collect_list(F.struct("source", "n", "units"))).alias("s"), F.sum("units").alias("total")).where("total is not null")
    one = one.withColumn("ends", F.expr("array_max(transform(s, x -> ceil(x.n * cast(total as decimal(20,0)) / x.units)))").cast("decimal(38,0)"))
    one = one.withColumn("block_docs", (F.greatest(F.lit(BLOCK_DOCS), F.ceil(F.col("ends") / slots)) if block_docs is None else F.lit(block_docs)).cast("long"))
    last = "array_max(transform(s, x -> cast(ceil(cast((x.n + block_docs - 1) div block_docs as decimal(20,0)) * total / x.units) as bigint)))"
    one = one.withColumn("slots", F.least("total", F.expr(last)))
    # The inner fold keeps the blocks each source has had and the picks of a stretch; due is the earliest deadline of what is released.
    pick = """array_min(transform(sequence(0, size(s) - 1),
          i -> if((st.had[i] * total) div s[i].units <= t,
                  struct(((st.had[i] + 1) * total + s[i].units - 1) div s[i].units as due, i as i), null)))"""
    inner = f"""aggregate(sequence(k * {STRETCH}L, least(slots, (k + 1) * {STRETCH}L) - 1),
          named_struct('had', out.had, 'picks', cast(array() as array<int>)),
          (st, t) -> transform(array({pick}), p -> if(p is null,
              named_struct('had', st.had, 'picks', st.picks || array(-1)),
              named_struct('had', transform(st.had, (h, i) -> if(i = p.i, h + 1, h)), 'picks', st.picks || array(p.i))))[0])"""
    picked = F.expr(f"""flatten(aggregate(sequence(0L, (slots - 1) div {STRETCH}L),
          named_struct('had', transform(s, x -> 0L), 'all', cast(array() as array<array<int>>)),
          (out, k) -> transform(array({inner}), r -> named_struct('had', r.had, 'all', out.all || array(r.picks)))[0]).all)""")
    rows = one.select("s", "total", "block_docs", F.posexplode(picked).alias("slot", "i")).where("i >= 0")
    rows = rows.select(F.expr("s[i].source").alias("source"), F.expr("s[i].units").alias("units"), "total", "block_docs", F.col("slot").cast("long").alias("slot"))
    turn = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return rows.withColumn("turn", turn.cast("long"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int | None = None, slots: int = SLOTS) -> DataFrame:
    """``docs`` with mix_source, mix_block (of the source), mix_slot (of the mixture) and mix_rank (within the block).

    Order by mix_slot, mix_rank to read the mixture.  Within a source,
    documents go by the MD5 of doc_id, then doc_id and text; a null doc_id
    counts as an empty string, and rows with a null id go in any order.  A null source is the source ''.  Columns named
    like the new ones are replaced.  An empty table gives no rows.
    """
    rows = docs.drop("mix_source", "mix_block", "mix_slot", "mix_rank")
    tie = F.coalesce(F.col("text"), F.lit("")) if "text" in rows.columns else F.lit("")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # The given columns travel as one, so none can clash with what is added here.
    rows = rows.select(F.struct("*").alias("row"), F.coalesce("source", F.lit("")).alias("source"), digest.alias("digest"), F.concat(F.substring(digest, 1, DIGITS), F.when(F.col("doc_id").isNull(), F.hex(F.monotonically_increasing_id() % 64)).otherwise("")).alias("bucket"), F.col("doc_id").alias("id"), tie.alias("tie"))
    sizes = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("digest", "id", "tie")) - 1
    rows = rows.withColumn("within", within).join(sizes, ["source", "bucket"])
    plan = schedule(source_units(docs, weights), block_docs, slots)
    each = plan.select("source", "units", "total", "block_docs").distinct()
    rows = rows.join(F.broadcast(each), "source")  # a row per source
    rows = rows.withColumn("number", F.col("before") + F.col("within")).withColumn("block", F.expr("number div block_docs"))
    rows = rows.withColumn("turn", F.col("block") % F.col("units"))
    rows = rows.join(F.broadcast(plan.select("source", "turn", "slot")), ["source", "turn"])  # a row per slot, ``slots`` at most
    slot = F.expr("block div units") * F.col("total") + F.col("slot")
    return rows.select("row.*", F.col("source").alias("mix_source"), F.col("block").alias("mix_block"), slot.alias("mix_slot"), (F.col("number") % F.col("block_docs")).alias("mix_rank"))


def in_mix_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs``, same columns, with the rows in the mixture's order: in range partitions, sorted within each."""
    rows = mixed(docs, weights)
    return rows.repartitionByRange("mix_slot", "mix_rank").sortWithinPartitions("mix_slot", "mix_rank").select(*docs.columns)
