"""MinHash near-duplicate removal with SetSketch registers (Ertl 2021).

1. One pass over the texts makes each document's set of five-word shingles, a
   digest of that set and its registers: K_i = floor(1 - log_b(min_i)), where
   min_i is the least of exponentially distributed hashes of the set, truncated
   to [0, q + 1].  Registers of a union are element-wise maxima, so they merge.
2. Documents with equal sets are one class; only classes go on.
3. Bands of registers are hashed to buckets.  A bucket beyond ``BLOCK`` members
   is dealt out as pairs of blocks, so no task holds an unbounded bucket, and a
   pair is taken up in its first common band only.
4. For such a pair the Jaccard similarity is estimated jointly by maximum
   likelihood from the counts of larger, smaller and equal registers and both
   set sizes.  Pairs far below the threshold (``MARGIN`` standard deviations)
   end here.
5. The rest is verified on full shingle sets.  Of small buckets, first every
   class with its most similar partner, then, of what these links leave in
   different components, all pairs.  Of large buckets, the members that have a
   similar one are dealt out in pairs of blocks once more, with their sets: a
   matrix product gives all intersections, and a spanning forest of the links
   is handed on, never all pairs.  Components come from alternating star steps.

With 20 bands of 4 registers a pair at similarity 0.85 shares no band with
probability 4e-7; none is lost otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_column, components, dropped, gram_hashes, mix, shingle_set, stored, text_batches, word_hashes

BANDS, ROWS = 20, 4
REGISTERS = 160  # bands take the first of them, estimates all
SKETCH_B, SKETCH_A, SKETCH_Q = 1.001, 20.0, 65534
BLOCK = 1024
#: Pairs of a bucket with up to so many members are spelled out; of a larger one, only links that its components need.
SMALL = 8
MARGIN = 4.5
#: Ids of candidate documents are broadcast up to this many (8 bytes each); beyond it they are joined by shuffling.
BROADCAST_IDS = 2_000_000

_MULTIPLIERS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
_BAND_MIX = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)


# --- sketches --------------------------------------------------------------
def registers(shingles: np.ndarray) -> np.ndarray:
    """The registers (uint16) of a set of 64-bit shingle hashes; zeros for the empty set."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, np.multiply.outer(_MULTIPLIERS, shingles[at : at + 1024]).min(axis=1), out=least)
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    uniform = ((least >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    value = np.floor(1 - np.log(-np.log1p(-uniform) / SKETCH_A) / np.log(SKETCH_B))
    return np.clip(value, 0, SKETCH_Q + 1).astype(np.uint16)


def joint_similarity(n1, n2, larger, smaller, equal) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons (1 against 2) and the set sizes."""
    n1, n2 = np.asarray(n1, np.float64), np.asarray(n2, np.float64)
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    log_b, step = np.log(SKETCH_B), (SKETCH_B - 1) / SKETCH_B

    def likelihood(j):
        p1 = -np.log1p(-np.clip(u - v * j, 0, 1) * step) / log_b
        p2 = -np.log1p(-np.clip(v - u * j, 0, 1) * step) / log_b
        p0 = 1 - p1 - p2
        tiny = 1e-300
        return larger * np.log(np.maximum(p1, tiny)) + smaller * np.log(np.maximum(p2, tiny)) + equal * np.log(np.maximum(p0, tiny))

    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(24):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        right = likelihood(a) < likelihood(b)
        low, high = np.where(right, a, low), np.where(right, high, b)
    return (low + high) / 2


def _sketched(batches):
    for batch in batches:
        ids = batch.column(0)
        for start, texts in text_batches(batch, "text"):
            words, bounds = word_hashes(texts)
            n, digest, regs, bands = [], [], [], []
            for i in range(len(texts)):
                own = shingle_set(words[bounds[i] : bounds[i + 1]])
                r = registers(own)
                n.append(len(own))
                digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                regs.append(r.tobytes())
            yield pa.RecordBatch.from_arrays([ids.slice(start, len(texts)), pa.array(n, pa.int64()), binary_column(digest), binary_column(regs)], names=["doc_id", "n_shingles", "digest", "registers"])


def _band_keys(batches):
    """The bucket of each band, as a 64-bit hash of the band's number and registers."""
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
        keys = mix((regs.astype(np.uint64) * _BAND_MIX).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        flat = pa.array(keys.reshape(-1).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)], names=["node", "bands"])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, registers), a row per document."""
    return docs.select("doc_id", "text").mapInArrow(_sketched, "doc_id long, n_shingles long, digest binary, registers binary")


# --- candidates ------------------------------------------------------------
def _pairs_of(threshold: float):
    p = threshold
    least_equal = int(REGISTERS * p - MARGIN * np.sqrt(REGISTERS * p * (1 - p)))
    floor = p - MARGIN * np.sqrt(p * (1 - p) / REGISTERS)

    def similar(n, regs, i, j):
        """Of the pairs (i, j), those whose estimate may reach the threshold, and the estimates."""
        ok = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[ok], j[ok]
        same = (regs[i] == regs[j]).sum(axis=1)
        ok = same >= least_equal
        i, j, same = i[ok], j[ok], same[ok]
        larger = (regs[i] > regs[j]).sum(axis=1)
        est = joint_similarity(n[i], n[j], larger, REGISTERS - same - larger, same)
        ok = est >= floor
        return i[ok], j[ok], est[ok]

    def first_band(regs, band, i, j):
        same = (regs[i, : BANDS * ROWS] == regs[j, : BANDS * ROWS]).reshape(-1, BANDS, ROWS)
        return same.all(axis=2).argmax(axis=1) == band[i]

    def batch_of(a, b, est, bucket):
        if len(a):
            b = pa.array(b) if b is not None else pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(est), pa.array(bucket)], names=["a", "b", "est", "bucket"])

    def whole_runs(table):
        """Sorted rows of complete buckets: pairs of small ones, members of large ones that have a similar member."""
        col = lambda c: table.column(c).to_numpy()
        ids, n, key, band, b1, b2, block = (col(c) for c in ("node", "n_shingles", "bucket", "band", "b1", "b2", "block"))
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1]))))
        size = np.diff(np.append(new, len(ids)))
        row_end = np.repeat(new + size, size)
        few = np.repeat((size <= SMALL) & (col("blocks")[new] == 1), size)
        rows = np.arange(len(ids))
        for d in range(1, SMALL):
            i = rows[few & (rows + d < row_end)]
            i = i[ids[i] != ids[i + d]]
            i = i[first_band(regs, band, i, i + d)]
            i, j, est = similar(n, regs, i, i + d)
            yield from batch_of(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), est, key[i])
        for start, m in zip(new.tolist(), size.tolist(), strict=True):
            if few[start]:
                continue
            near = np.zeros(m, bool)
            for k in range(m - 1):
                j = np.arange(k + 1, m)
                if near[k]:
                    j = j[~near[k + 1 :]]
                if b1[start] != b2[start]:
                    j = j[block[start + j] != block[start + k]]
                i, j, _ = similar(n, regs, np.full(len(j), start + k), start + j)
                near[j - start] = True
                near[k] |= len(j) > 0
            own = ids[start : start + m][near]
            yield from batch_of(own, None, np.ones(len(own)), np.full(len(own), key[start]))

    def pairs(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not held.num_rows:
                continue
            key, b1, b2 = (held.column(c).to_numpy() for c in ("bucket", "b1", "b2"))
            other = np.flatnonzero((key != key[-1]) | (b1 != b1[-1]) | (b2 != b2[-1]))
            if len(other):  # the last bucket may go on in the next batch
                yield from whole_runs(held.slice(0, other[-1] + 1))
                held = held.slice(other[-1] + 1)
        if held is not None and held.num_rows:
            yield from whole_runs(held)

    return pairs


def _dealt(members: DataFrame) -> DataFrame:
    """``members`` (node, bucket, ...) with the pairs of blocks (b1, b2) in which their bucket is worked on."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = members.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("members") / BLOCK))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return members.withColumn("b1", F.least("block", "with")).withColumn("b2", F.greatest("block", "with")).drop("with", "members")


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, est, bucket) of ``classes`` (node, n_shingles, registers): pairs that share a small bucket and whose estimate may reach the threshold.

    For a large bucket, a row with a null b for each member that has a similar one.
    """
    full = classes.where("n_shingles > 0")
    keys = full.select("node", "registers").mapInArrow(_band_keys, "node long, bands array<long>").select("node", F.posexplode("bands").alias("band", "bucket"))
    keys = stored(keys, "bands")
    dealt = _dealt(keys).join(full, "node").select("node", "n_shingles", "registers", "bucket", "band", "b1", "b2", "block", "blocks")
    dealt = dealt.repartition("bucket", "b1", "b2").sortWithinPartitions("bucket", "b1", "b2")
    pairs = stored(dealt.mapInArrow(_pairs_of(threshold), "a long, b long, est double, bucket long"), "pairs")
    dropped(keys)
    return pairs


# --- verification ----------------------------------------------------------
def _sets(batches):
    for batch in batches:
        for start, texts in text_batches(batch, "text"):
            words, bounds = word_hashes(texts)
            own = [shingle_set(words[bounds[i] : bounds[i + 1]]).view(np.int64) for i in range(len(texts))]
            at = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(own)))], names=["node", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return both.where(F.col("common") * 100 >= union * percent).select("a", "b").distinct()


def forest(sets: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) with 100 * intersection >= percent * union that connect what all such links connect.

    All intersections come from a product of the sets' incidence matrix with
    itself, some columns at a time; counts are exact.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets])
    shingle, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    shared = np.flatnonzero(np.bincount(at) > 1)
    place = np.full(len(shingle), -1)
    place[shared] = np.arange(len(shared))
    column = place[at]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((m, m), np.float32)
    for low in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((m, min(4096, len(shared) - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    linked = common * 100 >= percent * (size[:, None] + size[None, :] - common)
    left, links = np.ones(m, bool), []
    while left.any():
        todo = [int(np.flatnonzero(left)[0])]
        left[todo[0]] = False
        while todo:
            i = todo.pop()
            found = np.flatnonzero(linked[i] & left)
            left[found] = False
            links += [(i, j) for j in found.tolist()]
            todo += found.tolist()
    a, b = (np.array(x, np.int64) for x in zip(*links, strict=True)) if links else (np.empty(0, np.int64), np.empty(0, np.int64))
    return a, b


def _forests(percent: int):
    def whole(table):
        col = lambda c: table.column(c).to_numpy()
        ids, key, b1, b2 = (col(c) for c in ("node", "bucket", "b1", "b2"))
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1]))))
        lists = table.column("shingles").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for start, end in zip(new.tolist(), np.append(new[1:], len(ids)).tolist(), strict=True):
            i, j = forest([flat[at[k] : at[k + 1]] for k in range(start, end)], percent)
            a, b = ids[start + i], ids[start + j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def forests(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not held.num_rows:
                continue
            key, b1, b2 = (held.column(c).to_numpy() for c in ("bucket", "b1", "b2"))
            other = np.flatnonzero((key != key[-1]) | (b1 != b1[-1]) | (b2 != b2[-1]))
            if len(other):
                yield from whole(held.slice(0, other[-1] + 1))
                held = pa.concat_tables([held.slice(other[-1] + 1)]).combine_chunks()
        if held is not None and held.num_rows:
            yield from whole(held)

    return forests


def _large_buckets(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links among the members of large buckets; a bucket's members that all lie in one component need a link each."""
    dealt = _dealt(hot).join(sets, "node").select("node", "shingles", "bucket", "b1", "b2")
    dealt = dealt.repartition("bucket", "b1", "b2").sortWithinPartitions("bucket", "b1", "b2")
    return dealt.mapInArrow(_forests(percent), "a long, b long").distinct()


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Of ``pairs``, those whose ends are in different components so far."""
    ca = comps.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joined = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "est")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text, other columns ignored).

    Documents are linked if 100 * intersection >= percent * union of their
    five-word shingle sets.  Null, empty and white-space texts have the empty
    set and no links.  Rows with equal sets are one class, so exact copies and
    repeated rows cost one comparison; rows that repeat a doc_id are one
    document.  A null doc_id takes part in no link: its component_id is null
    and it is kept.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = stored(sketches(docs), "sketches")
    classes = stored(
        rows.where("doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("x")).select("digest", F.col("x.doc_id").alias("node"), "x.n_shingles", "x.registers"), "classes"
    )
    pairs = candidates(classes.drop("digest"), percent / 100)
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct(), "nodes")
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(wanted, "node", "left_semi")
    sets = stored(texts.mapInArrow(_sets, "node long, shingles array<long>"), "sets")
    hot = pairs.where("b is null").select(F.col("a").alias("node"), "bucket").distinct()
    small = pairs.where("b is not null").select("a", "b", "est")
    best = small.select(F.explode(F.array(F.struct("a", "b", "est", F.col("a").alias("n")), F.struct("a", "b", "est", F.col("b").alias("n")))).alias("p")).select("p.*")
    best = best.groupBy("n").agg(F.max(F.struct("est", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
    first = stored(_verified(best, sets, percent).unionAll(_large_buckets(hot, sets, percent)), "links")
    comps = components(first)
    rest = _across(small.join(best, ["a", "b"], "left_anti"), comps)
    # An id that several texts have links their classes.
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).where("d1 <> d2").select("doc_id")
    several = stored(several, "several")
    of_id = rows.join(several, "doc_id").where("n_shingles > 0").join(classes.select("digest", "node"), "digest").select("doc_id", "node")
    of_id = of_id.join(of_id.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b"))
    links = stored(first.unionAll(_verified(rest, sets, percent)).unionAll(of_id), "links")
    dropped(sets, pairs, nodes, first)
    comps = components(links)
    # Equal digests share the class's node; links of the class hold for all its rows.
    of_class = classes.where("n_shingles > 0").select("digest", "node").join(comps, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    if not several.isEmpty():  # such an id's rows with an empty text go with the others
        whole = out.join(several, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with the same columns and one document of each group: the smallest doc_id.

    Of rows that repeat a doc_id one stays; rows with a null doc_id all stay.
    """
    keep = near_duplicates(docs, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    own = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return own.select(*docs.columns).unionByName(docs.where("doc_id is null"))
