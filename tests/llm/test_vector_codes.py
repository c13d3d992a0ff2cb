"""Codes by heaps against plain Lloyd rounds in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from skyframe.llm.vector_codes import _Block, _nearest, compressed

R = random.Random(13)
ROWS = "vec_id long, embedding array<double>, label int, code string, error long, ids long"


def plain(rows, parts, entries, rounds):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) and abs(1024 * x) < 2**63 for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], ""
    dim = len(kept[0][2])
    kept = [(i, label, [*q, *([0] * (-dim % parts))]) for i, label, q in kept if len(q) == dim]
    w = len(kept[0][2]) // parts
    books = [[q[p * w : p * w + w] for _, _, q in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, _, q in kept:
                own.setdefault(nearest(q[p * w : p * w + w], book)[1], []).append(q[p * w : p * w + w])
            for e, members in own.items():
                book[e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out, by_label = [], {}
    for i, label, q in kept:
        found = [nearest(q[p * w : p * w + w], book) for p, book in enumerate(books)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    out = [(i, code, error if error < 2**63 else None, by_label[label] if by_label[label] < 2**63 else None) for i, code, error, label in out]
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def held(spark, rows, partitions=3, **limits):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ROWS).repartition(partitions)
    got = compressed(frame, **limits).collect()
    digests = {r.codebooks_sha256 for r in got}
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str), digests


def check(spark, rows, parts=4, entries=256, rounds=4, **more):
    want, digest = plain(rows, parts, entries, rounds)
    got, digests = held(spark, rows, parts=parts, entries=entries, rounds=rounds, **more)
    assert got == sorted(want, key=str) and digests == ({digest} if want else set())


def vectors(n, dim, spread=1.0):
    centres = [[R.gauss(0, spread) for _ in range(dim)] for _ in range(12)]
    return [[x + R.gauss(0, spread / 5) for x in R.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize(("n", "dim", "entries"), [(700, 8, 40), (300, 12, 256), (40, 4, 256), (200, 6, 1)])
def test_matches_plain_rounds(spark, n, dim, entries):
    check(spark, [(i * 7 % 1009, v, R.choice([None, 0, 1, 2])) for i, v in enumerate(vectors(n, dim))], entries=entries)


def test_nulls_ties_repeats_and_other_lengths(spark):
    rows = [(i, [R.randrange(-2, 3) / 1024 for _ in range(8)], i % 3) for i in range(120)]
    rows += [(5, rows[3][1], None), (5, [0.0] * 8, None), (None, [0.5] * 8, 1), (None, None, 1), (400, None, 1), (401, [0.1] * 7 + [None], 1), (402, [0.1] * 7 + [math.nan], 2), (403, [math.inf] + [0.0] * 7, 2), (404, [1.0] * 4, 1), (405, [], None)]
    check(spark, rows, entries=16)


def test_huge_components(spark):
    rows = [(i, [R.choice([-1, 1]) * 2.0 ** R.randrange(0, 52) for _ in range(4)], 1) for i in range(60)]
    check(spark, [*rows, (99, [1e300] * 4, 1), (100, [1e17] * 4, 2), (101, [0.0] * 4, 2)], entries=9)


def test_few_rows_and_none(spark):
    check(spark, [])
    check(spark, [(1, None, 1)])
    check(spark, [(1, [0.25] * 5, None)])
    check(spark, [(2, [], 0), (1, [], 0)])
    with pytest.raises(ValueError, match="256"):
        compressed(spark.createDataFrame([], ROWS), entries=257)


def test_any_partitioning_gives_the_same(spark):
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(400, 8))]
    assert held(spark, rows, 1, entries=30) == held(spark, rows, 11, entries=30)


def test_only_violated_parts_are_scanned_again(monkeypatch):
    """Without drift nothing is popped; with drift of one entry only its parts, or those near enough to it."""
    x = np.array([[i // 50 * 1000 + R.randrange(20)] for i in range(200)], np.int32)
    books, zero = [np.array([[0], [1000], [2000], [3000]])], np.zeros((1, 4))
    block = _Block(x, 1, 4)
    block.assigned(books, zero, None)
    seen = []
    monkeypatch.setattr("skyframe.llm.vector_codes._nearest", lambda rows, book: seen.append(len(rows)) or _nearest(rows, book))
    block.assigned(books, zero, None)
    assert seen == []
    books[0][0] = 990
    block.assigned(books, np.array([[990.0, 990.0, 0.0, 0.0]]), None)
    slack = [min(abs(v - c) for c in (0, 1000, 2000, 3000) if c != v // 1000 * 1000) - abs(v - v // 1000 * 1000) for v in x[:100, 0].tolist()]
    assert seen == [sum(s <= 990 for s in slack)] and 0 < seen[0] < 100
    assert block.entry[0].tolist() == [0 if abs(v - 990) <= abs(v - 1000) and v < 1500 else int(v // 1000) for v in x[:, 0]]
