"""The filter audit against a plain replay, document by document."""

import itertools
import random
import re

import duckdb
import pytest

from skyframe.llm import oracles
from skyframe.llm.filter_audit import document_flags, filter_audit, replayed

R = random.Random(11)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask int, part string, digest string"
LABELS = "doc_id long, quality int, toxic int, good boolean"


def documents():
    long = " ".join(f"w{i}" for i in range(150))
    texts = [long, long + " #", "Short", "", None, " \t\n\x0b", "A" * 50, "a b " * 200, long.upper(), long, "é&" * 3, "É" * 100, "x " * 20000 + "|", long + " x", " " + long + "\r\n", "a  b"]
    rows = [(i, t, [None, "", "en", "de"][i % 4], "s", 0, 9, "x", "y") for i, t in enumerate(texts)]
    rows += [(None, long, "en", None, None, 1, None, None), (None, None, None, None, None, None, None, None), rows[0], (0, "Short", "de", None, 0, 0, "", "")]
    for i in range(60):
        rows.append((100 + i, R.choice(texts), R.choice(["en", "fr", None]), "s", 0, 0, "", ""))
    return rows


def labels():
    rows = [(i, R.choice([0, 1, None]), R.choice([0, 1, None]), True) for i in range(0, 170, 2)]
    return [*rows, (0, 1, 0, False), (0, 0, 1, False), (None, 1, 1, None)]


def replay_by_force(docs, marks):
    first, good, toxic = {}, set(), set()
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x, _ in marks:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    out = {}
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {x for x, y in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t), i is not None and first[t] < i), strict=True) if y}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                own = out.setdefault((lang or "", "".join(order), step), [0] * 6)
                removed = f in fails and not gone
                own[0] += not gone and not removed
                own[1] += removed
                own[2] += gone and f in fails
                own[3] += fails == {f}
                own[4] += removed and i is not None and i in good
                own[5] += removed and i is not None and i in toxic
                gone |= removed
    total = {}
    for (part, order, step), n in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + n[1]
    return {k: [*n, total[k[0], k[1][k[2] - 1]]] for k, n in out.items()}


def test_replay_matches_brute_force_and_sql(spark):
    docs, marks = documents(), labels()
    frames = {"documents": spark.createDataFrame(docs, DOCS), "labels": spark.createDataFrame(marks, LABELS)}
    got = filter_audit(frames["documents"], frames["labels"]).toPandas()
    want = replay_by_force(docs, marks)
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len(got) == len(want) == 600 * len({k[0] for k in want})
    assert {(r.part, r.filter_order, r.step): [getattr(r, c) for c in columns] for r in got.itertuples()} == want
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame.toPandas().convert_dtypes())
    sql = con.sql(oracles.ORACLES["op11_filter_audit"]).df()[list(got.columns)]
    assert sorted(sql.itertuples(index=False, name=None)) == sorted(got.itertuples(index=False, name=None))


def test_empty_tables(spark):
    none, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit(none, no_labels).count() == 0
    some = filter_audit(spark.createDataFrame([(1, "a b", "en", "", 0, 0, "", "")], DOCS), no_labels)
    assert some.count() == 600 and some.agg({"good_lost": "sum", "removed": "sum"}).first()[0] in (0, 120)


def test_other_filters_and_their_bound(spark):
    flags = spark.createDataFrame([("p", 3, True, False), ("p", 2, False, True), ("p", 0, True, True)], "part string, mask int, good boolean, toxic boolean")
    rows = {(r.filter_order, r.step): r for r in replayed(flags, "XY").collect()}
    assert len(rows) == 4 and rows["XY", 1].removed == 1 and rows["XY", 2].removed == 1 and rows["XY", 2].redundant == 1 and rows["YX", 2].shapley == 1
    with pytest.raises(ValueError, match="six"):
        replayed(flags, "ABCDEFG")


def test_flags_hold_no_text(spark):
    assert document_flags(spark.createDataFrame(documents(), DOCS), spark.createDataFrame(labels(), LABELS)).columns == ["part", "mask", "good", "toxic"]
