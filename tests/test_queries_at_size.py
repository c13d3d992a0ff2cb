"""Registered queries on inputs that the smallest tables don't have."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import pixel as P
from skyframe.operators import coverage
from skyframe.plans import catalogue


def against_sql(spark, name, folder):
    got = catalogue.queries()[name](spark, str(folder))
    names = sorted(got.columns)
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(f"select {', '.join(names)} from ({catalogue.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, got.select(names).collect()))), sorted(map(repr, want))


@pytest.mark.parametrize("size, rows", [("0.01", 3072), ("0.1", 0)])
def test_distances_to_holes_where_there_are_none(spark, size, rows):
    got, want = against_sql(spark, "dist2holes", f"/root/testdata/sf{size}")
    assert len(want) == rows
    assert got == want


def test_ranges_of_regions_need_no_sort_of_cells(spark, tmp_path):
    """What a task sorts or gathers is the regions, not their cells: no more of it than rows of the input."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id < 300")
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("strip_coverage", "polygon_coverage", "disc_coverage"):
        got = catalogue.queries()[name](spark, str(tmp_path))
        assert len(got.collect()) > 1000
        sorted_rows, nodes = [], [got._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            kind = node.nodeName()
            if kind == "Exchange":
                sorted_rows.append(node.metrics().apply("shuffleRecordsWritten").value())
            if kind == "AdaptiveSparkPlan":
                nodes.append(node.executedPlan())
            elif kind.endswith("QueryStage"):
                nodes.append(node.plan())
            else:
                nodes += [node.children().apply(i) for i in range(node.children().size())]
        assert sorted_rows and max(sorted_rows) <= 300, (name, sorted_rows)


def test_regions_of_one_key_make_up_one(spark):
    """Discs that hold or overlap each other, also beyond a block's edge, on a coarse and a fine grid."""
    rng = np.random.default_rng(3)
    rows = [(k, *map(float, rng.normal(size=3)), r) for k in (1, 2, None) for r in (2.8, 0.9, 0.5, 0.2, 0.05)] + [(9, 1.0, 0.2, 0.3, 0.4)]
    table = spark.createDataFrame([*rows, rows[0]], "key int, x double, y double, z double, r double")
    for nside in (16, 128):
        grid = spark.range(12 * nside * nside).select(P.pix2vec(nside, "id", True).alias("v")).select("v.*").toPandas().to_numpy()
        got = coverage.covered_ranges(coverage.discs(table, F.struct("x", "y", "z"), F.col("r")), ["key"], nside).collect()
        for key in (1, 2, None, 9):
            inside = np.zeros(len(grid), bool)
            for k, *c, r in rows:
                if k == key:
                    inside |= np.arctan2(np.linalg.norm(np.cross(grid, c), axis=1), grid @ np.array(c)) <= r
            edge = np.flatnonzero(np.diff(np.concatenate(([0], inside, [0])).astype(int)))
            assert sorted((x.first, x.last + 1) for x in got if x.key == key) == list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), (nside, key)
