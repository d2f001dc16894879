"""Queries whose pages are whole brands: parts of one brand meet however far apart their keys are."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tablescribe.operators import series
from tablescribe.plans.catalog import QUERIES


@pytest.fixture
def rows_of(spark, tmp_path):
    def run(name, *parts):
        rows = [(key, "part", "Brand#1", "TYPE", size, price) for key, size, price in parts]
        spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
        got = QUERIES[name](spark, str(tmp_path))
        return sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect())

    return run


def test_points_within_radius_of_a_brand(rows_of):
    got = rows_of("points_within_radius", (1, 5, 900.0), (2501, 5, 910.0), (5001, 5, 910.0), (9000, 50, 900.0))
    assert got == [(1, 2, "Brand#1"), (2501, 2, "Brand#1"), (5001, 2, "Brand#1"), (9000, 0, "Brand#1")]


def test_right_neighbours_in_a_brand(rows_of):
    got = rows_of("right_neighbours", (1, 5, 900.0), (2501, 16, 905.0), (5001, 16, 905.0))
    assert got == [(4.0, 1, 2501, "Brand#1")]


def test_split_and_merge_in_a_brand(rows_of):
    got = rows_of("split_and_merge", (117, 5, 900.0), (117 * 20, 5, 900.0), (117 * 60, 50, 900.0))
    near, far = [(117, 2), (117 * 20, 2)], [(117 * 60, 1)]
    assert got == sorted((i, n, "Brand#1", side) for i, n in near + far for side in ("truth", "found"))


def test_first_block_in_a_brand(rows_of):
    got = rows_of("first_block_by_iou", (117, 5, 900.0), (117 * 20, 5, 900.0), (117 * 60, 50, 900.0))
    assert got == [(117, 117, "Brand#1"), (117, 117 * 20, "Brand#1"), (117 * 60, 117 * 60, "Brand#1")]


def test_mean_best_iou_in_a_brand(rows_of):
    # the second part's own moved box lies 8 to the right and 1 below; the first part's lies where the second one's is
    got = rows_of("mean_best_iou", (117, 5, 900.0), (117 * 20 + 53, 5, 900.0))
    assert got == [(2, 1.0, "Brand#1")]


def test_column_coverage_of_a_brand(rows_of):
    got = rows_of("column_coverage", (1, 5, 900.0), (2501, 5, 900.0), (5001, 6, 900.0))
    assert got == [(1, "Brand#1", 57.0, 49.0), (2, "Brand#1", 48.0, 40.0), (3, "Brand#1", 49.0, 48.0)]


def test_reading_order_of_a_brand(rows_of):
    got = rows_of("reading_order", (1, 5, 901.0), (2501, 4, 950.0), (5001, 5, 900.0), (7001, 1, 970.0), (9001, 5, 901.0))
    assert [(i, place) for i, _, place in got] == [(1, 3), (2501, 1), (5001, 2), (7001, 5), (9001, 4)]


def test_running_mean_clusters_of_a_brand(rows_of):
    got = rows_of("running_mean_clusters", (1, 5, 900.0), (2501, 5, 903.0), (5001, 5, 903.0), (7001, 5, 905.9), (9001, 5, 930.0))
    assert got == [(0, 905.9, 900.0, 4, "Brand#1"), (1, 930.0, 930.0, 1, "Brand#1")]


def test_cluster_bounds_equal_the_clusters_of_rows(spark):
    r = random.Random(5)
    rows = spark.createDataFrame([("g%d" % (i % 3), i, r.randint(0, 900) / 10) for i in range(900)] + [("g0", 1000, None), ("g1", 1001, math.nan), ("g1", 1002, math.nan)], "g string, id int, v double")
    slow = series.running_clusters(rows, ["g"], "v", ["id"], 4.0).groupBy("g", "cluster").agg(F.count("*").alias("members"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    shown = lambda df: sorted(str(tuple(x)) for x in df.collect())
    assert shown(series.running_cluster_bounds(rows, ["g"], "v", 4.0)) == shown(slow)


def test_host_rows_in_a_brand(rows_of):
    # the part at 117 * 20 + 9 has its moved box 9 below; the other part's covers it whole
    got = rows_of("host_rows", (117, 5, 900.0), (117 * 20 + 9, 5, 900.0))
    assert got == [(117, 117, "Brand#1"), (117, 117 * 20 + 9, "Brand#1")]


def test_label_distances_in_a_brand(rows_of):
    got = rows_of("label_distances", (4, 5, 900.0), (2501, 5, 903.0), (5002, 50, 900.0))
    assert got == [(0, 1, 3.0, "Brand#1")]
