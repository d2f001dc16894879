"""Joins of queries whose tables an explode multiplies: Spark takes them for small, none of them may be sent whole to the driver."""

import pytest

from tablescribe.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def sent_whole(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.mark.parametrize("name", ["split_and_merge", "border_crossings", "border_grids", "border_layouts", "first_block_by_iou", "host_rows", "mean_best_iou", "overlap_mean_confidence", "iou_pairs", "best_shears"])
def test_no_table_is_sent_whole(spark, name):
    assert sent_whole(QUERIES[name](spark, SF)) == 0


@pytest.mark.parametrize("name, of_rules", [("aligned_titles", 2), ("closest_header_rules", 3)])
def test_only_tables_of_rules_are_sent_whole(spark, name, of_rules):
    assert sent_whole(QUERIES[name](spark, SF)) == of_rules
