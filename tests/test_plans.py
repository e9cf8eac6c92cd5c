"""Plans are the ones wanted: filters and columns reach the scan, no cross join, map-side aggregation."""

import os
import re

import pytest

from mergeloom.plans import catalogue
from mergeloom.session import Scratch, drop_scratch, shared_dir

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
#: Queries whose plan is built without running jobs of their own.
PLAIN = [
    "zip_ownership_mix", "monthly_volume", "new_in_state", "recent_changes_join", "enrichment_coverage", "group_share_by_state", "multi_facet_filter", "anti_unchanged", "semi_office_zips", "pct_rank_peer",
    "latest_change", "topk_per_group", "platform_enrichment", "set_ghost_rows", "transition_counts", "fuzzy_block_best", "band_join_60d", "catchment_2mi", "location_collapse", "collapsed_counts",
    "two_key_enrichment", "row_diff_events", "watermark_pull", "upsert_guarded", "admission", "invariant_checks", "denominator_equality", "orphan_links", "best_cluster", "batch_changes", "market_rollup",
]


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df = catalogue.queries()[name](spark, DIR)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for read in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert read.count(":") < 20, "a scan reads columns that the query does not need"


def test_filters_reach_the_scan(spark):
    assert "GreaterThanOrEqual(enumeration_date" in plan(spark, "new_in_state")
    text = plan(spark, "multi_facet_filter")
    assert "In(deal_type" in text and "GreaterThanOrEqual(deal_date" in text


def test_scratch_is_dropped(spark):
    cut = Scratch(spark).cut(spark.range(5))
    folder = shared_dir(spark).removeprefix("file://") + f"/mergeloom/{spark.sparkContext.applicationId}"
    assert cut.count() == 5 and os.path.isdir(folder)
    drop_scratch(spark)
    assert not os.path.exists(folder)
