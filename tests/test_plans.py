"""Plans that must not fall back to costlier operators."""

import __spark_entry__ as entry
import pytest


def plan(spark, sf, name):
    return entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["trial_input", "feature_table", "stage_feature_table", "profile_rollup"])
def test_no_row_is_copied_for_distinct_counts_and_no_sorting_aggregate(spark, sf, name):
    text = plan(spark, sf, name)
    assert "Expand" not in text and "SortAggregate" not in text and "HashAggregate" in text


def test_shuffles_of_the_trial_projection(spark, sf):
    assert plan(spark, sf, "trial_input").count("Exchange hashpartitioning") <= 8
