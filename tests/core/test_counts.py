"""Texts are cut into words and counted once, however often the counts are read."""

import pytest

from driftline.plans.catalog import QUERIES


@pytest.mark.parametrize("name", ["aligned_matrix", "eligibility_mask", "exclude_half_years", "freq_totals", "postfilter_hy", "scored_occurrences", "survivors_abs", "variant_rescue"])
def test_counts_are_read_from_the_store(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_gate_cuts_texts_for_its_rows_only(spark, sf):
    plan = QUERIES["eligible_gate"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
