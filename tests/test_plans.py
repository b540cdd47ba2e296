"""Plan checks: filters reach the scan, no single-partition windows or exchanges."""
from __future__ import annotations

import re

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_code_filter_pushed_to_scan(spark):
    p = plan(queries()["filter_code"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in p


def test_projection_pruned(spark):
    p = plan(queries()["filter_session_hours"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p


@pytest.mark.parametrize("name", ["clean_posts", "lexicon_label", "lexicon_label_cumulative", "daily_post_volume",
                                  "attention_vs_close", "append_until_conflict", "pages_until_cutoff",
                                  "sector_attention", "top_stocks_per_sector", "viewpoints_by_day"])
def test_no_unpartitioned_window(spark, name):
    """A window without PARTITION BY sorts the whole table in one task. A
    global scalar aggregate may end in a one-row SinglePartition exchange after
    map-side partial aggregation; that is fine and not checked here."""
    p = plan(queries()[name](spark, SF))
    assert not re.search(r"Window \[.*?\], \[\],", p)
    for line in p.splitlines():
        if "Exchange SinglePartition" in line:
            nxt = p.splitlines()[p.splitlines().index(line) + 1]
            assert "HashAggregate" in nxt and "partial_" in nxt, line


@pytest.mark.parametrize("name", ["score_sentiment", "coverage_check", "filter_name_overlap", "longest_name_match"])
def test_no_shuffle_join_on_few_valued_keys(spark, name):
    """Joins keyed only on a class, range id, year or day are broadcast: a
    shuffle on a handful of key values would funnel rows into a few tasks."""
    p = plan(queries()[name](spark, SF))
    assert not re.search(r"SortMergeJoin \[(c|bk|year|day)#\d+\], ", p)


@pytest.mark.parametrize("name", ["sector_attention", "sector_attention_daily", "sector_sentiment"])
def test_posts_are_counted_before_they_meet_constituents(spark, name):
    """A hot stock reaches the join as one row a period: below the join lies an aggregate by code."""
    p = plan(queries()[name](spark, SF))
    joins = [k for k, line in enumerate(p.splitlines()) if re.search(r"Join \[code#\d+", line)]
    assert joins
    below = ["\n".join(p.splitlines()[k:]) for k in joins]
    assert any(re.search(r"HashAggregate\(keys=\[code#\d+[^\]]*, ", b) for b in below)
