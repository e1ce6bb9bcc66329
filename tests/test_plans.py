"""What the physical plans of the queries must and must not hold."""

from __future__ import annotations

import re

import pytest
from pointloom.plans import catalogue


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - {"progress_stream"}))
def test_no_query_joins_all_with_all(spark, sf_dir, capsys, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(catalogue.QUERIES[name](spark, sf_dir), capsys))


def test_lookup_reaches_the_scan(spark, sf_dir, capsys):
    text = plan(catalogue.QUERIES["keyed_lookup"](spark, sf_dir), capsys)
    assert "EqualTo(o_custkey,7)" in text
    assert "o_totalprice" not in re.search("ReadSchema: .*", text)[0]


def test_nearest_point_leaves_one_row_per_task(spark, sf_dir, capsys):
    text = plan(catalogue.QUERIES["nearest_point"](spark, sf_dir), capsys)
    assert "partial_min" in text and len(re.findall(r"\) Exchange", text)) == 1


@pytest.mark.parametrize("name", ["point_reshape", "float32_narrow", "status_stage", "list_row", "remove_at", "config_coerce", "ext_whitelist"])
def test_projections_do_not_shuffle(spark, sf_dir, capsys, name):
    assert "Exchange" not in plan(catalogue.QUERIES[name](spark, sf_dir), capsys)
