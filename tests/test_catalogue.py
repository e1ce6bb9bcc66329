from __future__ import annotations

import json

import pytest
from pointloom.plans import catalogue

from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(catalogue.QUERIES[name](spark, sf_dir), sf_dir, catalogue.ORACLE_SQL[name])


def test_gltf_export(spark, sf_dir):
    rows = catalogue.QUERIES["gltf_export"](spark, sf_dir).limit(5).collect()
    assert rows
    for r in rows:
        made = json.loads(r.gltf)
        assert made["accessors"][0]["count"] == r.n_points == 11
