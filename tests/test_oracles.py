"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry_points
from tests import oracle
from workload.oracles import ORACLES
from workload.runs import REGISTRY
from tests.conftest import SF_DIR

HOT = ["scene_dialogues", "scene_number", "subtitle_section_gate", "timeline_branches", "catalog_list", "script_build",
       "annotations_merge", "asset_links"]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, con, name):
    got = oracle.actual(entry_points.queries()[name](spark, SF_DIR))
    assert got == oracle.expected(con, entry_points.oracle_sql()[name])


@pytest.mark.parametrize("name", HOT)
def test_query_matches_sql_with_split_groups(spark, con, name):
    spark.conf.set("spark.storyframe.hotRows", "3")
    try:
        got = oracle.actual(entry_points.queries()[name](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.storyframe.hotRows")
    assert got == oracle.expected(con, entry_points.oracle_sql()[name])


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
