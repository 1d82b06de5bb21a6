import pytest

import __spark_entry__ as entry
from spatialplate.plans import queries

from .oracle import duck_rows, plain_outline, spark_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == duck_rows(queries.SQL[name], sf)


def test_simplified_outlines_are_parts_of_their_rings(spark, sf):
    simple = {(r.slide_id, r.ord, r.x, r.y) for r in queries.simplify_outline(spark, sf).collect()}
    whole = {(r.slide_id, r.ord, p.x, p.y) for r in queries._shapes(spark, sf).collect() for p in r.rings[0]}
    assert simple and simple < whole


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, sf):
    assert entry.entry(spark).columns == ["slide_id", "ord", "class_name", "well", "shape_no"]


def test_no_python_in_plans_but_for_simplification(spark, sf):
    for name, query in queries.QUERIES.items():
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert ("ArrowEvalPython" in plan) == (name in ("simplify_outline", "outline_crossings", "shape_stats", "collection_xml_lines")), name


def test_columns_are_pruned_and_filters_pushed(spark, sf):
    plan = queries.clean_shapes(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "value" not in plan.split("ReadSchema")[1]


def test_simplified_outlines_match_a_plain_version(spark, sf):
    rings = {(r.slide_id, r.ord): [(p.x, p.y) for p in r.rings[0]] for r in queries._shapes(spark, sf).select("slide_id", "ord", "rings").collect()}
    got = {}
    for r in queries.QUERIES["simplify_outline"](spark, sf).orderBy("slide_id", "ord", "i").collect():
        got.setdefault((r.slide_id, r.ord), []).append((r.x, r.y))
    assert got == {k: plain_outline(v, 3.0) for k, v in rings.items()}


def test_layouts_pick_their_classes_before_the_exchange(spark, sf):
    plan = queries.assign_wells(spark, sf)._jdf.queryExecution().executedPlan().toString()
    limits = [x for x in plan.split("\n") if "WindowGroupLimit" in x]
    assert any("Partial" in x for x in limits) and any("Final" in x for x in limits)


def test_the_median_needs_no_values_of_a_group(spark, sf):
    plan = queries.shape_stats(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
