"""Plans of the registered queries: no products, no unbounded windows, pruned scans."""

import re

import pytest

import catalog
from termweave.plans.cut import cut, release

catalog.load_all()
SF = "/root/testdata/sf0.001"
NAMES = ["get_labels", "resolve_labels", "all_active_labels", "contract_uri", "search_many", "borrow_candidates",
         "label_tokens", "find_references", "check_axiom_ids", "check_duplicate_labels", "rename_index", "mint_slug",
         "mint_counter", "edit_rows", "publish_lines", "closure", "match_chain", "delete_refusals", "incremental_results"]


def plan_of(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_products_and_bounded_windows(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if re.match(r"^\W*(?:\*\(\d+\) )?Window ", line):
            # A window runs over a salted part of a group, or over what a rank limit left of it
            # in every task: the limit stands below it, with only sorts and exchanges between.
            below = [x for x in lines[at + 1:at + 8] if not re.search(r"Sort|Exchange|Project|AQEShuffleRead|ShuffleQueryStage", x)]
            assert "_salt" in line or "WindowGroupLimit" in below[0] or "Filter (_p" in below[0], "\n".join(lines[at:at + 8])


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "supertypes")
    assert "In(prop" in plan.replace("IN(prop", "In(prop") or "prop" in plan.split("PushedFilters")[1]
    plan = plan_of(spark, "needs_update")
    assert "o_totalprice" not in plan


def test_written_tables_are_released(spark):
    frame = cut(spark.range(5).toDF("n"))
    assert frame.count() == 5 and release(spark) >= 1
    assert release(spark) == 0


def final_plan(spark, name):
    """The plan as it ran, with the joins that adaptive execution changed."""
    frame = catalog.QUERIES[name](spark, SF)
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


# A broadcast is sized by compressed bytes, so a side that grows with the input is never one.
@pytest.mark.parametrize("name, join", [
    ("rename_iris", r"SortMergeJoin \[k#\d+L\], \[k#\d+L\], LeftOuter"), ("exists", r"SortMergeJoin \[\w+#\d+\], \[\w+#\d+\], LeftSemi"),
    ("not_exists", r"SortMergeJoin \[\w+#\d+\], \[\w+#\d+\], LeftAnti"),
    ("known_tokens", r"SortMergeJoin \[token#\d+\], \[token#\d+\], LeftSemi"),
    ("edit_rows", r"SortMergeJoin \[end#\d+\], \[end#\d+\], LeftOuter")])
def test_growing_sides_are_not_broadcast(spark, name, join):
    assert re.search(join, final_plan(spark, name))


def test_constants_of_a_pattern_filter_before_the_distinct(spark):
    """No table of all triples: few of them match, and nobody asks for the kind of a value."""
    from catalog.graphs import match

    plan = match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    sides = plan.split("Aggregate")[1:]
    assert len(sides) == 2 and all("Filter" in side and "rdf" in side for side in sides)
    assert "RLIKE" not in plan
