"""What the plans of registered queries must and must not hold."""

import re

import pytest

from rowloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "read_columns_filtered")
    assert "GreaterThan(l_quantity,45.0)" in p
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double>", p)


@pytest.mark.parametrize("name", ["rolling_ungrouped", "rolling_ungrouped_var", "shift_rows"])
def test_ungrouped_windows_do_not_meet_in_one_partition(spark, name):
    p = plan(spark, name)
    for line in p.splitlines():
        if "SinglePartition" in line:  # the totals of partitions, one row each
            assert "ENSURE_REQUIREMENTS" in line
    assert not re.search(r"Window \[[^]]*\], \[__pos", p)


def test_asof_shuffles_once(spark):
    p = plan(spark, "asof_backward")
    assert p.count("Exchange hashpartitioning") == 1 and "Join" not in p


@pytest.mark.parametrize("name", [
    "group_agg_strict", "rolling_sum", "cumsum_mask_reset", "ema_decay", "ema_normal", "time_window_sum", "asof_forward", "is_member", "elementwise_math", "cut", "parse_datetime"])
def test_stays_in_the_jvm(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, name))


@pytest.mark.parametrize("name,x", [("group_trimmed_mean", "l_extendedprice"), ("group_quantile_midpoint", "v"), ("group_median", "v")])
def test_ranks_of_a_group_are_shared_among_tasks(spark, name, x):
    p = plan(spark, name)
    ordered = re.findall(rf"windowspecdefinition\(([^()]*), {x}#\d+L? ASC", p)
    assert ordered and all(keys.startswith("__part") for keys in ordered)
    assert "lambda" not in p  # a table of trimming steps that each row reads


def test_every_query_with_sql_is_registered():
    assert set(catalog.oracle_sql()) <= set(QUERIES)
    assert len(QUERIES) > 80


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(spark, parts, monkeypatch):
    from rowloom.plans import group_queries, order_queries, registry

    def dealt(spark, sf, name):
        return registry.table(spark, sf, name).repartition(parts)

    for module in (group_queries, order_queries):
        monkeypatch.setattr(module, "table", dealt)
    for name in ("group_first_last_nth", "group_ids_first_occurrence", "rolling_sum", "asof_forward", "lexsort", "time_window_sum"):
        got = sorted(map(str, QUERIES[name](spark, SF).collect()))
        monkeypatch.undo()
        want = sorted(map(str, QUERIES[name](spark, SF).collect()))
        for module in (group_queries, order_queries):
            monkeypatch.setattr(module, "table", dealt)
        assert got == want, name
