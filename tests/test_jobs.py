"""Definition tables: moves, parents, rules, sessions."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tickloom.functions.text import ident, level_kept, require_rows, stored_level
from tickloom.operators import bulk, jobs, sessions

STEPS = [(1, 11, 10.0), (1, 12, 20.0), (1, 13, 30.0), (2, 21, 10.0), (2, 22, 10.0), (2, 23, 20.0)]


def steps(spark):
    return spark.createDataFrame(STEPS, "chain_id bigint, task_id bigint, task_order double")


def moved(spark, ids, upward):
    wanted = spark.createDataFrame([(i,) for i in ids], "task_id bigint")
    out = jobs.move_steps(steps(spark), wanted, upward)
    return {r.task_id: r.task_order for r in out.where("moved").collect()}


@pytest.mark.parametrize(
    "ids,upward,want",
    [
        ([11], True, {}), ([12], True, {12: 10.0, 11: 20.0}), ([12], False, {12: 30.0, 13: 20.0}), ([13], False, {}),
        ([12, 23], True, {12: 10.0, 11: 20.0, 23: 10.0, 21: 20.0}),
        ([22], True, {}),  # its only companion is at the same order
        ([12, 13], True, {}),  # both moves want step 12: refused
    ],
)
def test_moves(spark, ids, upward, want):
    assert moved(spark, ids, upward) == want


def test_moves_in_small_blocks(spark):
    wanted = spark.createDataFrame([(13,)], "task_id bigint")
    out = jobs.move_steps(steps(spark), wanted, True, block_width=5.0)
    assert rows(out.where("moved"), "task_id", "task_order") == [(12, 30.0), (13, 20.0)]


def test_parents_loops_and_orphans(spark):
    links = [(i, i - 1 if i > 1 else None) for i in range(1, 40)] + [(50, 51), (51, 50), (60, 999), (70, None)]
    tasks = spark.createDataFrame(links, "task_id bigint, parent_id bigint")
    heads = spark.createDataFrame([(1, 7)], "task_id bigint, chain_id bigint")
    got = jobs.order_from_parents(tasks, heads)
    assert rows(got, "task_id", "chain_id", "task_order") == sorted([(i, 7, float(i)) for i in range(1, 40)], key=repr)


def test_pointer_tree(spark):
    tasks = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2)], "task_id bigint, parent_id bigint")
    heads = spark.createDataFrame([(1, 5)], "task_id bigint, chain_id bigint")
    assert rows(jobs.order_from_parents(tasks, heads), "task_id", "task_order") == [(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0)]


def test_not_in_null_rules(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    for right, want in (([("a",)], ["b"]), ([("a",), (None,)], []), ([], ["a", "b", None])):
        r = spark.createDataFrame(right, "k string")
        assert sorted((x.k for x in sessions.not_in(left, r, "k").collect()), key=repr) == sorted(want, key=repr)


def test_rules_see_defaults_first(spark):
    task = "task_name string, kind string, command string, timeout int, live boolean"
    schema = f"definition_id int, chain_name string, schedule string, client_name string, on_error string, max_instances int, tasks array<struct<{task.replace(' ', ':')}>>"
    schema = schema.replace(",:", ", ")
    ok = [("", "", "SELECT 1", None, None)]
    data = [
        (1, "a", "", None, None, None, ok),
        (2, "b", "@every 1 s", None, None, 0, ok),
        (3, "c", "1 2 3", None, None, 1, ok),
        (4, "", "* * * * *", None, None, 1, ok),
        (5, "e", "* * * * *", None, None, 1, []),
        (6, "f", "* * * * *", None, None, 1, [("", "bash", "x", None, None)]),
        (7, "g", "* * * * *", None, None, 1, [("", "sql", "", -1, None)]),
        (8, "h", "* * * * *", None, None, 1, ok), (9, "h", "* * * * *", None, None, 1, ok),
    ]
    got = jobs.definition_rules(jobs.definition_defaults(spark.createDataFrame(data, schema)))
    bad = {
        r.definition_id: sorted(k for k, v in r.asDict().items() if v is True and k != "accepted") for r in got.collect()
    }
    assert bad == {
        1: [], 2: ["never_admits"], 3: ["schedule_bad"], 4: ["name_missing"], 5: ["no_task"], 6: ["kind_bad"],
        7: ["command_missing", "timeout_negative"], 8: ["name_repeated"], 9: ["name_repeated"],
    }


def test_run_matrix_and_arguments(spark):
    tasks = spark.createDataFrame(
        [(1, "SQL"), (2, "SQL"), (3, "PROGRAM"), (4, "SQL"), (5, "BUILTIN")], "task_id bigint, kind string"
    ).withColumns({"chain_id": F.lit(1), "task_order": F.lit(1.0), "command": F.lit("c")})
    params = spark.createDataFrame(
        [(1, 1, "[42]"), (1, 2, '["John", 30, null]'), (2, 1, None), (3, 1, "[1]"), (3, 2, '["-l"]'), (4, 1, ""), (5, 1, "foo"), (1, 3, "foo")],
        "task_id bigint, order_id bigint, value string",
    )
    got = jobs.run_matrix(tasks, params)
    assert rows(got, "task_id", "value", "args_ok") == sorted(
        [(1, "[42]", True), (1, '["John", 30, null]', True), (1, "foo", False), (2, "", True), (3, "[1]", False), (3, '["-l"]', True), (5, "foo", True)],
        key=repr,
    )
    second = got.where("value like '%John%'").select(jobs.argument(F.col("value"), 1), jobs.argument(F.col("value"), 2)).first()
    assert tuple(second) == ("30", None)


def test_upsert_takes_nulls(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, v int, w string")
    new = spark.createDataFrame([(2, None, "x"), (3, 30, "y")], "k int, v int, w string")
    assert rows(bulk.upsert(old, new, ["k"], ["v"]), "k", "v", "w") == [(1, 10, "a"), (2, None, "b"), (3, 30, "y")]


def test_add_job_defaults(spark):
    chain = spark.createDataFrame([(5, "x")], "chain_id bigint, chain_name string")
    task = spark.createDataFrame([(9, 5)], "task_id bigint, chain_id bigint")
    new = bulk.expand_jobs(spark.createDataFrame([("j", "* * * * *", "SELECT 1")], "job_name string, job_schedule string, job_command string"), chain, task)
    assert rows(new.task, "task_id", "chain_id", "task_order", "kind", "ignore_error", "autonomous") == [(10, 6, 10.0, "SQL", True, True)]
    assert rows(new.parameter, "task_id", "order_id", "value") == [(10, 1, None)]


def test_levels_and_labels(spark):
    df = spark.createDataFrame([("debug",), ("info",), ("error",), ("fatal",), ("42",)], "l string")
    assert [r[0] for r in df.select(stored_level(F.col("l"))).collect()] == ["DEBUG", "INFO", "ERROR", "PANIC", "UNKNOWN"]
    assert [r[0] for r in df.select(level_kept(F.col("l"), "none")).collect()] == [False] * 5
    assert [r[0] for r in df.select(level_kept(F.col("l"), "other")).collect()] == [False, False, True, True, False]
    assert df.limit(1).select(ident(F.lit(1), F.lit(""))).first()[0] == "1"
    assert df.limit(1).select(ident(F.lit(1), F.lit("n"))).first()[0] == "1|n"
    with pytest.raises(ValueError):
        require_rows(df.where("false"), "no rows")


def test_finish_clears_every_row(spark):
    active = spark.createDataFrame([(1, "w"), (1, "w"), (1, "v"), (2, "w")], "chain_id int, client_name string")
    done = spark.createDataFrame([(1, "w")], "chain_id int, client_name string")
    assert rows(bulk.finish_chains(active, done), "chain_id", "client_name") == [(1, "v"), (2, "w")]
