"""Nested definitions and older tables on small hand rows."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tickloom.operators import bulk, definitions
from tickloom.operators.bulk import JobTables

CHAIN = "chain_id bigint, chain_name string, run_at string, max_instances int, timeout int, live boolean, self_destruct boolean, exclusive_execution boolean, client_name string, on_error string"
TASK = "task_id bigint, chain_id bigint, task_order double, task_name string, kind string, command string, run_as string, database_connection string, ignore_error boolean, autonomous boolean, timeout int, live boolean"
DOCS = [
    (1, {"chains": [
        {"name": "pears", "tasks": [{"command": "A", "parameters": [["x", 1], None, {"k": [2.50]}, "s", True]}, {"command": "B", "kind": ""}]},
        {"name": "old", "schedule": "@reboot", "live": True, "tasks": [{"command": "C", "live": None}]},
    ]}),
    (2, {"chains": [
        {"name": "no tasks"}, {"name": "figs", "tasks": [{"command": "D", "timeout": "soon"}]}, {"name": "", "tasks": [{"command": "E"}]},
        {"name": "twice", "tasks": [{"command": "F"}]}, {"name": "bad time", "schedule": "1 2", "tasks": [{"command": "G"}]},
        {"name": "late", "tasks": [{"command": "H", "timeout": -1}]}, {"name": "kinds", "tasks": [{"command": "I", "kind": "shell"}]}, "text",
    ]}),
    (3, {"chains": [{"name": "twice", "tasks": [{"command": "J"}]}, {"name": "plums", "max_instances": 3, "on_error": "", "tasks": [{"command": "K", "kind": "builtin", "name": "last"}]}]}),
    (4, {"chains": []}), (5, {"chains": "none"}), (6, {}), (7, [1]),
]


@pytest.fixture(scope="module")
def tables(spark):
    chain = spark.createDataFrame([(40, "old", None, None, 0, True, False, False, None, None)], CHAIN)
    task = spark.createDataFrame([(70, 40, 10.0, None, "SQL", "Z", None, None, False, False, 0, True)], TASK)
    return JobTables(chain, task, spark.createDataFrame([(70, 1, "[]")], "task_id bigint, order_id bigint, value string"))


@pytest.fixture(scope="module")
def load(spark, tables):
    documents = [(k, json.dumps(d)) for k, d in DOCS] + [(8, "{oops"), (9, None)]
    return definitions.load_definitions(spark.createDataFrame(documents, "k int, doc string").repartition(3), "k", "doc", tables)


def test_ids_go_down_both_levels(load):
    assert rows(load.new.chain, "chain_id", "chain_name", "run_at", "live", "max_instances", "on_error") == [
        (41, "pears", "* * * * *", False, 0, None), (42, "old", "@reboot", True, 0, None), (43, "plums", "* * * * *", False, 3, None)]
    assert rows(load.new.task, "task_id", "chain_id", "task_order", "task_name", "kind", "command", "live") == [
        (71, 41, 10.0, None, "SQL", "A", True), (72, 41, 20.0, None, "SQL", "B", True), (73, 42, 10.0, None, "SQL", "C", True), (74, 43, 10.0, "last", "BUILTIN", "K", True)]
    assert rows(load.new.parameter, "task_id", "order_id", "value") == [
        (71, 1, '["x",1]'), (71, 2, "null"), (71, 3, '{"k":[2.5]}'), (71, 4, '"s"'), (71, 5, "true")]


def test_refused_and_unreadable(load):
    flags = ["name_missing", "schedule_bad", "no_task", "kind_bad", "timeout_negative", "name_repeated", "mistyped"]
    got = {(r.k, r.position): {f for f in flags if r[f]} for r in load.refused.collect()}
    assert got == {(2, 0): {"no_task"}, (2, 1): {"mistyped"}, (2, 2): {"name_missing", "name_repeated"}, (2, 3): {"name_repeated"}, (2, 4): {"schedule_bad"},
                   (2, 5): {"timeout_negative"}, (2, 6): {"kind_bad"}, (2, 7): {"name_missing", "no_task", "name_repeated"}, (3, 0): {"name_repeated"}}
    assert rows(load.unreadable, "k") == [(5,), (6,), (7,), (8,), (9,)]


def test_store_with_and_without_replacement(load, tables):
    replaced, kept = definitions.store(load, tables, replace=True), definitions.store(load, tables)
    assert rows(replaced.chain, "chain_id") == [(41,), (42,), (43,)] and rows(replaced.task, "task_id") == [(71,), (72,), (73,), (74,)]
    assert rows(kept.chain, "chain_id") == [(40,), (41,), (43,)] and rows(kept.task, "task_id") == [(70,), (71,), (72,), (74,)]
    assert rows(kept.parameter, "task_id", "order_id") == [(70, 1), *[(71, i) for i in range(1, 6)]]
    assert rows(bulk.name_conflicts(tables.chain, load.new.chain), "chain_id") == [(40,)]


def test_older_tables(spark):
    links = spark.createDataFrame(
        [(1, None, 10, 5, True, "ann", False), (2, 1, 11, None, False, None, True), (3, 2, 10, 6, None, None, False), (8, 9, 10, None, False, None, False)],
        "task_id bigint, parent_id bigint, base_id bigint, connection_id bigint, ignore_error boolean, run_as string, autonomous boolean")
    base = spark.createDataFrame([(10, "ten", "SQL", "SELECT 10"), (11, "eleven", "PROGRAM", "sh")], "base_id bigint, task_name string, kind string, command string")
    connections = spark.createDataFrame([(5, "host=five")], "connection_id bigint, connect_string string")
    configs = spark.createDataFrame(
        [(101, 1, "first"), (100, 1, "shares"), (102, 77, "lost")], "chain_id bigint, head_id bigint, chain_name string"
    ).selectExpr("*", "'@reboot' AS run_at", "2 AS max_instances", "true AS live", "false AS self_destruct", "false AS exclusive_execution", "'w' AS client_name")
    parameters = spark.createDataFrame([(100, 1, 1, "[1]"), (101, 1, 1, "[2]"), (100, 3, 2, None), (102, 8, 1, "[3]")], "chain_id bigint, task_id bigint, order_id bigint, value string")
    out = bulk.import_older_tables(links, base, connections, configs, parameters)
    assert rows(out.chain, "chain_id", "chain_name", "timeout") == [(100, "shares", 0), (101, "first", 0)]
    assert rows(out.task, "task_id", "chain_id", "task_order", "database_connection", "run_as", "autonomous") == [
        (1, 100, 1.0, "host=five", "ann", False), (2, 100, 2.0, None, None, True), (3, 100, 3.0, None, None, False), (8, None, None, None, None, False)]
    assert rows(out.parameter, "task_id", "order_id", "value") == [(1, 1, "[1]"), (3, 2, None)]


def test_documents_are_read_once_by_several_tasks(spark):
    """A single file's documents are dealt out before they are parsed, and no table of the load reads them again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    one = '{"chains":[{"name":"n%d","tasks":[{"command":"SELECT 1","parameters":[1]}]}]}'
    documents = spark.createDataFrame([(i, one % i) for i in range(40)], "k bigint, doc string").coalesce(1).select("k", counted.asNondeterministic()("doc").alias("doc"))
    tables = JobTables(
        spark.createDataFrame([], "chain_id bigint, chain_name string"), spark.createDataFrame([], "task_id bigint"), None
    )
    load = definitions.load_definitions(documents, "k", "doc", tables)
    assert (load.new.chain.count(), load.new.task.count(), load.new.parameter.count(), load.refused.count()) == (40, 40, 40, 0)
    assert seen.value == 40
