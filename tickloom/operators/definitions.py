"""Nested chain definitions, held as JSON documents, loaded into the three job tables.

A document is ``{"chains": [{..., "tasks": [{..., "parameters": [...]}]}]}``. It is
read as VARIANT; chains are exploded from their document, tasks from their chain
and parameters from their task, each by its position. Ids are handed down both
levels: dense numbers in the order of documents and positions, after those in use.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import bulk, jobs
from tickloom.operators.bulk import JobTables
from tickloom.session import cut_lineage

# Members of a chain and of a task, what they are stored as, and their types.
CHAIN_MEMBERS = (
    ("name", "chain_name", "string"), ("schedule", "schedule", "string"), ("max_instances", "max_instances", "int"),
    ("timeout", "timeout", "int"), ("live", "live", "boolean"), ("self_destruct", "self_destruct", "boolean"),
    ("exclusive", "exclusive_execution", "boolean"), ("client_name", "client_name", "string"), ("on_error", "on_error", "string"),
)
TASK_MEMBERS = (
    ("name", "task_name", "string"), ("kind", "kind", "string"), ("command", "command", "string"), ("run_as", "run_as", "string"),
    ("connect_string", "database_connection", "string"), ("ignore_error", "ignore_error", "boolean"),
    ("autonomous", "autonomous", "boolean"), ("timeout", "timeout", "int"), ("live", "live", "boolean"),
)
_KINDS_OF = {"string": ("STRING",), "int": ("BIGINT",), "boolean": ("BOOLEAN",)}


@dataclass
class Load:
    """The rows of a load, the chains that broke a rule, and the documents that are none."""

    new: JobTables
    refused: DataFrame
    unreadable: DataFrame


def _members(value: Column, members) -> dict[str, Column]:
    return {stored: F.try_variant_get(value, f"$.{name}", kind) for name, stored, kind in members}


def _mistyped(value: Column, members) -> Column:
    """Whether a member is there with another type; null and absent count as not given."""
    bad = F.lit(False)
    for name, _, kind in members:
        found = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        bad = bad | F.coalesce(~found.isin("VOID", *_KINDS_OF[kind]), F.lit(False))
    return bad


def _array(value: Column, name: str) -> Column:
    """Elements of a member; none if it is null or absent."""
    return F.coalesce(F.try_variant_get(value, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def parse_definitions(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(definitions, unreadable): one row per chain with its defaults, and the keys of documents that are no such document.

    A definition has ``key``, ``position``, the chain's columns, ``mistyped``, and ``tasks``: an array of structs
    with the nine members of a task and ``parameters``, an array of JSON texts in order.
    """
    parsed = documents.select(key, F.try_parse_json(text).alias("doc"))
    listed = parsed.withColumn("chains", F.try_variant_get("doc", "$.chains", "array<variant>"))
    unreadable = listed.where(F.col("chains").isNull()).select(key)
    chains = listed.select(key, F.posexplode("chains").alias("position", "chain"))

    def blank_to_null(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    def task(value: Column) -> Column:
        m = _members(value, TASK_MEMBERS)
        filled = m | {
            "kind": F.upper(F.coalesce(blank_to_null(m["kind"]), F.lit("SQL"))),
            "command": F.coalesce(m["command"], F.lit("")),
            "ignore_error": F.coalesce(m["ignore_error"], F.lit(False)), "autonomous": F.coalesce(m["autonomous"], F.lit(False)),
            "timeout": F.coalesce(m["timeout"], F.lit(0)), "live": F.coalesce(m["live"], F.lit(True)),
            **{c: blank_to_null(m[c]) for c in ("task_name", "run_as", "database_connection")},
        }
        parameters = F.transform(_array(value, "parameters"), lambda p: F.to_json(p))
        return F.struct(*[c.alias(name) for name, c in filled.items()], parameters.alias("parameters"), _mistyped(value, TASK_MEMBERS).alias("mistyped"))

    m = _members(F.col("chain"), CHAIN_MEMBERS)
    filled = m | {
        "chain_name": F.coalesce(m["chain_name"], F.lit("")),
        "schedule": F.coalesce(blank_to_null(m["schedule"]), F.lit("* * * * *")),
        "client_name": blank_to_null(m["client_name"]), "on_error": blank_to_null(m["on_error"]),
        **{c: F.coalesce(m[c], F.lit(0)) for c in ("max_instances", "timeout")},
        **{c: F.coalesce(m[c], F.lit(False)) for c in ("live", "self_destruct", "exclusive_execution")},
    }
    definitions = chains.select(
        key, "position", *[c.alias(name) for name, c in filled.items()],
        F.transform(_array(F.col("chain"), "tasks"), task).alias("tasks"), _mistyped(F.col("chain"), CHAIN_MEMBERS).alias("mistyped"),
    )
    any_task = F.exists("tasks", lambda t: t["mistyped"])
    return definitions.withColumn("mistyped", F.col("mistyped") | any_task), unreadable


def load_definitions(documents: DataFrame, key: str, text: str, tables: JobTables) -> Load:
    """Rows for the job tables from definition documents, numbered after those in ``tables``.

    Chains that break a rule, or have a member of another type, are refused with their flags. Kinds are stored
    in upper case. A parameter is stored as JSON, null too; steps are ten apart in the order they are written.
    """
    spark = documents.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A small file holds very many documents, and parsing them is most of the work: they are dealt out before.
    definitions, unreadable = parse_definitions(documents.repartition(tasks, key, text), key, text)
    # Rules, refusals, chains, steps and parameters all read these: documents are parsed once.
    definitions = cut_lineage(definitions)
    judged = jobs.definition_rules(definitions.withColumn("definition_id", F.struct(key, "position"))).select(
        F.col(f"definition_id.{key}").alias(key), "definition_id.position", *[c for c in _FLAGS]
    )
    placed = definitions.join(judged, [key, "position"]).withColumn("accepted", F.col("accepted") & ~F.col("mistyped"))
    refused = placed.where("NOT accepted").select(key, "position", "chain_name", "mistyped", *[c for c in _FLAGS if c != "accepted"])
    chains = jobs.with_ids(placed.where("accepted").drop(*_FLAGS, "mistyped"), [key, "position"], "chain_id", taken=tables.chain)
    steps = chains.select("chain_id", F.posexplode("tasks").alias("pos", "t")).select("chain_id", "pos", "t.*").drop("mistyped")
    numbered = jobs.with_ids(steps, ["chain_id", "pos"], "task_id", taken=tables.task)
    tasks = numbered.withColumn("task_order", ((F.col("pos") + 1) * jobs.ORDER_STEP).cast("double"))
    parameters = tasks.select("task_id", F.posexplode("parameters").alias("pos", "value")).select(
        "task_id", (F.col("pos") + 1).cast("bigint").alias("order_id"), "value"
    )
    headers = chains.withColumnRenamed("schedule", "run_at").drop("tasks", key, "position")
    return Load(JobTables(headers, tasks.drop("pos", "parameters"), parameters), refused, unreadable)


def store(load: Load, tables: JobTables, replace: bool = False) -> JobTables:
    """The job tables with the loaded rows. Chains of a name in use are replaced, or without ``replace`` left out (see ``bulk.name_conflicts``)."""
    if replace:
        return bulk.replace_jobs(tables, load.new)
    chain = load.new.chain.join(tables.chain.select("chain_name"), "chain_name", "left_anti")
    task = load.new.task.join(chain.select("chain_id"), "chain_id", "left_semi")
    parameter = load.new.parameter.join(task.select("task_id"), "task_id", "left_semi")
    return bulk.append_jobs(tables, JobTables(chain, task, parameter))


_FLAGS = (
    "name_missing", "schedule_bad", "no_task", "command_missing", "kind_bad", "timeout_negative", "name_repeated", "never_admits", "accepted",
)
