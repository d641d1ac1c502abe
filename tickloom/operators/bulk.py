"""Bulk changes of job tables: snapshots in, new snapshots out. Nothing is written in place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.cron import flags_to_cron
from tickloom.operators.jobs import ORDER_STEP, order_from_parents, rank_by, with_ids


# Text that imports write.
CONNECTION_FORMAT = "host=%s port=%s dbname=%s user=%s"
DATABASE_PREFIX = "dbname="
UNNAMED_JOB_PREFIX = "cronjob"
COMMAND_NAME_PREFIX = "job: "
JOB_AND_SCHEDULE_FORMAT = "%s @ %s"


@dataclass
class JobTables:
    """The three definition tables, one of them always the parent of the next."""

    chain: DataFrame
    task: DataFrame
    parameter: DataFrame


def _append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name in the old table's shape; columns the new rows lack are NULL."""
    return old.unionByName(new.select(*[c for c in new.columns if c in old.columns]), allowMissingColumns=True)


# --- insert ------------------------------------------------------------------


def expand_jobs(jobs: DataFrame, chain: DataFrame, task: DataFrame) -> JobTables:
    """New chain, task and parameter rows of one-task jobs (``job_name`` unique).

    The step is autonomous and ignores errors unless told otherwise; the
    parameter row is kept even when its value is NULL.
    """

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in jobs.columns else default

    null = F.lit(None)
    top_task = task.agg(F.coalesce(F.max("task_id"), F.lit(0)).alias("m")).scalar()
    numbered = with_ids(jobs, ["job_name"], "n")
    top_chain = chain.agg(F.coalesce(F.max("chain_id"), F.lit(0)).alias("m")).scalar()
    d = numbered.withColumn("chain_id", F.col("n") + top_chain).withColumn("task_id", F.col("n") + top_task)
    chains = d.select(
        "chain_id",
        F.col("job_name").alias("chain_name"),
        F.col("job_schedule").alias("run_at"),
        given("job_max_instances", null.cast("int")).alias("max_instances"),
        F.lit(0).alias("timeout"),
        given("job_live", F.lit(True)).alias("live"),
        given("job_self_destruct", F.lit(False)).alias("self_destruct"),
        given("job_exclusive", F.lit(False)).alias("exclusive_execution"),
        given("job_client_name", null.cast("string")).alias("client_name"),
        given("job_on_error", null.cast("string")).alias("on_error"),
    )
    tasks = d.select(
        "task_id",
        "chain_id",
        F.lit(float(ORDER_STEP)).alias("task_order"),
        given("job_kind", F.lit("SQL")).alias("kind"),
        F.col("job_command").alias("command"),
        given("job_ignore_errors", F.lit(True)).alias("ignore_error"),
        F.lit(True).alias("autonomous"),
        F.lit(0).alias("timeout"),
        F.lit(True).alias("live"),
    )
    params = d.select(
        "task_id", F.lit(1).cast("bigint").alias("order_id"), given("job_parameters", null.cast("string")).alias("value")
    )
    return JobTables(chains, tasks, params)


def add_jobs(tables: JobTables, jobs: DataFrame) -> JobTables:
    new = expand_jobs(jobs, tables.chain, tables.task)
    return JobTables(
        _append(tables.chain, new.chain), _append(tables.task, new.task), _append(tables.parameter, new.parameter)
    )


def append_jobs(tables: JobTables, new: JobTables) -> JobTables:
    return JobTables(_append(tables.chain, new.chain), _append(tables.task, new.task), _append(tables.parameter, new.parameter))


def add_tasks(task: DataFrame, requests: DataFrame) -> DataFrame:
    """Append a step after ``parent_id`` of each request, ``delta`` (default 10) further on.

    A request whose parent does not exist adds nothing. New steps get the
    column defaults: errors count, no timeout, live.
    """
    delta = F.coalesce(F.col("delta"), F.lit(float(ORDER_STEP))) if "delta" in requests.columns else F.lit(float(ORDER_STEP))
    parents = task.select(F.col("task_id").alias("parent_id"), "chain_id", "task_order")
    placed = requests.join(parents, "parent_id").select(
        "parent_id", "chain_id", (F.col("task_order") + delta).alias("task_order"), "kind", "command",
        F.lit(False).alias("ignore_error"), F.lit(0).alias("timeout"), F.lit(True).alias("live"),
    )
    return _append(task, with_ids(placed, ["parent_id", "kind", "command"], "task_id", taken=task))


# --- delete, pause, replace --------------------------------------------------


def _without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti").select(*df.columns)


def delete_tasks(tables: JobTables, gone: DataFrame) -> JobTables:
    """Tasks by id, with their parameters."""
    return JobTables(tables.chain, _without(tables.task, gone, "task_id"), _without(tables.parameter, gone, "task_id"))


def delete_jobs(tables: JobTables, names: DataFrame) -> JobTables:
    """Chains by name, with their tasks and the parameters of those."""
    chains = tables.chain.join(names.select("chain_name").distinct(), "chain_name", "left_semi")
    return delete_chains(tables, chains.select("chain_id"))


def delete_chains(tables: JobTables, chains: DataFrame) -> JobTables:
    tasks = tables.task.join(chains.select("chain_id").distinct(), "chain_id", "left_semi").select("task_id")
    return JobTables(
        _without(tables.chain, chains, "chain_id"),
        _without(tables.task, chains, "chain_id"),
        _without(tables.parameter, tasks, "task_id"),
    )


def set_live(chain: DataFrame, names: DataFrame, live: bool) -> DataFrame:
    """Pause (False) or resume (True) chains by name."""
    marked = names.select("chain_name").distinct().withColumn("__hit", F.lit(True))
    return (
        chain.join(marked, "chain_name", "left")
        .withColumn("live", F.when(F.col("__hit"), F.lit(live)).otherwise(F.col("live")))
        .select(*chain.columns)
    )


def name_conflicts(chain: DataFrame, new: DataFrame) -> DataFrame:
    """Existing chains that a load without replacement would collide with."""
    return chain.join(new.select("chain_name").distinct(), "chain_name", "left_semi").select("chain_id", "chain_name")


def replace_jobs(tables: JobTables, new: JobTables) -> JobTables:
    """Old chains of the same names go, with everything below them; the new ones come in."""
    kept = delete_jobs(tables, new.chain)
    return JobTables(
        _append(kept.chain, new.chain), _append(kept.task, new.task), _append(kept.parameter, new.parameter)
    )


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Insert new keys; on a known key take ``update`` columns from the source, NULLs included.

    ``keys`` are unique on both sides.
    """
    marked = source.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("__new"))
    held = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("__old"))
    new, old = F.col("__new").isNotNull(), F.col("__old").isNotNull()

    def pick(c: str) -> Column:
        take = new if c in update else new & ~old
        return F.when(take, F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c)

    return held.join(marked, keys, "full_outer").select(
        *[F.col(c) if c in keys else pick(c) for c in target.columns]
    )


def retain_since(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """Rows not older than ``cutoff``; a plain range filter, so whole date partitions are skipped."""
    return df.where(F.col(ts) >= cutoff)


def drop_finished_once(chain: DataFrame, runs: DataFrame) -> DataFrame:
    """Self-destructing chains that have completed at least once are gone."""
    done = runs.where("outcome = 'COMPLETED'").select("chain_id").distinct()
    doomed = chain.where("self_destruct").select("chain_id").join(done, "chain_id", "left_semi")
    return _without(chain, doomed, "chain_id")


def end_session(sessions: DataFrame, active: DataFrame, clients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and active chains of the given clients are removed."""
    return _without(sessions, clients, "client_name"), _without(active, clients, "client_name")


def finish_chains(active: DataFrame, finished: DataFrame) -> DataFrame:
    """A finish clears *every* active row of its (chain, client), not just one."""
    keys = ["chain_id", "client_name"]
    return active.join(finished.select(*keys).distinct(), keys, "left_anti").select(*active.columns)


def collect_and_log(parameter: DataFrame, sent: Column, log_task: Column, field: str, lead: str, most: int = 1_000_000) -> DataFrame:
    """Delete parameter rows, gather one JSON field of them into a log message, upsert the message.

    ``sent`` marks the rows to delete and ``log_task`` gives the task whose
    first parameter becomes the message; its other parameters stay. A message
    of over ``most`` items fails the query.
    """
    gone = parameter.where(sent).select(
        log_task.alias("task_id"), F.struct(F.col("task_id").alias("of"), "order_id", F.get_json_object("value", f"$.{field}").alias("item")).alias("s")
    )
    listed = gone.where(F.col("s.item").isNotNull()).groupBy("task_id").agg(F.array_sort(F.collect_list("s")).alias("items"))
    too_long = F.raise_error(F.format_string("the message of task %s has over %d items", F.col("task_id").cast("string"), F.lit(most)))
    text = F.when(F.size("items") > most, too_long).otherwise(F.array_join("items.item", ";"))
    # As a JSON text: the element of a one-element array.
    value = F.regexp_extract(F.to_json(F.array(F.concat(F.lit(lead), text))), r"^\[(.*)\]$", 1)
    messages = listed.select("task_id", F.lit(1).cast(parameter.schema["order_id"].dataType).alias("order_id"), value.alias("value"))
    return upsert(parameter.where(~sent), messages, ["task_id", "order_id"], ["value"])


# --- imports from other schedulers -------------------------------------------


def connection_string(host: Column, port: Column, database: Column, user: Column, here: dict) -> Column:
    """Connection text if anything differs from ``here``, else NULL (also when nothing can be told)."""
    differs = (
        (database != here["database"]) | (host != here["host"]) | (user != here["user"]) | (port != here["port"])
    )
    return F.when(differs, F.format_string(CONNECTION_FORMAT, host, port, database, user))


def import_cron_table(jobs: DataFrame, here: dict, chain: DataFrame, task: DataFrame) -> JobTables:
    """Rows of a plain cron job table (jobid, jobname, schedule, command, nodename, nodeport, database, username, active)."""
    numbered = with_ids(jobs, ["jobid"], "n")
    top_chain = chain.agg(F.coalesce(F.max("chain_id"), F.lit(0)).alias("m")).scalar()
    top_task = task.agg(F.coalesce(F.max("task_id"), F.lit(0)).alias("m")).scalar()
    d = numbered.withColumn("chain_id", F.col("n") + top_chain).withColumn("task_id", F.col("n") + top_task)
    chains = d.select(
        "chain_id",
        F.coalesce("jobname", F.concat(F.lit(UNNAMED_JOB_PREFIX), F.col("chain_id").cast("string"))).alias("chain_name"),
        F.col("schedule").alias("run_at"),
        F.col("active").alias("live"),
    )
    connection = connection_string(F.col("nodename"), F.col("nodeport"), F.col("database"), F.col("username"), here)
    tasks = d.select(
        "task_id", "chain_id", F.lit(1.0).alias("task_order"), F.lit("SQL").alias("kind"), "command",
        connection.alias("database_connection"),
    )
    return JobTables(chains, tasks, d.sparkSession.createDataFrame([], "task_id bigint, order_id bigint, value string"))


def cron_table_requests(jobs: DataFrame) -> DataFrame:
    """A plain cron job table as requests for ``add_jobs``: a job without a name is called by its command.

    As there, names must be unique, so nameless jobs must differ in their commands.
    """
    return jobs.select(
        F.coalesce("jobname", F.concat(F.lit(COMMAND_NAME_PREFIX), F.col("command"))).alias("job_name"),
        F.col("schedule").alias("job_schedule"), F.col("command").alias("job_command"),
        F.lit("SQL").alias("job_kind"), F.col("active").alias("job_live"),
    )


def import_flag_schedules(
    jobs: DataFrame,
    schedules: DataFrame,
    steps: DataFrame,
    now: Column,
    here_database: str,
    chain: DataFrame,
    task: DataFrame,
    shell: str = "sh",
    shell_option: str = "-c",
) -> JobTables:
    """Jobs whose schedules are five flag arrays; only enabled and currently valid schedules come over.

    jobs: job_id, job_name, host, enabled. schedules: job_id, schedule_id, schedule_name,
    minutes, hours, monthdays, months, weekdays, enabled, start_at, end_at. steps: step_id, job_id, step_name,
    step_kind ('b' = batch), code, connection, database. One chain per (job, schedule). Steps are ranked by
    name over *all* of them: equal names share an order, gaps follow.
    """
    valid = schedules.where(
        F.col("enabled") & (F.col("start_at") < now) & F.coalesce(now < F.col("end_at"), F.lit(True))
    ).select(
        "job_id", "schedule_id", "schedule_name",
        F.format_string(
            "%s %s %s %s %s",
            flags_to_cron(F.col("minutes")), flags_to_cron(F.col("hours")), flags_to_cron(F.col("monthdays")),
            flags_to_cron(F.col("months"), 1), flags_to_cron(F.col("weekdays"), 1),
        ).alias("run_at"),
    )
    pairs = jobs.join(valid, "job_id").select(
        "job_id", "schedule_id", F.format_string(JOB_AND_SCHEDULE_FORMAT, "job_name", "schedule_name").alias("chain_name"),
        F.col("host").alias("client_name"), F.col("enabled").alias("live"), "run_at",
    )
    chains = with_ids(pairs, ["job_id", "schedule_id"], "chain_id", taken=chain)
    batch = F.col("step_kind") == "b"
    connection = F.coalesce(
        F.nullif(F.col("connection"), F.lit("")),
        F.when(F.col("database") == here_database, None).when(F.col("database") > "", F.concat(F.lit(DATABASE_PREFIX), F.col("database"))),
    )
    expanded = chains.select("chain_id", "job_id").join(steps, "job_id").select(
        "chain_id", "step_id", "step_name", F.when(batch, "PROGRAM").otherwise("SQL").alias("kind"),
        "code", connection.alias("database_connection"),
    )
    ranked = with_ids(rank_by(expanded, "step_name", "step_rank"), ["chain_id", "step_id"], "task_id", taken=task)
    program = F.col("kind") == "PROGRAM"
    tasks = ranked.select(
        "task_id", "chain_id", F.col("step_name").alias("task_name"), F.col("step_rank").cast("double").alias("task_order"),
        "kind", F.when(program, F.lit(shell)).otherwise(F.col("code")).alias("command"), "database_connection",
    )
    params = ranked.where(program).select(
        "task_id", F.lit(1).cast("bigint").alias("order_id"), F.to_json(F.array(F.lit(shell_option), F.col("code"))).alias("value")
    )
    return JobTables(chains.drop("job_id", "schedule_id"), tasks, params)


def import_older_layout(links: DataFrame, base: DataFrame, connections: DataFrame, heads: DataFrame) -> DataFrame:
    """Steps of the older layout, where a step points at its parent and at a shared base task.

    links: task_id, parent_id, base_id, connection_id, ignore_error. base: base_id, task_name, kind, command.
    connections: connection_id, connect_string. heads: task_id, chain_id. Unreachable steps keep NULL chain and order.
    """
    steps = links.join(base, "base_id").join(connections, "connection_id", "left").select(
        "task_id", "parent_id", "task_name", "kind", "command", F.col("connect_string").alias("database_connection"),
        "ignore_error", F.lit(0).alias("timeout"),
    )
    placed = order_from_parents(steps.select("task_id", "parent_id"), heads)
    return steps.join(placed, "task_id", "left").drop("parent_id")


def import_older_tables(links: DataFrame, base: DataFrame, connections: DataFrame, configs: DataFrame, parameters: DataFrame) -> JobTables:
    """The whole older layout: headers that name the first step of their chain, linked steps, parameters by header and step.

    links, base and connections as for ``import_older_layout``, links with run_as and autonomous too. configs: chain_id,
    head_id, chain_name, run_at, max_instances, live, self_destruct, exclusive_execution, client_name. parameters:
    chain_id, task_id, order_id, value. A header whose first step is not there is left out. Where several headers share
    steps, these and their parameters go to the one of least id, as a step has one chain in the new layout.
    """
    chains = configs.join(links.select(F.col("task_id").alias("head_id")), "head_id", "left_semi").withColumns(
        {"timeout": F.lit(0), "on_error": F.lit(None).cast("string")}
    )
    heads = chains.groupBy(F.col("head_id").alias("task_id")).agg(F.min("chain_id").alias("chain_id"))
    steps = import_older_layout(links, base, connections, heads)
    tasks = steps.join(links.select("task_id", "run_as", "autonomous"), "task_id").withColumn("live", F.lit(True))
    of_chain = tasks.where(F.col("chain_id").isNotNull()).select("task_id", "chain_id")
    return JobTables(chains.drop("head_id"), tasks, parameters.join(of_chain, ["task_id", "chain_id"]).select("task_id", "order_id", "value"))
