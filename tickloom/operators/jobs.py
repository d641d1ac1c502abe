"""Job-definition tables: selection, run matrix, rules, defaults, reordering and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import blocked
from tickloom.session import cut_and_count, cut_lineage

# Limit of a chain without one, distance of steps, kinds of step, schedules that are not cron text.
DEFAULT_MAX_INSTANCES = 16
#: More steps than a chain may have for its list to be one value.
MOST_STEPS = 1_000_000
ORDER_STEP = 10
KINDS = ("SQL", "PROGRAM", "BUILTIN")
SPECIAL_SCHEDULES = ("@reboot", "@after", "@every")


# --- selection ---------------------------------------------------------------


def _eligible(client: str) -> Column:
    return (F.col("client_name") == client) | F.col("client_name").isNull()


def _chain_header(chains: DataFrame) -> list[Column]:
    on_error = F.col("on_error") if "on_error" in chains.columns else F.lit(None).cast("string")
    return [
        F.col("chain_id"),
        F.col("chain_name"),
        F.col("self_destruct"),
        F.col("exclusive_execution"),
        F.coalesce("max_instances", F.lit(DEFAULT_MAX_INSTANCES)).alias("max_instances"),
        F.coalesce("timeout", F.lit(0)).alias("timeout"),
        F.coalesce(on_error, F.lit("")).alias("on_error"),
    ]


def live_chains(chains: DataFrame, client: str) -> DataFrame:
    """Live chains that ``client`` may run, with their defaults filled in."""
    return chains.where(F.col("live") & _eligible(client)).select(*_chain_header(chains))


def reboot_chains(chains: DataFrame, client: str) -> DataFrame:
    return live_chains(chains.where(F.col("run_at") == "@reboot"), client)


def interval_chains(chains: DataFrame, client: str) -> DataFrame:
    """Live @every / @after chains with their interval; @after repeats after the finish."""
    from tickloom.functions.cron import is_interval_schedule, schedule_seconds

    run_at = F.col("run_at")
    return chains.where(F.col("live") & _eligible(client) & is_interval_schedule(run_at)).select(
        *_chain_header(chains),
        schedule_seconds(run_at).cast("int").alias("interval_seconds"),
        run_at.startswith("@after").alias("repeat_after"),
    )


def chain_lookup(chains: DataFrame, wanted: DataFrame, client: str) -> DataFrame:
    """Chains by id, live or not; the client rule still holds."""
    return chains.join(wanted.select("chain_id"), "chain_id", "left_semi").where(_eligible(client)).select(
        *_chain_header(chains)
    )


def active_state(chains: DataFrame) -> DataFrame:
    """Live chains outside the '@' schedules; a NULL schedule stays in."""
    return chains.where(F.col("live") & ~F.coalesce(F.col("run_at").startswith("@"), F.lit(False)))


def chain_steps(tasks: DataFrame) -> DataFrame:
    """Live steps in running order, NULL text read as ''."""

    def text(name: str) -> Column:
        have = F.col(name) if name in tasks.columns else F.lit(None).cast("string")
        return F.coalesce(have, F.lit("")).alias(name)

    return (
        tasks.where("live")
        .select(
            "chain_id", "task_order", "task_id", text("task_name"), "command", "kind", text("run_as"),
            "ignore_error", text("database_connection"), "timeout",
        )
        .orderBy("chain_id", "task_order", "task_id")
    )


def ordered_params(params: DataFrame) -> DataFrame:
    return params.where(F.col("value").isNotNull()).orderBy("task_id", "order_id")


# --- run matrix --------------------------------------------------------------


def argument(value: Column, position: int) -> Column:
    """Positional argument (from 0) of a JSON parameter row as text."""
    return F.try_variant_get(F.try_parse_json(value), f"$[{position}]", "string")


def arguments_ok(kind: Column, value: Column) -> Column:
    """Can the parameter row be handed to the command? SQL takes a JSON array, PROGRAM one of strings."""
    parsed = F.try_parse_json(value)
    items = F.try_variant_get(parsed, "$", "array<variant>")
    is_null = F.coalesce(F.is_variant_null(parsed), F.lit(False))
    # A JSON null is accepted as "no arguments", and a null element as an empty string.
    array_or_null = items.isNotNull() | is_null
    strings = F.forall(items, lambda x: F.is_variant_null(x) | (F.schema_of_variant(x) == "STRING"))
    return (
        F.when(value == "", F.lit(True))
        .when(kind == "SQL", array_or_null)
        .when(kind == "PROGRAM", F.coalesce(strings, is_null))
        .otherwise(F.lit(True))
    )


def run_matrix(tasks: DataFrame, params: DataFrame) -> DataFrame:
    """One row per execution: (task, parameter row), or the task once with '' if it has none.

    SQL tasks skip '' rows. Built as inner join plus anti join rather than one
    outer join, because adaptive execution may split a hot key on either side
    of an inner join.
    """
    given = params.where(F.col("value").isNotNull()).select("task_id", "order_id", "value")
    head = ["task_id", "chain_id", "task_order", "kind", "command"]
    with_params = (
        tasks.select(*head).join(given, "task_id").where((F.col("kind") != "SQL") | (F.col("value") != ""))
    )
    without = (
        tasks.select(*head)
        .join(given.select("task_id").distinct(), "task_id", "left_anti")
        .withColumn("order_id", F.lit(None).cast("bigint"))
        .withColumn("value", F.lit(""))
    )
    return with_params.unionByName(without).withColumn("args_ok", arguments_ok(F.col("kind"), F.col("value")))


# --- definitions -------------------------------------------------------------


def definition_defaults(definitions: DataFrame) -> DataFrame:
    """Blank schedule, kind, live and optional text of nested chain definitions filled in.

    ``definitions`` has chain_name, schedule, client_name, on_error and
    ``tasks``, an array of (task_name, kind, command, timeout, live) structs.
    """

    def blank_to_null(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    def fill(task: Column) -> Column:
        return F.struct(
            blank_to_null(task["task_name"]).alias("task_name"),
            F.coalesce(blank_to_null(task["kind"]), F.lit("SQL")).alias("kind"),
            task["command"].alias("command"),
            F.coalesce(task["timeout"], F.lit(0)).alias("timeout"),
            F.coalesce(task["live"], F.lit(True)).alias("live"),
        )

    return definitions.withColumns(
        {
            "schedule": F.coalesce(blank_to_null(F.col("schedule")), F.lit("* * * * *")),
            "client_name": blank_to_null(F.col("client_name")),
            "on_error": blank_to_null(F.col("on_error")),
            "tasks": F.transform("tasks", fill),
        }
    )


def definition_steps(definitions: DataFrame) -> DataFrame:
    """Tasks of nested definitions as rows, ten apart in the order they are written."""
    return definitions.select("definition_id", F.posexplode("tasks").alias("pos", "t")).select(
        "definition_id",
        ((F.col("pos") + 1) * ORDER_STEP).cast("double").alias("task_order"),
        *[F.col(f"t.{c}").alias(c) for c in ("task_name", "kind", "command", "timeout", "live")],
    )


def definition_rules(definitions: DataFrame) -> DataFrame:
    """One flag per broken rule and a verdict, per definition (defaults already applied).

    Zero ``max_instances`` is legal but never runs: it is a warning only.
    """
    name, schedule, tasks = F.col("chain_name"), F.col("schedule"), F.col("tasks")
    special = F.lit(False)
    for word in SPECIAL_SCHEDULES:
        special = special | schedule.startswith(word)
    words = F.filter(F.split(schedule, r"\s+"), lambda w: w != "")

    def some(bad) -> Column:
        return F.exists(tasks, lambda t: F.coalesce(bad(t), F.lit(True)))

    flags = {
        "name_missing": F.coalesce(name == "", F.lit(True)),
        "schedule_bad": F.coalesce(~special & (F.size(words) != 5), F.lit(True)),
        "no_task": F.coalesce(F.size(tasks) <= 0, F.lit(True)),
        "command_missing": some(lambda t: t["command"] == ""),
        "kind_bad": some(lambda t: ~F.upper(t["kind"]).isin("", *KINDS)),
        "timeout_negative": some(lambda t: t["timeout"] < 0),
    }
    repeated = (
        definitions.groupBy("chain_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chain_name")
    )
    repeated = repeated.withColumn("name_repeated", F.lit(True))
    d = definitions.select("definition_id", "chain_name", "max_instances", *[f.alias(n) for n, f in flags.items()])
    d = d.join(repeated, "chain_name", "left").withColumn(
        "name_repeated", F.coalesce("name_repeated", F.lit(False))
    )
    broken = F.col("name_repeated")
    for n in flags:
        broken = broken | F.col(n)
    return d.select(
        "definition_id", *flags, "name_repeated",
        F.coalesce(F.col("max_instances") == 0, F.lit(False)).alias("never_admits"),
        (~broken).alias("accepted"),
    )


# --- order within a chain ----------------------------------------------------


def _neighbours(tasks: DataFrame, upward: bool, block_width: float) -> DataFrame:
    """Nearest strictly lower (or higher) order of each (chain, order), with its task."""
    sign = 1 if upward else -1
    steps = tasks.groupBy("chain_id", (F.col("task_order") * sign).alias("o")).agg(
        F.min("task_id").alias("neighbour_id")
    )
    near = blocked.previous(
        steps, ["chain_id"], F.floor(F.col("o") / block_width), ["o"],
        {"near_o": F.col("o"), "near_id": F.col("neighbour_id")},
    )
    return near.where(F.col("near_o").isNotNull()).select(
        "chain_id", (F.col("o") * sign).alias("task_order"),
        (F.col("near_o") * sign).alias("neighbour_order"), F.col("near_id").alias("neighbour_id"),
    )


def move_steps(tasks: DataFrame, wanted: DataFrame, upward: bool, block_width: float = 100_000.0) -> DataFrame:
    """Swap the order of each wanted task with its neighbour; the whole table comes back.

    Steps at the same order are no neighbours; at the end of a chain nothing
    moves. A move that shares a task with another move of the batch is
    refused, since its result would depend on who goes first. ``moved`` tells
    which rows changed.
    """
    near = _neighbours(tasks, upward, block_width)
    # Used four times below, so it is worked out once.
    moves = cut_lineage(
        tasks.join(wanted.select("task_id").distinct(), "task_id", "left_semi")
        .select("task_id", "chain_id", "task_order")
        .join(near, ["chain_id", "task_order"])
    )
    touched = moves.select(F.explode(F.array("task_id", "neighbour_id")).alias("task_id"))
    shared = touched.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("task_id")
    refused = shared.select(F.col("task_id").alias("neighbour_id"))
    clean = moves.join(shared, "task_id", "left_anti").join(refused, "neighbour_id", "left_anti")
    changes = clean.select(
        F.explode(
            F.array(
                F.struct(F.col("task_id"), F.col("neighbour_order").alias("new_order")),
                F.struct(F.col("neighbour_id").alias("task_id"), F.col("task_order").alias("new_order")),
            )
        ).alias("c")
    ).select("c.*")
    return update_from(tasks, changes.withColumnRenamed("new_order", "task_order"), "task_id", "task_order").withColumnRenamed(
        "changed", "moved"
    )


def update_from(target: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` taken from ``changes`` where the key is listed; ``changed`` marks those rows."""
    new = changes.select(key, F.col(column).alias("__new"), F.lit(True).alias("changed"))
    return (
        target.join(new, key, "left")
        .withColumn(column, F.when(F.col("changed"), F.col("__new")).otherwise(F.col(column)))
        .withColumn("changed", F.coalesce("changed", F.lit(False)))
        .drop("__new")
    )


def order_from_parents(tasks: DataFrame, heads: DataFrame) -> DataFrame:
    """(task_id, chain_id, task_order) from parent links, heads first at order 1.

    ``tasks``: task_id, parent_id. ``heads``: task_id, chain_id. Every step
    looks at its ancestor's ancestor each round, so the number of rounds is
    the logarithm of the longest chain, and no chain has to fit in one task.
    Steps that never reach a head (broken links, loops) are left out, as a
    recursive walk from the heads would leave them out. A step whose parent
    link is set is reached through that link even when it is a head as well.
    """
    roots = heads.join(tasks.where(F.col("parent_id").isNull()).select("task_id"), "task_id", "left_semi")
    state = (
        tasks.join(roots.select("task_id", "chain_id"), "task_id", "left")
        .select(
            "task_id",
            F.when(F.col("chain_id").isNull(), F.col("parent_id")).alias("up"),
            F.when(F.col("chain_id").isNull(), 1).otherwise(0).cast("bigint").alias("hops"),
            "chain_id",
        )
        .where(F.col("chain_id").isNotNull() | F.col("up").isNotNull())
    )
    written, still_open = cut_and_count(state, F.col("chain_id").isNull())
    is_open, before = F.col("chain_id").isNull(), None
    settled, frontier = written.where(~is_open), written.where(is_open)
    # A round writes the open steps only, settled or moved on. One that settles no step proves that none is
    # further from a head: the rest are loops.
    while still_open and still_open != before:
        before = still_open
        anchor = settled.unionByName(frontier).select(
            F.col("task_id").alias("a_id"), F.col("up").alias("a_up"),
            F.col("hops").alias("a_hops"), F.col("chain_id").alias("a_chain"),
        )
        moved = frontier.join(anchor, F.col("up") == F.col("a_id")).select(
            "task_id", F.col("a_up").alias("up"), (F.col("hops") + F.col("a_hops")).alias("hops"), F.col("a_chain").alias("chain_id")
        )
        written, still_open = cut_and_count(moved, is_open)
        settled, frontier = settled.unionByName(written.where(~is_open)), written.where(is_open)
    return settled.select("task_id", "chain_id", (F.col("hops") + 1).cast("double").alias("task_order"))


# --- rank, ids, snapshots ----------------------------------------------------


def rank_by(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """rank() over the whole table: equal values share a rank, gaps follow.

    Values are counted first, so only distinct values are put in global order.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    upto = blocked.global_running_sum(counts, [F.col(column)], F.col("__n"), "__upto")
    ranks = upto.select(F.col(column).alias("__k"), (F.col("__upto") - F.col("__n") + 1).alias(name))
    return df.join(ranks, df[column].eqNullSafe(F.col("__k"))).drop("__k")


def with_ids(df: DataFrame, order: list[str], name: str, taken: DataFrame | None = None, taken_id: str | None = None) -> DataFrame:
    """Dense new ids in ``order``, starting after the largest id of ``taken``."""
    numbered = blocked.global_row_number(df, [F.col(c) for c in order], name)
    if taken is None:
        return numbered
    top = taken.agg(F.coalesce(F.max(taken_id or name), F.lit(0)).alias("m")).scalar()
    return numbered.withColumn(name, F.col(name) + top)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "chain_id") -> DataFrame:
    """removed / new / kept per key; a kept row counts as updated if any shared column differs."""
    shared = [c for c in new.columns if c in old.columns and c != key]
    o = old.select(key, F.struct(F.lit(True).alias("__there"), *shared).alias("o"))
    n = new.select(key, F.struct(F.lit(True).alias("__there"), *shared).alias("n"))
    return o.join(n, key, "full_outer").select(
        key,
        F.when(F.col("n").isNull(), "removed")
        .when(F.col("o").isNull(), "new")
        .when(F.col("o").eqNullSafe(F.col("n")), "kept")
        .otherwise("updated")
        .alias("change"),
    )


def step_ids(tasks: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """Step ids of each chain by order, one array per chain. A chain of over ``most`` steps fails the query."""
    listed = tasks.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("task_order", "task_id"))).alias("s"))
    too_long = F.raise_error(F.format_string("chain %s has over %d steps", F.col("chain_id").cast("string"), F.lit(most)))
    return listed.select("chain_id", F.when(F.size("s") > most, too_long).otherwise(F.col("s.task_id")).alias("task_ids"))
