"""Job-definition tables: selection, rules, joins, order, rank, set operations (F, J, A10-A13, A23, W1-W8, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import blocked, bulk, jobs, runlog, schedule, sessions
from tickloom.plans.registry import query
from tickloom.plans.runlog_queries import SESSIONS, sessions as session_table
from tickloom.session import cut_lineage
from tickloom.sources.fixtures import ctes

CLIENT = "worker_1"
ELIGIBLE = f"(client_name = '{CLIENT}' OR client_name IS NULL)"
HEAD = """chain_id, chain_name, self_destruct, exclusive_execution, coalesce(max_instances, 16) AS max_instances,
    coalesce(timeout, 0) AS timeout, '' AS on_error"""


@query("f01_live_chains", ctes("chain") + f"SELECT {HEAD} FROM chain WHERE live AND {ELIGIBLE}")
def f01(t):
    return jobs.live_chains(t.chain, CLIENT)


@query("f02_reboot_chains", ctes("chain") + f"SELECT {HEAD} FROM chain WHERE live AND {ELIGIBLE} AND run_at = '@reboot'")
def f02(t):
    return jobs.reboot_chains(t.chain, CLIENT)


@query(
    "f03_interval_chains",
    ctes("chain")
    + f"""SELECT {HEAD}, CASE run_at WHEN '@every 10 minutes' THEN 600 ELSE 7200 END AS interval_seconds,
    starts_with(run_at, '@after') AS repeat_after FROM chain WHERE live AND {ELIGIBLE} AND run_at[1:6] IN ('@every', '@after')""",
)
def f03(t):
    return jobs.interval_chains(t.chain, CLIENT)


@query(
    "f04_chain_lookup",
    ctes("chain") + f"SELECT {HEAD} FROM chain WHERE chain_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND {ELIGIBLE}",
)
def f04(t):
    wanted = t.raw("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("chain_id"))
    return jobs.chain_lookup(t.chain, wanted, CLIENT)


@query(
    "f05_chain_steps",
    ctes("task")
    + """SELECT chain_id, task_order, task_id, '' AS task_name, command, kind, '' AS run_as, ignore_error,
    '' AS database_connection, timeout FROM task WHERE live""",
)
def f05(t):
    return jobs.chain_steps(t.task)


@query("f06_ordered_params", ctes("parameter") + "SELECT * FROM parameter WHERE value IS NOT NULL ORDER BY task_id, order_id")
def f06(t):
    return jobs.ordered_params(t.parameter)


@query(
    "f07_run_matrix",
    ctes("task", "parameter", p="SELECT * FROM parameter WHERE value IS NOT NULL")
    + """SELECT task.task_id, chain_id, task_order, kind, command, order_id, coalesce(value, '') AS value,
    CASE WHEN value IS NULL OR kind = 'BUILTIN' THEN true ELSE json_type(value) = 'ARRAY' END AS args_ok
    FROM task LEFT JOIN p ON p.task_id = task.task_id WHERE kind <> 'SQL' OR value IS NULL OR value <> ''""",
)
def f07(t):
    return jobs.run_matrix(t.task, t.parameter)


# Chain definitions as a loader would deliver them: nested steps, blanks, repeated names.
def definitions(t):
    return t.raw("part").selectExpr(
        "p_partkey AS definition_id",
        "CASE WHEN p_size = 1 THEN '' ELSE p_name END AS chain_name",
        "CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '* * * * *' WHEN 2 THEN '@every 1 hour' WHEN 3 THEN '1 2 3' ELSE ' 0  1 1 * 1 ' END AS schedule",
        "CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_brand END AS client_name",
        "'' AS on_error",
        "p_size % 4 AS max_instances",
        """filter(array(
            named_struct('task_name', '', 'kind', '', 'command', p_type, 'timeout', p_size - 2, 'live', CAST(NULL AS BOOLEAN)),
            named_struct('task_name', p_name, 'kind', CASE WHEN p_size = 7 THEN 'shell' ELSE 'program' END,
                         'command', CASE WHEN p_size = 9 THEN '' ELSE p_brand END, 'timeout', CAST(NULL AS INT), 'live', false)),
            x -> p_size <> 50)""" + " AS tasks",
    )


DEFINITIONS = {
    "def": """SELECT p_partkey AS definition_id, CASE WHEN p_size = 1 THEN '' ELSE p_name END AS chain_name,
        CASE p_size % 5 WHEN 0 THEN '* * * * *' WHEN 1 THEN '* * * * *' WHEN 2 THEN '@every 1 hour' WHEN 3 THEN '1 2 3' ELSE ' 0  1 1 * 1 ' END AS schedule,
        nullif(CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_brand END, '') AS client_name, p_size, p_type, p_brand, p_name FROM part""",
    "step": """SELECT definition_id, 10.0::DOUBLE AS task_order, CAST(NULL AS VARCHAR) AS task_name, 'SQL' AS kind, p_type AS command,
        p_size - 2 AS timeout, true AS live FROM def WHERE p_size <> 50
        UNION ALL SELECT definition_id, 20.0::DOUBLE, p_name, CASE WHEN p_size = 7 THEN 'shell' ELSE 'program' END,
        CASE WHEN p_size = 9 THEN '' ELSE p_brand END, 0, false FROM def WHERE p_size <> 50""",
}


@query(
    "f08_definition_rules",
    ctes(
        **DEFINITIONS,
        ts="""SELECT definition_id, bool_or(command = '') AS command_missing, bool_or(upper(kind) NOT IN ('SQL','PROGRAM','BUILTIN')) AS kind_bad,
        bool_or(timeout < 0) AS timeout_negative FROM step GROUP BY 1""",
        rep="SELECT chain_name FROM def GROUP BY 1 HAVING count(*) > 1",
        fl="""SELECT d.definition_id, chain_name = '' AS name_missing,
        NOT (starts_with(schedule, '@') OR len(list_filter(string_split(schedule, ' '), lambda w: w <> '')) = 5) AS schedule_bad,
        ts.definition_id IS NULL AS no_task, coalesce(command_missing, false) AS command_missing, coalesce(kind_bad, false) AS kind_bad,
        coalesce(timeout_negative, false) AS timeout_negative, chain_name IN (SELECT chain_name FROM rep) AS name_repeated,
        p_size % 4 = 0 AS never_admits FROM def d LEFT JOIN ts USING (definition_id)""",
    )
    + """SELECT *, NOT (name_missing OR schedule_bad OR no_task OR command_missing OR kind_bad OR timeout_negative OR name_repeated)
    AS accepted FROM fl""",
)
def f08(t):
    return jobs.definition_rules(jobs.definition_defaults(definitions(t)))


@query("f09_definition_defaults", ctes(**DEFINITIONS) + "SELECT * FROM step")
def f09(t):
    return jobs.definition_steps(jobs.definition_defaults(definitions(t)))


@query(
    "f09_chain_defaults",
    ctes(**DEFINITIONS) + "SELECT definition_id, schedule, client_name, CAST(NULL AS VARCHAR) AS on_error FROM def",
)
def f09_chain(t):
    return jobs.definition_defaults(definitions(t)).select("definition_id", "schedule", "client_name", "on_error")


HERE = {"host": "NATION_1", "port": 5432, "database": "BUILDING", "user": "Customer#000000001"}
_CONN = """CASE WHEN c_mktsegment <> 'BUILDING' OR n_name <> 'NATION_1' OR c_name <> 'Customer#000000001' OR 5432 <> 5432
    THEN format('host={} port={} dbname={} user={}', n_name, 5432, c_mktsegment, c_name) END"""


@query(
    "f16_connection_rule",
    f"SELECT c_custkey, {_CONN} AS connection FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def f16(t):
    rule = bulk.connection_string(F.col("n_name"), F.lit(5432), F.col("c_mktsegment"), F.col("c_name"), HERE)
    return t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", rule.alias("connection")
    )


@query(
    "f17_active_state",
    ctes("chain") + "SELECT chain_id, run_at FROM chain WHERE live AND NOT coalesce(starts_with(run_at, '@'), false)",
)
def f17(t):
    return jobs.active_state(t.chain).select("chain_id", "run_at")


# --- joins -------------------------------------------------------------------


@query(
    "j01_inner_equi",
    "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def j01(t):
    return t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", "n_name"
    )


@query(
    "j02_using_and_left",
    """SELECT l_orderkey, l_linenumber, l_suppkey, p_name, s_name FROM lineitem
    JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s_suppkey""",
)
def j02(t):
    """Inner USING, then left outer USING, over three tables."""
    parts = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    suppliers = t.raw("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return t.raw("lineitem").join(parts, "l_partkey").join(suppliers, "l_suppkey", "left").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "p_name", "s_name"
    )


@query(
    "j03_cross_arrays",
    "SELECT p_partkey, h, m FROM part, (SELECT unnest([0, 6, 12, 18]) AS h), (SELECT unnest([0, 30]) AS m)",
)
def j03(t):
    """Hours x minutes per row: two explodes of small arrays instead of a cross join."""
    d = t.raw("part").select("p_partkey", F.explode(F.array(*[F.lit(h) for h in (0, 6, 12, 18)])).alias("h"))
    return d.select("p_partkey", "h", F.explode(F.array(F.lit(0), F.lit(30))).alias("m"))


@query(
    "j04_theta_membership",
    ctes("chain")
    + r"""SELECT event_id, run_at AS schedule FROM events, (SELECT DISTINCT run_at FROM chain) c WHERE
    (run_at = '* * * * *') OR (run_at = '*/15 8-17 * * 1,2,3,4,5' AND minute(ts) IN (0,15,30,45) AND hour(ts) BETWEEN 8 AND 17 AND isodow(ts) <= 5)
    OR (run_at = '40 */2 27 * *' AND minute(ts) = 40 AND hour(ts) % 2 = 0 AND day(ts) = 27)
    OR (run_at = '0 0 * * 7' AND minute(ts) = 0 AND hour(ts) = 0 AND isodow(ts) = 7)
    OR (run_at = '23 0-20/2 * * *' AND minute(ts) = 23 AND hour(ts) % 2 = 0 AND hour(ts) <= 20)""",
)
def j04(t):
    """Membership of a timestamp in parsed arrays, planned as an equi join; every text that parses takes part."""
    return schedule.match_texts(t.raw("events").select("event_id", "ts"), t.chain, "ts", stored=False).select(
        "event_id", "schedule"
    )


@query(
    "j05_not_in",
    ctes("exec_log", sess=SESSIONS)
    + """SELECT exec_id, client_name FROM exec_log WHERE client_name NOT IN (SELECT client_name FROM sess)""",
)
def j05(t):
    """Active rows whose client has no session left."""
    return sessions.not_in(
        t.exec_log.select("exec_id", "client_name"), session_table(t), "client_name"
    ).select("exec_id", "client_name")


@query(
    "j05_not_in_null",
    ctes("chain", "exec_log") + "SELECT exec_id, client_name FROM exec_log WHERE client_name NOT IN (SELECT client_name FROM chain)",
)
def j05_null(t):
    """A NULL on the right leaves nothing."""
    return sessions.not_in(t.exec_log.select("exec_id", "client_name"), t.chain, "client_name").select("exec_id", "client_name")


@query(
    "j06_open_starts",
    ctes("run_status")
    + """SELECT run_status_id, chain_id, created_at, client_name FROM run_status s WHERE execution_status = 'CHAIN_STARTED' AND NOT EXISTS
    (SELECT 1 FROM run_status f WHERE f.start_status_id = s.run_status_id AND f.execution_status IN ('CHAIN_FAILED','CHAIN_DONE','DEAD'))""",
)
def j06(t):
    return sessions.open_starts(t.run_status).select("run_status_id", "chain_id", "created_at", "client_name")


@query(
    "j06_dead_rows",
    ctes("run_status")
    + f"""SELECT run_status_id AS start_status_id, 'DEAD' AS execution_status, client_name FROM run_status s
    WHERE execution_status = 'CHAIN_STARTED' AND client_name = '{CLIENT}' AND NOT EXISTS (SELECT 1 FROM run_status f
     WHERE f.start_status_id = s.run_status_id) UNION ALL SELECT start_status_id, execution_status, client_name FROM run_status""",
)
def j06_dead(t):
    return sessions.with_dead_rows(t.run_status, CLIENT).select("start_status_id", "execution_status", "client_name")


@query(
    "j07_name_conflict",
    ctes(sess=SESSIONS)
    + "SELECT * FROM sess s WHERE EXISTS (SELECT 1 FROM sess o WHERE o.client_name = s.client_name AND o.client_pid <> s.client_pid)",
)
def j07(t):
    return sessions.name_conflicts(session_table(t)).select("client_pid", "server_pid", "client_name")


@query(
    "j08_lateral_explode",
    "SELECT p_partkey, unnest(range(1, p_size + 1)) AS n FROM part",
)
def j08(t):
    """A set-returning function per row."""
    return t.raw("part").select("p_partkey", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("p_size").cast("bigint"))).alias("n"))


LINKS = {
    "link": """SELECT task_id, lag(task_id) OVER (PARTITION BY chain_id ORDER BY task_order) AS parent_id, chain_id FROM task""",
    "placed": """SELECT task_id, chain_id, CAST(row_number() OVER (PARTITION BY chain_id ORDER BY task_order) AS DOUBLE) AS task_order FROM task""",
}


def parent_links(t):
    """Every step points at the one before it in its chain; kept as a table, as the queries use it repeatedly."""
    task = t.task.select("chain_id", "task_order", "task_id")
    links = blocked.previous(
        task, ["chain_id"], F.floor(F.col("task_order") / 100_000), ["task_order"],
        {"parent_id": F.col("task_id")},
    )
    return cut_lineage(links)


@query("j09_order_from_parents", ctes("task", **LINKS) + "SELECT task_id, chain_id, task_order FROM placed")
def j09(t):
    links = parent_links(t)
    heads = links.where("parent_id IS NULL").select("task_id", "chain_id")
    return jobs.order_from_parents(links.select("task_id", "parent_id"), heads)


@query(
    "j10_snapshot_diff",
    ctes(
        "chain",
        o="SELECT chain_id, run_at, timeout FROM chain WHERE live",
        n="SELECT chain_id, run_at, CASE WHEN self_destruct THEN 1 ELSE timeout END AS timeout FROM chain WHERE client_name IS NOT NULL",
    )
    + """SELECT chain_id, CASE WHEN n.chain_id IS NULL THEN 'removed' WHEN o.chain_id IS NULL THEN 'new'
    WHEN n.run_at IS NOT DISTINCT FROM o.run_at AND n.timeout IS NOT DISTINCT FROM o.timeout THEN 'kept' ELSE 'updated' END AS change
    FROM o FULL JOIN n USING (chain_id)""",
)
def j10(t):
    old = t.chain.where("live").select("chain_id", "run_at", "timeout")
    new = t.chain.where("client_name IS NOT NULL").select(
        "chain_id", "run_at", F.when(F.col("self_destruct"), 1).otherwise(F.col("timeout")).alias("timeout")
    )
    return jobs.snapshot_diff(old, new)


@query(
    "j12_chain_and_steps",
    ctes("chain", "task")
    + """SELECT chain_name, run_at, c.live, task_order, kind, command FROM chain c JOIN task t ON t.chain_id = c.chain_id ORDER BY chain_name, task_order""",
)
def j12(t):
    return (
        t.chain.select("chain_id", "chain_name", "run_at", "live")
        .join(t.task.select("chain_id", "task_order", "kind", "command"), "chain_id")
        .select("chain_name", "run_at", "live", "task_order", "kind", "command")
        .orderBy("chain_name", "task_order")
    )


@query(
    "j13_update_from",
    ctes("task", **LINKS)
    + """SELECT t.task_id, p.task_order, true AS changed FROM task t JOIN placed p USING (task_id)""",
)
def j13(t):
    links = parent_links(t)
    heads = links.where("parent_id IS NULL").select("task_id", "chain_id")
    placed = jobs.order_from_parents(links.select("task_id", "parent_id"), heads)
    return jobs.update_from(t.task, placed, "task_id", "task_order").select("task_id", "task_order", "changed")


# --- aggregates over definitions ---------------------------------------------


@query(
    "a10_step_ids",
    ctes("task")
    + """SELECT chain_id, string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY task_order, task_id) AS task_ids FROM task GROUP BY 1""",
)
def a10(t):
    """Step ids by order, one list per chain."""
    return jobs.step_ids(t.task).select("chain_id", F.array_join(F.col("task_ids").cast("array<string>"), ",").alias("task_ids"))


@query(
    "a11_string_agg",
    ctes("exec_log") + "SELECT client_name, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM exec_log GROUP BY 1",
)
def a11(t):
    """Kinds seen per client: the set is bounded by the kinds there are."""
    return t.exec_log.groupBy("client_name").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query(
    "a12_distinct_min_max",
    """SELECT p_brand, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes,
    min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1""",
)
def a12(t):
    return t.raw("part").groupBy("p_brand").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), ",").alias("sizes"),
        F.min("p_size").alias("lo"), F.max("p_size").alias("hi"),
    )


@query(
    "a13_bool_and_or",
    ctes("task")
    + """SELECT chain_id, bool_and(ignore_error) AS all_ignore, bool_or(ignore_error) AS any_ignore,
    bool_and(ignore_error) FILTER (kind = 'PROGRAM') AS programs_ignore FROM task GROUP BY 1""",
)
def a13(t):
    """No input gives NULL, not true."""
    return t.task.groupBy("chain_id").agg(
        F.bool_and("ignore_error").alias("all_ignore"), F.bool_or("ignore_error").alias("any_ignore"),
        F.bool_and(F.when(F.col("kind") == "PROGRAM", F.col("ignore_error"))).alias("programs_ignore"),
    )


# --- order, rank, ids --------------------------------------------------------


def _move_oracle(first: str, near: str) -> str:
    return ctes(
        "task",
        o=f"SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY task_order {first}) AS pos FROM task",
    ) + """SELECT o.task_id, coalesce(p.task_order, o.task_order) AS task_order, p.task_id IS NOT NULL AS moved FROM o
    LEFT JOIN o p ON p.chain_id = o.chain_id AND p.pos = CASE o.pos WHEN 1 THEN 2 WHEN 2 THEN 1 END""" + near


@query("w01_move_up", _move_oracle("DESC", ""))
def w01(t):
    """The last step of every chain moves up by one."""
    last = t.task.groupBy("chain_id").agg(F.max_by("task_id", "task_order").alias("task_id"))
    return jobs.move_steps(t.task, last, upward=True).select("task_id", "task_order", "moved")


@query("w02_move_down", _move_oracle("ASC", ""))
def w02(t):
    """The first step of every chain moves down by one."""
    first = t.task.groupBy("chain_id").agg(F.min_by("task_id", "task_order").alias("task_id"))
    return jobs.move_steps(t.task, first, upward=False).select("task_id", "task_order", "moved")


@query("w07_rank", "SELECT c_custkey, c_mktsegment, rank() OVER (ORDER BY c_mktsegment) AS segment_rank FROM customer")
def w07(t):
    return jobs.rank_by(t.raw("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "segment_rank")


@query(
    "w08_dense_ids",
    ctes("chain") + "SELECT s_name, row_number() OVER (ORDER BY s_name) + (SELECT max(chain_id) FROM chain) AS chain_id FROM supplier",
)
def w08(t):
    return jobs.with_ids(t.raw("supplier").select("s_name"), ["s_name"], "chain_id", taken=t.chain)


# --- sort and set operations -------------------------------------------------


@query("l01_order_by", ctes("task") + "SELECT task_id, chain_id, task_order FROM task ORDER BY task_order, chain_id")
def l01(t):
    return t.task.select("task_id", "chain_id", "task_order").orderBy("task_order", "chain_id")


@query(
    "l03_first_per_group",
    ctes("exec_log") + "SELECT chain_id, min(last_run) AS first_run, arg_min(exec_id, last_run) AS exec_id FROM exec_log GROUP BY 1",
)
def l03(t):
    """LIMIT 1 in order, for every chain at once."""
    return t.exec_log.groupBy("chain_id").agg(F.min("last_run").alias("first_run"), F.min_by("exec_id", "last_run").alias("exec_id"))


@query(
    "l04_union_distinct",
    ctes("chain", "exec_log") + "SELECT client_name FROM chain UNION SELECT client_name FROM exec_log",
)
def l04(t):
    return t.chain.select("client_name").union(t.exec_log.select("client_name")).distinct()


@query(
    "l05_union_all",
    "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
)
def l05(t):
    customers = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return customers.unionByName(t.raw("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


@query("l06_distinct", ctes("chain") + "SELECT DISTINCT run_at, max_instances FROM chain")
def l06(t):
    return t.chain.select("run_at", "max_instances").distinct()


@query(
    "l07_key_difference",
    "SELECT p_partkey, array_to_string(list_sort(list_filter(['brass', 'bolt', 'small', 'ring'], lambda w: NOT list_contains(string_split(p_name, ' '), w))), ',') AS missing FROM part",
)
def l07(t):
    wanted = F.array(*[F.lit(w) for w in ("brass", "bolt", "small", "ring")])
    return t.raw("part").select(
        "p_partkey", F.array_join(F.array_sort(F.array_except(wanted, F.split("p_name", " "))), ",").alias("missing")
    )


@query(
    "l08_containment",
    """SELECT p_partkey, list_has_all(string_split(p_name, ' '), ['small', 'ring']) AS contains_both,
    list_has_all(['small', 'red', 'blue', 'ring', 'bolt'], string_split(p_name, ' ')) AS contained FROM part""",
)
def l08(t):
    words = F.split("p_name", " ")
    both, known = F.array(F.lit("small"), F.lit("ring")), F.array(*[F.lit(w) for w in ("small", "red", "blue", "ring", "bolt")])
    return t.raw("part").select(
        "p_partkey",
        (F.size(F.array_except(both, words)) == 0).alias("contains_both"),
        (F.size(F.array_except(words, known)) == 0).alias("contained"),
    )


@query(
    "a23_affected_rows",
    ctes("chain") + "SELECT count(*) FILTER (live) AS paused, count(*) FILTER (live) > 0 AS affected FROM chain WHERE run_at IS NULL",
)
def a23(t):
    """How many rows a pause of the schedule-less chains would change."""
    hit = t.chain.where("run_at IS NULL AND live")
    return runlog.row_count(hit, "paused").select("paused", (F.col("paused") > 0).alias("affected"))
