"""Bulk table changes and imports (D1-D14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bulk, definitions, runlog
from tickloom.operators.bulk import JobTables
from tickloom.plans.jobs_queries import HERE, LINKS, parent_links
from tickloom.plans.registry import at, query
from tickloom.plans.runlog_queries import RUNS, SESSIONS, sessions
from tickloom.sources.fixtures import ANCHOR, ctes


def tables(t) -> JobTables:
    return JobTables(t.chain, t.task, t.parameter)


def tagged(x: JobTables):
    """Chain, task and parameter rows in one frame of (entity, id, parent, label)."""
    return (
        x.chain.select(F.lit("chain").alias("entity"), F.col("chain_id").alias("id"), F.lit(None).cast("bigint").alias("parent"),
                       F.col("chain_name").alias("label"))
        .unionByName(x.task.select(F.lit("task").alias("entity"), F.col("task_id").alias("id"), F.col("chain_id").alias("parent"),
                                   F.col("command").alias("label")))
        .unionByName(x.parameter.select(F.lit("parameter").alias("entity"), F.col("order_id").alias("id"),
                                        F.col("task_id").alias("parent"), F.col("value").alias("label")))
    )


TAGGED = """SELECT 'chain' AS entity, chain_id AS id, CAST(NULL AS BIGINT) AS parent, chain_name AS label FROM {c}
    UNION ALL SELECT 'task', task_id, chain_id, command FROM {t} UNION ALL SELECT 'parameter', order_id, task_id, value FROM {p}"""


def job_requests(t):
    return t.raw("supplier").select(
        F.col("s_name").alias("job_name"), F.lit("0 1 * * *").alias("job_schedule"),
        F.concat(F.lit("SELECT "), F.col("s_suppkey").cast("string")).alias("job_command"),
        F.when(F.col("s_acctbal") > 0, F.lit("[1]")).alias("job_parameters"),
        F.when(F.col("s_nationkey") > 12, F.lit("PROGRAM")).alias("job_kind"),
    )


_JOBS = {
    "j": """SELECT *, row_number() OVER (ORDER BY s_name) AS n FROM supplier""",
    "nc": """SELECT n + (SELECT max(chain_id) FROM chain) AS chain_id, s_name AS chain_name FROM j""",
    "nt": """SELECT n + (SELECT max(task_id) FROM task) AS task_id, n + (SELECT max(chain_id) FROM chain) AS chain_id,
        concat('SELECT ', CAST(s_suppkey AS VARCHAR)) AS command FROM j""",
    "np": """SELECT n + (SELECT max(task_id) FROM task) AS task_id, 1 AS order_id, CASE WHEN s_acctbal > 0 THEN '[1]' END AS value FROM j""",
    "c2": "SELECT chain_id, chain_name FROM chain UNION ALL SELECT * FROM nc",
    "t2": "SELECT task_id, chain_id, command FROM task UNION ALL SELECT * FROM nt",
    "p2": "SELECT task_id, order_id, value FROM parameter UNION ALL SELECT * FROM np",
}


@query("d01_add_jobs", ctes("chain", "task", "parameter", **_JOBS) + TAGGED.format(c="c2", t="t2", p="p2"))
def d01(t):
    """Every supplier becomes a one-task job."""
    return tagged(bulk.add_jobs(tables(t), job_requests(t)))


@query(
    "d01_new_steps",
    ctes("chain", "task", **{k: _JOBS[k] for k in ("j",)})
    + """SELECT n + (SELECT max(task_id) FROM task) AS task_id, 10.0::DOUBLE AS task_order,
    CASE WHEN s_nationkey > 12 THEN 'PROGRAM' ELSE 'SQL' END AS kind, true AS ignore_error, true AS autonomous FROM j""",
)
def d01_steps(t):
    return bulk.expand_jobs(job_requests(t), t.chain, t.task).task.select(
        "task_id", "task_order", "kind", "ignore_error", "autonomous"
    )


@query(
    "d02_add_tasks",
    ctes("task", r="SELECT *, row_number() OVER (ORDER BY task_id) AS n FROM task WHERE kind = 'BUILTIN'")
    + """SELECT task_id, chain_id, task_order, kind, command FROM task UNION ALL
    SELECT n + (SELECT max(task_id) FROM task), chain_id, task_order + CASE WHEN ignore_error THEN 5 ELSE 10 END, 'SQL', 'ANALYZE' FROM r""",
)
def d02(t):
    """A follow-up step after every built-in step."""
    requests = t.task.where("kind = 'BUILTIN'").select(
        F.col("task_id").alias("parent_id"), F.lit("SQL").alias("kind"), F.lit("ANALYZE").alias("command"),
        F.when(F.col("ignore_error"), 5.0).alias("delta"),
    )
    return bulk.add_tasks(t.task, requests).select("task_id", "chain_id", "task_order", "kind", "command")


@query(
    "d03_delete_tasks",
    ctes(
        "chain", "task", "parameter",
        t2="SELECT * FROM task WHERE live",
        p2="SELECT * FROM parameter WHERE task_id NOT IN (SELECT task_id FROM task WHERE NOT live)",
    )
    + TAGGED.format(c="chain", t="t2", p="p2"),
)
def d03(t):
    """Every step that is switched off goes, with its parameters."""
    return tagged(bulk.delete_tasks(tables(t), t.task.where("NOT live").select("task_id")))


@query(
    "d04_delete_jobs",
    ctes(
        "chain", "task", "parameter",
        gone="SELECT chain_id FROM chain WHERE run_at = '61 0 * * *'",
        c2="SELECT * FROM chain WHERE chain_id NOT IN (SELECT chain_id FROM gone)",
        t2="SELECT * FROM task WHERE chain_id NOT IN (SELECT chain_id FROM gone)",
        p2="SELECT * FROM parameter WHERE task_id NOT IN (SELECT task_id FROM task WHERE chain_id IN (SELECT chain_id FROM gone))",
    )
    + TAGGED.format(c="c2", t="t2", p="p2"),
)
def d04(t):
    """Chains with a broken schedule go by name, two levels deep."""
    return tagged(bulk.delete_jobs(tables(t), t.chain.where("run_at = '61 0 * * *'").select("chain_name")))


@query(
    "d05_pause_resume",
    ctes("chain")
    + """SELECT chain_id, CASE WHEN run_at = '@reboot' THEN false WHEN run_at IS NULL THEN true ELSE live END AS live FROM chain""",
)
def d05(t):
    """Reboot chains are paused, schedule-less chains resumed."""
    paused = bulk.set_live(t.chain, t.chain.where("run_at = '@reboot'"), False)
    return bulk.set_live(paused, t.chain.where("run_at IS NULL"), True).select("chain_id", "live")


def replacement(t) -> JobTables:
    """New definitions for every exclusive chain: same name, one fresh step."""
    old = t.chain.where("exclusive_execution")
    chains = old.withColumn("chain_id", F.col("chain_id") + 10_000_000_000)
    tasks = chains.select(
        (F.col("chain_id") * 10).alias("task_id"), "chain_id", F.lit(10.0).alias("task_order"), F.lit("SQL").alias("kind"),
        F.lit("SELECT 1").alias("command"),
    )
    return JobTables(chains, tasks, tasks.select("task_id", F.lit(1).cast("bigint").alias("order_id"), F.lit("[]").alias("value")))


@query(
    "d06_replace_jobs",
    ctes(
        "chain", "task", "parameter",
        gone="SELECT chain_id FROM chain WHERE exclusive_execution",
        c2="""SELECT chain_id, chain_name FROM chain WHERE NOT exclusive_execution
        UNION ALL SELECT chain_id + 10000000000, chain_name FROM chain WHERE exclusive_execution""",
        t2="""SELECT task_id, chain_id, command FROM task WHERE chain_id NOT IN (SELECT chain_id FROM gone)
        UNION ALL SELECT (chain_id + 10000000000) * 10, chain_id + 10000000000, 'SELECT 1' FROM gone""",
        p2="""SELECT task_id, order_id, value FROM parameter WHERE task_id NOT IN (SELECT task_id FROM task WHERE chain_id IN (SELECT chain_id FROM gone))
        UNION ALL SELECT (chain_id + 10000000000) * 10, 1, '[]' FROM gone""",
    )
    + TAGGED.format(c="c2", t="t2", p="p2"),
)
def d06(t):
    return tagged(bulk.replace_jobs(tables(t), replacement(t)))


@query("d06_name_conflicts", ctes("chain") + "SELECT chain_id, chain_name FROM chain WHERE exclusive_execution")
def d06_conflicts(t):
    """What the same load would collide with, without replacement."""
    return bulk.name_conflicts(t.chain, replacement(t).chain)


# A document per part: a chain with two steps, every third time another with one step; every tenth is named like a customer.
DOCUMENTS = """concat('{"chains":[{"name":"', CASE WHEN z % 10 = 0 THEN concat('Customer#', lpad(CAST(k AS STRING), 9, '0')) ELSE concat('c', CAST(k AS STRING)) END, '"',
    CASE z % 3 WHEN 1 THEN ',"schedule":"@every 1 hour"' WHEN 2 THEN ',"schedule":""' ELSE '' END,
    CASE WHEN z % 2 = 0 THEN ',"live":true' ELSE '' END, CASE WHEN z % 4 = 0 THEN concat(',"max_instances":', z) ELSE '' END,
    CASE WHEN z % 5 = 0 THEN ',"exclusive":true' ELSE ',"exclusive":null' END, ',"timeout":', z, ',"client_name":"', CASE WHEN z % 2 = 0 THEN '' ELSE br END, '"',
    CASE WHEN z % 6 = 0 THEN ',"on_error":"SELECT 1","self_destruct":true' ELSE '' END,
    ',"tasks":[{"command":"', ty, '","timeout":', z, CASE WHEN z % 2 = 0 THEN concat(',"parameters":[', k, ',"x",null,[', z, ',{"a":1.5}]]') ELSE '' END, '},',
    '{"name":"second","kind":"program","command":"', CASE WHEN z % 13 = 0 THEN '' ELSE br END, '","run_as":"user', z,
    '","connect_string":"","ignore_error":true,"autonomous":true,"live":false,"parameters":[]}]}',
    CASE WHEN z % 3 = 0 THEN concat(',{"name":"d', k, '","tasks":[{"name":"","kind":"BUILTIN","command":"NoOp","connect_string":"host=h","live":',
        CASE WHEN z % 9 = 0 THEN '"yes"' ELSE 'true' END, ',"parameters":[{"p":', z, '}]}]}') ELSE '' END, ']}')"""


def loaded(t) -> definitions.Load:
    parts = t.raw("part").selectExpr("p_partkey AS k", "p_size AS z", "p_brand AS br", "p_type AS ty")
    documents = parts.select("k", F.expr(DOCUMENTS).alias("doc"))
    return definitions.load_definitions(documents, "k", "doc", tables(t))


LOADED = {
    "pt": "SELECT p_partkey AS k, p_size AS z, p_brand AS br, p_type AS ty FROM part",
    "both_c": """SELECT k, 0 AS position, CASE WHEN z % 10 = 0 THEN concat('Customer#', lpad(k::VARCHAR, 9, '0')) ELSE concat('c', k) END AS chain_name,
        CASE WHEN z % 3 = 1 THEN '@every 1 hour' ELSE '* * * * *' END AS run_at, CASE WHEN z % 4 = 0 THEN z ELSE 0 END AS max_instances, z AS timeout,
        z % 2 = 0 AS live, z % 6 = 0 AS self_destruct, z % 5 = 0 AS exclusive_execution, CASE WHEN z % 2 <> 0 THEN br END AS client_name,
        CASE WHEN z % 6 = 0 THEN 'SELECT 1' END AS on_error FROM pt WHERE z % 13 <> 0
        UNION ALL SELECT k, 1, concat('d', k), '* * * * *', 0, 0, false, false, false, NULL, NULL FROM pt WHERE z % 3 = 0 AND z % 9 <> 0""",
    "new_c": "SELECT *, (SELECT max(chain_id) FROM chain) + row_number() OVER (ORDER BY k, position) AS chain_id FROM both_c",
    "both_t": """SELECT chain_id, 0 AS pos, CAST(NULL AS VARCHAR) AS task_name, 'SQL' AS kind, ty AS command, CAST(NULL AS VARCHAR) AS run_as,
        CAST(NULL AS VARCHAR) AS database_connection, false AS ignore_error, false AS autonomous, z AS timeout, true AS live, z, k FROM new_c JOIN pt USING (k) WHERE position = 0
        UNION ALL SELECT chain_id, 1, 'second', 'PROGRAM', br, concat('user', z), NULL, true, true, 0, false, z, k FROM new_c JOIN pt USING (k) WHERE position = 0
        UNION ALL SELECT chain_id, 0, NULL, 'BUILTIN', 'NoOp', NULL, 'host=h', false, false, 0, true, z, k FROM new_c JOIN pt USING (k) WHERE position = 1""",
    "new_t": """SELECT *, (SELECT max(task_id) FROM task) + row_number() OVER (ORDER BY chain_id, pos) AS task_id,
        CAST(10 * (pos + 1) AS DOUBLE) AS task_order FROM both_t""",
    "new_p": """SELECT task_id, unnest([1, 2, 3, 4])::BIGINT AS order_id, unnest([k::VARCHAR, '"x"', 'null', concat('[', z, ',{"a":1.5}]')]) AS value
        FROM new_t WHERE kind = 'SQL' AND z % 2 = 0 UNION ALL SELECT task_id, 1, concat('{"p":', z, '}') FROM new_t WHERE kind = 'BUILTIN'""",
}


@query(
    "d06_load_definitions",
    ctes("chain", "task", **LOADED)
    + """SELECT task_id, chain_id, task_order, task_name, kind, command, run_as, database_connection, ignore_error, autonomous, timeout, live FROM new_t""",
)
def d06_load(t):
    """Tasks of nested definition documents, with all their members."""
    return loaded(t).new.task


@query(
    "d06_loaded_chains",
    ctes("chain", **LOADED)
    + """SELECT chain_id, chain_name, run_at, max_instances, timeout, live, self_destruct, exclusive_execution, client_name, on_error FROM new_c""",
)
def d06_chains(t):
    return loaded(t).new.chain


@query("d06_loaded_parameters", ctes("chain", "task", **LOADED) + "SELECT * FROM new_p")
def d06_parameters(t):
    return loaded(t).new.parameter


@query(
    "d06_refused_definitions",
    ctes(**LOADED)
    + """SELECT k, 0 AS position, false AS mistyped, true AS command_missing FROM pt WHERE z % 13 = 0
    UNION ALL SELECT k, 1, true, false FROM pt WHERE z % 9 = 0""",
)
def d06_refused(t):
    return loaded(t).refused.select("k", "position", "mistyped", "command_missing")


@query(
    "d06_load_and_replace",
    ctes(
        "chain", "task", "parameter", **LOADED,
        gone="SELECT chain_id FROM chain WHERE chain_name IN (SELECT chain_name FROM new_c)",
        c2="SELECT chain_id, chain_name FROM chain WHERE chain_id NOT IN (SELECT chain_id FROM gone) UNION ALL SELECT chain_id, chain_name FROM new_c",
        t2="SELECT task_id, chain_id, command FROM task WHERE chain_id NOT IN (SELECT chain_id FROM gone) UNION ALL SELECT task_id, chain_id, command FROM new_t",
        p2="""SELECT task_id, order_id, value FROM parameter WHERE task_id NOT IN (SELECT task_id FROM task WHERE chain_id IN (SELECT chain_id FROM gone))
        UNION ALL SELECT task_id, order_id, value FROM new_p""",
    )
    + TAGGED.format(c="c2", t="t2", p="p2"),
)
def d06_load_replace(t):
    """The job tables after the load, chains of names in use replaced."""
    return tagged(definitions.store(loaded(t), tables(t), replace=True))


@query(
    "d07_upsert",
    """WITH tgt AS (SELECT o_orderkey, o_custkey, o_totalprice AS amount, o_orderdate AS processed FROM orders WHERE o_orderstatus <> 'P'),
    src AS (SELECT l_orderkey AS o_orderkey, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1)
    SELECT o_orderkey, o_custkey, coalesce(src.amount, tgt.amount) AS amount,
    CASE WHEN src.o_orderkey IS NOT NULL THEN TIMESTAMP '2024-01-15' ELSE processed END AS processed FROM tgt FULL JOIN src USING (o_orderkey)""",
)
def d07(t):
    """Order revenue from the lines loaded over the order table."""
    target = t.raw("orders").where("o_orderstatus <> 'P'").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("processed")
    )
    source = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("amount")
    )
    source = source.select("o_orderkey", F.lit(None).cast("bigint").alias("o_custkey"), "amount", at(ANCHOR).alias("processed"))
    return bulk.upsert(target, source, ["o_orderkey"], ["amount", "processed"])


@query(
    "d08_retention",
    ctes("exec_log") + f"SELECT exec_id, finished FROM exec_log WHERE finished >= TIMESTAMP '{ANCHOR}' - INTERVAL 7 DAY",
)
def d08(t):
    cutoff = (at(ANCHOR) - F.expr("INTERVAL 7 DAYS")).cast("timestamp_ntz")
    return bulk.retain_since(t.exec_log, "finished", cutoff).select("exec_id", "finished")


@query(
    "d09_self_destruct",
    ctes("chain", "exec_log", **RUNS)
    + """SELECT chain_id, chain_name FROM chain WHERE NOT (self_destruct AND chain_id IN (SELECT chain_id FROM r WHERE outcome = 'COMPLETED'))""",
)
def d09(t):
    return bulk.drop_finished_once(t.chain, runlog.chain_runs(t.exec_log)).select("chain_id", "chain_name")


@query(
    "d10_session_cleanup",
    ctes("exec_log", sess=SESSIONS)
    + """SELECT 'session' AS kind, client_pid AS id, client_name FROM sess WHERE client_name <> 'worker_1'
    UNION ALL SELECT 'active', exec_id, client_name FROM exec_log WHERE client_name <> 'worker_1'""",
)
def d10(t):
    client = session_clients(t)
    left, active = bulk.end_session(sessions(t), t.exec_log.select("exec_id", "chain_id", "client_name"), client)
    return left.select(F.lit("session").alias("kind"), F.col("client_pid").alias("id"), "client_name").unionByName(
        active.select(F.lit("active").alias("kind"), F.col("exec_id").alias("id"), "client_name")
    )


def session_clients(t):
    return t.exec_log.where("client_name = 'worker_1'").select("client_name").distinct()


@query(
    "d10_finish_clears_all",
    ctes("exec_log", done="SELECT DISTINCT chain_id, client_name FROM exec_log WHERE returncode <> 0 AND dur_us > 200000000")
    + """SELECT exec_id FROM exec_log e WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.chain_id = e.chain_id AND d.client_name = e.client_name)""",
)
def d10_finish(t):
    active = t.exec_log.select("exec_id", "chain_id", "client_name")
    return bulk.finish_chains(active, t.exec_log.where("returncode <> 0 AND dur_us > 200000000")).select("exec_id")


def cron_jobs(t):
    """A plain cron job table: one job per customer, on its nation's host."""
    return t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("jobid"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("jobname"),
        F.lit("5 4 * * *").alias("schedule"), F.concat(F.lit("CALL p("), F.col("c_custkey").cast("string"), F.lit(")")).alias("command"),
        F.col("n_name").alias("nodename"), F.lit(5432).alias("nodeport"), F.col("c_mktsegment").alias("database"),
        F.col("c_name").alias("username"), (F.col("c_acctbal") > 100).alias("active"),
    )


@query(
    "d11_import_cron_table",
    ctes(
        "chain", "task",
        j="SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey",
        m="SELECT (SELECT max(chain_id) FROM chain) AS mc, (SELECT max(task_id) FROM task) AS mt",
    )
    + """SELECT n + mc AS chain_id, n + mt AS task_id, CASE WHEN c_acctbal > 0 THEN c_name ELSE concat('cronjob', CAST(n + mc AS VARCHAR)) END AS chain_name,
    '5 4 * * *' AS run_at, c_acctbal > 100 AS live, 1.0::DOUBLE AS task_order, 'SQL' AS kind, concat('CALL p(', CAST(c_custkey AS VARCHAR), ')') AS command,
    CASE WHEN c_mktsegment <> 'BUILDING' OR n_name <> 'NATION_1' OR c_name <> 'Customer#000000001'
     THEN format('host={} port={} dbname={} user={}', n_name, 5432, c_mktsegment, c_name) END AS database_connection FROM j, m""",
)
def d11(t):
    new = bulk.import_cron_table(cron_jobs(t), HERE, t.chain, t.task)
    return new.chain.join(new.task, "chain_id")


@query(
    "d11_add_cron_table",
    ctes(
        "chain", "task",
        c="""SELECT CASE WHEN c_acctbal > 0 THEN c_name ELSE concat('job: CALL p(', CAST(c_custkey AS VARCHAR), ')') END AS chain_name,
        concat('CALL p(', CAST(c_custkey AS VARCHAR), ')') AS command, c_acctbal > 100 AS live FROM customer JOIN nation ON c_nationkey = n_nationkey""",
        j="SELECT *, row_number() OVER (ORDER BY chain_name) AS n FROM c",
        m="SELECT (SELECT max(chain_id) FROM chain) AS mc, (SELECT max(task_id) FROM task) AS mt",
    )
    + """SELECT n + mc AS chain_id, n + mt AS task_id, chain_name, '5 4 * * *' AS run_at, live, 'SQL' AS kind, command,
    true AS ignore_error, true AS autonomous FROM j, m""",
)
def d11_added(t):
    """The same job table through the job interface, nameless jobs called by their commands."""
    new = bulk.expand_jobs(bulk.cron_table_requests(cron_jobs(t)), t.chain, t.task)
    return new.chain.select("chain_id", "chain_name", "run_at", "live").join(
        new.task.select("task_id", "chain_id", "kind", "command", "ignore_error", "autonomous"), "chain_id"
    )


def flag_tables(t):
    """Flag-array scheduler tables: nations own jobs' hosts, suppliers are jobs, parts their steps."""
    job = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("job_id"), F.col("s_name").alias("job_name"), F.col("n_name").alias("host"),
        (F.col("s_acctbal") > 0).alias("enabled"),
    )

    def flags(size: int, divisor: int):
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i + F.col("s_suppkey")) % divisor == 0)

    sched = t.raw("supplier").select(
        F.col("s_suppkey").alias("job_id"), F.lit(1).alias("schedule_id"), F.lit("main").alias("schedule_name"),
        flags(60, 30).alias("minutes"), flags(24, 12).alias("hours"),
        F.array_repeat(F.lit(False), 32).alias("monthdays"), flags(12, 6).alias("months"), flags(7, 7).alias("weekdays"),
        (F.col("s_acctbal") > -500).alias("enabled"), at("2020-01-01 00:00:00").alias("start_at"),
        F.when(F.col("s_nationkey") > 20, at("2023-01-01 00:00:00")).alias("end_at"),
    )
    step = t.raw("part").select(
        F.col("p_partkey").alias("step_id"), F.floor(F.col("p_retailprice")).cast("bigint").alias("slot"), F.col("p_name").alias("step_name"),
        F.when(F.col("p_size") > 25, "b").otherwise("s").alias("step_kind"), F.col("p_type").alias("code"),
        F.when(F.col("p_size") == 3, "host=x").otherwise("").alias("connection"),
        F.when(F.col("p_size") == 4, "").when(F.col("p_size") == 5, None).otherwise(F.col("p_brand")).alias("database"),
    )
    n_jobs = t.raw("supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    return job, sched, step.withColumn("job_id", F.col("step_id") % n_jobs).drop("slot")


_FLAGS = {
    "m": "SELECT (SELECT max(chain_id) FROM chain) AS mc, (SELECT max(task_id) FROM task) AS mt",
    "fl": """SELECT s_suppkey, f, string_agg(CAST(i + off AS VARCHAR), ',' ORDER BY i) AS txt FROM (
        SELECT s_suppkey, f, unnest(range(0, n)) AS i, d, off FROM supplier,
        (SELECT 'mi' AS f, 60 AS n, 30 AS d, 0 AS off UNION ALL SELECT 'ho', 24, 12, 0 UNION ALL SELECT 'mo', 12, 6, 1 UNION ALL SELECT 'wd', 7, 7, 1))
        WHERE (i + s_suppkey) % d = 0 GROUP BY 1, 2""",
    "sched": """SELECT s.s_suppkey, s_name, n_name, s_acctbal, concat(mi.txt, ' ', ho.txt, ' * ', mo.txt, ' ', wd.txt) AS run_at FROM supplier s
        JOIN nation ON s_nationkey = n_nationkey
        JOIN fl mi ON mi.s_suppkey = s.s_suppkey AND mi.f = 'mi' JOIN fl ho ON ho.s_suppkey = s.s_suppkey AND ho.f = 'ho'
        JOIN fl mo ON mo.s_suppkey = s.s_suppkey AND mo.f = 'mo' JOIN fl wd ON wd.s_suppkey = s.s_suppkey AND wd.f = 'wd'
        WHERE s_acctbal > -500 AND s_nationkey <= 20""",
    "c2": "SELECT *, row_number() OVER (ORDER BY s_suppkey) + mc AS chain_id FROM sched, m",
    "st": """SELECT c2.chain_id, p.*, rank() OVER (ORDER BY p_name) AS rk, row_number() OVER (ORDER BY c2.chain_id, p_partkey) + mt AS task_id
        FROM c2 JOIN part p ON p_partkey % (SELECT count(*) FROM supplier) = s_suppkey""",
}


def flag_import(t):
    job, sched, step = flag_tables(t)
    return bulk.import_flag_schedules(job, sched, step, at(ANCHOR), "Brand#7", t.chain, t.task)


@query(
    "d12_import_flag_chains",
    ctes("chain", "task", **{k: _FLAGS[k] for k in ("m", "fl", "sched", "c2")})
    + "SELECT chain_id, concat(s_name, ' @ main') AS chain_name, n_name AS client_name, s_acctbal > 0 AS live, run_at FROM c2",
)
def d12(t):
    return flag_import(t).chain


@query(
    "d12_import_flag_steps",
    ctes("chain", "task", **_FLAGS)
    + """SELECT task_id, chain_id, p_name AS task_name, CAST(rk AS DOUBLE) AS task_order, CASE WHEN p_size > 25 THEN 'PROGRAM' ELSE 'SQL' END AS kind,
    CASE WHEN p_size > 25 THEN 'sh' ELSE p_type END AS command, CASE WHEN p_size = 3 THEN 'host=x' WHEN p_size IN (4, 5) OR p_brand = 'Brand#7' THEN NULL
    ELSE concat('dbname=', p_brand) END AS database_connection, CASE WHEN p_size > 25 THEN concat('["-c","', p_type, '"]') END AS value FROM st""",
)
def d12_steps(t):
    new = flag_import(t)
    return new.task.join(new.parameter.select("task_id", "value"), "task_id", "left")


@query(
    "d13_import_older_layout",
    ctes("task", **LINKS)
    + """SELECT l.task_id, p.chain_id, p.task_order, p_name AS task_name, 'SQL' AS kind, p_type AS command, s_name AS database_connection,
    t.ignore_error, 0 AS timeout FROM link l JOIN task t USING (task_id) JOIN placed p USING (task_id)
    JOIN (SELECT *, (SELECT count(*) FROM part) AS np FROM part) b ON b.p_partkey = l.task_id % np
    LEFT JOIN supplier s ON s.s_suppkey = l.task_id % 1000 - 500""",
)
def d13(t):
    """Steps that point at parents and at shared base tasks."""
    n_parts = t.raw("part").agg(F.count(F.lit(1)).alias("n")).scalar()
    links = parent_links(t)
    steps = links.join(t.task.select("task_id", "ignore_error"), "task_id").select(
        "task_id", "parent_id", (F.col("task_id") % n_parts).alias("base_id"),
        (F.col("task_id") % 1000 - 500).alias("connection_id"), "ignore_error",
    )
    base = t.raw("part").select(
        F.col("p_partkey").alias("base_id"), F.col("p_name").alias("task_name"), F.lit("SQL").alias("kind"), F.col("p_type").alias("command")
    )
    connections = t.raw("supplier").select(F.col("s_suppkey").alias("connection_id"), F.col("s_name").alias("connect_string"))
    heads = links.where("parent_id IS NULL").select("task_id", "chain_id")
    return bulk.import_older_layout(steps, base, connections, heads)


def older_tables(t) -> JobTables:
    n_parts = t.raw("part").agg(F.count(F.lit(1)).alias("n")).scalar()
    links = parent_links(t)
    steps = links.join(t.task.select("task_id", "ignore_error"), "task_id").select(
        "task_id", "parent_id", (F.col("task_id") % n_parts).alias("base_id"), (F.col("task_id") % 1000 - 500).alias("connection_id"), "ignore_error",
        F.when(F.col("task_id") % 5 == 0, F.lit("runner")).alias("run_as"), (F.col("task_id") % 4 == 0).alias("autonomous"),
    )
    base = t.raw("part").select(
        F.col("p_partkey").alias("base_id"), F.col("p_name").alias("task_name"), F.lit("SQL").alias("kind"), F.col("p_type").alias("command")
    )
    connections = t.raw("supplier").select(F.col("s_suppkey").alias("connection_id"), F.col("s_name").alias("connect_string"))
    # A second header for every seventh chain, and one that names a step which is not there.
    configs = t.raw("orders").selectExpr(*OLDER_CONFIG)
    heads = links.where("parent_id IS NULL").select("chain_id", F.col("task_id").alias("head_id"))
    named = configs.join(heads, "chain_id")
    again = named.where("chain_id % 7 = 0").withColumn("chain_id", F.col("chain_id") + 10_000_000)
    lost = named.where("chain_id % 11 = 0").withColumns({"chain_id": F.col("chain_id") + 20_000_000, "head_id": F.lit(-1).cast("bigint")})
    given = links.where("task_id % 3 = 0").select("chain_id", "task_id", F.lit(1).cast("bigint").alias("order_id"), F.format_string("[%d]", "task_id").alias("value"))
    extra = given.where("chain_id % 7 = 0").withColumn("chain_id", F.col("chain_id") + 10_000_000)
    return bulk.import_older_tables(steps, base, connections, named.unionByName(again).unionByName(lost), given.unionByName(extra))


OLDER_CONFIG = (
    "o_orderkey AS chain_id", "concat('order ', CAST(o_orderkey AS STRING)) AS chain_name", "CASE WHEN o_orderkey % 2 = 0 THEN '@reboot' ELSE '0 1 * * *' END AS run_at",
    "CAST(o_orderkey % 3 AS INT) AS max_instances", "o_orderkey % 2 = 1 AS live", "o_orderkey % 5 = 0 AS self_destruct",
    "o_orderkey % 13 = 0 AS exclusive_execution", "o_orderstatus AS client_name",
)
OLDER = {
    "cfg": "SELECT " + ", ".join(OLDER_CONFIG) + " FROM orders",
    "named": "SELECT cfg.* FROM cfg JOIN (SELECT DISTINCT chain_id FROM task) USING (chain_id)",
}


@query(
    "d13_chains",
    ctes("task", **OLDER)
    + """SELECT *, 0 AS timeout, CAST(NULL AS VARCHAR) AS on_error FROM named
    UNION ALL SELECT * REPLACE (chain_id + 10000000 AS chain_id), 0, NULL FROM named WHERE chain_id % 7 = 0""",
)
def d13_chains(t):
    """Headers of the older layout; those whose first step is not there stay out."""
    return older_tables(t).chain


@query(
    "d13_tasks",
    ctes("task", **LINKS)
    + """SELECT l.task_id, p.chain_id, p.task_order, CASE WHEN l.task_id % 5 = 0 THEN 'runner' END AS run_as, l.task_id % 4 = 0 AS autonomous, t.ignore_error
    FROM link l JOIN task t USING (task_id) JOIN placed p USING (task_id) WHERE l.task_id % (SELECT count(*) FROM part) IN (SELECT p_partkey FROM part)""",
)
def d13_tasks(t):
    return older_tables(t).task.select("task_id", "chain_id", "task_order", "run_as", "autonomous", "ignore_error")


@query(
    "d13_parameters",
    ctes("task", **LINKS) + """SELECT task_id, CAST(1 AS BIGINT) AS order_id, format('[{}]', task_id) AS value FROM placed WHERE task_id % 3 = 0""",
)
def d13_parameters(t):
    """Parameters by header and step; a step's are those of its one chain."""
    return older_tables(t).parameter


@query(
    "d14_collect_and_log",
    ctes(
        "parameter",
        g="SELECT task_id + 1000000 AS task_id, order_id, json_extract_string(value, '$.k') AS item FROM parameter WHERE value IS NOT NULL",
    )
    + """SELECT task_id, CAST(1 AS BIGINT) AS order_id, concat('"Sent: ', string_agg(item, ';' ORDER BY order_id), '"') AS value FROM g GROUP BY 1
    UNION ALL SELECT task_id, order_id, value FROM parameter WHERE value IS NULL""",
)
def d14(t):
    """Non-null parameters are consumed; their numbers go into a log task's message."""
    sent = bulk.collect_and_log(t.parameter, F.col("value").isNotNull(), F.col("task_id") + 1_000_000, "k", "Sent: ")
    return sent.withColumn("order_id", F.col("order_id").cast("bigint"))


@query(
    "d14_keeps_parameters",
    ctes(
        "parameter",
        g="SELECT task_id, order_id, json_extract_string(value, '$.k') AS item FROM parameter WHERE value IS NOT NULL AND order_id % 2 = 0",
        m="""SELECT task_id, CAST(1 AS BIGINT) AS order_id, concat('"Sent: ', string_agg(item, ';' ORDER BY order_id), '"') AS value
        FROM g WHERE item IS NOT NULL GROUP BY 1""",
    )
    + """SELECT task_id, order_id, value FROM m UNION ALL
    SELECT task_id, order_id, value FROM parameter p WHERE NOT (value IS NOT NULL AND order_id % 2 = 0)
      AND NOT EXISTS (SELECT 1 FROM m WHERE m.task_id = p.task_id AND m.order_id = p.order_id)""",
)
def d14_keeps(t):
    """A task logs about itself: its first parameter becomes the message, and those not sent stay."""
    sent = F.col("value").isNotNull() & (F.col("order_id") % 2 == 0)
    out = bulk.collect_and_log(t.parameter, sent, F.col("task_id"), "k", "Sent: ")
    return out.withColumn("order_id", F.col("order_id").cast("bigint"))
