"""Sessions and run states: set membership with NULLs, name conflicts, open and dead starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States that close a start.
FINISHED_STATES = ("CHAIN_FAILED", "CHAIN_DONE", "DEAD")


def not_in(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """``left`` rows whose key is NOT IN the right column, with SQL's NULL rules.

    Nothing on the right keeps every row; a NULL on the right keeps none; a
    NULL key on the left is kept only if the right side is empty. Spelled as a
    plain anti join plus two one-row figures, because the engine's own
    null-aware anti join broadcasts the right side whatever its size.
    """
    values = right.select(F.col(right_key or key).alias(key)).distinct()
    facts = F.struct(F.count(F.lit(1)).alias("total"), F.count_if(F.col(key).isNull()).alias("nulls"))
    right_side = values.agg(facts.alias("f")).scalar()
    keeps = (right_side["total"] == 0) | ((right_side["nulls"] == 0) & F.col(key).isNotNull())
    return left.where(keeps).join(
        values.where(F.col(key).isNotNull()), key, "left_anti"
    )


def name_conflicts(sessions: DataFrame) -> DataFrame:
    """Sessions whose client name is also held by another pid.

    A name is in conflict iff its smallest and largest pid differ: one
    aggregate row per name instead of pairing all sessions of a busy name.
    """
    shared = (
        sessions.groupBy("client_name")
        .agg(F.min("client_pid").alias("lo"), F.max("client_pid").alias("hi"))
        .where("lo <> hi")
    )
    return sessions.join(shared.select("client_name"), "client_name", "left_semi")


def open_starts(run_status: DataFrame) -> DataFrame:
    """Chain starts without a finish of any kind."""
    closed = run_status.where(F.col("execution_status").isin(*FINISHED_STATES) & F.col("start_status_id").isNotNull())
    return run_status.where("execution_status = 'CHAIN_STARTED'").join(
        closed.select(F.col("start_status_id").alias("run_status_id")), "run_status_id", "left_anti"
    )


def with_dead_rows(run_status: DataFrame, client: str) -> DataFrame:
    """The status table plus one DEAD row for every open start of ``client``."""
    dead = open_starts(run_status).where(F.col("client_name") == client).select(
        F.col("run_status_id").alias("start_status_id"),
        F.lit("DEAD").alias("execution_status"),
        "client_name",
    )
    return run_status.unionByName(dead, allowMissingColumns=True)
