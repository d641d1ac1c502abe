"""The SQL functions against their Column twins."""

from pyspark.sql import functions as F

from tickloom.functions import cron as C
from tickloom.functions import sqlfunctions
from tickloom.functions.intervals import interval_seconds

TEXTS = ["* * * * *", "*/7 3-9/2 1,15 * *", "0 0 * * 7", "0 0 * * 1", "61 0 * * *", "59 23 31 12 *", "@every 1 sec", "@every x", None]


def test_scalars_agree(spark):
    sqlfunctions.register(spark)
    now = "2024-02-29 23:59:00"
    ts = F.lit(now).cast("timestamp_ntz")
    df = spark.createDataFrame([(t,) for t in TEXTS], "c string").coalesce(1)
    c = F.col("c")
    columns = df.select(C.cron_fields(c), C.cron_valid(c), C.is_cron_in_time(c, ts), C.next_cron_run(c, ts), interval_seconds(F.substring(c, 7, 99)))
    text = f"TIMESTAMP_NTZ'{now}'"
    sql = df.selectExpr("cron_fields(c)", "cron_valid(c)", f"is_cron_in_time(c, {text})", f"next_run(c, {text})", "interval_seconds(substr(c, 7))")
    assert [tuple(r) for r in columns.collect()] == [tuple(r) for r in sql.collect()]


def test_table_functions(spark):
    sqlfunctions.register(spark)
    at = "TIMESTAMP_NTZ'2024-01-15 10:05:30'"
    assert spark.sql(f"SELECT * FROM cron_months({at}, array(1, 3))").count() == 3
    assert spark.sql(f"SELECT * FROM cron_days({at}, array(2), array(29, 30), array(0, 1, 2, 3, 4, 5, 6))").count() == 1
    assert sorted(r[0] for r in spark.sql("SELECT * FROM cron_times(array(1), array(0, 30))").collect()) == [60, 90]
    got = spark.sql(f"SELECT min(run_ts), count(*) FROM cron_runs({at}, '0 12 15 * *')").first()
    assert str(got[0]) == "2024-01-15 12:00:00" and got[1] == 13
