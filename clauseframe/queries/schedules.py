"""Cost projections. An order is an agreement: a twelfth of its price is the rent, its priority gives the term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import money
from ..plans import rules, schedule
from ..registry import query, table


def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("start"), money(F.col("o_totalprice") / 12).alias("rent"), (digit * 3 + 3).alias("term"),
        F.when(F.col("o_orderstatus") == "P", 12).otherwise(0).alias("option_months"), F.lit(4.0).alias("option_percent"), F.lit("ANNUAL").alias("indexation"), F.lit(3.0).alias("inflation"), F.lit(250.0).alias("charges"),
    )


MONTHS_SQL = """a AS (SELECT o_orderkey, o_orderdate, floor(o_totalprice / 12 * 100 + 0.5) / 100 AS rent, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 3 + 3 AS term, CASE WHEN o_orderstatus = 'P' THEN 12 ELSE 0 END AS opt FROM orders),
m AS (SELECT *, CAST(unnest(range(1, term + opt + 1)) AS INTEGER) AS month FROM a),
f AS (SELECT *, CASE WHEN month <= term THEN rent ELSE rent * (1 + 4.0::DOUBLE / 100) END AS base, greatest(1.0, pow(1 + 3.0::DOUBLE / 100, floor((month - 1) / 12))) AS factor FROM m),
s AS (SELECT *, floor((base + base * (factor - 1) + 250.0) * 100 + 0.5) / 100 AS total FROM f)"""


@query(f"""WITH {MONTHS_SQL} SELECT o_orderkey, month, strftime(date_trunc('month', CAST(o_orderdate AS DATE)) + to_months(month - 1), '%Y-%m') AS period, CASE WHEN month <= term THEN 'TERM' ELSE 'OPTION' END AS phase, round(total, 2) AS total FROM s""")
def cost_schedule(spark, sf_dir):
    return schedule.schedule(agreements(spark, sf_dir), "o_orderkey").select("o_orderkey", "month", "period", "phase", F.round("total", 2).alias("total"))


@query(f"""WITH {MONTHS_SQL} SELECT o_orderkey, month, floor((sum(total) OVER (PARTITION BY o_orderkey ORDER BY month)) * 100 + 0.5) / 100 AS cumulative FROM s""")
def cost_cumulative(spark, sf_dir):
    return schedule.schedule(agreements(spark, sf_dir), "o_orderkey").select("o_orderkey", "month", "cumulative")


@query(f"""WITH {MONTHS_SQL} SELECT o_orderkey, floor((sum(base)) * 100 + 0.5) / 100 AS rent, floor((sum(base * (factor - 1))) * 100 + 0.5) / 100 AS indexation, floor((sum(250.0::DOUBLE)) * 100 + 0.5) / 100 AS charges, floor((sum(total)) * 100 + 0.5) / 100 AS total, floor((sum(total) / count(*)) * 100 + 0.5) / 100 AS average FROM s GROUP BY o_orderkey""")
def cost_totals(spark, sf_dir):
    t = schedule.totals(schedule.schedule(agreements(spark, sf_dir), "o_orderkey"), "o_orderkey")
    return t.select("o_orderkey", F.col("base").alias("rent"), F.col("indexation_due").alias("indexation"), F.col("charges_due").alias("charges"), "total", "average")


@query(f"""WITH {MONTHS_SQL} SELECT o_orderkey, round(max(total), 2) AS peak, min(CASE WHEN total > 20000 + 0.005 THEN month END) AS first_month FROM s GROUP BY o_orderkey""")
def first_over_budget(spark, sf_dir):
    return schedule.first_over(schedule.schedule(agreements(spark, sf_dir), "o_orderkey"), "o_orderkey", F.lit(20000.0)).withColumn("peak", F.round("peak", 2))


@query(f"""WITH {MONTHS_SQL}, e AS (SELECT o_orderkey, count(*) AS span, arg_min(base * factor, month) AS a, arg_max(base * factor, month) AS b FROM s WHERE month <= 13 GROUP BY 1)
SELECT o_orderkey, round(CASE WHEN span > 1 AND a > 0 THEN (pow(b / a, 12 / CAST(span - 1 AS DOUBLE)) - 1) * 100 ELSE 0 END, 4) AS percent FROM e""")
def effective_annual_pct(spark, sf_dir):
    return schedule.effective_percent(schedule.schedule(agreements(spark, sf_dir), "o_orderkey"), "o_orderkey").withColumn("percent", F.round("percent", 4))


@query("""WITH a AS (SELECT o_orderkey, o_totalprice / 12 AS rent, CASE WHEN o_orderstatus <> 'P' THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 3 + 3 END AS term, o_totalprice / 3 AS security FROM orders),
c AS (SELECT *, CASE WHEN term IS NOT NULL THEN least(rent * term / 3, rent * 3) ELSE rent * 3 END AS cap FROM a)
SELECT o_orderkey, floor((cap) * 100 + 0.5) / 100 AS cap, floor((greatest(security - cap, 0)) * 100 + 0.5) / 100 AS difference, CASE WHEN security > cap THEN false WHEN term IS NOT NULL THEN true END AS passed FROM c""")
def security_cap_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    months = F.when(F.col("o_orderstatus") != "P", F.substring("o_orderpriority", 1, 1).cast("int") * 3 + 3)
    found = rules.security_cap(F.col("o_totalprice") / 12, months, F.col("o_totalprice") / 3)
    return orders.select("o_orderkey", money(found["cap"]).alias("cap"), money(found["difference"]).alias("difference"), found["passed"].alias("passed"))


EXITS = ("UNTIL_END", "UNTIL_REPLACEMENT", "ALLOWED_WITH_NOTICE", "FIXED_MONTHS", "FIXED_AMOUNT")
FREQUENCIES = ("NONE", "MONTHLY", "ANNUAL", "AT_RENEWAL")


@query("""WITH a AS (SELECT c_custkey AS k, 1000 + c_custkey % 500 AS rent, c_custkey % 6 AS v, c_custkey % 2 AS late, floor(c_custkey / 6) % 4 AS f, CASE WHEN c_custkey % 6 = 5 THEN 18 ELSE 5 END AS occupied,
  CASE c_custkey % 6 WHEN 0 THEN 7 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 0 END AS owed FROM customer),
m AS (SELECT *, unnest(range(1, occupied + owed + late + 1)) AS seq FROM a),
p AS (SELECT *, CASE WHEN seq <= occupied AND seq <= 12 THEN 'TERM' WHEN seq <= occupied THEN 'OPTION' WHEN seq <= occupied + owed THEN 'EXIT' ELSE 'LATE' END AS phase FROM m),
r AS (SELECT *, CASE WHEN phase = 'LATE' THEN occupied ELSE seq END AS month FROM p),
b AS (SELECT *, rent * CASE WHEN month > 12 THEN 1 + 10.0::DOUBLE / 100 ELSE 1.0::DOUBLE END AS base, 1 + 6.0::DOUBLE / 100 AS one FROM r),
i AS (SELECT *, base + base * (CASE f WHEN 1 THEN pow(one, (month - 1) / 12.0::DOUBLE) WHEN 2 THEN pow(one, floor((month - 1) / 12.0::DOUBLE)) WHEN 3 THEN CASE WHEN month > 12 THEN one ELSE 1 END ELSE 1 END - 1) AS due FROM b),
t AS (SELECT k, phase, floor(CASE WHEN phase = 'LATE' THEN 1.5::DOUBLE * due / 30 * 10 ELSE due + CASE WHEN v = 4 AND seq = 5 THEN 2000 ELSE 0 END END * 100 + 0.5) / 100 AS total FROM i)
SELECT k AS c_custkey, phase, count(*) AS months, round(sum(total), 2) AS total FROM t GROUP BY ALL""")
def cost_exits(spark, sf_dir):
    """Each way of leaving early, or an option taken up, under each frequency of the index, with and without handing over late."""
    k = F.col("c_custkey")
    of = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    leaves = k % 6 != 5
    inputs = table(spark, sf_dir, "customer").select(
        k, (F.lit(1000.0) + k % 500).alias("rent"), F.lit(12).alias("term"), F.when(leaves, 5).alias("exit_after"), F.when(leaves, of((*EXITS, "none"), k % 6)).alias("exit_kind"), F.lit(60).alias("exit_notice_days"), F.lit(4).alias("exit_months"),
        F.lit(2000.0).alias("exit_amount"), F.lit(3).alias("replacement_after"), F.when(~leaves, 6).alias("option_months"), F.lit(10.0).alias("option_percent"), of(FREQUENCIES, F.floor(k / 6) % 4).alias("indexation"), F.lit(6.0).alias("inflation"),
        F.when(k % 2 == 1, 10).alias("late_vacating_days"), F.lit(1.5).alias("vacating_multiple"),
    )
    months = schedule.schedule(inputs, "c_custkey")
    return months.groupBy("c_custkey", "phase").agg(F.count(F.lit(1)).alias("months"), F.round(F.sum("total"), 2).alias("total"))
