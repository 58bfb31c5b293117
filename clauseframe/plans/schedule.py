"""Month-by-month cost projection of agreements.

Each agreement becomes its months by one ``explode``; every amount is a column of the month number, so a projection of any
number of agreements is a narrow job but for the running total, which is a window within one agreement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import add_months, money

#: Columns of an agreement and its scenario; absent ones count as null.
INPUTS = {
    "start": "string", "rent": "double", "term": "int", "increase_percent": "double", "option_months": "int", "option_rent": "double", "option_percent": "double",
    "indexation": "string", "floor_at_base": "boolean", "inflation": "double", "charges": "double", "one_time_start": "double", "one_time_end": "double",
    "exit_after": "int", "exit_kind": "string", "exit_notice_days": "int", "exit_months": "int", "exit_amount": "double", "replacement_after": "int",
    "late_vacating_days": "int", "vacating_per_day": "double", "vacating_multiple": "double", "late_payment_days": "int", "payment_per_day": "double", "payment_interest": "double",
}
PARTS = ("base", "increase", "indexation_due", "charges_due", "one_time", "penalties")


def _or(name: str, value: float) -> Column:
    return F.coalesce(name, F.lit(value))


def _owed_months() -> Column:
    """Months still owed after an early exit. Silence about exits counts as no right to leave."""
    remaining = F.col("term") - F.col("exit")
    notice = F.greatest(F.lit(1), F.ceil(_or("exit_notice_days", 30) / 30)).cast("int")
    kind = _or("exit_kind", "NOT_ALLOWED")
    owed = (
        F.when(kind.isin("UNTIL_END", "NOT_ALLOWED"), remaining)
        .when(kind == "UNTIL_REPLACEMENT", F.least(remaining, F.greatest(notice, _or("replacement_after", 0))))
        .when(kind == "ALLOWED_WITH_NOTICE", F.least(remaining, notice))
        .when(kind == "FIXED_MONTHS", F.least(remaining, F.coalesce("exit_months", remaining)))
        .otherwise(0)
    )
    return F.when(F.col("exit").isNull(), 0).otherwise(owed).cast("int")


def _index(month: Column) -> Column:
    i = 1 + _or("inflation", 0.0) / 100
    years = F.when(F.col("indexation") == "ANNUAL", F.floor((month - 1) / 12)).when(F.col("indexation") == "AT_RENEWAL", F.when(month > F.col("term"), F.col("term") / 12).otherwise(0)).otherwise((month - 1) / 12)
    factor = F.when(_or("indexation", "NONE") == "NONE", 1.0).otherwise(F.pow(i, years))
    return F.when(F.coalesce("floor_at_base", F.lit(True)), F.greatest(F.lit(1.0), factor)).otherwise(factor)


def _raised(month: Column) -> Column:
    return F.pow(1 + _or("increase_percent", 0.0) / 100, F.floor((month - 1) / 12))


def rent_of(month: Column) -> dict[str, Column]:
    """The rent of a month in its parts. A stated option rent is nominal and not indexed again."""
    option = F.coalesce("option_rent", F.col("rent") * _raised(F.col("term")) * (1 + _or("option_percent", 0.0) / 100))
    in_term = month <= F.col("term")
    raised = F.col("rent") * _raised(month)
    return {
        "base": F.when(in_term, F.col("rent")).otherwise(option),
        "increase": F.when(in_term, raised - F.col("rent")).otherwise(0.0),
        "indexation_due": F.when(in_term, raised * (_index(month) - 1)).when(F.col("option_rent").isNotNull(), 0.0).otherwise(option * (_index(month) - 1)),
    }


def schedule(agreements: DataFrame, key: str) -> DataFrame:
    """(key, seq, month, period, phase, parts, total, cumulative), parts unrounded but for ``total``, which is rounded before it
    is summed. Agreements without rent or term have no months."""
    df = agreements.select(key, *(F.col(c).cast(t).alias(c) if c in agreements.columns else F.lit(None).cast(t).alias(c) for c, t in INPUTS.items()))
    df = df.where("rent IS NOT NULL AND term >= 1").withColumn("exit", F.least(F.greatest(F.lit(1), "exit_after"), F.col("term") - 1))
    df = df.withColumn("exit", F.when(F.col("exit_after").isNotNull(), F.col("exit")))
    df = df.withColumn("owed", _owed_months()).withColumn("occupied", F.coalesce("exit", F.col("term") + _or("option_months", 0)))
    late = ((_or("late_vacating_days", 0) > 0) & (F.col("occupied") > 0)).cast("int")
    df = df.withColumn("rows", F.col("occupied") + F.col("owed") + late).where("rows > 0")
    last = rent_of(F.col("occupied"))
    df = df.withColumn("last_rent", sum(last.values(), F.lit(0.0)))
    df = df.withColumn("seq", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    in_use, owing = F.col("seq") <= F.col("occupied"), F.col("seq") <= F.col("occupied") + F.col("owed")
    df = df.withColumn("phase", F.when(in_use & (F.col("seq") <= F.col("term")), "TERM").when(in_use, "OPTION").when(owing, "EXIT").otherwise("LATE"))
    df = df.withColumn("month", F.when(F.col("phase") == "LATE", F.col("occupied") + 1).otherwise(F.col("seq")))
    pays = F.col("phase") != "LATE"
    parts = {n: F.when(pays, c).otherwise(0.0) for n, c in rent_of(F.col("month")).items()}
    daily = F.coalesce("vacating_per_day", _or("vacating_multiple", 1.0) * F.col("last_rent") / 30)
    payment = F.coalesce(F.col("payment_per_day") * F.col("late_payment_days"), F.col("rent") * F.col("payment_interest") / 100 * F.col("late_payment_days") / 30, F.lit(0.0))
    penalties = (
        F.when((F.col("exit_kind") == "FIXED_AMOUNT") & (F.col("seq") == F.col("exit")), _or("exit_amount", 0.0)).otherwise(0.0)
        + F.when(F.col("phase") == "LATE", daily * F.col("late_vacating_days")).otherwise(0.0)
        + F.when((F.col("seq") == 1) & (_or("late_payment_days", 0) > 0), payment).otherwise(0.0)
    )
    one_time = F.when(F.col("seq") == 1, _or("one_time_start", 0.0)).otherwise(0.0) + F.when(F.col("seq") == F.col("occupied"), _or("one_time_end", 0.0)).otherwise(0.0)
    df = df.withColumns(parts | {"charges_due": F.when(in_use, _or("charges", 0.0)).otherwise(0.0), "one_time": one_time, "penalties": penalties})
    df = df.withColumn("total", money(sum((F.col(p) for p in PARTS), F.lit(0.0))))
    running = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("cumulative", money(F.sum("total").over(running)))
    return df.select(key, "seq", "month", add_months("start", F.col("month") - 1).alias("period"), "phase", *PARTS, "total", "cumulative")


def totals(months: DataFrame, key: str) -> DataFrame:
    """Sums of unrounded parts, rounded once; ``total`` is the sum of rounded months; the average is over occupied months."""
    occupied = F.count_if(F.col("phase").isin("TERM", "OPTION"))
    sums = months.groupBy(key).agg(*(money(F.sum(p)).alias(p) for p in PARTS), F.sum("total").alias("_t"), occupied.alias("occupied"))
    return sums.select(key, *PARTS, money("_t").alias("total"), F.when(F.col("occupied") > 0, money(F.col("_t") / F.col("occupied"))).otherwise(0.0).alias("average"))


def first_over(months: DataFrame, key: str, limit: Column, rent_only: bool = False, tolerance: float = 0.005) -> DataFrame:
    """(key, peak, first_month): the highest month, and the first one above the limit, or null."""
    value = F.col("base") + F.col("increase") + F.col("indexation_due") if rent_only else F.col("total")
    over = F.when(value > limit + tolerance, F.col("month"))
    return months.groupBy(key).agg(money(F.max(value)).alias("peak"), F.min(over).alias("first_month"))


def effective_percent(months: DataFrame, key: str) -> DataFrame:
    """(key, percent): the yearly rate at which the rent moves over the first 13 occupied months."""
    rent = F.col("base") + F.col("increase") + F.col("indexation_due")
    own = months.where("phase IN ('TERM', 'OPTION') AND month <= 13")
    ends = own.groupBy(key).agg(F.min_by(rent, "month").alias("first"), F.max_by(rent, "month").alias("last"), F.count(F.lit(1)).alias("span"))
    rate = F.when((F.col("span") > 1) & (F.col("first") > 0), (F.pow(F.col("last") / F.col("first"), 12 / (F.col("span") - 1)) - 1) * 100).otherwise(0.0)
    return ends.select(key, rate.alias("percent"))


def security_summary(securities: DataFrame, key: str) -> DataFrame:
    """(key, total, cash_locked, return_days) of ``securities`` (key, ord, kind, amount, return_days): what is known of their amounts,
    what of it is held in cash, and the first return time that is stated."""
    known = lambda c: money(F.coalesce(F.sum(c), F.lit(0.0)))
    days = F.min(F.when(F.col("return_days").isNotNull(), F.struct("ord", "return_days")))["return_days"]
    return securities.groupBy(key).agg(known(F.col("amount")).alias("total"), known(F.when(F.col("kind") == "CASH_DEPOSIT", F.col("amount"))).alias("cash_locked"), days.alias("return_days"))
