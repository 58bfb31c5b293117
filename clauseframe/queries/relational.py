"""Relational idioms on the star tables.

A line item stands for a finding: what was returned (R) is a violation, what is open (O) a risk. An order stands for an
analysis, a customer for a contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ranking as R
from ..plans import rules
from ..registry import query, table

SEVERITY_SQL = "CASE WHEN l_returnflag = 'R' THEN 'RED' WHEN l_linestatus = 'O' OR l_discount > 0.07 THEN 'ORANGE' ELSE 'OK' END"
RANK_SQL = "CASE {} WHEN 'RED' THEN 0 WHEN 'ORANGE' THEN 1 WHEN 'OK' THEN 2 ELSE 3 END"
STATUSES = ("F", "O", "P", "X")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    severity = rules.severity(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_discount") > 0.07)
    return lines.withColumn("severity", severity)


@query(f"SELECT l_orderkey, l_linenumber, {SEVERITY_SQL} AS severity FROM lineitem")
def severity_classify(spark, sf_dir):
    return findings(spark, sf_dir).select("l_orderkey", "l_linenumber", "severity")


@query("""SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'legal_violation' WHEN quality = 0 THEN 'legal_risk'
  WHEN toxic = 1 THEN 'preference_conflict' ELSE 'ok' END AS category FROM labels""")
def category_classify(spark, sf_dir):
    violates, risk, preference = (F.col("quality") == 0) & (F.col("toxic") == 1), F.col("quality") == 0, F.col("toxic") == 1
    return table(spark, sf_dir, "labels").select("doc_id", rules.category(violates, risk, preference).alias("category"))


@query(f"""WITH f AS (SELECT l_orderkey, {SEVERITY_SQL} AS severity FROM lineitem)
SELECT l_orderkey, count(*) FILTER (severity = 'RED') AS n_red, count(*) FILTER (severity = 'ORANGE') AS n_orange,
  count(*) FILTER (severity = 'OK') AS n_ok FROM f GROUP BY l_orderkey""")
def severity_summary(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("l_orderkey").agg(*A.status_counts("severity", R.SEVERITIES))


@query("""SELECT s.o_orderstatus, coalesce(n, 0) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(o_orderstatus)
LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) c USING (o_orderstatus)""")
def status_counts_zero_filled(spark, sf_dir):
    return A.zero_filled_counts(table(spark, sf_dir, "orders"), "o_orderstatus", STATUSES)


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, {SEVERITY_SQL} AS severity FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {RANK_SQL.format('severity')}, l_linenumber) AS rank FROM f WHERE severity <> 'OK')
SELECT l_orderkey, l_linenumber, severity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def key_findings_top5(spark, sf_dir):
    open_ = findings(spark, sf_dir).where("severity <> 'OK'").select("l_orderkey", "l_linenumber", "severity")
    return R.first_per_key(open_, ["l_orderkey"], R.rank_of("severity", R.SEVERITIES), F.col("l_linenumber"), n=5)


@query("""SELECT o_orderkey, o_custkey, coalesce(c_name, 'unknown') AS c_name, coalesce(c_nationkey, -1) AS c_nationkey
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def history_left_join(spark, sf_dir):
    contracts = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(contracts, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", "o_custkey", F.coalesce("c_name", F.lit("unknown")).alias("c_name"), F.coalesce("c_nationkey", F.lit(-1)).alias("c_nationkey"))


@query("""WITH e AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS price FROM lineitem WHERE l_discount = 0 AND l_quantity > 0 GROUP BY ALL),
g AS (SELECT p_partkey AS l_partkey, p_retailprice AS price FROM part WHERE p_size <= 25)
SELECT l_orderkey, l_linenumber, floor(coalesce(e.price, g.price) * 100 + 0.5) / 100 AS price FROM lineitem l
LEFT JOIN e USING (l_partkey, l_suppkey) LEFT JOIN g USING (l_partkey) WHERE coalesce(e.price, g.price) IS NOT NULL""")
def lookup_with_fallback(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("pair", F.struct("l_partkey", "l_suppkey"))
    exact = lines.where("l_discount = 0 AND l_quantity > 0").groupBy("pair").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    general = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("price"))
    found = J.lookup_with_fallback(lines.select("l_orderkey", "l_linenumber", "pair", "l_partkey"), exact, general, "pair", "l_partkey", "price")
    return found.select("l_orderkey", "l_linenumber", numbers.money("price").alias("price"))


@query("""WITH b AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
a AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT o_custkey, b.s AS before, a.s AS after, CASE WHEN b.s IS NULL THEN 'ADDED' WHEN a.s IS NULL THEN 'REMOVED' WHEN a.s = b.s THEN 'UNCHANGED' ELSE 'CHANGED' END AS change
FROM b FULL JOIN a USING (o_custkey)""")
def full_outer_status_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    side = lambda odd: orders.where(F.col("o_orderkey") % 2 == odd).groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"))
    return J.full_outer_status(side(0), side(1), "o_custkey", "s")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1-%')")
def analysed_semi_join(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1-"))
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unavailable_anti_join(spark, sf_dir):
    partial = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(partial, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""WITH t AS (SELECT o_custkey, o_orderpriority AS topic, list(o_orderkey ORDER BY o_orderkey) AS members FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL HAVING count(*) >= 2)
SELECT o_custkey, topic, array_to_string(members, ',') AS members, CAST(len(members) - 1 AS INTEGER) AS peers FROM t""")
def topic_peers(spark, sf_dir):
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    grouped = open_.groupBy("o_custkey", F.col("o_orderpriority").alias("topic")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("members"))
    return grouped.where(F.size("members") >= 2).select("o_custkey", "topic", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), (F.size("members") - 1).alias("peers"))


@query(f"""WITH u AS (SELECT 'FINDING' AS kind, l_orderkey AS key, l_linenumber AS item, {SEVERITY_SQL} AS severity FROM lineitem WHERE l_quantity >= 45
  UNION ALL SELECT 'PROTECTION', o_orderkey, 0, 'SUGGESTION' FROM orders WHERE o_orderstatus = 'P')
SELECT kind, key, CAST(item AS INTEGER) AS item, severity, CAST(row_number() OVER (PARTITION BY key ORDER BY
  CASE severity WHEN 'RED' THEN 0 WHEN 'ORANGE' THEN 1 WHEN 'SUGGESTION' THEN 2 ELSE 3 END, kind, item) AS INTEGER) AS rank FROM u""")
def issue_union_ranked(spark, sf_dir):
    found = findings(spark, sf_dir).where("l_quantity >= 45").select(F.lit("FINDING").alias("kind"), F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("item"), "severity")
    missing = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit("PROTECTION").alias("kind"), F.col("o_orderkey").alias("key"), F.lit(0).alias("item"), F.lit("SUGGESTION").alias("severity"))
    order = (R.rank_of("severity", ("RED", "ORANGE", "SUGGESTION")), F.col("kind"), F.col("item"))
    return R.first_per_key(found.unionByName(missing), ["key"], *order, n=2**31 - 1)


@query(f"""WITH f AS (SELECT l_partkey, {SEVERITY_SQL} AS severity, l_orderkey, l_linenumber FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {RANK_SQL.format('severity')}, l_orderkey, l_linenumber) AS n FROM f)
SELECT l_partkey, severity, l_orderkey, l_linenumber FROM r WHERE n = 1""")
def merge_issues_most_severe(spark, sf_dir):
    issues = findings(spark, sf_dir).select("l_partkey", "severity", "l_orderkey", "l_linenumber")
    return A.most_severe(issues, ["l_partkey"], "severity", R.SEVERITIES, "l_orderkey", "l_linenumber")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_per_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.first_per_key(orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).drop("rank")


@query("""SELECT o_custkey, count(*) AS entries, count(DISTINCT o_orderstatus) AS statuses, array_to_string(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC), ',') AS versions
FROM orders GROUP BY o_custkey""")
def version_groups(spark, sf_dir):
    ordered = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")), asc=False)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("entries"), F.countDistinct("o_orderstatus").alias("statuses"), F.array_join(F.transform(ordered, lambda x: x["o_orderkey"].cast("string")), ",").alias("versions")
    )


@query("""SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type, p_brand) > 1 THEN p_type || ' ' || p_brand || '-INSTANCE-' || row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey)
  ELSE p_type || ' ' || p_brand END AS instance_id FROM part""")
def repeat_instance_suffix(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("ref"))
    return R.with_instance(named, "ref", F.col("p_partkey")).select("p_partkey", "instance_id")


@query("""WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type FROM events),
m AS (SELECT *, CASE WHEN event_type = 'purchase' THEN pos END AS matched FROM e)
SELECT event_id, CAST(first_value(matched IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 0.5 AS DOUBLE) AS shown_at FROM m""")
def next_survivor(spark, sf_dir):
    from pyspark.sql import Window

    placed = table(spark, sf_dir, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    matched = placed.withColumn("matched", F.when(F.col("event_type") == "purchase", F.col("pos").cast("double")))
    return R.next_survivor(matched, ["user_id"], "pos", "matched", "shown_at").select("event_id", "shown_at")


@query("""SELECT conv_id, turn, round(CASE WHEN count(*) OVER w > 1 THEN (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / CAST(count(*) OVER w - 1 AS DOUBLE) ELSE 0 END, 6) AS relative
FROM conversations WINDOW w AS (PARTITION BY conv_id)""")
def relative_position(spark, sf_dir):
    placed = R.relative_position(table(spark, sf_dir, "conversations"), ["conv_id"], F.col("turn"))
    return placed.select("conv_id", "turn", F.round("relative", 6).alias("relative"))


@query("""SELECT c.c_custkey, round(coalesce(o.price, CASE WHEN c.c_acctbal > 0 THEN c.c_acctbal END), 2) AS price, CASE WHEN o.price IS NOT NULL THEN 'override' WHEN c.c_acctbal > 0 THEN 'verified' END AS origin
FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def override_coalesce(spark, sf_dir):
    overrides = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("override"))
    joined = table(spark, sf_dir, "customer").join(overrides, "c_custkey", "left")
    value, origin = rules.overridden(F.col("override"), F.col("c_acctbal"), F.col("c_acctbal") > 0)
    return joined.select("c_custkey", F.round(value, 2).alias("price"), origin.alias("origin"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS violates, CASE WHEN l_returnflag = 'R' THEN false ELSE l_quantity > 40 OR l_tax > 0.06 END AS risk,
  CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_tax > 0.06 THEN 'tax' WHEN l_quantity > 40 THEN 'quantity' END AS reason FROM lineitem""")
def rule_table_last_wins(spark, sf_dir):
    table_ = [
        rules.Rule("returned", F.col("l_returnflag") == "R", "violates"),
        rules.Rule("quantity", F.col("l_quantity") > 40, "risk"),
        rules.Rule("tax", F.col("l_tax") > 0.06, "risk"),
    ]
    return rules.evaluate(table(spark, sf_dir, "lineitem"), table_, ("violates", "risk")).select("l_orderkey", "l_linenumber", "violates", "risk", "reason")


@query("""WITH d AS (SELECT source, doc_id, CAST(floor(doc_id / 1024.0) AS BIGINT) AS block, sha256(coalesce(text, '')) AS own FROM documents),
b AS (SELECT source, block, count(*) AS n, sha256(string_agg(own, ':' ORDER BY doc_id)) AS own FROM d GROUP BY source, block)
SELECT source, CAST(sum(n) AS BIGINT) AS members, sha256(string_agg(own, ':' ORDER BY block)) AS manifest FROM b GROUP BY source""")
def manifest_hash(spark, sf_dir):
    return A.manifest_hash(table(spark, sf_dir, "documents"), ["source"], "doc_id", "text")


@query("""WITH p AS (SELECT l.doc_id, l.quality AS gold, CASE WHEN length(d.text) > 100 THEN 1 ELSE 0 END AS predicted FROM labels l LEFT JOIN documents d USING (doc_id))
SELECT count(*) AS n, round(coalesce(sum(CASE WHEN gold = 1 AND predicted = 1 THEN 1 ELSE 0 END) / nullif(sum(gold), 0), 0), 6) AS recall,
  round(coalesce(sum(CASE WHEN gold = 1 AND predicted = 1 THEN 1 ELSE 0 END) / nullif(sum(predicted), 0), 0), 6) AS precision FROM p""")
def eval_metrics(spark, sf_dir):
    from ..plans.metrics import recall_precision

    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 100).alias("long")), "doc_id", "left")
    return recall_precision(joined, F.col("quality") == 1, F.coalesce("long", F.lit(False)))


@query("""SELECT 'orders_without_customer' AS check, count(*) AS failures FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'labels_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'customers_without_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def integrity_report(spark, sf_dir):
    from ..plans.metrics import dangling

    t = lambda n: table(spark, sf_dir, n)
    checks = [
        ("orders_without_customer", t("orders"), "o_custkey", t("customer"), "c_custkey"),
        ("lines_without_order", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        ("labels_without_document", t("labels"), "doc_id", t("documents"), "doc_id"),
        ("customers_without_nation", t("customer"), "c_nationkey", t("nation"), "n_nationkey"),
    ]
    return dangling(checks)


@query("""SELECT l_orderkey, l_linenumber, r.o_totalprice AS price_as_of FROM (SELECT l.*, o_custkey AS k FROM lineitem l JOIN orders ON l_orderkey = o_orderkey) f
ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL) r ON f.k = r.o_custkey AND f.l_shipdate >= r.o_orderdate""")
def asof_effective_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    history = orders.groupBy("o_custkey", "o_orderdate").agg(F.max("o_totalprice").alias("price_as_of"))
    return J.as_of(facts, history, "o_custkey", "l_shipdate", "o_orderdate", "price_as_of").select("l_orderkey", "l_linenumber", "price_as_of")
