"""Repository changes, page geometry, reports and nested inputs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repository as P
from ..plans import layout, report
from ..registry import query, table


@query("""WITH c AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS balance FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 UNION ALL SELECT -s_suppkey, s_acctbal FROM supplier)
SELECT c_custkey, round(balance, 2) AS balance FROM c UNION ALL SELECT c_custkey, round(c_acctbal, 2) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM c)""")
def snapshot_upsert(spark, sf_dir):
    snapshot = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    changed = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("balance"))
    added = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("balance"))
    return P.upsert(snapshot, changed.unionByName(added), "c_custkey").select("c_custkey", F.round("balance", 2).alias("balance"))


@query("""WITH n AS (SELECT o_orderkey % 4000 AS id, count(*) AS k FROM orders GROUP BY 1)
SELECT o_orderkey % 4000 AS id, CASE WHEN n.k > 1 THEN 'REPEATED' ELSE 'KNOWN' END AS reason FROM orders JOIN n ON n.id = o_orderkey % 4000 WHERE n.k > 1 OR o_orderkey % 4000 IN (SELECT c_custkey FROM customer)""")
def unique_key_rejects(spark, sf_dir):
    snapshot = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4000).alias("id"))
    _, rejected = P.insert_unique(snapshot, rows, "id")
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    return rejected.join(repeated, "id").select("id", F.when(F.col("k") > 1, "REPEATED").otherwise("KNOWN").alias("reason"))


@query("""WITH l AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F')
SELECT c_custkey FROM customer WHERE NOT (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM l))""")
def cascade_delete(spark, sf_dir):
    children = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    parents, _ = P.delete_cascade(table(spark, sf_dir, "customer").select("c_custkey"), children, children.where("o_orderstatus = 'F'"), "o_orderkey", "c_custkey")
    return parents


@query("""WITH g AS (SELECT *, lag(o_totalprice) OVER w AS py, lag(o_orderstatus) OVER w AS pe FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
b AS (SELECT *, sum(CASE WHEN py IS NULL OR abs(o_totalprice - py) > 0.5 * 100000 OR pe = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line FROM g)
SELECT o_custkey, CAST(line AS BIGINT) AS line, count(*) AS glyphs FROM b GROUP BY o_custkey, line""")
def glyph_line_runs(spark, sf_dir):
    columns = {"doc_id": F.col("o_custkey"), "page": F.lit(1), "seq": F.col("o_orderkey"), "text": F.col("o_orderstatus"), "x": F.lit(0.0), "y": F.col("o_totalprice"), "width": F.lit(1.0), "size": F.lit(100000.0), "eol": F.col("o_orderstatus") == "P"}
    glyphs = table(spark, sf_dir, "orders").select(*(c.alias(n) for n, c in columns.items()))
    return layout.glyph_lines(glyphs).groupBy(F.col("doc_id").alias("o_custkey"), "line").agg(F.count(F.lit(1)).alias("glyphs"))


@query("""WITH f AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'RED' WHEN 'O' THEN 'ORANGE' ELSE 'OK' END AS severity, CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN o_orderpriority < '3' THEN o_orderpriority ELSE 'other' END AS topic FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE severity WHEN 'RED' THEN 0 WHEN 'ORANGE' THEN 1 ELSE 2 END, CASE confidence WHEN 'high' THEN 0 ELSE 1 END, o_orderkey) AS rank,
  count(CASE WHEN severity <> 'OK' AND topic <> 'other' THEN 1 END) OVER (PARTITION BY o_custkey, topic) AS named FROM f)
SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank, CAST(CASE WHEN severity <> 'OK' AND topic <> 'other' THEN named - 1 ELSE 0 END AS INTEGER) AS peers, severity <> 'OK' AND rank <= 5 AS key FROM r""")
def findings_report(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "contract_id").withColumn("clause_id", F.col("o_orderkey").cast("string"))
    severity = F.when(F.col("o_orderstatus") == "P", "RED").when(F.col("o_orderstatus") == "O", "ORANGE").otherwise("OK")
    topic = F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority")).otherwise("other")
    verdicts = rows.select("contract_id", "clause_id", severity.alias("severity"), F.when(F.col("o_totalprice") > 150000, "high").otherwise("medium").alias("confidence"), topic.alias("topic"))
    found = report.findings(rows.select("contract_id", "clause_id", F.col("o_orderkey").alias("ord"), F.lit("").alias("text")), verdicts)
    return found.select(F.col("contract_id").alias("o_custkey"), F.col("ord").alias("o_orderkey"), "rank", F.size("peers").alias("peers"), "key")


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL""")
def nested_json_counts(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return parsed.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, len([x FOR x IN a IF list_contains(b, x)]) >= 0.5 * len(a) AND len(a) > 0 AS approvable FROM (
  SELECT o_orderkey, [substr(o_orderpriority, 1, 1), o_orderstatus] AS a, [substr(o_orderpriority, 1, 1), substr(o_orderpriority, 3, 1)] AS b FROM orders)""")
def auto_approval(spark, sf_dir):
    first, status, third = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"), F.substring("o_orderpriority", 3, 1)
    ok = P.auto_approvable(F.array(first, status), F.array(first, third), F.lit(True), F.lit(24.0), least_ratio=0.5)
    return table(spark, sf_dir, "orders").select("o_orderkey", ok.alias("approvable"))
