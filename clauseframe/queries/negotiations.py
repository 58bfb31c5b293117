"""Queries of negotiations, of records that look up their sources, and of changes to single fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lineage
from ..operators import repository as P
from ..plans import layout, negotiations, schedule
from ..registry import query, table
from ..streaming import negotiation

TOPICS = {"1": ("status", "price"), "2": ("price",), "3": ("customer",)}
WISHES = ("status", "price", "customer", "notes")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("p", F.substring("o_orderpriority", 1, 1))


@query(f"""WITH o AS (SELECT o_orderkey, left(o_orderpriority, 1) AS topic FROM orders), t(topic, key) AS (VALUES {', '.join(f"('{t}', '{k}')" for t, ks in TOPICS.items() for k in ks)}),
w AS (SELECT o_custkey, w.key FROM (SELECT DISTINCT o_custkey FROM orders) CROSS JOIN (VALUES {', '.join(f"({i}, '{k}')" for i, k in enumerate(WISHES))}) w(i, key) WHERE (o_custkey + i) % 3 <> 0)
SELECT q.o_orderkey, w.key, w.key || ' of ' || q.o_custkey AS line FROM orders q JOIN w USING (o_custkey) WHERE w.key = 'notes' OR EXISTS (SELECT 1 FROM o JOIN t USING (topic) WHERE o.o_orderkey = q.o_orderkey AND t.key = w.key)""")
def issue_preferences(spark, sf_dir):
    """Each order is an issue whose topic is its priority; each customer has stated some wishes."""
    issues = _orders(spark, sf_dir).select(F.col("o_custkey").alias("contract_id"), F.col("o_orderkey").alias("issue_id"), F.col("p").alias("topic"))
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("key")) for i, k in enumerate(WISHES)))).alias("x")
    stated = issues.select("contract_id").distinct().select("contract_id", keys).where((F.col("contract_id") + F.col("x.i")) % 3 != 0)
    lines = stated.select("contract_id", "x.key", F.concat("x.key", F.lit(" of "), F.col("contract_id").cast("string")).alias("line"))
    return negotiations.preferences_for(issues, lines, TOPICS).select(F.col("issue_id").alias("o_orderkey"), "key", "line")


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT l_orderkey, l_partkey % 3 AS issue, string_agg(l_partkey, ',' ORDER BY l_partkey) AS refs FROM l WHERE l_partkey % 2 = 0 GROUP BY ALL""")
def cited_sources(spark, sf_dir):
    """An order's draft asks for three issues and cites, of the parts that are their references, those of an even key."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft_id"), (F.col("l_partkey") % 3).alias("issue_id"), F.col("l_partkey").alias("ref_id")).distinct()
    requests = lines.groupBy("draft_id", "issue_id").agg(F.collect_list(F.when(F.col("ref_id") % 2 == 0, F.col("ref_id"))).alias("law_refs"))
    found = negotiations.draft_sources(requests, lines.withColumn("ord", F.col("ref_id")))
    return found.select(F.col("draft_id").alias("l_orderkey"), F.col("issue_id").alias("issue"), F.array_join(F.transform("refs", lambda r: r["ref_id"].cast("string")), ",").alias("refs"))


@query("""SELECT o_custkey, count(*) FILTER (p = '1') AS n_red, count(*) FILTER (p = '2') AS n_orange, count(*) FILTER (p = '3') AS n_suggestion
FROM (SELECT o_custkey, left(o_orderpriority, 1) AS p FROM orders) GROUP BY o_custkey""")
def opening_counts(spark, sf_dir):
    severity = F.when(F.col("p") == "1", "RED").when(F.col("p") == "2", "ORANGE").when(F.col("p") == "3", "SUGGESTION")
    counts = negotiations.opening_counts(_orders(spark, sf_dir).select(F.col("o_custkey").alias("contract_id"), severity.alias("severity")))
    return counts.withColumnRenamed("contract_id", "o_custkey")


@query(r"""WITH n AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '\d+')) AS cited FROM documents), a AS (SELECT ['1', '2', '3', '5', '7', '12', '24', '100'] AS allowed)
SELECT doc_id, array_to_string(list_sort(list_intersect(cited, allowed)), ' ') AS cited FROM n, a WHERE len(list_intersect(cited, allowed)) > 0""")
def allowed_citations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1)).alias("cited"), F.array(*map(F.lit, ("1", "2", "3", "5", "7", "12", "24", "100"))).alias("allowed"))
    return negotiations.allowed_only(docs, "cited", "allowed").select("doc_id", F.array_join(F.array_sort("cited"), " ").alias("cited"))


@query(r"""SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND turn % 4 <> 3 AND NOT regexp_matches(text, '\[[A-Z_]{3,}\]') AND NOT regexp_matches(text, '(?i)https?://|www\.|@[a-z0-9-]+\.')
  AND len([x FOR x IN regexp_extract_all(regexp_replace(text, '(?m)^[ \t]*\d{1,3}[.)][ \t]', '', 'g'), '(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)') IF replace(x, ',', '') NOT IN ('1', '2', '3')]) = 0""")
def usable_replies(spark, sf_dir):
    """Answers of conversations as replies: every second turn is an issue, and that of every second answer is raised."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    none = F.array().cast("array<string>")
    issue = F.when(F.col("turn") % 2 == 1, F.col("turn").cast("string"))
    replies = rows.select(F.col("conv_id").alias("contract_id"), issue.alias("issue_id"), F.col("text").alias("reply"), F.lit("").alias("answer"), none.alias("law"), none.alias("contract"), F.array(*map(F.lit, "123")).alias("grounded"), "turn")
    raised = replies.where("turn % 4 = 1").select("contract_id", "issue_id")
    return negotiations.usable_replies(replies, raised).select(F.col("contract_id").alias("conv_id"), "turn")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 1000 END AS amount, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 90 END AS days FROM orders)
SELECT o_custkey, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total, CAST(coalesce(sum(amount) FILTER (o_orderstatus = 'F'), 0) AS DOUBLE) AS cash_locked, arg_min(days, o_orderkey) FILTER (days IS NOT NULL) AS return_days FROM s GROUP BY o_custkey""")
def security_summary(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", key.alias("ord"), F.when(F.col("o_orderstatus") == "F", "CASH_DEPOSIT").otherwise("CHECK").alias("kind"), F.when(key % 3 > 0, (key % 1000).cast("double")).alias("amount"), F.when(key % 4 == 0, key % 90).alias("return_days"))
    return schedule.security_summary(rows, "o_custkey")


@query("""SELECT l_orderkey, l_suppkey, page, y0 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY page, y0 DESC) AS k
  FROM (SELECT l_orderkey, l_suppkey, l_linenumber AS page, l_quantity AS y0 FROM lineitem)) WHERE k = 1""")
def first_locations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    zero = F.lit(0.0)
    boxes = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("clause_id"), F.col("l_linenumber").alias("page"), zero.alias("x0"), F.col("l_quantity").alias("y0"), zero.alias("x1"), zero.alias("y1"))
    return layout.first_location(boxes).select(F.col("doc_id").alias("l_orderkey"), F.col("clause_id").alias("l_suppkey"), "page", "y0")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN 'X' END AS o_orderstatus FROM orders""")
def field_updates(spark, sf_dir):
    """Every third order has a new status, or loses its own; the link to every fifth customer goes with the customer."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changes = rows.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").alias("o_orderstatus"))
    gone = rows.where("o_custkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return P.unlink(P.update_fields(rows, changes, "o_orderkey", "o_orderstatus"), "o_custkey", gone, "c_custkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS section, max(l_linestatus) AS hash, max(l_partkey) AS body FROM lineitem GROUP BY ALL),
r AS (SELECT l_orderkey, l_linenumber AS number, l_linenumber + l_orderkey % 2 AS l_linenumber, section, hash FROM c),
u AS (SELECT l_orderkey, section, hash, min(body) AS body FROM c GROUP BY ALL HAVING count(*) = 1)
SELECT r.l_orderkey, r.number, coalesce(p.body, u.body) AS body, CASE WHEN p.body IS NOT NULL THEN 'PLACE' WHEN u.body IS NOT NULL THEN 'IDENTITY' END AS found_by
FROM r LEFT JOIN c p USING (l_orderkey, l_linenumber, section, hash) LEFT JOIN u ON r.l_orderkey = u.l_orderkey AND r.section = u.section AND r.hash = u.hash""")
def hydrated_chunks(spark, sf_dir):
    """A line is a chunk of its order; the records of odd orders point one place too far."""
    chunks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("section"), F.max("l_linestatus").alias("hash"), F.max("l_partkey").alias("body"))
    records = chunks.select("l_orderkey", F.col("l_linenumber").alias("number"), (F.col("l_linenumber") + F.col("l_orderkey") % 2).alias("l_linenumber"), "section", "hash")
    return P.hydrated(records, chunks, "l_orderkey", "l_linenumber", ["section", "hash"], "body").select("l_orderkey", "number", "body", "found_by")


@query("""WITH h AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey - 1 END AS previous, o_orderdate FROM orders),
l AS (SELECT o_custkey, o_orderkey AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM h) WHERE k = 1)
SELECT h.o_orderkey, l.latest AS previous_analysis FROM h LEFT JOIN l ON h.previous = l.o_custkey""")
def previous_versions(spark, sf_dir):
    key = F.col("o_custkey")
    history = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis_id"), key.alias("contract_id"), F.when(key % 3 != 0, key - 1).alias("previous_contract_id"), F.col("o_orderdate").alias("at"))
    return P.previous_version(history).select(F.col("analysis_id").alias("o_orderkey"), F.col("previous_analysis_id").alias("previous_analysis"))


@query("""SELECT o_orderkey, sha256('{"version":"1","o_orderkey":' || o_orderkey || ',"status":' || CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS key FROM orders""")
def content_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"))
    return rows.select("o_orderkey", P.content_key("1", "o_orderkey", "status").alias("key"))


@query("""WITH b AS (SELECT c_nationkey, c_custkey, CAST(floor(c_custkey / 1024.0) AS BIGINT) AS block, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS own FROM customer),
g AS (SELECT c_nationkey, block, sha256(string_agg(own, ':' ORDER BY c_custkey)) AS own FROM b GROUP BY ALL), m AS (SELECT c_nationkey, sha256(string_agg(own, ':' ORDER BY block)) AS bound FROM g GROUP BY ALL)
SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' || chr(10) || coalesce(bound, '')) AS fingerprint FROM nation LEFT JOIN m ON n_nationkey = c_nationkey""")
def official_fingerprints(spark, sf_dir):
    """A nation is a law, and its customers are what binds others to it."""
    bindings = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return P.official_fingerprint(table(spark, sf_dir, "nation"), bindings, "n_nationkey", ["n_nationkey", "n_name"], "c_custkey", ["c_mktsegment"])


@query("""SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7""")
def owner_projection(spark, sf_dir):
    own = P.owned(table(spark, sf_dir, "customer"), F.lit(7), "c_nationkey")
    return P.public(own, "c_nationkey", "c_acctbal", "c_mktsegment")


@query("""SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS active_laws, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS active_vectors""")
def health_counts(spark, sf_dir):
    state = lambda name, column: table(spark, sf_dir, name).select(F.when(F.col(column) == "O", "ACTIVE").alias("status"))
    return P.health(state("orders", "o_orderstatus"), state("lineitem", "l_linestatus"))


@query("""SELECT o_orderkey, first_value(o_orderkey) OVER w AS root, row_number() OVER w AS version FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def version_lineage(spark, sf_dir):
    """Each order replaces the customer's order before; its root and number are found from those pointers alone."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return lineage.lineage(table(spark, sf_dir, "orders").select("o_orderkey", before.alias("parent")), "o_orderkey", "parent")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
s(n, outcome, state) AS (VALUES (1, 'SAVED', 'PRIORITIZE'), (2, 'SAVED', 'PRIORITIZE'), (3, 'SAVED', 'STRATEGY'), (4, 'SAVED', 'STRATEGY'), (5, 'SAVED', 'DRAFT'), (6, 'SAVED', 'DRAFT'), (7, 'SAVED', 'COUNTER'), (8, 'SAVED', 'DONE'), (9, 'NOT_AVAILABLE', 'DONE'))
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o.n > 1 THEN CASE o.n WHEN 2 THEN 'UNKNOWN_ISSUE' WHEN 3 THEN 'NO_ADDRESS_FORM' ELSE 'NOT_AVAILABLE' END ELSE outcome END AS outcome,
  CASE WHEN o_custkey % 3 = 0 THEN 'PRIORITIZE' ELSE state END AS state, CAST(CASE WHEN o_custkey % 3 = 0 OR o.n < 4 THEN 0 WHEN o.n = 4 THEN 1 ELSE 2 END AS INTEGER) AS decided FROM o JOIN s ON s.n = least(o.n, 9)""")
def negotiation_calls(spark, sf_dir):
    """A customer's orders as the calls of one negotiation, from its opening to its end; every third customer is not asked how to be addressed."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    skips = F.col("o_custkey") % 3 == 0
    some = lambda *named: F.array(*(F.lit(i) for i in named))
    tool = F.element_at(some("open", "set_address_form", "set_priorities", "record_strategy", "record_strategy", "submit_draft", "finalize_draft", "complete_negotiation"), F.least("n", F.lit(8)))
    calls = table(spark, sf_dir, "orders").withColumn("n", n).select(
        F.col("o_custkey").cast("long").alias("negotiation_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").cast("long").alias("seq"), F.when(skips & (F.col("n") == 2), "get_issue_details").otherwise(tool).alias("tool"),
        F.when(F.col("n") == 4, "a").when(F.col("n") == 5, "b").otherwise("z").alias("issue"), F.when(F.col("n") == 6, some("a")).otherwise(some("a", "b")).alias("issues"),
        F.when(F.col("n") == 2, "PLURAL").when(F.col("n") == 4, "CITE_LAW").when(F.col("n") == 5, "CONCEDE").alias("kind"), F.lit("please").alias("text"), F.lit(True).alias("confirmed"), F.lit(True).alias("conceded"),
    )
    return negotiation.replayed(calls).select(F.col("seq").alias("o_orderkey"), "outcome", "state", "decided")
