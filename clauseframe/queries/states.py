"""Versions, caches, limits, conversations, pages and alignments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import repository as P
from ..plans import align, segment
from ..registry import query, table
from ..sources import pages
from ..streaming import conversations, limits


@query()
def html_sections(spark, sf_dir):
    return pages.sections(table(spark, sf_dir, "pages"))


@query()
def html_manifest(spark, sf_dir):
    return A.manifest_hash(pages.sections(table(spark, sf_dir, "pages")).where(F.length("text") >= 20), ["page_id"], "ord", "text")


@query("""SELECT o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'ACTIVE' ELSE 'RETIRED' END AS status
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def scd_flip(spark, sf_dir):
    return P.versions(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "valid_from", "valid_to", "status")


@query("""WITH p AS (SELECT o_orderkey, lag(o_orderstatus) OVER w = o_orderstatus AS official, lag(o_orderpriority) OVER w = o_orderpriority AS txt, o_totalprice > 200000 AS staged FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, CASE WHEN official IS NULL THEN 'FIRST_VERSION' WHEN official AND txt THEN 'UNCHANGED' WHEN staged THEN 'ALREADY_STAGED' WHEN NOT official AND txt THEN 'OFFICIAL_UPDATE_PENDING' ELSE 'CANDIDATE' END AS decision FROM p""")
def cdc_decision_table(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    same = lambda c: F.lag(c).over(w) == F.col(c)
    checked = table(spark, sf_dir, "orders").withColumn("official", same("o_orderstatus")).withColumn("txt", same("o_orderpriority"))
    return checked.select("o_orderkey", P.change_decision(F.col("official"), F.col("txt"), F.col("o_totalprice") > 200000).alias("decision"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, date_trunc('hour', ts) + INTERVAL 2 HOUR AS expires FROM events GROUP BY ALL")
def rate_limit_tumbling(spark, sf_dir):
    return limits.counts(table(spark, sf_dir, "events"), "event_type", window="1 hour")


@query("""WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS nth FROM events)
SELECT event_id, nth <= 3 AS allowed, CAST(greatest(0, 3 - nth) AS INTEGER) AS remaining FROM n""")
def rate_limit_decision(spark, sf_dir):
    return limits.decisions(table(spark, sf_dir, "events"), "event_type", 3, "ts", "1 hour", "event_id").select("event_id", "allowed", "remaining")


@query("""SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS user_turns, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AND role = 'assistant' AS terminal,
  sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w > 60 AS over_limit FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def conversation_state(spark, sf_dir):
    return conversations.summary(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "user_turns", "terminal", "over_limit")


@query("""SELECT event_id, coalesce(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > ts - INTERVAL 7 DAY, false) AS hit FROM events""")
def ttl_cache_lookup(spark, sf_dir):
    return P.cache_hits(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "7 DAY", "event_id").select("event_id", "hit")


def _versions(spark, sf_dir):
    """Lines of pairs of documents that begin alike: (pair_id, side, ord, text). A pair is a document and the next one with
    the same first line and language."""
    docs = table(spark, sf_dir, "documents").withColumn("start", F.md5(F.substring_index("text", "\n", 1)))
    w = Window.partitionBy("lang", "start").orderBy("doc_id")
    paired = docs.withColumn("pair_id", F.lag("doc_id").over(w)).where("pair_id IS NOT NULL").select("pair_id", "doc_id")
    sides = paired.select("pair_id", F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("pair_id").alias("doc_id")), F.struct(F.lit("after").alias("side"), F.col("doc_id")))).alias("x")).select("pair_id", "x.side", "x.doc_id")
    lines = segment.explode_lines(table(spark, sf_dir, "documents").join(paired.select(F.explode(F.array("pair_id", "doc_id")).alias("doc_id")).distinct(), "doc_id", "left_semi"))
    return sides.join(lines, "doc_id").select("pair_id", "side", "ord", F.col("line").alias("text"))


@query()
def clause_alignment(spark, sf_dir):
    return align.align(_versions(spark, sf_dir))


@query()
def assignment_optimal(spark, sf_dir):
    found = align.align(_versions(spark, sf_dir))
    return found.where("change = 'MODIFIED'").groupBy("pair_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("similarity"), 3).alias("similarity"))


@query()
def word_diff(spark, sf_dir):
    return align.diffs(align.align(_versions(spark, sf_dir)).where("change = 'MODIFIED'"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 280 THEN left(text, 277) || '...' ELSE text END AS quote, coalesce(nullif(regexp_replace(regexp_replace(left(text, 40), '[^\pL\pN]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'ITEM-' || doc_id) AS section_key FROM documents""")
def quotes_and_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.capped("text", 280).alias("quote"), T.section_key(F.substring("text", 1, 40), F.col("doc_id")).alias("section_key"))
