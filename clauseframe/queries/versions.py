"""Two versions of one agreement for each customer, aligned and compared, and chunks of long clauses. What changes follows from the key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import align, segment
from ..registry import query, table
from ..session import dealt

RENT = "The tenant pays %s shekels of rent on the first of every month."
CLEAN = "The tenant keeps the flat clean and in good repair during the lease."
PETS = "Cats may stay in a garden, never inside."
ROOF = "The landlord insures the building and mends its roof as section %s says."
NOTICE = "Either side ends this contract by written notice of sixty days."
KEYS, EMPTY = "All keys go back to the office on the final day of July", "and every room is handed over swept, painted and without furniture."
COURT = "Disputes reach a mediator before any judge hears them."


def _agreements(spark, sf_dir):
    """Of the later version: another rent, no pets, a clause on disputes, the notice moved up for even keys, the keys' clause in two
    for every third; sections are numbered anew, and the roof's clause names the notice by its number."""
    k, even = F.col("c_custkey"), F.col("c_custkey") % 2 == 0
    said = lambda text, x: F.format_string(text, x.cast("string"))
    plain = lambda *texts: [F.lit(t) for t in texts]
    before = F.array(said(RENT, 1000 + k), *plain(CLEAN, PETS), said(ROOF, F.lit(5)), *plain(NOTICE, f"{KEYS} {EMPTY}"))
    middle = F.when(even, F.array(*plain(NOTICE, CLEAN), said(ROOF, F.lit(2)))).otherwise(F.array(F.lit(CLEAN), said(ROOF, F.lit(4)), F.lit(NOTICE)))
    keys = F.when(k % 3 == 0, F.array(*plain(KEYS, EMPTY))).otherwise(F.array(F.lit(f"{KEYS} {EMPTY}")))
    after = F.concat(F.array(said(RENT, 1200 + k)), middle, keys, F.array(F.lit(COURT)))
    sides = F.array(F.struct(F.lit("before").alias("side"), before.alias("texts")), F.struct(F.lit("after").alias("side"), after.alias("texts")))
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("pair_id"), F.explode(sides).alias("s"))
    rows = rows.select("pair_id", "s.side", F.posexplode("s.texts").alias("ord", "text"))
    return rows.withColumn("text", F.concat((F.col("ord") + 1).cast("string"), F.lit(". "), "text"))


@query("""WITH k AS (SELECT c_custkey AS pair_id, c_custkey % 2 = 0 AS even, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS split FROM customer)
SELECT pair_id, '0' AS before, '0' AS after, 'MODIFIED' AS change, false AS moved, false AS renumbered FROM k
UNION ALL SELECT pair_id, '1', CASE WHEN even THEN '2' ELSE '1' END, 'UNCHANGED', false, false FROM k
UNION ALL SELECT pair_id, '2', '', 'REMOVED', false, false FROM k
UNION ALL SELECT pair_id, '3', CASE WHEN even THEN '3' ELSE '2' END, 'UNCHANGED', false, true FROM k
UNION ALL SELECT pair_id, '4', CASE WHEN even THEN '1' ELSE '3' END, 'UNCHANGED', even, false FROM k
UNION ALL SELECT pair_id, '5', CASE WHEN split = 1 THEN '4,5' ELSE '4' END, CASE WHEN split = 1 THEN 'SPLIT' ELSE 'UNCHANGED' END, false, false FROM k
UNION ALL SELECT pair_id, '', CAST(5 + split AS VARCHAR), 'ADDED', false, false FROM k""")
def agreement_alignment(spark, sf_dir):
    at = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return align.align(_agreements(spark, sf_dir)).select("pair_id", at("before"), at("after"), "change", "moved", "renumbered")


@query("SELECT c_custkey AS pair_id, '4' AS before, '1' AS after FROM customer WHERE c_custkey % 2 = 0")
def lis_moved(spark, sf_dir):
    """The clauses off the longest run that keeps its order: the notice, where it stands earlier than before."""
    at = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return align.align(_agreements(spark, sf_dir)).where("moved").select("pair_id", at("before"), at("after"))


@query("""WITH k AS (SELECT c_custkey AS pair_id, 1000 + c_custkey AS a, 1200 + c_custkey AS b FROM customer)
SELECT pair_id, 'equal:1. The tenant pays |delete:' || a || '|insert:' || b || '|equal: shekels of rent on the first of every month.' AS runs, a || '>' || b AS numbers FROM k""")
def agreement_diffs(spark, sf_dir):
    """The words and the numbers in which the modified clause differs."""
    found = align.diffs(align.align(_agreements(spark, sf_dir)).where("change = 'MODIFIED'"))
    runs = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["op"], r["text"])), "|")
    return found.select("pair_id", runs.alias("runs"), F.array_join(F.transform("numbers", lambda n: F.concat_ws(">", n["before"], n["after"])), ",").alias("numbers"))


@query(f"""WITH l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 2 WHEN c_custkey % 3 = 1 THEN 5 ELSE 1 END AS n FROM customer)
SELECT k AS doc_id, CAST(part AS INTEGER) AS part, CAST(CASE WHEN k % 3 = 0 THEN CASE part WHEN 1 THEN {segment.TARGET} ELSE {segment.TARGET + 50} END WHEN k % 3 = 1 THEN {segment.TARGET - 10} ELSE 40 END AS INTEGER) AS n_words
FROM l, LATERAL (SELECT unnest(range(1, n + 1)) AS part)""")
def clause_chunks(spark, sf_dir):
    """Clauses of one line that is too long, of five lines that each fill a chunk, and of two short lines."""
    k = F.col("c_custkey")
    line = lambda n: F.array_join(F.array_repeat(F.lit("word"), n), " ")
    several = lambda n, of: F.array_join(F.array_repeat(line(of), n), "\n")
    text = F.when(k % 3 == 0, line(2 * segment.TARGET + 50)).when(k % 3 == 1, several(5, segment.TARGET - 10)).otherwise(several(2, 20))
    chunks = segment.pack_chunks(dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("doc_id"), text.alias("text")))
    return chunks.select("doc_id", "part", F.size(F.split("chunk", r"\s+")).alias("n_words"))
