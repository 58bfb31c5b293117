"""Statutes as they stand on a date, their versions, price indices, recognised pages, and streams of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import repository as P
from ..plans import layout, statutes
from ..registry import query, table
from ..session import dealt
from ..sources import feeds
from ..streaming import laws as monitor

REPEALED, SINCE = "(בוטל).", "החל מיום"
HEBREW = "שלומעולם"


@query("""WITH s(ord, number, k, text) AS (
  SELECT 0, '1', c_custkey, '1 Aim The aim of law ' || c_custkey || ' is fair renting for all.' FROM customer
  UNION ALL SELECT 1, '2', c_custkey, '2 A landlord shall repair within ' || CASE WHEN c_custkey % 2 = 0 THEN 14 ELSE 30 + c_custkey % 10 END || ' days of notice.' FROM customer
  UNION ALL SELECT 2, '3', c_custkey, '3 A tenant under law ' || c_custkey || ' may ask for receipts.' FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT 3, '2', c_custkey, '2 Another section of the same number. (a) with a paragraph' FROM customer)
SELECT k AS law_id, CAST(row_number() OVER (PARTITION BY k ORDER BY ord) - 1 AS INTEGER) AS ordinal, 'IL-' || k || '-' || number || CASE WHEN number = '2' THEN '-INSTANCE-' || row_number() OVER (PARTITION BY k, number ORDER BY ord) ELSE '' END AS reference,
  number AS section, text, sha256(text) AS hash FROM s""")
def statute_chunks(spark, sf_dir):
    """A law for each customer: a wording that holds or does not yet, a section that is repealed in every third, one too short, and
    one whose number comes twice."""
    return statutes.chunks(_pages(spark, sf_dir), "2024-06-01")


def _pages(spark, sf_dir):
    k = F.col("c_custkey")
    number = lambda n, more="", level=1: F.lit(f'<div class="law-number{level}">{n}{more}</div>')
    content = lambda *parts, level=1: F.concat(F.lit(f'<div class="law-content{level}">'), *(p if not isinstance(p, str) else F.lit(p) for p in parts), F.lit("</div>"))
    year = F.when(k % 2 == 0, "2024").otherwise("2030")
    note = F.concat(F.lit(f'<span class="law-note">({SINCE} 1.1.'), year, F.lit("):</span> "))
    days = (F.lit(30) + k % 10).cast("string")
    html = F.concat(
        number("1.", '<div class="law-desc">Aim</div>'), content("The aim of law ", k.cast("string"), " is fair renting for all."),
        number("2."), content("A landlord shall repair within ", days, " days of notice."), content(note, "A landlord shall repair within 14 days of notice."),
        number("3."), F.when(k % 3 == 0, content(REPEALED)).otherwise(content("A tenant under law ", k.cast("string"), " may ask for receipts.")),
        number("4."), content("Short."),
        number("2."), content("Another section of the same number."), number("(a)", level=2), content("with a paragraph", level=2),
    )
    return dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("law_id"), html.alias("html"))


DATES = ("1999-12-31", "2023-12-31", "2024-01-01", "2024-06-01", "2029-12-31", "2030-01-01", "2031-07-01")


@query(f"""WITH d AS (SELECT c_custkey AS k, unnest([{', '.join(f"'{d}'" for d in DATES)}]) AS as_of FROM customer),
s AS (SELECT k, as_of, CASE WHEN as_of >= CASE WHEN k % 2 = 0 THEN '2024-01-01' ELSE '2030-01-01' END THEN '14' ELSE CAST(30 + k % 10 AS VARCHAR) END AS days FROM d)
SELECT k AS law_id, as_of, 'IL-' || k || '-2-INSTANCE-1' AS reference, '2 A landlord shall repair within ' || days || ' days of notice.' AS text, CAST(CASE WHEN k % 3 = 0 THEN 3 ELSE 4 END AS BIGINT) AS standing FROM s""")
def statute_history(spark, sf_dir):
    """The laws of ``statute_chunks`` on many dates, from intervals that are found once: what section 2 says, and how many chunks stand."""
    pages = _pages(spark, sf_dir)
    dates = pages.select("law_id", F.explode(F.array(*map(F.lit, DATES))).alias("as_of"))
    at = statutes.chunks_at(statutes.chunk_intervals(pages), dates)
    of_two = F.max(F.when(F.col("reference").endswith("-2-INSTANCE-1"), F.struct("reference", "text")))
    return at.groupBy("law_id", "as_of").agg(of_two.alias("x"), F.count(F.lit(1)).alias("standing")).select("law_id", "as_of", "x.reference", "x.text", "standing")


_RANKED = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders"


@query(f"""WITH r AS ({_RANKED}), c AS (SELECT o_custkey, o_orderstatus = 'F' AS approved FROM r WHERE n = 1)
SELECT o_orderkey, CASE WHEN n = 1 THEN CASE WHEN approved THEN 'ACTIVE' ELSE 'CANDIDATE' END WHEN n = 2 AND NOT approved THEN 'ACTIVE' ELSE 'RETIRED' END AS status FROM r JOIN c USING (o_custkey)""")
def law_activation(spark, sf_dir):
    """A customer's last order is a candidate and the one before is active. Approved is the candidate's date in the state F."""
    orders = P.versions(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    last = F.struct("o_orderdate", "o_orderkey")
    newest = orders.where("status = 'ACTIVE'").select("o_custkey", F.col("o_orderdate").alias("approved_date"))
    before = orders.where("status <> 'ACTIVE'").groupBy("o_custkey").agg(F.max(last)["o_orderkey"].alias("second"))
    status = F.when(F.col("status") == "ACTIVE", "CANDIDATE").when(F.col("o_orderkey") == F.col("second"), "ACTIVE").otherwise("RETIRED")
    states = orders.join(before, "o_custkey", "left").withColumn("status", status).select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "status")
    approvals = newest.select("o_custkey", F.col("approved_date").alias("o_orderdate"), F.lit("F").alias("o_orderstatus"))
    return P.activate(states, approvals, "o_custkey", ["o_orderdate", "o_orderstatus"]).select("o_orderkey", "status")


@query("""SELECT c_custkey, CAST(coalesce(floor(100 * avg(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 WHEN 'P' THEN 0.0 END) + 0.5), 100) AS BIGINT) AS coverage
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def coverage_percent(spark, sf_dir):
    """Finished orders are covered, open ones partly; a customer without orders has nothing that is not covered."""
    status = F.when(F.col("o_orderstatus") == "F", "COVERED").when(F.col("o_orderstatus") == "O", "PARTIAL").otherwise("MISSING")
    covered = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(A.coverage_percent(status).alias("coverage"))
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(covered, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("coverage", F.lit(100)).cast("long").alias("coverage"))


@query("SELECT event_id, CAST(timezone('Asia/Jerusalem', timezone('UTC', ts)) AS DATE) AS local_date FROM events")
def local_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.date_in_zone("ts").alias("local_date"))


@query("""SELECT conv_id, CAST(row_number() OVER w - 1 AS INTEGER) AS ord, turn, role, lead(turn) OVER w IS NOT NULL AS complete FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def stream_blocks(spark, sf_dir):
    """A conversation's turns as a stream of events in JSON, each event cut into two pieces; the last has no blank line behind it yet."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    end = F.when(F.col("turn") == F.col("last"), "").otherwise("\n\n")
    rows = turns.join(last, "conv_id").withColumn("event", F.concat(F.lit("event: turn\ndata: "), F.to_json(F.struct("turn", "role")), end))
    cut = 1 + F.col("turn") * 7 % 30
    halves = F.array(F.struct(F.lit(0).alias("half"), F.substr("event", F.lit(1), cut).alias("text")), F.struct(F.lit(1).alias("half"), F.substr("event", cut + 1).alias("text")))
    pieces = rows.select("conv_id", "turn", F.explode(halves).alias("p")).select("conv_id", F.struct("turn", "p.half").alias("at"), "p.text")
    event = F.from_json("data", "turn long, role string")
    return feeds.event_blocks(pieces, "conv_id", "at").select("conv_id", "ord", event["turn"].alias("turn"), event["role"].alias("role"), "complete")




def _responses(spark, sf_dir):
    """A price-index response for each nation: a good month, one without its number, one without a yearly change."""
    k = F.col("n_nationkey").cast("string")
    text = '{"month": [{"date": [{"year": %s, "month": 3, "percent": 0.5, "percentYear": %s.25}, {"year": %s, "percent": 1.0}]}, {"date": [{"year": %s, "month": 11, "percent": 0.25}]}]}'
    year = F.lit(2000) + F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.format_string(text, year.cast("string"), k, year.cast("string"), year.cast("string")).alias("body"))


@query("""WITH r AS (SELECT n_nationkey AS k FROM nation) SELECT 2000 + k || '-03' AS period, CAST(0.5 AS DOUBLE) AS percent, k + CAST(0.25 AS DOUBLE) AS percent_year FROM r
UNION ALL SELECT 2000 + k || '-11', CAST(0.25 AS DOUBLE), NULL FROM r""")
def index_months(spark, sf_dir):
    return feeds.index_months(_responses(spark, sf_dir))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0.0 END AS c_acctbal, 'he' AS language FROM customer")
def records_as_read(spark, sf_dir):
    """Customers as old records: no language, and no balance where it is below zero."""
    old = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    return P.as_read(old, c_acctbal=F.lit(0.0), language=F.lit("he"))


@query("""SELECT c_custkey AS doc_id, l AS line_no, w AS word, CASE WHEN w = 0 THEN c_name ELSE c_mktsegment END AS text, CAST(10 + 50 * w AS DOUBLE) AS x, CAST(800 - 10 * (l + 1) AS DOUBLE) AS y,
  CAST(CASE WHEN w = 0 THEN 40 ELSE 1 END AS DOUBLE) AS width, CAST(8 AS DOUBLE) AS height FROM customer, (VALUES (0), (1)) a(l), (VALUES (0), (1)) b(w)""")
def ocr_words(spark, sf_dir):
    """A page for each customer with two lines of two words; the second word has no width, and so the least."""
    box = lambda l, w: F.struct(*(F.lit(float(v)).alias(n) for n, v in (("x0", 20 + 100 * w), ("y0", 4 + 20 * l), ("x1", 100 if w == 0 else 120), ("y1", 20 * (l + 1)))))  # noqa: E731, E741
    word = lambda l, w: F.struct(F.col(("c_name", "c_mktsegment")[w]).alias("text"), box(l, w).alias("bbox"))  # noqa: E731, E741
    rows = F.array(*(F.struct(F.array(word(i, 0), word(i, 1)).alias("words")) for i in (0, 1)))
    blocks = F.array(F.struct(F.array(F.struct(rows.alias("lines"))).alias("paragraphs")))
    found = feeds.ocr_words(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(800.0).alias("page_height"), blocks.alias("blocks")))
    return found.select("doc_id", F.col("line.l").alias("line_no"), "word", "text", "x", "y", "width", "height")


@query("""WITH l AS (SELECT l_orderkey AS o, l_returnflag AS f, l_linenumber AS n, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
b AS (SELECT *, sum(CASE WHEN n - p = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY o, f ORDER BY n) AS block FROM (SELECT *, lag(n) OVER (PARTITION BY o, f ORDER BY n) AS p FROM l))
SELECT o AS doc_id, f AS clause_id, CAST(block AS BIGINT) AS block, CAST(0 AS DOUBLE) AS x0, CAST(700 - 12 * max(n) - 2 AS DOUBLE) AS y0, least(40.0, 1 + max(q) + 2)::DOUBLE AS x1, CAST(700 - 12 * min(n) + 12 AS DOUBLE) AS y1 FROM b GROUP BY o, f, block""")
def marked_boxes(spark, sf_dir):
    """An order's lines on a page of 40 by 800, 12 apart and 10 high, as wide as their quantity; lines of one return flag are a clause."""
    n = F.col("l_linenumber")
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_returnflag").alias("clause_id"), F.lit(1.0).alias("x"), (F.lit(700.0) - 12 * n).alias("y"), F.col("l_quantity").alias("width"), F.lit(10.0).alias("height"))
    sized = layout.boxes(words).withColumns({"page_width": F.lit(40), "page_height": F.lit(800)})
    return layout.marks(sized).select("doc_id", "clause_id", "block", "x0", "y0", "x1", "y1")


def _glyphs(spark, sf_dir):
    """Letters of a segment's name or, for every second customer, Hebrew ones, from left to right with a gap after the fourth; blanks are no
    glyphs, and the page has one line."""
    text = F.when(F.col("c_custkey") % 2 == 0, HEBREW).otherwise(F.col("c_mktsegment"))
    letters = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.split(text, "")).alias("seq", "text"))
    x = 10.0 * F.col("seq") + F.when(F.col("seq") >= 4, 5.0).otherwise(0.0)
    return layout.glyph_lines(letters.where("text <> ''").select("*", x.alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("width"), F.lit(10.0).alias("size"), F.lit(False).alias("eol")))


@query(f"""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN '{HEBREW[7:3:-1]} {HEBREW[3::-1]}' ELSE substr(c_mktsegment, 5) || ' ' || left(c_mktsegment, 4) END AS text FROM customer""")
def page_reading_order(spark, sf_dir):
    return layout.right_to_left(layout.line_words(_glyphs(spark, sf_dir))).select("doc_id", "text")


@query("SELECT c_custkey AS doc_id, true AS visual FROM customer WHERE c_custkey % 2 = 0")
def page_visual_order(spark, sf_dir):
    return layout.visual_order(_glyphs(spark, sf_dir)).select("doc_id", "visual")


@query(r"""SELECT doc_id, regexp_extract(text, '[^ \t-\r]+([ \t-\r]+[^ \t-\r]+){4}') AS span FROM documents WHERE regexp_matches(text, '[^ \t-\r]+([ \t-\r]+[^ \t-\r]+){4}')""")
def verbatim_spans(spark, sf_dir):
    """The first five words, quoted with a dash of white space between them, found again as the text has them."""
    docs = table(spark, sf_dir, "documents").withColumn("words", F.regexp_extract_all("text", F.lit(r"([^ \t-\r]+)"), F.lit(1))).where(F.size("words") >= 5)
    return docs.select("doc_id", T.verbatim("text", F.array_join(F.slice("words", 1, 5), " \n ")).alias("span"))


@query("SELECT o_orderkey, o_orderpriority AS priority FROM orders")
def fenced_json(spark, sf_dir):
    """An order's priority in JSON, in a fence for every second one."""
    body = F.to_json(F.struct(F.col("o_orderpriority").alias("priority")))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))).otherwise(body)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get_json_object(T.without_fence(text), "$.priority").alias("priority"))


def law_events(spark, sf_dir):
    """Orders as events: a customer's law is checked at each order, every fourth is an approval of what the order names."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    revision = (k % 3).cast("long")
    error = F.when(F.col("o_orderpriority").startswith("5"), "unreachable")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("long").alias("law_id"), F.col("o_orderdate").cast("timestamp").alias("at"), k.cast("long").alias("seq"), F.when(F.floor(k / 4) % 4 == 0, "approve").otherwise("check").alias("kind"),
        F.concat(F.lit("o"), (F.floor(k / 8) % 2).cast("string")).alias("official"), revision.alias("revision"), F.concat(F.lit("c"), revision.cast("string")).alias("content"), F.lit("s").alias("sections"),
        F.array(F.lit("1"), F.lit("2")).alias("keys"), none.alias("approved_content"), none.alias("approved_sections"), error.alias("error"),
    )


@query()
def law_monitor(spark, sf_dir):
    """The log of every law; one state after another, which SQL over sets does not say. Tests hold it to the rules applied one by one."""
    return monitor.replayed(law_events(spark, sf_dir))
