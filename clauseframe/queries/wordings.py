"""Wordings that vary with the row, near misses among them, and rules over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..plans import clauses as C
from ..plans import mentions, redact, segment
from ..registry import query, table
from ..sources import feeds
from ..streaming import indices
from .texts import _LAST, LINES_SQL, _steps

#: One-word phrases of the driver's documents; a star stands for any ending.
NAMED = (("ARTICLE", ("the", "der", "die", "das", "el", "la", "le", "les")), ("LINK", ("and", "und", "et", "y")), ("SECRET", ("token*", "secret*", "password*")), ("RIGHTS", ("copyright", "licen*", "rights")))


def _takes(phrases: tuple[str, ...]) -> str:
    return " OR ".join(f"starts_with(x, '{p[:-1]}')" if p.endswith("*") else f"x = '{p}'" for p in phrases)


@query("WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\pL+') AS w FROM documents) " + " UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, '{c}' AS name, CAST(len([x FOR x IN w IF {_takes(p)}]) AS INTEGER) AS n FROM w) WHERE n > 0" for c, p in NAMED))
def phrase_counts(spark, sf_dir):
    return mentions.counts(table(spark, sf_dir, "documents"), ["doc_id"], ("text",), list(NAMED)).drop("field")


#: (sentence, what it states as kind and SQL value of n); those that state nothing look like the others.
SAID = (
    ("שיעור העלייה {n}%", (("percent", "n"),)),
    ("שיעור העלייה {n} אחוזים", (("percent", "n"),)),
    ("an increase of {n}.5 percent", (("percent", "n + 0.5"),)),
    ("בתוך {n} ימים", (("days", "n"),)),
    ("בתוך {n} ימי עבודה", (("days", "n"),)),
    ("בתוך שלושים וחמישה ימים", (("days", "35"),)),
    ("בתוך מאה עשרים ימים", (("days", "120"),)),
    ("בתוך {n} שבועות", (("days", "7 * n"),)),
    ("תוך {n} שעות", (("days", "n / 24"),)),
    ("למשך {n} חודשים", (("months", "n"),)),
    ("למשך {n} שנים", (("months", "12 * n"),)),
    ("בתוך יומיים", (("days", "2"),)),
    ("בתוך שבועיים", (("days", "14"),)),
    ("סך של {n},500 ש״ח", (("money", "1000 * n + 500"),)),
    ("₪ {n}00.5", (("money", "100 * n + 0.5"),)),
    ("{n},000 שקלים חדשים", (("money", "1000 * n"),)),
    ("{n} ימים או {n} חודשים", (("days", "n"), ("months", "n"))),
    ("לפי סעיף {n}.1 להסכם", ()),
    ("בקומה {n} יש {n} דירות", ()),
    ("בתוך 0 ימים", ()),
)


@query(f"WITH k AS (SELECT CAST(c_custkey AS BIGINT) AS contract_id, CAST(c_custkey % {len(SAID)} AS INTEGER) AS v, CAST(c_custkey % 9 + 3 AS DOUBLE) AS n FROM customer) " + " UNION ALL ".join(f"SELECT contract_id, '{kind}' AS kind, CAST({value} AS DOUBLE) AS value FROM k WHERE v = {v}" for v, (_, told) in enumerate(SAID) for kind, value in told))
def agreement_numbers(spark, sf_dir):
    key = F.col("c_custkey").cast("long")
    said = F.get(F.array(*(F.lit(s) for s, _ in SAID)), (key % len(SAID)).cast("int"))
    rows = table(spark, sf_dir, "customer").select(key.alias("contract_id"), F.lit("C001").alias("clause_id"), F.lit(0).alias("ord"), F.lit(0).alias("s_ord"), F.replace(said, F.lit("{n}"), (key % 9 + 3).cast("string")).alias("sentence"))
    return C.sentence_numbers(rows).select("contract_id", "kind", "value")


_NUMBERED = (r"^\s*(?:סעיף|[Ss]ection|§)\s*(\d+(?:\.\d+)*)\s*[.):\-]?\s+\S", r"^\s*(\d+(?:\.\d+)+)\s*[.):\-]?\s+\S", r"^\s*(\d+)\s*[.):\-]\s*\S")
_LABEL_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{p}', 1), '')" for p in _NUMBERED) + ")"


@query(f"""WITH {LINES_SQL}, m AS (SELECT doc_id, CASE WHEN ord % 4 = 1 THEN 'Section ' || ord || '.' || (doc_id % 7) || ' ' || line WHEN ord % 4 = 2 THEN '(' || ord || ') ' || line WHEN ord % 4 = 3 THEN ord || ') ' || line ELSE line END AS line, ord FROM lines)
SELECT doc_id, ord, {_LABEL_SQL} AS label, len([w FOR w IN string_split_regex(line, '\\s+') IF w <> '']) BETWEEN 1 AND 7 AND NOT regexp_matches(trim(line), '[.:;,]$') AS heading FROM m""")
def heading_lines(spark, sf_dir):
    """Lines of documents, some of them numbered by their place: the label and whether the line reads like a heading."""
    lines, at = segment.explode_lines(table(spark, sf_dir, "documents")), F.col("ord") % 4
    marked = F.when(at == 1, F.concat(F.lit("Section "), "ord", F.lit("."), F.col("doc_id") % 7, F.lit(" "), "line")).when(at == 2, F.concat(F.lit("("), "ord", F.lit(") "), "line")).when(at == 3, F.concat("ord", F.lit(") "), "line")).otherwise(F.col("line"))
    return lines.select("doc_id", "ord", marked.alias("line")).select("doc_id", "ord", T.numbered_heading("line").alias("label"), T.is_heading("line").alias("heading"))


@query(r"""WITH w AS (SELECT doc_id, [CASE WHEN length(x) > 4 THEN regexp_replace(x, '^(?:[והבלמשכ]{1,2})(.{3})', '\1') ELSE x END FOR x IN regexp_extract_all(lower(coalesce(text, '')) || ' ולהסכם הדירה בית', '(\pL+)')] AS s FROM documents)
SELECT doc_id, CAST(len(f) AS INTEGER) AS n, CAST(len(list_distinct(f)) AS INTEGER) AS different, f[-2] AS last FROM (SELECT doc_id, [x FOR x IN s IF length(x) >= 3 AND x <> 'the'] AS f FROM w)""")
def word_stems(spark, sf_dir):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" ולהסכם הדירה בית"))
    rows = table(spark, sf_dir, "documents").select("doc_id", T.stems(text, stop=("the",)).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.size(F.array_distinct("s")).alias("different"), F.element_at("s", -2).alias("last"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders")
def readiness_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(*A.status_counts("o_orderstatus", ("F", "O", "P")))


@query(f"SELECT doc_id, coalesce(regexp_matches(t{_LAST}, '{redact.LATIN[0].pattern}') OR regexp_matches(t{_LAST}, '{redact.LATIN[1].pattern}'), false) AS blocked, t{_LAST} IS DISTINCT FROM text AS changed FROM ({_steps().replace('text AS t0', 'text, text AS t0')})")
def pii_gate_after_redaction(spark, sf_dir):
    """The gate as a pipeline has it: what the rules have left is looked at again, and a document in which anything stands is held back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("own"))
    done = redact.redact(docs, redact.LATIN)
    return done.select("doc_id", F.coalesce(redact.residual("text", redact.LATIN, ("email", "card")), F.lit(False)).alias("blocked"), (~F.col("text").eqNullSafe(F.col("own"))).alias("changed"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN false ELSE true END AS accepted, regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) || '-' || page_id || '.pdf' AS name FROM pages""")
def upload_checks(spark, sf_dir):
    """Pages as uploaded files: their name, in which a control character stands, and whether they begin as they must."""
    pages = table(spark, sf_dir, "pages")
    name = F.concat(F.regexp_replace("url", "/+$", ""), F.lit("-\t"), F.col("page_id"), F.lit("\x7f.pdf"))
    content = F.encode(F.concat(F.when(F.col("page_id") % 4 == 0, "%pdf-").otherwise("%PDF-"), F.coalesce("html", F.lit(""))), "UTF-8")
    return pages.select("page_id", feeds.acceptable_pdf(content).alias("accepted"), feeds.file_name(name).alias("name"))


@query("""WITH u AS (SELECT o_orderkey, o_custkey % 5 AS own, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey - 1 END AS before FROM orders)
SELECT u.o_orderkey, CASE WHEN u.before IS NULL THEN 'NEW' WHEN p.own = u.own THEN 'CONTINUES' ELSE 'PREVIOUS_NOT_FOUND' END AS lineage FROM u LEFT JOIN u p ON u.before = p.o_orderkey""")
def upload_lineage(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("contract_id"), (F.col("o_custkey") % 5).alias("user_id"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise((F.col("o_orderkey") - 1).cast("string")).alias("previous_contract_id"))
    return feeds.continued(rows, rows).select(F.col("contract_id").alias("o_orderkey"), "lineage")


@query("""WITH RECURSIVE c AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 100 AS DOUBLE) / 8 END AS offered, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, event_id, n, true AS fetched, CASE WHEN offered IS NULL THEN 'ASSUMPTION' ELSE 'FETCHED' END AS source, coalesce(offered, 2.5) AS percent, offered AS good, t + CASE WHEN offered IS NULL THEN 3600000000 ELSE 86400000000 END AS expires FROM c WHERE n = 1
UNION ALL SELECT c.user_id, c.event_id, c.n, s.expires <= c.t, CASE WHEN s.expires > c.t THEN s.source WHEN c.offered IS NOT NULL THEN 'FETCHED' WHEN s.good IS NOT NULL THEN 'LAST_GOOD' ELSE 'ASSUMPTION' END,
  CASE WHEN s.expires > c.t THEN s.percent ELSE coalesce(c.offered, s.good, 2.5) END, CASE WHEN s.expires > c.t THEN s.good ELSE coalesce(c.offered, s.good) END,
  CASE WHEN s.expires > c.t THEN s.expires WHEN c.offered IS NULL THEN c.t + 3600000000 ELSE c.t + 86400000000 END FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1)
SELECT event_id, fetched, source, percent FROM s""")
def index_lookups(spark, sf_dir):
    """Each event as a reader's call for the index; every third would find the publisher at work."""
    offered = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 100).cast("double") / 8)
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), offered.alias("percent"))
    return indices.served(calls).select(F.col("seq").alias("event_id"), "fetched", "source", "percent")
