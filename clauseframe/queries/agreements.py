"""The agreement plans over one agreement for each customer, whose figures come from the customer's key.

The clauses are sentences of our own; what each must say follows from the key, so SQL can state it without reading the text.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..plans import analyses, comparison, links, metrics, rules, terms, verdicts
from ..plans import clauses as C
from ..registry import query, table
from ..session import dealt, settled

#: Figure -> expression over the key, in SQL that both engines read.
FIGURES = {
    "rent": "3000 + (c_custkey * 37) % 4000", "months": "6 + c_custkey % 30", "security": "10000 + (c_custkey * 911) % 30000", "days": "30 + c_custkey % 60", "urgent": "1 + c_custkey % 9", "charge": "100 + c_custkey % 300",
}
CLAUSES = (
    "דמי השכירות החודשיים יהיו {rent} ש״ח לחודש.",
    "תקופת השכירות היא {months} חודשים.",
    "השוכר ימסור ערבות בנקאית בסך {security} ש״ח. הערבות תוחזר בתוך {days} ימים.",
    "ליקוי דחוף יתוקן בתוך {urgent} ימים.",
    "על אף האמור בסעיף 3, המשכיר רשאי להיכנס לדירה בכל עת ללא תיאום.",
    "השוכר ישלם ארנונה בסך {charge} ש״ח לחודש.",
    "הצדדים ינהגו בתום לב.",
)
WISHES = {"max_rent": 5000.0}
KEYS = f"k AS (SELECT CAST(c_custkey AS BIGINT) AS contract_id, {', '.join(f'{e} AS {n}' for n, e in FIGURES.items())} FROM customer)"


def agreements(spark, sf_dir, figures=FIGURES, clauses=CLAUSES):
    """(contract_id, ord, clause_id, text, section_label, heading)."""
    keyed = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").cast("long").alias("contract_id"), *(F.expr(e).alias(n) for n, e in figures.items()))

    def filled(text):
        parts = []
        for piece in text.split("{"):
            name, _, rest = piece.partition("}") if "}" in piece else ("", "", piece)
            parts += [F.col(name).cast("string"), F.lit(rest)] if name else [F.lit(rest)]
        return F.concat(*parts)

    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f"C{i + 1:03d}").alias("clause_id"), filled(t).alias("text"), F.lit(str(i + 1)).alias("section_label"), F.lit(None).cast("string").alias("heading")) for i, t in enumerate(clauses)))
    return keyed.select("contract_id", F.explode(rows).alias("x")).select("contract_id", "x.*")


@query(f"""WITH {KEYS} SELECT contract_id, unnest(['C001', 'C002', 'C003', 'C003', 'C004']) AS clause_id, unnest(['MONTHLY_RENT', 'LEASE_TERM_MONTHS', 'SECURITY_AMOUNT', 'SECURITY_RETURN_DAYS', 'URGENT_REPAIR_DAYS']) AS fact,
  unnest([CAST(rent AS DOUBLE), CAST(months AS DOUBLE), CAST(security AS DOUBLE), CAST(days AS DOUBLE), CAST(urgent AS DOUBLE)]) AS value FROM k""")
def agreement_facts(spark, sf_dir):
    facts = C.contract_facts(C.sentence_facts(settled(C.with_sentences(agreements(spark, sf_dir)))))
    return facts.select("contract_id", "clause_id", "fact", "value")


@query(f"""WITH {KEYS} SELECT contract_id, unnest(['C001', 'C002', 'C003', 'C003', 'C004', 'C005', 'C006', 'C007']) AS clause_id, CAST(unnest([0, 0, 0, 1, 0, 0, 0, 0]) AS INTEGER) AS s_ord, CAST(unnest([5, 4, 7, 5, 6, 13, 7, 4]) AS INTEGER) AS n_words FROM (SELECT contract_id FROM k)""".replace("[5, 4, 7, 5, 6, 13, 7, 4]", str([len(s.split()) for c in CLAUSES for s in c.replace(". ", ".|").split("|")])))
def agreement_sentences(spark, sf_dir):
    from ..functions import text as T

    return C.with_sentences(agreements(spark, sf_dir)).select("contract_id", "clause_id", "s_ord", T.word_count("sentence").alias("n_words"))


@query(f"WITH {KEYS} SELECT contract_id, 'C005' AS clause_id, '3' AS label, 'NOTWITHSTANDING' AS kind, 'C003' AS target FROM k")
def agreement_references(spark, sf_dir):
    rows = agreements(spark, sf_dir)
    return C.resolved(C.references(C.with_sentences(rows), rows), rows).select("contract_id", "clause_id", "label", "kind", "target")


def _said(clause: int) -> str:
    """A clause's text as SQL over the figures."""
    return "'" + re.sub(r"\{(\w+)\}", r"' || \1 || '", CLAUSES[clause - 1]) + "'"


#: (clause, rank, target, relation, score): what clause 3 needs (its value is told by 1 and 2), what overrides it, and what a way into the home is read with.
LINKS = (
    (3, 1, 5, "OVERRIDDEN_BY", 0.97), (3, 2, 1, "DEFINES_VALUE", 0.85), (3, 3, 2, "DEFINES_VALUE", 0.85),
    (5, 1, 3, "OVERRIDES", 0.95), (5, 2, 4, "RELATED_TOPIC", 0.6),
)


@query(f"WITH {KEYS} " + " UNION ALL ".join(f"SELECT contract_id, 'C00{c}' AS clause_id, {n} AS rank, 'C00{t}' AS target, '{r}' AS relation, CAST({x} AS DOUBLE) AS score, {_said(t)} AS excerpt FROM k" for c, n, t, r, x in LINKS))
def agreement_links(spark, sf_dir):
    return links.link_clauses(agreements(spark, sf_dir))


CAP_SQL = "security > least(rent * months / 3.0, rent * 3)"
JUDGED_SQL = f"""j AS (SELECT contract_id, 'C001' AS clause_id, CASE WHEN rent > 5000 THEN 'ORANGE' ELSE 'OK' END AS severity, CASE WHEN rent > 5000 THEN 'BUDGET' END AS rule, rent, urgent FROM k
UNION ALL SELECT contract_id, 'C002', 'OK', NULL, rent, urgent FROM k
UNION ALL SELECT contract_id, 'C003', CASE WHEN {CAP_SQL} THEN 'RED' WHEN days > 60 THEN 'ORANGE' ELSE 'OK' END, CASE WHEN {CAP_SQL} THEN 'SECURITY_CAP' WHEN days > 60 THEN 'SECURITY_RETURN' END, rent, urgent FROM k
UNION ALL SELECT contract_id, 'C004', CASE WHEN urgent > 3 THEN 'RED' ELSE 'OK' END, CASE WHEN urgent > 3 THEN 'URGENT_REPAIR' END, rent, urgent FROM k
UNION ALL SELECT contract_id, 'C005', 'ORANGE', 'ENTRY', rent, urgent FROM k
UNION ALL SELECT contract_id, unnest(['C006', 'C007']), 'OK', NULL, rent, urgent FROM k)"""


@query(f"""WITH {KEYS}, {JUDGED_SQL} SELECT contract_id, clause_id, severity, rule,
  CASE WHEN rule IN ('SECURITY_CAP', 'SECURITY_RETURN') THEN 'guarantee_security' WHEN rule = 'URGENT_REPAIR' THEN 'repairs_maintenance' WHEN rule = 'BUDGET' THEN 'rent_and_term' WHEN rule = 'ENTRY' THEN 'entry_privacy' ELSE 'other' END AS topic,
  CASE WHEN severity = 'RED' THEN 'legal_violation' WHEN rule = 'BUDGET' THEN 'preference_conflict' WHEN rule IS NOT NULL THEN 'legal_risk' ELSE 'ok' END AS category FROM j""")
def agreement_verdicts(spark, sf_dir):
    rows = agreements(spark, sf_dir)
    return verdicts.verdicts(rows, links.link_clauses(rows), WISHES).select("contract_id", "clause_id", "severity", "rule", "topic", "category")


@query(f"""WITH {KEYS} SELECT contract_id, unnest(['rent', 'term', 'security_return_days', 'charge']) AS term, unnest(['', '', '', 'ARNONA']) AS kind, unnest([CAST(rent AS DOUBLE), CAST(months AS DOUBLE), CAST(days AS DOUBLE), CAST(charge AS DOUBLE)]) AS value FROM k""")
def agreement_terms(spark, sf_dir):
    return terms.extract(agreements(spark, sf_dir)).select("contract_id", "term", "kind", "value")


@query(f"""WITH {KEYS} SELECT contract_id, unnest(['RR-REC-EARLY-TERMINATION', 'RR-REC-WEAR-AND-TEAR', 'RR-REC-REPAIR-TIMELINE', 'RR-REC-SECURITY-RETURN', 'RR-REC-ENTRY-NOTICE', 'RR-REC-CHARGES-ALLOCATION', 'RR-REC-HANDOVER-CONDITION', 'RR-REC-RENEWAL-TERMS']) AS item,
  unnest(['MISSING', 'MISSING', CASE WHEN urgent = 3 THEN 'COVERED' ELSE 'PARTIAL' END, 'PARTIAL', 'PARTIAL', 'MISSING', 'MISSING', 'MISSING']) AS status FROM k""")
def agreement_protections(spark, sf_dir):
    from ..lexicon import hebrew as H

    found = rules.checklist(agreements(spark, sf_dir).select("contract_id", "clause_id", "text"), [rules.Item(*i) for i in H.PROTECTIONS], "contract_id", "text", "clause_id")
    return found.select("contract_id", "item", "status")


@query(f"""WITH {KEYS}, {JUDGED_SQL} SELECT contract_id, count(*) FILTER (severity = 'RED') AS red, count(*) FILTER (severity = 'ORANGE') AS orange, count(*) FILTER (severity = 'OK') AS ok,
  CAST(max(CASE WHEN urgent = 3 THEN 1 ELSE 0 END) AS BIGINT) AS covered, CAST(max(CASE WHEN urgent = 3 THEN 2 ELSE 3 END) AS BIGINT) AS partial, CAST(5 AS BIGINT) AS missing FROM j GROUP BY contract_id""")
def agreement_report(spark, sf_dir):
    return analyses.analyze(agreements(spark, sf_dir), WISHES).overview()


STATUS_SQL = """SELECT o_orderkey, CASE WHEN change = 'REMOVED' THEN CASE WHEN x > 0 THEN 'FIXED' ELSE 'UNREQUESTED_CHANGE' END WHEN change = 'ADDED' THEN CASE WHEN y > 0 THEN 'NEW_ISSUE' ELSE 'UNREQUESTED_CHANGE' END
  WHEN x > 0 AND y = 0 THEN 'FIXED' WHEN y > 0 AND x = 0 THEN 'NEW_ISSUE' WHEN x > 0 AND y > x THEN 'WORSENED' WHEN x > 0 AND y < x THEN 'IMPROVED' WHEN x > 0 THEN 'STILL_OPEN' WHEN change = 'UNCHANGED' THEN 'UNCHANGED' ELSE 'UNREQUESTED_CHANGE' END AS status
FROM (SELECT o_orderkey, ['UNCHANGED', 'MODIFIED', 'ADDED', 'REMOVED'][1 + CAST(o_orderkey % 4 AS INTEGER)] AS change, CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS x, CASE left(o_orderpriority, 1) WHEN '1' THEN 2 WHEN '2' THEN 1 ELSE 0 END AS y FROM orders)"""


@query(STATUS_SQL)
def comparison_statuses(spark, sf_dir):
    """Two analyses of one clause an order: each alignment row names what stands before and after it."""
    orders = table(spark, sf_dir, "orders").withColumn("change", F.element_at(F.array(*map(F.lit, ("UNCHANGED", "MODIFIED", "ADDED", "REMOVED"))), (1 + F.col("o_orderkey") % 4).cast("int")))
    none, own = F.array().cast("array<int>"), F.array(F.lit(0))
    rows = orders.select(F.col("o_orderkey").alias("pair_id"), F.when(F.col("change") == "ADDED", none).otherwise(own).alias("before"), F.when(F.col("change") == "REMOVED", none).otherwise(own).alias("after"), "change")
    mapped = lambda c, red, orange: F.when(c == red, "RED").when(c == orange, "ORANGE").otherwise("OK").alias("severity")
    before = orders.select(F.col("o_orderkey").alias("pair_id"), F.lit(0).alias("ord"), mapped(F.col("o_orderstatus"), "P", "O"))
    after = orders.select(F.col("o_orderkey").alias("pair_id"), F.lit(0).alias("ord"), mapped(F.substring("o_orderpriority", 1, 1), "1", "2"))
    return analyses.compare(rows, before, after).select(F.col("pair_id").alias("o_orderkey"), "status")


@query("""WITH g AS (SELECT *, CASE o_orderstatus WHEN 'P' THEN 'RED' WHEN 'O' THEN 'ORANGE' ELSE 'OK' END AS severity, CASE left(o_orderpriority, 1) WHEN '1' THEN 'RED' WHEN '2' THEN 'ORANGE' ELSE 'OK' END AS said FROM orders),
r AS (SELECT round(count(*) FILTER (severity = 'RED' AND said = 'RED') / CAST(count(*) FILTER (severity = 'RED') AS DOUBLE), 6) AS violation_recall,
  round(count(*) FILTER (said IN ('RED', 'ORANGE') AND said = severity) / CAST(count(*) FILTER (said IN ('RED', 'ORANGE')) AS DOUBLE), 6) AS warning_precision,
  round(count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0) / CAST(count(*) FILTER (o_orderkey % 3 = 0) AS DOUBLE), 6) AS protection_recall FROM g)
SELECT *, violation_recall >= 0.9 AND warning_precision >= 0.95 AND protection_recall >= 0.85 AS passed FROM r""")
def release_gate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("clause_id"), "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p"))
    told = lambda c, red, orange: F.when(F.col(c) == red, "RED").when(F.col(c) == orange, "ORANGE").otherwise("OK")
    side = lambda severity: orders.select("case_id", "clause_id", severity.alias("severity"), (severity == "RED").alias("violates"))
    items = orders.select("case_id", F.col("clause_id").alias("item"))
    reported = items.select("case_id", "item", F.when(F.col("item") % 5 == 0, "COVERED").otherwise("MISSING").alias("status"))
    return metrics.release_gate(side(told("o_orderstatus", "P", "O")), side(told("p", "1", "2")), items.where("item % 3 = 0"), reported)


#: The later version: the rent is raised, urgent repairs have three days, the way in is gone.
RAISE = 1500
LATER = FIGURES | {"rent": f"{FIGURES['rent']} + {RAISE}", "urgent": "3"}
LATER_CLAUSES = tuple(c for i, c in enumerate(CLAUSES) if i != 4)


@query(f"""WITH {KEYS}, v AS (SELECT *, rent + {RAISE} AS later, security > least(rent * months / 3.0, rent * 3) AS over_before, security > least((rent + {RAISE}) * months / 3.0, (rent + {RAISE}) * 3) AS over_after FROM k),
c AS (SELECT contract_id, '0' AS before, '0' AS after, 'MODIFIED' AS change, CASE WHEN rent > 5000 THEN 1 ELSE 0 END AS x, CASE WHEN later > 5000 THEN 1 ELSE 0 END AS y FROM v
UNION ALL SELECT contract_id, '1', '1', 'UNCHANGED', 0, 0 FROM v
UNION ALL SELECT contract_id, '2', '2', 'UNCHANGED', CASE WHEN over_before THEN 2 WHEN days > 60 THEN 1 ELSE 0 END, CASE WHEN over_after THEN 2 WHEN days > 60 THEN 1 ELSE 0 END FROM v
UNION ALL SELECT contract_id, '3', '3', CASE WHEN urgent = 3 THEN 'UNCHANGED' ELSE 'MODIFIED' END, CASE WHEN urgent > 3 THEN 2 ELSE 0 END, 0 FROM v
UNION ALL SELECT contract_id, '4', '', 'REMOVED', 1, 0 FROM v
UNION ALL SELECT contract_id, unnest(['5', '6']), unnest(['4', '5']), 'UNCHANGED', 0, 0 FROM v)
SELECT c.contract_id AS pair_id, before, after, change, CASE WHEN x > 0 AND y = 0 THEN 'FIXED' WHEN y > 0 AND x = 0 THEN 'NEW_ISSUE' WHEN y > x THEN 'WORSENED' WHEN y < x THEN 'IMPROVED' WHEN x > 0 THEN 'STILL_OPEN' WHEN change = 'UNCHANGED' THEN 'UNCHANGED' ELSE 'UNREQUESTED_CHANGE' END AS status,
  CAST(months * (rent + charge) AS DOUBLE) AS cost_before, CAST(months * (later + charge) AS DOUBLE) AS cost_after, CAST(1 + CASE WHEN urgent = 3 THEN 0 ELSE 1 END AS BIGINT) AS protections_changed FROM c JOIN v USING (contract_id)""")
def agreement_comparison(spark, sf_dir):
    """Two versions of each customer's agreement, analysed, aligned and compared in one plan, with what they cost and how many protections changed."""
    numbered = lambda rows, n: rows.withColumn("contract_id", 2 * F.col("contract_id") + n)
    both = numbered(agreements(spark, sf_dir), 0).unionByName(numbered(agreements(spark, sf_dir, LATER, LATER_CLAUSES), 1))
    key = F.col("c_custkey").cast("long")
    pairs = table(spark, sf_dir, "customer").select(key.alias("pair_id"), (2 * key).alias("before_id"), (2 * key + 1).alias("after_id"))
    found = comparison.compare_agreements(both, pairs, WISHES)
    changed = found.protections.groupBy("pair_id").agg(F.count_if(F.col("change") != "UNCHANGED").alias("protections_changed"))
    at = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.clauses.join(found.costs.hint("merge"), "pair_id").join(changed.hint("merge"), "pair_id").select("pair_id", at("before"), at("after"), "change", "status", "cost_before", "cost_after", "protections_changed")


#: A clause, and what a tenant with ``PARTICULAR`` wishes is told of it: severity and rule, or that it is fine.
RULED = (
    ("השוכר ימסור ערבות בנקאית בסך 40,000 ש״ח.", "RED", "SECURITY_CAP"), ("השוכר ימסור ערבות בנקאית בסך 12,000 ש״ח.", "OK", None),
    ("ליקוי דחוף יתוקן בתוך שבעה ימים.", "RED", "URGENT_REPAIR"), ("תקלה דחופה תתוקן בתוך 48 שעות.", "ORANGE", "REPAIR_TIME"), ("ליקוי דחוף יתוקן בתוך 24 שעות.", "OK", None),
    ("אסור להחזיק בדירה כלב או חתול.", "ORANGE", "PETS"), ("מותר להחזיק בדירה כלב או חתול.", "OK", None),
    ("דמי השכירות החודשיים יהיו 6,000 ש״ח לחודש.", "ORANGE", "BUDGET"), ("דמי השכירות החודשיים יהיו 4,500 ש״ח לחודש.", "OK", None),
    ("הדירה נמסרת כשהיא לא מרוהטת.", "ORANGE", "FURNITURE"), ("הדירה נמסרת כשהיא מרוהטת.", "OK", None),
    ("השוכר יפקיד פיקדון אצל המשכיר.", "ORANGE", "SECURITY_KIND"), ("השוכר יפקיד פיקדון או ימסור ערבות בנקאית.", "OK", None),
    ("דמי השכירות יעלו ב-5% בכל שנה.", "ORANGE", "INCREASE"), ("דמי השכירות יעלו ב-2% בכל שנה.", "OK", None),
    ("תקופת השכירות היא 18 חודשים.", "ORANGE", "LENGTH"), ("משך השכירות הוא שנה אחת.", "OK", None),
    ("דמי השכירות יהיו צמודים למדד.", "ORANGE", "INDEXATION"), ("דמי השכירות אינם צמודים למדד.", "OK", None),
    ("השוכר ישלם דמי תיווך.", "ORANGE", "BROKER_FEE"), ("המשכיר ישלם דמי תיווך.", "OK", None),
    ("אין לשוכר כל זכות לסיום מוקדם.", "ORANGE", "EARLY_EXIT"), ("השוכר רשאי לסיים בסיום מוקדם בהודעה של 60 ימים.", "OK", None),
    ("לא תינתן לשוכר אופציה.", "ORANGE", "RENEWAL"), ("תינתן לשוכר אופציה.", "OK", None),
    ("השוכר אינו רשאי להכניס שותפים לדירה.", "ORANGE", "ROOMMATES"), ("השוכר רשאי להכניס שותפים לדירה.", "OK", None),
    ("המשכיר רשאי להיכנס לדירה בהודעה מראש של 24 שעות.", "ORANGE", "ENTRY_NOTICE"), ("המשכיר רשאי להיכנס לדירה בהודעה מראש של 72 שעות.", "OK", None),
    ("השוכר מוותר על כל טענה.", "ORANGE", "WAIVER"), ("השוכר מוותר על החניה.", "OK", None),
    ("המשכיר רשאי לחלט את הערבות ללא הודעה.", "ORANGE", "REALIZATION"), ("המשכיר רשאי לחלט את הערבות לאחר הודעה.", "OK", None),
    ("המשכיר רשאי להיכנס לדירה בכל עת ללא תיאום.", "ORANGE", "ENTRY"), ("המשכיר רשאי להיכנס לדירה לאחר תיאום.", "OK", None),
    ("ביטוח המבנה יחול על השוכר.", "ORANGE", "OWNER_CHARGES"), ("ביטוח המבנה יחול על המשכיר.", "OK", None),
    ("הערבות תוחזר לשוכר בתוך 90 ימים.", "ORANGE", "SECURITY_RETURN"), ("הערבות תוחזר לשוכר בתוך 45 ימים.", "OK", None),
    ("השוכר לא יהיה זכאי להחזר בגין תיקון שביצע.", "ORANGE", "NO_REFUND"), ("השוכר יהיה זכאי להחזר בגין תיקון שביצע.", "OK", None),
    ("על אף האמור בסעיף 2, השוכר יישא בכל הוצאות המשכיר.", "ORANGE", "OVERRIDES"), ("בכפוף לסעיף 2, השוכר יישא בכל הוצאות המשכיר.", "OK", None),
)
PARTICULAR = {
    "pets": True, "max_rent": 5000.0, "furnished": True, "accepted_securities": ("BANK_GUARANTEE",), "max_increase": 3.0, "term": 12, "accepts_indexation": False, "accepts_broker_fee": False, "early_exit": True, "renewal": True,
    "roommates": True, "min_notice_hours": 48, "repair_hours": 24.0,
}
_RULED_SQL = ", ".join(f"({i}, '{severity}', {'NULL' if rule is None else repr(rule)})" for i, (_, severity, rule) in enumerate(RULED))


@query(f"""WITH s(n, severity, rule) AS (VALUES {_RULED_SQL}), k AS (SELECT CAST(c_custkey AS BIGINT) AS contract_id, severity, rule FROM customer JOIN s ON n = c_custkey % {len(RULED)})
SELECT contract_id, 'C1' AS clause_id, severity, rule FROM k UNION ALL SELECT contract_id, 'C2', CASE WHEN rule = 'OVERRIDES' THEN 'ORANGE' ELSE 'OK' END, CASE WHEN rule = 'OVERRIDES' THEN 'OVERRIDDEN' END FROM k UNION ALL SELECT contract_id, 'C3', 'OK', NULL FROM k""")
def agreement_rules(spark, sf_dir):
    """Every rule of the verdict chain on a clause that it concerns, and on one that nearly says the same, before the rent and the term."""
    texts = F.array(*(F.lit(t) for t, *_ in RULED))
    first = F.element_at(texts, (F.col("c_custkey") % len(RULED) + 1).cast("int"))
    parts = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f"C{i + 1}").alias("clause_id"), t.alias("text"), F.lit(str(i + 1)).alias("section_label"), F.lit(None).cast("string").alias("heading")) for i, t in enumerate((first, F.lit("דמי השכירות החודשיים יהיו 4,000 ש״ח לחודש."), F.lit("תקופת השכירות היא 12 חודשים.")))))
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").cast("long").alias("contract_id"), F.explode(parts).alias("x")).select("contract_id", "x.*")
    return verdicts.verdicts(rows, links.link_clauses(rows), PARTICULAR).select("contract_id", "clause_id", "severity", "rule")
