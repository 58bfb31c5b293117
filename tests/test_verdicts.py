"""Verdict rules and early-exit terms on sentences of our own."""

from clauseframe.plans import clauses as C
from clauseframe.plans import links, verdicts

SCHEMA = "contract_id int, ord int, clause_id string, text string, section_label string, heading string"


def agreement(spark, *texts, contract=1):
    return [(contract, i, f"C{i + 1:03d}", t, str(i + 1), None) for i, t in enumerate(texts)]


def test_verdicts(spark):
    rows = agreement(
        spark,
        "דמי השכירות החודשיים יהיו 6,000 ש״ח לחודש והם צמודים למדד.",
        "תקופת השכירות היא 12 חודשים.",
        "להבטחת התחייבויותיו ימסור השוכר ערבות בנקאית בסך 30,000 ש״ח.",
        "אסור להחזיק בדירה כלב או חתול.",
        "ליקוי דחוף יתוקן בתוך שבעה ימים.",
        "המשכיר רשאי להיכנס לדירה בכל עת ללא תיאום.",
        "על אף האמור בסעיף 6, השוכר יישא בכל הוצאות המשכיר.",
        "הצדדים ינהגו בתום לב.",
    )
    clauses = spark.createDataFrame(rows, SCHEMA).cache()
    graph = links.link_clauses(clauses).cache()
    got = {r.clause_id: r for r in verdicts.verdicts(clauses, graph, {"pets": True, "max_rent": 5000.0, "term": 24, "accepts_indexation": False}).collect()}
    told = {c: (r.severity, r.rule, r.topic) for c, r in got.items()}
    assert told["C001"] == ("ORANGE", "INDEXATION", "rent_and_term") and told["C002"] == ("ORANGE", "LENGTH", "rent_and_term")
    assert told["C003"] == ("RED", "SECURITY_CAP", "guarantee_security") and told["C004"] == ("ORANGE", "PETS", "pets_and_use")
    assert told["C005"] == ("RED", "URGENT_REPAIR", "repairs_maintenance") and told["C006"] == ("ORANGE", "OVERRIDDEN", "entry_privacy")
    assert told["C007"] == ("ORANGE", "OVERRIDES", "other") and told["C008"] == ("OK", None, "other")
    assert got["C003"].category == "legal_violation" and got["C004"].category == "preference_conflict" and got["C006"].category == "legal_risk"
    calm = {r.clause_id: r.severity for r in verdicts.verdicts(clauses, graph, {}).collect()}
    assert calm["C001"] == calm["C002"] == calm["C004"] == "OK" and calm["C003"] == "RED"


def test_exit_terms(spark):
    texts = {
        "UNTIL_END": "במקרה של סיום מוקדם השוכר ישלם את דמי השכירות עד תום התקופה.",
        "FIXED_MONTHS": "בגין סיום מוקדם ישלם השוכר פיצוי של 3 חודשי שכירות.",
        "FIXED_AMOUNT": "סיום מוקדם יחייב פיצוי בסך 4,000 ש״ח.",
        "UNTIL_REPLACEMENT": "השוכר רשאי לסיים בסיום מוקדם ובלבד שיעמיד שוכר חלופי.",
        "ALLOWED_WITH_NOTICE": "המשכיר בהודעה של 90 ימים והשוכר רשאי לסיום מוקדם בהודעה של 60 ימים. ",
        "NOT_ALLOWED": "אין לשוכר כל זכות לסיום מוקדם.",
    }
    rows = [(i, 0, "C001", t, None, None) for i, t in enumerate(texts.values())]
    clauses = spark.createDataFrame(rows, SCHEMA)
    got = {r.contract_id: r for r in verdicts.exit_terms(C.with_sentences(clauses)).collect()}
    for i, kind in enumerate(texts):
        if kind != "ALLOWED_WITH_NOTICE":
            assert got[i].kind == kind, kind
    assert got[1].months == 3 and got[2].amount == 4000.0 and got[4].notice_days == 60.0
    both = spark.createDataFrame([(1, 0, "C001", texts["NOT_ALLOWED"], None, None), (1, 1, "C002", texts["UNTIL_END"], None, None)], SCHEMA)
    r = verdicts.agreement_exit(verdicts.exit_terms(C.with_sentences(both))).first()
    assert (r.kind, r.clause_id, r.conflict) == ("UNTIL_END", "C002", True)
