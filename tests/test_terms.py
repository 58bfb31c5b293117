"""Money terms, their merge and the projection that starts from them, on an agreement of our own."""

from clauseframe.plans import schedule, terms

SCHEMA = "contract_id int, ord int, clause_id string, text string, section_label string, heading string"
TEXTS = [
    "תקופת השכירות היא 12 חודשים החל מיום 1 בספטמבר 2026.",
    "דמי השכירות החודשיים יהיו 6,000 ש״ח לחודש. דמי השכירות צמודים למדד המחירים ויעודכנו אחת לשנה ולא יפחתו.",
    "השוכר ישלם ארנונה בסך 250 ש״ח לחודש. השוכר ישלם מים וחשמל. ביטוח המבנה על חשבון המשכיר.",
    "השוכר ישלם דמי תיווך בסך 3,000 ש״ח. בסיום ישלם השוכר ניקיון בסך 400 ש״ח.",
    "בגין איחור בפינוי הדירה ישלם השוכר 400 ש״ח לכל יום. על איחור בתשלום תחול ריבית פיגורים של 18% לשנה.",
    "אין לשוכר כל זכות לסיום מוקדם.",
]


def test_terms(spark):
    clauses = spark.createDataFrame([(1, i, f"C{i + 1:03d}", t, str(i + 1), None) for i, t in enumerate(TEXTS)], SCHEMA).cache()
    read = terms.extract(clauses).cache()
    got = {(r.term, r.kind): r for r in read.collect()}
    assert got[("start", "")].note == "2026-09-01" and got[("rent", "")].value == 6000.0 and got[("term", "")].value == 12.0
    assert (got[("indexation", "")].note, got[("indexation", "")].value) == ("ANNUAL", 1.0)
    assert (got[("charge", "ARNONA")].value, got[("charge", "ARNONA")].note) == (250.0, "TENANT") and got[("charge", "WATER")].value is None and got[("charge", "BUILDING_INSURANCE")].note == "LANDLORD"
    assert (got[("one_time", "BROKER_FEE")].value, got[("one_time", "CLEANING")].value, got[("one_time", "CLEANING")].note) == (3000.0, 400.0, "END")
    assert got[("late_vacating", "")].value == 400.0 and got[("late_payment", "")].other == 1.5 and got[("exit", "")].note == "NOT_ALLOWED"
    notes = terms.unknowns(read, clauses).first().notes
    assert notes == ["UNPRICED_ELECTRICITY", "UNPRICED_WATER"]

    months = schedule.schedule(terms.schedule_inputs(read), "contract_id")
    total = schedule.totals(months, "contract_id").first()
    assert (total.base, total.charges_due, total.one_time, total.total) == (72000.0, 3000.0, 3400.0, 78400.0) and months.where("month = 1").first().period == "2026-09"

    model = read.where("term IN ('rent', 'term')").withColumn("value", read.value + 500)
    assert {r.term: r.verified for r in terms.verified(model, clauses).collect()} == {"rent": False, "term": False}
    checked = terms.verified(read.where("term = 'rent'"), clauses)
    assert checked.first().verified is True
    kept = {r.term: (r.value, r.origin, r.conflict) for r in terms.merged(read, terms.verified(model, clauses)).where("kind = ''").collect()}
    assert kept["rent"] == (6000.0, "RULE", False)
    other = checked.withColumn("value", checked.value + 1)
    assert {r.term: (r.value, r.origin, r.conflict) for r in terms.merged(read, other).collect()}["rent"] == (6001.0, "MODEL", True)
