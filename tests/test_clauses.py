"""Profiles, facts, references, links and protections on a small agreement of our own."""

import pytest
from pyspark.sql import functions as F

from clauseframe.lexicon import hebrew as H
from clauseframe.plans import clauses as C
from clauseframe.plans import links, rules

TEXTS = [
    ("C001", "1", "דמי שכירות", "דמי שכירות\nדמי השכירות החודשיים יהיו 6,000 ש״ח לחודש. דמי השכירות צמודים למדד המחירים."),
    ("C002", "2", "תקופה", "תקופה\nתקופת השכירות היא שנים עשר חודשים."),
    ("C003", "3", "בטוחות", "בטוחות\nהשוכר ימסור ערבות בנקאית בסך 30,000 ש״ח. הערבות תוחזר בתוך 60 ימים."),
    ("C004", "4", None, "על אף האמור בסעיף 3, המשכיר רשאי לממש את הערבות. ליקוי דחוף יתוקן בתוך שבעה ימים וליקוי אחר בתוך 45 ימים."),
    ("C005", "5", None, "לפי סעיף 25י לחוק השכירות ובכפוף לסעיף 2.1 תינתן אופציה. בתקופת האופציה דמי השכירות יהיו 7,500 ש״ח ויעלו ב-4%."),
]


@pytest.fixture(scope="module")
def agreement(spark):
    rows = [(1, i, c, t, s, h) for i, (c, s, h, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "contract_id int, ord int, clause_id string, text string, section_label string, heading string").cache()


def test_sentences_keep_the_heading_apart(agreement):
    got = C.with_sentences(agreement).where("clause_id = 'C001'").orderBy("s_ord").collect()
    assert [r.sentence for r in got] == ["דמי שכירות", "דמי השכירות החודשיים יהיו 6,000 ש״ח לחודש.", "דמי השכירות צמודים למדד המחירים."]


def test_facts_find_their_subject(agreement):
    facts = {(r.clause_id, r.fact): r.value for r in C.sentence_facts(C.with_sentences(agreement)).collect()}
    assert facts[("C001", "MONTHLY_RENT")] == 6000.0 and facts[("C002", "LEASE_TERM_MONTHS")] == 12.0
    assert facts[("C003", "SECURITY_AMOUNT")] == 30000.0 and facts[("C003", "SECURITY_RETURN_DAYS")] == 60.0
    assert facts[("C004", "URGENT_REPAIR_DAYS")] == 7.0 and facts[("C004", "REPAIR_DAYS")] == 45.0
    assert facts[("C005", "OPTION_RENT")] == 7500.0 and facts[("C005", "RENT_INCREASE_PERCENT")] == 4.0
    first = {r.fact: (r.clause_id, r.value) for r in C.contract_facts(C.sentence_facts(C.with_sentences(agreement))).collect()}
    assert first["MONTHLY_RENT"] == ("C001", 6000.0) and first["SECURITY_AMOUNT"] == ("C003", 30000.0)


def test_number_words(spark):
    values = {"שנים עשר": 12, "ארבעים וחמישה": 45, "מאה ועשרים": 120, "שבעה": 7, "שבעה כלבים": None}
    df = spark.createDataFrame([(k,) for k in values], "p string").withColumn("v", C.number_word_value(F.col("p")))
    assert {r.p: r.v for r in df.collect()} == values


def test_references(agreement):
    got = {(r.clause_id, r.label, r.kind) for r in C.references(C.with_sentences(agreement), agreement).collect()}
    assert got == {("C004", "3", "NOTWITHSTANDING"), ("C005", "2.1", "SUBJECT_TO")}
    to = {(r.clause_id, r.target) for r in C.resolved(C.references(C.with_sentences(agreement), agreement), agreement).collect()}
    assert to == {("C004", "C003"), ("C005", "C002")}


def test_concepts(agreement):
    _, headings, primary = C.profile_concepts(agreement)
    about = {(r.clause_id, r.concept) for r in primary.collect()}
    assert {("C001", "RENT"), ("C002", "TERM"), ("C003", "SECURITY"), ("C004", "REPAIRS")} <= about
    assert {(r.clause_id, r.concept) for r in headings.collect()} >= {("C001", "RENT"), ("C003", "SECURITY")}


def test_links(agreement):
    got = {(r.clause_id, r.target): r for r in links.link_clauses(agreement).collect()}
    assert got[("C004", "C003")].relation == "OVERRIDES" and got[("C003", "C004")].relation == "OVERRIDDEN_BY"
    assert got[("C003", "C001")].relation == "DEFINES_VALUE" and got[("C003", "C002")].relation == "DEFINES_VALUE"
    assert got[("C005", "C002")].relation == "REFERENCES" and got[("C002", "C005")].relation == "REFERENCED_BY"
    assert all(0 < r.score <= 1 and len(r.excerpt) <= 900 for r in got.values())
    per = {}
    for r in got.values():
        per.setdefault(r.clause_id, []).append(r)
    for rows in per.values():
        explicit = [r for r in rows if r.relation in links.EXPLICIT]
        assert len(explicit) <= 6 and len(rows) <= max(4, len(explicit)) and sum(len(r.excerpt) for r in rows) <= 2500
        assert sorted(r.rank for r in rows) == list(range(1, len(rows) + 1))


def test_fold_raises_the_stronger(spark):
    rows = [(1, "a", "b", 1, [0], "REFERENCES", 0.9, "short"), (1, "a", "b", 3, [0], "RELATED_TOPIC", 0.6, "a longer one"), (1, "a", "b", 0, [0], "SAME_SECTION", 1.0, "x"), (1, "a", "c", 4, [0], "RELATED_TOPIC", 0.55, "y")]
    df = spark.createDataFrame(rows, "contract_id int, clause_id string, target string, step int, sub array<int>, relation string, score double, excerpt string")
    got = {r.target: (r.relation, round(r.score, 2), r.excerpt) for r in links.folded(df).collect()}
    assert got == {"b": ("SAME_SECTION", 1.0, "a longer one"), "c": ("RELATED_TOPIC", 0.55, "y")}


def test_protections(agreement):
    items = [rules.Item(*p) for p in H.PROTECTIONS]
    got = {r.item: (r.status, r.parts) for r in rules.checklist(agreement.select("contract_id", "clause_id", "text"), items, "contract_id", "text", "clause_id").collect()}
    assert got["RR-REC-SECURITY-RETURN"][0] == "PARTIAL" and got["RR-REC-RENEWAL-TERMS"] == ("COVERED", ["C005"]) and got["RR-REC-WEAR-AND-TEAR"] == ("MISSING", []) and len(got) == 8
    assert got["RR-REC-REPAIR-TIMELINE"] == ("PARTIAL", ["C004"])


STATED = {
    "RR-REC-EARLY-TERMINATION": ("לשוכר הזכות לסיום מוקדם בהודעה של חודשיים", "המשכיר רשאי לדרוש סיום מוקדם", "COVERED", "PARTIAL"),
    "RR-REC-WEAR-AND-TEAR": ("השוכר אינו נושא בעלות בלאי סביר", "השוכר יתקן כל נזק", "COVERED", "PARTIAL"),
    "RR-REC-REPAIR-TIMELINE": ("בתוך 48 שעות יטפל המשכיר בכל תקלה דחופה", "תקלה דחופה תטופל. שלושה ימים אחר כך יבוא שמאי", "COVERED", "PARTIAL"),
    "RR-REC-SECURITY-RETURN": ("השבת הפיקדון תיעשה בתוך שלושים ימים", "השוכר יפקיד פיקדון. המפתח יוחזר", "COVERED", "PARTIAL"),
    "RR-REC-ENTRY-NOTICE": ("בתיאום עם השוכר רשאי המשכיר להיכנס לדירה", "המשכיר רשאי להיכנס לדירה ללא תיאום", "COVERED", "PARTIAL"),
    "RR-REC-CHARGES-ALLOCATION": ("חשמל, גז וארנונה יחולו על השוכר", "תשלומים שוטפים יחולו על השוכר", "COVERED", "PARTIAL"),
    "RR-REC-HANDOVER-CONDITION": ("מצב הדירה יתועד בצילומים", "מצב הדירה ידוע לשוכר", "COVERED", "PARTIAL"),
    "RR-REC-RENEWAL-TERMS": ("דמי השכירות באופציה יהיו 5,000", "לשוכר אופציה לשנה. דמי השכירות ישולמו מראש", "COVERED", "PARTIAL"),
}


def test_each_protection_needs_its_parts_in_one_sentence(spark):
    assert set(STATED) == {p[0] for p in H.PROTECTIONS}
    rows = [(i, item, text) for item, (yes, no, *_) in STATED.items() for i, text in ((1, yes), (2, no), (3, "הצדדים חתמו ביום שמש"))]
    frame = spark.createDataFrame([(f"{item}/{i}", text) for i, item, text in rows], "key string, text string").selectExpr("key", "text", "0 AS ord")
    got = {(r.key, r.item): r.status for r in rules.checklist(frame, [rules.Item(*p) for p in H.PROTECTIONS], "key").collect()}
    for item, (_, _, *want) in STATED.items():
        assert [got[f"{item}/{i}", item] for i in (1, 2, 3)] == [*want, "MISSING"], item


def test_owners_take_their_sample_sentences(spark):
    samples = [("נזילה בתקרה תטופל בתוך ארבעה ימים", {"REPAIR_DAYS": 4.0}), ("קלקול בדוד יתוקן בתוך שבוע", {"REPAIR_DAYS": 7.0}), ("השוכר יודיע שלושים יום קודם", {}), ("שוכר שאיחר בשבעה ימים ישלם 200 ש\"ח", {}), ("שכר המתווך 3,000 ש\"ח", {}), ("דמי השכירות 4,000 ש\"ח לחודש ושכר המתווך 3,000 ש\"ח", {"MONTHLY_RENT": 4000.0})]
    frame = spark.createDataFrame([(i, "C1", 0, t, None, None) for i, (t, _) in enumerate(samples)], "contract_id int, clause_id string, ord int, text string, section_label string, heading string")
    got = {}
    for r in C.sentence_facts(C.with_sentences(frame)).collect():
        got.setdefault(r.contract_id, {})[r.fact] = r.value
    for i, (text, want) in enumerate(samples):
        assert got.get(i, {}) == want, text


MUST = {
    "RENT": ("דמי השכירות ישולמו מדי חודש", "השבחת הדירה"), "TERM": ("משך השכירות שנה", "התקופה האחרונה"), "SECURITY": ("השוכר יפקיד פיקדון", "הצדדים ערבים זה לזה"), "GUARANTOR": ("שני ערבים יחתמו", "בשעות הערב"),
    "INDEXATION": ("הסכום יוצמד למדד", "הצימוד הלשוני"), "RENT_INCREASE": ("שכר הדירה יעלה", "מעלית הבניין"), "OPTION": ("לשוכר אופציה", "האופק פתוח"), "URGENT_REPAIR": ("תקלה דחופה תטופל", "דואר דחוף"), "REPAIRS": ("תחזוקת הדוד", "תקנון הבית"),
    "SELF_REPAIR": ("יזמין בעל מקצוע", "בעל הדירה"), "ENTRY": ("המשכיר רשאי להיכנס לדירה", "הכנסות לדירה"), "EARLY_TERMINATION": ("סיום מוקדם של החוזה", "סיום התקופה"), "REPLACEMENT_TENANT": ("יציע דייר חלופי", "חלקי חילוף"), "BREACH": ("הפרת החוזה", "הפרחים בגינה"),
    "VACATING": ("פינוי המושכר", "פינה שקטה"), "PENALTY": ("קנס של מאה שקלים", "כנס השוכרים"), "CHARGES": ("ארנונה ומים", "ימים נוספים"), "INSURANCE": ("פוליסה בתוקף", "בטוח ויציב"), "HANDOVER": ("פרוטוקול מסירה ייחתם", "מסירות הצדדים"), "WAIVER": ("השוכר מוותר", "לא נותר דבר"),
    "PETS": ("אין להכניס חתולים", "כלבבי"), "SUBLET": ("שכירות משנה אסורה", "משנה זהירות"), "SALE_TRANSFER": ("במקרה של מכירת הדירה", "מכירת רהיטים"), "ALTERATIONS": ("שיפוצים באישור בלבד", "שופט בית המשפט"),
}


def test_each_concept_takes_its_sentence_and_leaves_another(spark):
    assert set(MUST) == set(H.CONCEPTS)
    for concept, (yes, no) in MUST.items():
        r = spark.createDataFrame([(yes, no)], "yes string, no string").select(F.rlike("yes", F.lit(H.CONCEPTS[concept])), F.rlike("no", F.lit(H.CONCEPTS[concept]))).first()
        assert tuple(r) == (True, False), concept


def test_each_rule_takes_its_sentence_and_leaves_another(spark):
    from clauseframe.lexicon import money as M
    from clauseframe.lexicon import verdicts as V

    told = [
        (V.PETS_BARRED, "אין להחזיק בדירה כלבים", "מותר להחזיק כלב"), (V.UNFURNISHED, "הדירה אינה מרוהטת", "הדירה מרוהטת"), (V.RENT_INDEXED, "שכר הדירה יהיה צמוד למדד", "הערבות צמודה. דמי השכירות קבועים"),
        (V.NO_RENEWAL, "לא תינתן אופציה לשוכר", "תינתן אופציה לשוכר"), (V.SUBLET_BARRED, "השוכר אינו רשאי להכניס דיירים נוספים", "השוכר רשאי להכניס שותף"), (V.WAIVES_ALL, "השוכר מוותר על כל טענה", "השוכר מוותר על החניה"),
        (V.REALIZES, "המשכיר רשאי לחלט את הפיקדון", "הפיקדון יוחזר"), (V.NO_NOTICE, "ללא כל הודעה", "ללא עיכוב לאחר שתימסר לו ולכל הצדדים האחרים הודעה"), (V.OWNER_CHARGES, "ביטוח המבנה יחול על השוכר", "ביטוח המבנה יחול על המשכיר"),
        (V.NO_REFUND, "השוכר לא יהיה זכאי להחזר", "השוכר יהיה זכאי להחזר"), (V.SHIFTS_BURDEN, "התיקון על חשבון השוכר", "התיקון על חשבון המשכיר"), (V.TENANT_MAY_END, "כל צד רשאי לסיים", "המשכיר רשאי לסיים"),
        (V.NO_TENANT_RIGHT, "לשוכר לא תהיה זכות לעזוב", "לשוכר תהיה זכות לעזוב"), (V.REPLACEMENT_REQUIRED, "בתנאי שיביא שוכר חלופי", "שוכר חלופי אינו נדרש"), (V.PAYS_TO_END, "ישלם את שכר הדירה עד סוף התקופה", "ישלם את שכר הדירה בכל חודש"),
        (V.FIXED_MONTHS, "פיצוי של שני חודשי שכירות", "תקופה של שני חודשים"), (M.START, "החל מיום 1.9.2026", "ביום השבת"), (M.LANDLORD_PAYS, "המשכיר יישא בהוצאה", "השוכר יישא בהוצאה"), (M.TENANT_PAYS, "המים יחולו על השוכר", "המים יחולו על המשכיר"),
        (M.FLOOR, "ולא יפחתו מהבסיס", "ויפחתו"), (M.LATE_VACATING, "בגין איחור בפינוי", "בגין איחור בתשלום"), (M.LATE_PAYMENT, "איחור בתשלום יחויב", "התשלום הבא"), (M.MULTIPLE, "פי שניים מדמי השכירות היומיים", "פי התהום"),
        (H.RETURN_VERB, "הערובה תוחזר", "הערובה תחולט"), (H.PREPAYMENT_MARKER, "עבור שלושה חודשים", "בסוף החודש"), (H.REFERENCE, "כאמור בסעיפים 3, 4.1 ו-5", "סעיף 5 לחוק השכירות"),
    ]
    for pattern, yes, no in told:
        r = spark.createDataFrame([(yes, no)], "yes string, no string").select(F.rlike("yes", F.lit(pattern)), F.rlike("no", F.lit(pattern))).first()
        assert tuple(r) == (True, False), (pattern, yes, no)
