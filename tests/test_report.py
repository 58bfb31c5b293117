"""Reports and grounding on small inputs of our own."""

from clauseframe.plans import grounding, report


def test_report(spark):
    clauses = spark.createDataFrame([(1, f"C{i}", i, f"text {i}") for i in range(5)], "contract_id int, clause_id string, ord int, text string")
    rows = [("C0", "OK", "other", "medium"), ("C1", "ORANGE", "rent", "high"), ("C2", "RED", "security", "high"), ("C3", "ORANGE", "rent", "medium"), ("C4", "ORANGE", "other", "high")]
    v = spark.createDataFrame([(1, *r) for r in rows], "contract_id int, clause_id string, severity string, topic string, confidence string")
    found = report.findings(clauses, v).cache()
    got = {r.clause_id: (r.rank, r.peers, r.key) for r in found.collect()}
    assert got == {"C2": (1, [], True), "C1": (2, ["C3"], True), "C4": (3, [], True), "C3": (4, ["C1"], True), "C0": (5, [], False)}
    assert tuple(report.summary(found).first()) == (1, 1, 3, 1)
    protections = spark.createDataFrame([(1, "P1", "MISSING"), (1, "P2", "COVERED")], "contract_id int, item string, status string")
    issues = report.negotiation_issues(found, protections)
    assert [r.issue_id for r in issues.orderBy("rank").collect()] == ["F-C2", "F-C1", "F-C4", "F-C3", "P-P1"]
    flagged = spark.createDataFrame([(1, "F-C4")], "contract_id int, issue_id string")
    assert [r.issue_id for r in report.negotiation_issues(found, protections, flagged).where("priority").collect()] == ["F-C4"]
    cross = spark.createDataFrame([(1, "OVERRIDE", ["C2", "C1"], "ORANGE", 1, "a"), (1, "OVERRIDE", ["C1", "C2"], "RED", 2, "b")], "contract_id int, kind string, clause_ids array<string>, severity string, ord int, explanation string")
    assert [(r.severity, r.explanation) for r in report.across_clauses(cross).collect()] == [("RED", "b")]


def test_grounding(spark):
    kind = "id int, text string, requests array<struct<issue_id:string,law_refs:array<string>>>, issues array<struct<issue_id:string,section:string,refs:array<struct<id:string,section:string>>,strategy:string,request:string>>, known array<string>"
    issue = ("I1", "9", [("L1", "25י")], "CITE_LAW", "להפחית ל-18,000 ש״ח")
    good = "אבקש להפחית את הערובה ל-18,000 ש״ח בהתאם לסעיף 25י(א) לחוק ולסעיף 9.2 בחוזה, תודה רבה."
    rows = [
        (1, good, [("I1", ["L1"])], [issue], ["18,000"]),
        (2, "Please call www.x.org", [("I1", []), ("I1", ["L9"]), ("I2", [])], [issue], ["18,000"]),
        (3, good + " ועוד 7,777 לפי סעיף 3 [LANDLORD_NAME]", [], [issue], ["18,000"]),
    ]
    got = {r.id: set(r.problems) for r in grounding.draft_problems(spark.createDataFrame(rows, kind)).collect()}
    assert got[1] == set()
    assert got[2] == {"ISSUE_TWICE", "ISSUE_NOT_RAISED", "FOREIGN_REFERENCE", "UNCITED", "FIGURE_DROPPED", "NOT_HEBREW", "TOO_SHORT", "LINK"}
    assert got[3] == {"ISSUE_LEFT_OUT", "LAW_WITHOUT_CITATION", "PLACEHOLDER", "UNKNOWN_SECTION", "LOOSE_NUMBER"}
    s = [("RED", False, True, "CITE_LAW", "בקשה", False), ("RED", True, True, "CONCEDE", None, False), ("ORANGE", True, True, "PROPOSE_ALTERNATIVE", "x", False), ("RED", True, False, "CONCEDE", None, True)]
    told = grounding.strategy_problems(spark.createDataFrame(s, "severity string, has_reference boolean, prioritised boolean, kind string, request string, confirmed boolean"))
    assert [r.problems for r in told.collect()] == [["NO_REFERENCE"], ["CONFIRMATION_NEEDED"], ["NO_REQUEST"], ["NOT_A_PRIORITY"]]


def test_spans_are_resolved_and_masked(spark):
    from clauseframe.plans import redact

    spans = [(0, 4, "[A]", 0.9), (0, 6, "[B]", 0.9), (5, 8, "[C]", 0.9), (6, 9, "[D]", 0.9), (9, 9, "[E]", 0.9), (10, 12, None, 0.9), (10, 12, "[F]", 0.1), (11, 99, "[G]", 0.9), (12, 13, "[H]", 0.5)]
    rows = [(1, "0123456789abcdef", spans), (2, "nothing", []), (3, None, spans), (4, "no list", None)]
    df = spark.createDataFrame(rows, "id int, text string, spans array<struct<start:int,end:int,mark:string,score:double>>")
    got = {r.id: (r.text, r.masked) for r in redact.mask_spans(df, "spans", 0.5).collect()}
    assert got == {1: ("[B][D]9ab[H]def", 3), 2: ("nothing", 0), 3: (None, 0), 4: ("no list", 0)}


def test_similar_by_vector_where_both_have_one(spark):
    from clauseframe.plans import links

    clauses = spark.createDataFrame([(1, c, t) for c, t in (("a", "alpha beta gamma"), ("b", "alpha beta gamma"), ("c", "delta"), ("d", "delta"), ("e", "epsilon"))], "contract_id int, clause_id string, text string")
    words = {(r.part_a, r.part_b) for r in links.similar(clauses, None).collect()}
    assert words == {("a", "b"), ("c", "d")}
    vectors = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0]), (1, "e", [0.9, 0.1]), (1, "c", None)], "contract_id int, clause_id string, vector array<double>")
    assert {(r.part_a, r.part_b) for r in links.similar(clauses, vectors).collect()} == {("a", "e"), ("c", "d")}


def test_release_gate_without_cases(spark):
    from clauseframe.plans import metrics

    found = spark.createDataFrame([], "case_id int, clause_id string, severity string, violates boolean")
    r = metrics.release_gate(found, found, spark.createDataFrame([], "case_id int, item string"), spark.createDataFrame([], "case_id int, item string, status string")).first()
    assert tuple(r) == (0.0, 0.0, 1.0, False)
