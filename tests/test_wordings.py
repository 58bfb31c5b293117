"""What follows from a clause's words is read once for each wording, and the same as clause by clause."""

import itertools
import random

from pyspark.sql import functions as F

from clauseframe.operators import streams
from clauseframe.plans import analyses, assignment, mentions, rules
from clauseframe.plans import clauses as C
from clauseframe.queries.agreements import WISHES, agreements

KIND = "contract_id long, ord int, clause_id string, text string, section_label string, heading string"
TEXTS = [
    ("דמי השכירות החודשיים יהיו 4,000 ש״ח לחודש.", None), ("דמי השכירות החודשיים יהיו 4,000 ש״ח לחודש.", ""), ("ערבות\nהשוכר ימסור ערבות בנקאית בסך 20,000 ש״ח. הערבות תוחזר בתוך 70 ימים.", "ערבות"),
    ("על אף האמור בסעיף 2, המשכיר רשאי להיכנס לדירה בכל עת ללא תיאום.", None), ("", None), (None, None), (None, "x"), ("אין לשוכר זכות לסיום מוקדם.", None), ("ליקוי דחוף יתוקן בתוך 9 ימים.", None),
]


def frame(spark):
    rows = [(k, i, f"C{i}", t, str(i), h) for k in range(6) for i, (t, h) in enumerate(TEXTS[k % 3 :])]
    return spark.createDataFrame([*rows, (9, 0, "C0", TEXTS[0][0], "1", None), (9, 1, "C1", "טלפון 052-1234567", "2", None)], KIND)


def test_wordings_are_read_as_clauses_are(spark):
    df = frame(spark)
    read = C.read(df)
    assert C.worded(df)[1].count() == len(TEXTS) + 1 and read.count() == df.count()
    plain = lambda d: sorted(map(str, d.collect()))
    names = [*C.KEY, "ord", "counts", "heads", "primary"]
    assert plain(read.select(names)) == plain(C.profiled(df).select(names))
    said = ["contract_id", "clause_id", "ord", "s_ord", "sentence", "numbers", "facts", "refs"]
    got, want = (plain(C.with_references(C.with_facts(C.with_sentences(d))).select(said)) for d in (read, df))
    assert got == want and len(got) > 30


def test_an_analysis_reads_each_wording_once(spark, sf, monkeypatch):
    seen, scan = [], mentions.tallied
    monkeypatch.setattr(mentions, "tallied", lambda df, *more: seen.append(df.count()) or scan(df, *more))
    rows = agreements(spark, sf)
    twice = rows.unionByName(rows.withColumn("contract_id", F.col("contract_id") + 1_000_000))
    assert analyses.analyze(twice, WISHES).overview().count() == 2 * rows.select("contract_id").distinct().count()
    assert seen == [rows.select("text").distinct().count()]


def test_an_analysis_keeps_what_it_kept(spark):
    done = analyses.analyze(frame(spark), WISHES)
    held = {tuple(r) for r in done.quarantined.select("contract_id", "clause_id").collect()}
    kept = {(r.contract_id, r.clause_id) for r in done.clauses.collect()}
    assert not held and (9, "C1") in kept  # what is masked does not remain
    assert {r.text for r in done.clauses.where("contract_id = 9 AND clause_id = 'C1'").collect()} == {"טלפון [PHONE_NUMBER]"}
    assert kept == {(k, f"C{i}") for k in range(6) for i, (t, _) in enumerate(TEXTS[k % 3 :]) if t} | {(9, "C0"), (9, "C1")}
    told = {(r.clause_id, r.rule) for r in done.findings.where("contract_id = 0 AND severity <> 'OK'").collect()}
    assert {("C2", "SECURITY_CAP"), ("C3", "ENTRY"), ("C8", "URGENT_REPAIR")} <= told
    assert {(r.term, r.value) for r in done.terms().where("contract_id = 3 AND value IS NOT NULL").collect()} >= {("rent", 4000.0), ("security_return_days", 70.0)}


def test_rules_give_what_their_order_gives(spark):
    flags = ("risk", "violates", "preference", "violates", "risk")
    rows = [tuple(v) for v in itertools.product((True, False, None), repeat=len(flags))]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} boolean" for i in range(len(flags))))
    table = [rules.Rule(f"R{i}", F.col(f"c{i}"), f) for i, f in enumerate(flags)]
    for r in rules.evaluate(df, table, ("violates", "risk", "preference")).collect():
        hits = [(f"R{i}", f) for i, f in enumerate(flags) if r[f"c{i}"]]
        broken = next((n for n, (_, f) in enumerate(hits) if f == "violates"), None)
        hits = hits if broken is None else hits[: broken + 1]
        assert r.violates == (broken is not None) and r.reason == (hits[-1][0] if hits else None)
        assert all(r[f] == (broken is None and any(g == f for _, g in hits)) for f in ("risk", "preference"))


def test_short_texts_are_remembered_and_long_ones_are_not():
    made = []
    f = streams.remembered(lambda t: made.append(t) or len(t))
    assert [f(t) for t in ("a", "a", "b" * 5000, "b" * 5000)] == [1, 1, 5000, 5000]
    assert [len(t) for t in made] == [1, 5000, 5000]


def test_lone_edges_are_parts_of_their_own():
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        edges = sorted({(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(1, 7))})
        i, j = (np.array(c, np.int64) for c in zip(*edges, strict=True))
        label = {e: e[0] for e in edges}
        for _ in edges:
            for a, b in itertools.product(edges, edges):
                if a[0] == b[0] or a[1] == b[1]:
                    label[a] = label[b] = min(label[a], label[b])
        assert assignment.parts(i, j).tolist() == [label[e] for e in edges]


def test_links_are_those_of_clauses_that_are_not_read(spark):
    from clauseframe.plans import links

    df = frame(spark)
    plain = lambda d: sorted(map(str, links.candidates(d).collect()))
    want, read = plain(df), C.read(df)
    assert plain(read) == plain(links.with_told(read)) == want and len(want) > 5
    done = analyses.analyze(df, WISHES)
    assert "told" in done.wordings.columns and done.wordings.count() == len(TEXTS) + 1  # made once a wording
