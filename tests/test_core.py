"""The engine's queries against DuckDB, and its rules against worked examples."""

import glob
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseframe.functions import numbers as N
from clauseframe.functions import text as T
from clauseframe.operators import joins, ranking, repository
from clauseframe.plans import align, redact, rules, schedule, segment
from clauseframe.queries import ORACLE_SQL, QUERIES
from clauseframe.sources import pages
from clauseframe.streaming import conversations, limits


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in duck.description]
    assert sorted(columns) == names
    assert got == sorted(tuple(plain(r[columns.index(n)]) for n in names) for r in duck.fetchall())


UNCHECKED = {"law_monitor", "html_sections", "html_manifest", "clause_alignment", "assignment_optimal", "word_diff", "chunk_pack_300"}


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(ORACLE_SQL) == UNCHECKED


def test_chunks_hold_the_words_in_order(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    chunks = {}
    for r in QUERIES["chunk_pack_300"](spark, sf).orderBy("doc_id", "part").collect():
        chunks.setdefault(r.doc_id, []).append((r.part, r.chunk))
    assert set(chunks) == {i for i, t in texts.items() if t.strip()}
    for i, own in chunks.items():
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and " ".join(c for _, c in own).split() == texts[i].split()
        sizes = [len(c.split()) for _, c in own]
        assert len(sizes) == 1 and sizes[0] <= segment.MOST or all(0.8 * segment.TARGET <= n for n in sizes[:-1])


def versions_of(spark, sf):
    from clauseframe.queries import states

    sides = {}
    for r in states._versions(spark, sf).orderBy("pair_id", "side", "ord").collect():
        sides.setdefault(r.pair_id, {"before": [], "after": []})[r.side].append(r.text)
    return sides


def test_alignments_name_each_clause_once(spark, sf):
    sides, rows = versions_of(spark, sf), {}
    for r in QUERIES["clause_alignment"](spark, sf).collect():
        rows.setdefault(r.pair_id, []).append(r)
    assert set(rows) == set(sides)
    for pair, own in rows.items():
        for side in ("before", "after"):
            assert sorted(i for r in own for i in getattr(r, side)) == list(range(len(sides[pair][side])))
        for r in own:
            told = {s: "\n".join(sides[pair][s][i] for i in getattr(r, s)) for s in ("before", "after")}
            assert (r.before_text, r.after_text) == (told["before"], told["after"])
            assert (r.change == "ADDED") == (not r.before) and (r.change == "REMOVED") == (not r.after)
            assert r.change != "UNCHANGED" or r.renumbered or align.normalized(r.before_text) == align.normalized(r.after_text)
    counted = {r.pair_id: (r.pairs, r.similarity) for r in QUERIES["assignment_optimal"](spark, sf).collect()}
    for pair, own in rows.items():
        changed = [r.similarity for r in own if r.change == "MODIFIED"]
        assert (pair in counted) == bool(changed)
        assert not changed or counted[pair][0] == len(changed) and abs(counted[pair][1] - sum(changed)) < 0.002


def test_moved_clauses_are_those_off_the_longest_run(spark, sf):
    import itertools

    rows = QUERIES["lis_moved"](spark, sf).collect()
    assert all(r.before and r.after for r in rows)
    rng = random.Random(3)
    clauses = [f"clause {i} says that {i * i} things of kind {i % 7} hold in case {i * 31 % 17} of all" for i in range(9)]
    made = []
    for pair in range(6):
        order = rng.sample(range(9), 9)
        made += [(pair, "before", i, t) for i, t in enumerate(clauses)] + [(pair, "after", i, clauses[j]) for i, j in enumerate(order)]
    got = {}
    for r in align.align(spark.createDataFrame(made, "pair_id long, side string, ord int, text string")).collect():
        got.setdefault(r.pair_id, []).append((r.before[0], r.after[0], r.moved))
    for own in got.values():
        places = [j for _, j, _ in sorted(own)]
        longest = max(n for n in range(10) for c in itertools.combinations(places, n) if list(c) == sorted(c))
        still = [j for _, j, moved in sorted(own) if not moved]
        assert len(still) == longest and still == sorted(still)


def plain_lcs(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_word_diffs_give_both_texts_and_a_longest_common_run(spark, sf):
    rng = random.Random(11)
    pairs = [(" ".join(rng.choices("abcd", k=rng.randrange(0, 30))), " ".join(rng.choices("abcd", k=rng.randrange(0, 30)))) for _ in range(150)]
    for a, b in [*pairs, ("", ""), ("a", ""), ("", "a b"), ("same text", "same text"), ("a b c", "a b")]:
        runs = align.word_diff(a, b)
        assert "".join(t for o, t in runs if o != "insert") == a and "".join(t for o, t in runs if o != "delete") == b
        assert sum(len(align.TOKEN.findall(t)) for o, t in runs if o == "equal") == plain_lcs(align.TOKEN.findall(a), align.TOKEN.findall(b))
    for r in QUERIES["word_diff"](spark, sf).collect():
        assert [x.op for x in r.runs] and all(x.op in ("equal", "delete", "insert") for x in r.runs)
    long = " ".join(str(rng.randrange(500)) for _ in range(4000))
    assert "".join(t for o, t in align.word_diff(long, long[7000:] + long[:7000]) if o != "insert") == long


def test_html_sections_are_parts_of_their_page(spark, sf):
    pages_ = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    sections = QUERIES["html_sections"](spark, sf).collect()
    assert {r.page_id for r in sections} <= set(pages_) and len({(r.page_id, r.ord) for r in sections}) == len(sections)
    for r in sections:
        first = next((w for w in (r.text or "").split() if w.isascii() and w.isalnum()), "")
        assert first in pages_[r.page_id] and "<" not in (r.text or "").split(" ")[0][:1]
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = {}
    for r in sorted(sections, key=lambda r: (r.page_id, r.ord)):
        if len(r.text) >= 20:
            own.setdefault(r.page_id, {}).setdefault(r.ord // 1024, []).append(sha(r.text))
    expected = {p: sha(":".join(sha(":".join(b)) for _, b in sorted(blocks.items()))) for p, blocks in own.items()}
    assert {r.page_id: r.manifest for r in QUERIES["html_manifest"](spark, sf).collect()} == expected


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_numbers(spark):
    r = one(spark, half=N.money(F.lit(1.005)), neg=N.money(F.lit(-2.505)), n=N.numbers_in(F.lit("1. rent 6,000 and 2.5\n12) x 7")), a=N.amounts_in(F.lit("ILS 6,000, 250 ₪ and 9")), p=N.percents_in(F.lit("4% or 2.5 percent")))
    assert (r.half, r.neg) == (1.0, -2.5) and r.n == ["6000", "2.5", "7"] and r.a == [6000.0, 250.0] and r.p == [4.0, 2.5]
    r = one(spark, m=N.add_months(F.lit("2024-11"), F.lit(3)), h=N.duration(F.lit(48.0), F.lit("hours")), y=N.duration(F.lit(2.0), F.lit("years")))
    assert r.m == "2025-02" and tuple(r.h) == (2.0, "days") and tuple(r.y) == (24.0, "months")


def test_text(spark):
    r = one(
        spark, a=T.numbered_heading(F.lit("7.2 Security")), b=T.numbered_heading(F.lit("7 days")), c=T.numbered_heading(F.lit("7. Rent")), d=T.is_heading(F.lit("Rent and term")), e=T.is_heading(F.lit("It ends here.")),
        s=T.sentences(F.lit("Pay 6.5 now. Then go!\nOn time; yes")), v=T.verbatim(F.lit("a (b)\n c"), F.lit("(b) c")), n=T.verbatim(F.lit("abc"), F.lit("x")), g=T.trigrams(F.lit("ab cd")), q=T.capped(F.lit("abcdefgh"), 5),
        refs=T.references(F.lit("see sections 5, 7.1 and 9")), sh=T.shingles(F.lit("a b c d"), 3), norm=T.normalized(F.lit("3. “x”   y ")),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == ("7.2", None, "7", True, False)
    assert r.s == ["Pay 6.5 now.", "Then go!", "On time;", "yes"] and r.v == "(b)\n c" and r.n is None and r.g == ["abc", "bcd"] and r.q == "ab..."
    assert r.refs == ["5", "7.1", "9"] and r.sh == ["a b c", "b c d"] and r.norm == '"x" y'


def test_packing_keeps_words_and_bounds():
    rng = random.Random(1)
    for _ in range(60):
        lines = [" ".join("w" * rng.choice([1, 5]) for _ in range(rng.choice([3, 40, 199, 250, 301, 700]))) for _ in range(rng.randint(1, 9))]
        chunks = segment.packed(lines)
        assert sum(len(c.split()) for c in chunks) == sum(len(x.split()) for x in lines)
        assert all(len(c.split()) < 200 + 300 for c in chunks)
        if len(chunks) > 1:
            assert all(len(c.split()) >= 200 for c in chunks[:-1])
    assert segment.packed([]) == [""]


def test_redaction_of_hebrew_identifiers(spark):
    text = "המשכיר משה כהן, ת.ז 123456789, טלפון 052-1234567, a.b@c.co.il, חשבון בנק 12345678, IL123456789012345678901 וגם 987654321"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in redact.redact(df, redact.HEBREW).collect()}
    assert "[LANDLORD_NAME]" in got[1].text and "[PHONE_NUMBER]" in got[1].text and "[EMAIL_ADDRESS]" in got[1].text and "[BANK_ACCOUNT]" in got[1].text and "[IBAN]" in got[1].text
    assert got[2].text is None and not any(got[2].redactions.values()) and sum(got[1].redactions.values()) >= 6
    clean, held = redact.gate(redact.redact(df, redact.HEBREW))
    assert clean.count() == 2 and held.count() == 0
    assert redact.gate(df)[1].select("doc_id").collect() == [(1,)]


def months_of(spark, **inputs):
    df = spark.createDataFrame([(1, "2025-01")], "id int, start string").select("id", "start", *(F.lit(v).alias(k) for k, v in inputs.items()))
    return schedule.schedule(df, "id")


def test_schedule_examples(spark):
    t = schedule.totals(months_of(spark, rent=6000.0, term=12, charges=250.0), "id").first()
    assert (t.base, t.charges_due, t.total, t.average) == (72000.0, 3000.0, 75000.0, 6250.0)
    m = months_of(spark, rent=5500.0, term=12, option_months=12, option_percent=4.0, indexation="ANNUAL", inflation=3.0)
    r = m.where("month = 13").first()
    assert (round(r.base, 2), round(r.indexation_due, 2), r.phase, r.period) == (5720.0, 171.6, "OPTION", "2026-01")
    assert round(schedule.effective_percent(m, "id").first().percent, 2) == 7.12
    exits = {k: schedule.totals(months_of(spark, rent=5000.0, term=12, exit_after=4, **({"exit_kind": k} if k else {}), exit_notice_days=60), "id").first().base for k in ("UNTIL_END", "ALLOWED_WITH_NOTICE", None)}
    assert exits == {"UNTIL_END": 60000.0, "ALLOWED_WITH_NOTICE": 30000.0, None: 60000.0}  # four months lived in, and 40,000, 10,000, 40,000 owed
    late = lambda **x: schedule.totals(months_of(spark, term=12, **x), "id").first().penalties
    assert late(rent=6000.0, late_vacating_days=5, vacating_per_day=400.0) == 2000.0
    assert late(rent=5500.0, late_payment_days=10, payment_interest=1.5) == 27.5
    assert late(rent=6000.0, late_vacating_days=3) == 600.0
    assert months_of(spark, rent=100.0, term=1, exit_after=1).count() == 1
    assert late(rent=100.0, exit_after=4, exit_kind="FIXED_AMOUNT", exit_amount=70.0) == 70.0


def test_cap_examples(spark):
    cap = lambda rent, months, s: one(spark, **rules.security_cap(F.lit(rent), F.lit(months).cast("int"), F.lit(s)))
    r = cap(6000.0, 12, 30000.0)
    assert (r.cap, r.difference, r.passed) == (18000.0, 12000.0, False)
    assert cap(5000.0, None, 16000.0).passed is False and cap(5000.0, None, 12000.0).passed is None and cap(5000.0, 6, 9000.0).passed is True


def test_rules_fold(spark):
    df = spark.createDataFrame([(1, True, True), (2, False, True), (3, False, False), (4, None, None)], "id int, bad boolean, soft boolean")
    table = [rules.Rule("soft first", F.col("soft"), "risk"), rules.Rule("bad", F.col("bad"), "violates"), rules.Rule("soft last", F.col("soft"), "risk")]
    got = {r.id: (r.violates, r.risk, r.reason) for r in rules.evaluate(df, table, ("violates", "risk")).collect()}
    assert got == {1: (True, False, "bad"), 2: (False, True, "soft last"), 3: (False, False, None), 4: (False, False, None)}


def test_assignment_is_optimal():
    from itertools import permutations

    assert align.assign(1 - np.array([[0.1, 0.2], [0.15, 0.9]])) == [0, 1]
    assert align.assign(np.array([[0.1, 0.2], [0.15, 0.9]])) == [1, 0] and align.assign(np.array([[0.5, 0.1, 0.9]])) == [1]
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 5))
        cost = rng.random((n, n))
        got = align.assign(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert sum(cost[i, j] if j >= 0 else 1 for i, j in enumerate(got)) <= best + 1e-9


def test_alignment_of_two_versions():
    before = ["1. Rent is 6,000 a month.", "2. The tenant may not keep any pets at all in the flat.", "3. The deposit is returned in 60 days.", "4. Gone."]
    after = ["1. The deposit is returned in 60 days.", "2. Rent is 6,500 a month.", "3. The tenant may not keep any pets at all in the flat.", "4. Entirely new words about parking spaces."]
    rows = align.aligned(before, after)
    kinds = {(tuple(x), tuple(y)): (c, m) for x, y, c, _, m, _ in rows}
    assert kinds[(2,), (0,)] == ("UNCHANGED", True) and kinds[(0,), (1,)] == ("MODIFIED", False) and kinds[(1,), (2,)][0] == "UNCHANGED"
    assert kinds[(3,), ()][0] == "REMOVED" and kinds[(), (3,)][0] == "ADDED"
    runs = align.word_diff("Rent is 6,000 a month", "Rent is 6,500 a month")
    assert [r for r in runs if r[0] != "equal"] == [("delete", "6,000"), ("insert", "6,500")] and align.number_changes(runs) == [("6,000", "6,500")]
    assert align.increasing([2, 0, 1, 3]) == {1, 2, 3} and align.increasing([]) == set()


def test_split_clause_joins_its_neighbour():
    whole = "The tenant shall pay the rent on the first of each month by bank transfer. The landlord shall repair urgent defects within three days of notice."
    first, second = whole.split(". ", 1)
    rows = align.aligned([whole], [first + ".", second])
    assert [(x, y, c) for x, y, c, *_ in rows] == [([0], [0, 1], "SPLIT")]


def test_joins_and_ranking(spark):
    facts = spark.createDataFrame([(1, 5), (1, 15), (2, 5)], "k int, at int")
    history = spark.createDataFrame([(1, 0, "a"), (1, 10, "b"), (2, 9, "c")], "k int, since int, v string")
    assert sorted(tuple(r) for r in joins.as_of(facts, history, "k", "at", "since", "v").select("k", "at", "v").collect()) == [(1, 5, "a"), (1, 15, "b"), (2, 5, None)]
    cut = ranking.within_budget(spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "c")], "k int, o int, t string"), ["k"], "t", 6, F.col("o"))
    assert sorted((r.o, r.t) for r in cut.collect()) == [(1, "aaaa"), (2, "bb")]


def test_repository(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    change = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert sorted(tuple(r) for r in repository.upsert(base, change, "id").collect()) == [(1, "a"), (2, "B"), (3, "c")]
    kept, rejected = repository.insert_unique(base, change, "id")
    assert kept.count() == 3 and rejected.count() == 1
    parents, children = spark.createDataFrame([(1,), (2,)], "p int"), spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "c int, p int")
    left, rest = repository.delete_cascade(parents, children, spark.createDataFrame([(10,), (20,)], "c int"), "c", "p")
    assert [r.p for r in left.collect()] == [1] and [r.c for r in rest.collect()] == [11]
    states = spark.createDataFrame([(1, "ACTIVE", "h0"), (1, "CANDIDATE", "h1"), (2, "ACTIVE", "g0"), (2, "CANDIDATE", "g1")], "law int, status string, hash string")
    asked = spark.createDataFrame([(1, "h1"), (2, "other")], "law int, hash string")
    got = sorted(tuple(r) for r in repository.activate(states, asked, "law", ["hash"]).collect())
    assert got == [(1, "ACTIVE", "h1"), (1, "RETIRED", "h0"), (2, "ACTIVE", "g0"), (2, "CANDIDATE", "g1")]
    keys = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, yes=repository.auto_approvable(keys("a", "b"), keys("a", "b", "c"), F.lit(True), F.lit(25.0)), no=repository.auto_approvable(keys("a", "b"), keys("a"), F.lit(True), F.lit(25.0)))
    assert (r.yes, r.no) == (True, False)


def test_small_operators(spark):
    from clauseframe.operators import aggregates
    from clauseframe.plans import layout

    status = spark.createDataFrame([("COVERED",), ("PARTIAL",), ("MISSING",)], "s string")
    assert status.agg(aggregates.coverage_percent(F.col("s")).alias("c")).first().c == 50 and status.limit(0).agg(aggregates.coverage_percent(F.col("s")).alias("c")).first().c == 100
    r = one(spark, a=layout.is_scanned(F.lit("  12 ")), b=layout.is_scanned(F.lit("x" * 40)), c=T.without_fence(F.lit("```json\n{}\n```")))
    assert (r.a, r.b, r.c) == (True, False, "{}")
    kept = repository.unexpired(spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2024-01-02'), (2, TIMESTAMP'2023-01-01'), (3, CAST(NULL AS TIMESTAMP)) t(id, e)"), "e", F.lit("2024-01-01").cast("timestamp"))
    assert sorted(x.id for x in kept.collect()) == [1, 3]
    members = spark.createDataFrame([("k", 1), ("k", 2), ("j", 2), ("j", 3), ("j", 2)], "k string, m int")
    assert sorted(map(tuple, joins.shared_member_pairs(members, "k", "m").collect())) == [(1, 2), (2, 3)]


def test_pages():
    rows = pages.sections_of("<h1>A</h1><p>one <b>two</b></p><h2>B</h2><script>x</script><ul><li>three</li></ul><h1>C</h1>tail")
    assert rows == [(1, [], "A"), (0, ["A"], "one two"), (2, ["A"], "B"), (0, ["A", "B"], "three"), (1, [], "C"), (0, ["C"], "tail")]
    assert pages.sections_of(None) == []


def test_rate_limit_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = limits.counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "event_type", window="1 hour", late="40 days")
    stream.writeStream.format("memory").queryName("limits").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    batch = limits.counts(events, "event_type", window="1 hour")
    assert sorted(map(tuple, spark.table("limits").collect())) == sorted(map(tuple, batch.collect()))


def test_conversation_stream(spark, tmp_path):
    rows = [(1, 0, "user", "STRATEGY"), (1, 1, "assistant", "DRAFT"), (1, 2, "user", "DONE"), (2, 0, "user", None), (2, 1, "assistant", "COUNTER")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, asked string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("conv_id long, turn long, role string, asked string").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a replay waits for timeouts and never ends
    conversations.stream_states(source).writeStream.format("memory").queryName("talks").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted(map(tuple, spark.table("talks").collect())) == [(1, "DRAFT", 2, 2), (2, "PRIORITIZE", 1, 1)]
    assert conversations.fold(iter([(5, "user", None)]), ("DONE", 3, 4)) == ("DONE", 3, 4) and conversations.fold(iter([(1, "user", None)] * 2), ("DRAFT", 60, 0)) == ("DRAFT", 60, 1)
