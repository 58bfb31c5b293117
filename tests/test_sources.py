"""Statutes, layout and feeds on small inputs of our own."""

from pyspark.sql import functions as F

from clauseframe.plans import layout, statutes
from clauseframe.sources import feeds

PAGE = """<div class="law"><div class="law-number1">1.<div class="law-desc">Aim</div></div><div class="law-content1">The aim of this law is fair renting for all.</div>
<div class="law-number1">2.</div><div class="law-content1">A landlord shall repair within 30 days of notice.</div>
<div class="law-content1"><span class="law-note">(החל מיום 1.1.2024):</span> A landlord shall repair within 14 days of notice.</div>
<div class="law-number1">3.</div><div class="law-content1">(בוטל).</div>
<div class="law-number1">2.</div><div class="law-content1">Another section of the same number.</div><div class="law-number2">(a)</div><div class="law-content2">with a paragraph</div>
<div class="law-content1"><span class="law-note">(החל מיום 1.1.2030):</span> A later wording that does not hold yet.</div><h2>תוספת ראשונה</h2><h3>Forms</h3><p>The form of a notice is free.</p></div>"""


def test_statute_in_force():
    now = dict(statutes.sections_of(PAGE, "2024-06-01")[:2])
    assert now["1"].startswith("1 Aim The aim") and "14 days" in now["2"] and "30 days" not in now["2"]
    before = statutes.sections_of(PAGE, "2023-06-01")
    assert "30 days" in before[1][1] and "14 days" not in before[1][1] and [n for n, _ in before] == ["1", "2", "2", "תוספת ראשונה"]
    assert "later wording" not in str(before) and "later wording" in str(statutes.sections_of(PAGE, "2031-01-01")) and statutes.sections_of(None, "2024-01-01") == []
    assert statutes.shares_wording("abcdef", "abXdef") and not statutes.shares_wording("abcdef", "uvwxyz")
    assert [len(p) for p in statutes.split_text("a" * 50 + " " + "b" * 60, 70)] == [50, 60] and statutes.split_text("a" * 150, 70) == ["a" * 70, "a" * 70, "a" * 10]


def test_statute_chunks(spark):
    got = statutes.chunks(spark.createDataFrame([(7, PAGE), (8, None)], "law_id int, html string"), "2024-06-01").orderBy("ordinal").collect()
    assert [r.reference for r in got] == ["IL-7-1", "IL-7-2-INSTANCE-1", "IL-7-2-INSTANCE-2", "IL-7-תוספת-ראשונה"] and [r.ordinal for r in got] == [0, 1, 2, 3] and all(len(r.hash) == 64 for r in got)


def test_layout(spark):
    g = [(1, 1, 0, "He", 10.0, 700.0, 10.0, 10.0, False), (1, 1, 1, "llo", 20.5, 700.0, 15.0, 10.0, False), (1, 1, 2, "world", 40.0, 700.0, 25.0, 10.0, True), (1, 1, 3, " ", 0.0, 690.0, 3.0, 10.0, False), (1, 1, 4, "next", 10.0, 688.0, 20.0, 10.0, False)]
    lines = layout.glyph_lines(spark.createDataFrame(g, "doc_id int, page int, seq int, text string, x double, y double, width double, size double, eol boolean"))
    words = layout.line_words(lines)
    assert sorted((r.line, r.word, r.text) for r in words.collect()) == [(1, 1, "Hello"), (1, 2, "world"), (2, 1, "next")]
    assert {r.line: r.text for r in layout.right_to_left(words).collect()} == {1: "world Hello", 2: "next"}
    assert layout.visual_order(lines.withColumn("text", F.lit("א"))).first().visual is True
    rows = [(1, 1, "a", 10.0, 100.0, 30.0, 10.0), (1, 1, "a", 50.0, 101.0, 30.0, 10.0), (1, 1, "a", 10.0, 88.0, 30.0, 10.0), (1, 1, "a", 10.0, 20.0, 5.0, 10.0)]
    got = layout.boxes(spark.createDataFrame(rows, "doc_id int, page int, clause_id string, x double, y double, width double, height double"))
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in got.collect()) == [(10.0, 20.0, 15.0, 30.0), (10.0, 88.0, 80.0, 111.0)]
    m = layout.marks(got.withColumn("page_width", F.lit(81)).withColumn("page_height", F.lit(800))).where("y0 > 50").first()
    assert (m.x0, m.y0, m.x1, m.y1) == (8.0, 86.0, 81.0, 113.0)
    pages = [(1, p, t, y, 800.0) for p in (1, 2) for t, y in (("Draft 3", 780.0), (f"body {p}", 400.0), (f"{p} / 2", 20.0))]
    kept = layout.without_running_heads(spark.createDataFrame(pages, "doc_id int, page int, text string, y double, height double"))
    assert sorted(r.text for r in kept.collect()) == ["body 1", "body 2"]


def test_feeds(spark):
    body = '{"month":[{"date":[{"year":2025,"month":2,"percent":0.1,"percentYear":3.4},{"year":2025,"month":1,"percent":0.2,"percentYear":3.2},{"year":null,"month":1}]}]}'
    months = feeds.index_months(spark.createDataFrame([(body,)], "body string"))
    assert sorted(map(tuple, months.collect())) == [("2025-01", 0.2, 3.2), ("2025-02", 0.1, 3.4)]
    assert tuple(feeds.yearly_percent(months).first()) == ("2025-02", 3.4) and tuple(feeds.yearly_percent(months.limit(0)).first()) == (None, 2.5)
    text = spark.createDataFrame([("x", "Title\n[C001]\none\ntwo\n[C002]\nthree\n")], "case_id string, text string")
    assert [tuple(r) for r in feeds.marked_clauses(text).orderBy("ord").collect()] == [("x", 0, "C001", "one\ntwo"), ("x", 1, "C002", "three")]
    files = spark.createDataFrame([(b"%PDF-1.7",), (b"hello",)], "content binary").select(feeds.acceptable_pdf(F.col("content")).alias("ok"))
    assert [r.ok for r in files.collect()] == [True, False]
    kind = "doc_id int, page int, page_height double, blocks array<struct<paragraphs:array<struct<lines:array<struct<words:array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>>>>>>"
    word = ("hi", (20.0, 40.0, 60.0, 41.0))
    got = feeds.ocr_words(spark.createDataFrame([(1, 1, 100.0, [([([([word],)],)],)])], kind)).first()
    assert (got.text, got.x, got.y, got.width, got.height) == ("hi", 10.0, 79.5, 20.0, 1.0)
    assert feeds.progress_lines(spark.createDataFrame([(1, None)], "a int, b string"), "a", "b").first().value == '{"a":1}'


def test_intervals_equal_the_plan_on_every_date(spark):
    import itertools
    from datetime import date, timedelta

    second = PAGE.replace("2024", "2022") + PAGE
    pages = spark.createDataFrame([(7, PAGE), (8, None), (9, second), (10, "<p>nothing</p>")], "law_id int, html string")
    intervals = statutes.chunk_intervals(pages).checkpoint()
    turns = sorted({t for html in (PAGE, second) for t in statutes.turns_of(statutes.blocks_of(html))})
    assert turns
    days = sorted({str(date.fromisoformat(t) + timedelta(days=d)) for t, d in itertools.product(turns, (-1, 0, 1))} | {"1980-01-01", "2099-01-01"})
    dates = pages.select("law_id", F.explode(F.array(*map(F.lit, days))).alias("as_of"))
    got = {}
    for r in statutes.chunks_at(intervals, dates).collect():
        got.setdefault(r.as_of, []).append((r.law_id, r.ordinal, r.reference, r.section, r.text, r.hash))
    for day in days:
        want = [(r.law_id, r.ordinal, r.reference, r.section, r.text, r.hash) for r in statutes.chunks(pages, day).collect()]
        assert sorted(got.get(day, []), key=repr) == sorted(want, key=repr), day
    still = intervals.where("law_id = 7").groupBy("reference", "text").count()
    assert still.where("count > 1").count() == 0  # a wording that stays is one row


def test_the_catalog_of_laws(spark):
    from clauseframe.sources import catalog

    assert len(catalog.LAWS) == len({i for i, _ in catalog.LAWS}) == len({t for _, t in catalog.LAWS}) == 13
    rows = spark.createDataFrame([(2000596, 1), (2000596, 2), (5, 3), (None, 4)], "law_id long, n int")
    assert sorted((r.n, r.title) for r in catalog.monitored(rows).collect()) == [(1, "חוק השכירות והשאילה"), (2, "חוק השכירות והשאילה")]
    assert catalog.unseen(rows).count() == 12 and catalog.unseen(rows.limit(0)).count() == 13
