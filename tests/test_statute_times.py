"""Times of a statute: a page is read once, and times in which nothing stands are times too."""

import contextlib
import io

from clauseframe.plans import statutes

CONTENT, NOTE = '<div class="law-content1">{}</div>', '<span class="law-note">(החל מיום 1.1.{}):</span> '
WORDING = "Rent is due monthly to the owner."
#: For four years the section says too little to be a chunk.
PAGE = '<div class="law-number1">1.</div>' + CONTENT.format(WORDING) + CONTENT.format(NOTE.format(2020) + "Rent is due.") + CONTENT.format(NOTE.format(2024) + WORDING)


def test_a_time_without_chunks_ends_what_stood_before(spark):
    pages = spark.createDataFrame([(1, PAGE)], "law_id int, html string")
    rows = {(r.since, r.until, r.text) for r in statutes.chunk_intervals(pages).collect()}
    assert rows == {(statutes.EARLIEST, "2020-01-01", f"1 {WORDING}"), ("2024-01-01", None, f"1 {WORDING}")}
    assert [statutes.chunks(pages, d).count() for d in ("2019-12-31", "2022-01-01", "2024-01-01")] == [1, 0, 1]


def test_intervals_read_each_page_once(spark):
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        statutes.chunk_intervals(spark.createDataFrame([(1, PAGE)], "law_id int, html string")).explain()
    assert told.getvalue().count("MapInArrow") == 1 and "Join" not in told.getvalue() and told.getvalue().count("Exchange") == 1


def test_tidy():
    assert statutes.tidy(" a \n ( b ) , c ־ d  ״ e ״ [ ] ") == "a (b), c ־d״e״[]"
