"""Nested and marked inputs as rows: OCR blocks, price indices, agreements with clause markers, upload checks, progress lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CPI = "month array<struct<date:array<struct<year:int,month:int,percent:double,percentYear:double>>>>"
FALLBACK_PERCENT = 2.5


def ocr_words(pages: DataFrame, blocks: str = "blocks", scale: float = 2.0) -> DataFrame:
    """(doc_id, page, line, word, text, x, y, width, height) of nested blocks, paragraphs, lines and words.

    Boxes (x0, y0, x1, y1 in pixels from the top left) become page units from the bottom left, at least 1 in size.
    """
    df = pages.select("doc_id", "page", "page_height", F.posexplode(blocks).alias("b", "block")).select("doc_id", "page", "page_height", "b", F.posexplode("block.paragraphs").alias("p", "paragraph"))
    df = df.select("doc_id", "page", "page_height", "b", "p", F.posexplode("paragraph.lines").alias("l", "row")).select("doc_id", "page", "page_height", F.struct("b", "p", "l").alias("line"), F.posexplode("row.words").alias("word", "w"))
    box = F.col("w.bbox")
    size = lambda a, b: F.greatest(F.lit(1.0), (box[b] - box[a]) / scale)
    return df.select("doc_id", "page", "line", "word", F.col("w.text").alias("text"), (box["x0"] / scale).alias("x"), (F.col("page_height") - box["y1"] / scale).alias("y"), size("x0", "x1").alias("width"), size("y0", "y1").alias("height"))


def index_months(responses: DataFrame, body: str = "body") -> DataFrame:
    """(period, percent, percent_year) of price-index responses in JSON; rows without year or month are left out."""
    parsed = responses.select(F.explode(F.from_json(body, CPI)["month"]).alias("m")).select(F.explode("m.date").alias("d")).select("d.*")
    good = parsed.where("year IS NOT NULL AND month IS NOT NULL")
    return good.select(F.format_string("%d-%02d", "year", "month").alias("period"), "percent", F.col("percentYear").alias("percent_year"))


def yearly_percent(months: DataFrame, last_good: float | None = None) -> DataFrame:
    """(period, percent): the latest month's yearly change, else the last good one, else a fixed assumption."""
    latest = months.agg(F.max_by("percent_year", "period").alias("p"), F.max("period").alias("period"))
    return latest.select(F.when(F.col("p").isNotNull(), F.col("period")).alias("period"), F.coalesce("p", F.lit(last_good), F.lit(FALLBACK_PERCENT)).alias("percent"))


def marked_clauses(texts: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """(key, ord, clause_id, text) of texts whose clauses follow a line ``[Cnnn]``; what stands before the first is left out."""
    parts = F.split(text, r"(?m)^\[C\d{3}\]\s*$", -1)
    ids = F.regexp_extract_all(text, F.lit(r"(?m)^\[(C\d{3})\]\s*$"), F.lit(1))
    zipped = F.arrays_zip(ids.alias("clause_id"), F.slice(parts, F.lit(2), F.size(ids)).alias("text"))
    return texts.select(key, F.posexplode(zipped).alias("ord", "c")).select(key, "ord", "c.clause_id", F.trim(F.regexp_replace("c.text", r"^\s+|\s+$", "")).alias("text"))


def acceptable_pdf(content: Column, most_bytes: int = 10 * 2**20) -> Column:
    """A file that begins like a PDF and is not too large."""
    return (F.decode(F.substring(content, 1, 5), "ISO-8859-1") == "%PDF-") & (F.length(content) <= most_bytes)


def file_name(path: Column) -> Column:
    """The last part of a path, without control characters."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"[\x00-\x1f\x7f]", "")


def continued(uploads: DataFrame, known: DataFrame, owner: str = "user_id") -> DataFrame:
    """``uploads`` (contract_id, owner, previous_contract_id) with ``lineage``: NEW without a predecessor, CONTINUES where the owner has the one
    that is named, else PREVIOUS_NOT_FOUND, also where somebody else has it. ``known`` has contract_id, once each, and owner; blank names none."""
    before = F.nullif(F.trim(F.col("previous_contract_id").cast("string")), F.lit(""))
    own = known.select(F.col("contract_id").cast("string").alias("_before"), F.col(owner).alias("_owner"), F.lit(True).alias("_found"))
    named = uploads.withColumn("_named", before)
    rows = named.join(own, (F.col("_named") == F.col("_before")) & (F.col(owner) == F.col("_owner")), "left")
    return rows.select(*uploads.columns, F.when(F.col("_named").isNull(), "NEW").when(F.col("_found"), "CONTINUES").otherwise("PREVIOUS_NOT_FOUND").alias("lineage"))


def progress_lines(events: DataFrame, *columns: str) -> DataFrame:
    """(value): one JSON object a row, nulls left out; for the text sink."""
    return events.select(F.to_json(F.struct(*columns)).alias("value"))


def event_blocks(pieces: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, ord, data, complete) of event streams that arrive in pieces, cut anywhere: the ``data`` lines of each block between blank
    lines, joined by line breaks. What follows the last blank line is not complete yet; blocks without data are left out.

    A stream is one reply, so its pieces are put together in one row.
    """
    ordered = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("_text"))))
    whole = F.regexp_replace(F.array_join(F.transform(ordered, lambda p: p["_text"]), ""), r"\r\n?", "\n")
    blocks = pieces.groupBy(key).agg(F.split(whole, r"\n{2,}", -1).alias("_blocks")).select(key, F.size("_blocks").alias("_n"), F.posexplode("_blocks").alias("ord", "_block"))
    lines = F.filter(F.split("_block", "\n"), lambda x: F.startswith(x, F.lit("data:")))
    data = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    return blocks.where(F.size(lines) > 0).select(key, "ord", data.alias("data"), (F.col("ord") < F.col("_n") - 1).alias("complete"))
