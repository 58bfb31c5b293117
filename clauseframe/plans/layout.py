"""Page geometry: glyphs to lines and words, reading order, boxes around clauses.

Coordinates are in page units from the bottom left. Breaks are gaps and islands: a lag, a condition, a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
#: Fixed values, in parts of the letter size or of the height.
SAME_WORD, NEW_LINE, LINE_GAP = 0.15, 0.5, 1.8
HEADER, FOOTER, PAD, SCANNED = 55, 50, 2, 30


def _islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_b", F.coalesce(breaks.cast("int"), F.lit(1)))
    return marked.withColumn(name, F.sum("_b").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """``glyphs`` (doc_id, page, seq, text, x, y, width, size, eol) that are not blank, with ``line``: a new one begins when the baseline
    moves by more than half the larger size, or after an end-of-line mark."""
    w = Window.partitionBy(*PAGE).orderBy("seq")
    kept = glyphs.where(F.trim("text") != "")
    jump = F.abs(F.col("y") - F.lag("y").over(w)) > NEW_LINE * F.greatest(F.col("size"), F.lag("size").over(w))
    return _islands(kept, PAGE, ["seq"], jump | F.lag("eol").over(w), "line")


def line_words(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line, word, text, x, right): glyphs of a line from left to right, joined while the gap is under 0.15 em."""
    keys = [*PAGE, "line"]
    w = Window.partitionBy(*keys).orderBy("x", "seq")
    gap = F.col("x") - (F.lag("x").over(w) + F.lag("width").over(w))
    marked = _islands(lines, keys, ["x", "seq"], gap >= SAME_WORD * F.col("size"), "word")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))), lambda g: g["text"]), "")
    return marked.groupBy(*keys, "word").agg(text.alias("text"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"))


def right_to_left(words: DataFrame) -> DataFrame:
    """(doc_id, page, line, text): words by their right edge, Hebrew ones turned round, leading punctuation of others put last."""
    hebrew = F.rlike("text", F.lit(r"\p{IsHebrew}"))
    turned = F.when(hebrew, F.reverse("text")).otherwise(F.regexp_replace("text", r"^([.,:;!?)\]]+)(.+)$", "$2$1"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("right")).alias("k"), turned.alias("t")))), lambda x: x["t"])
    return words.groupBy(*PAGE, "line").agg(F.array_join(ordered, " ").alias("text"))


def visual_order(lines: DataFrame) -> DataFrame:
    """(doc_id, page, visual): whether the neighbours of a page's lines run left to right at least twice and more often than not."""
    w = Window.partitionBy(*PAGE, "line").orderBy("seq")
    pairs = lines.where(F.rlike("text", F.lit(r"\p{IsHebrew}"))).withColumn("d", F.col("x") - F.lag("x").over(w))
    counted = pairs.groupBy(*PAGE).agg(F.count_if(F.col("d") > 0).alias("ltr"), F.count_if(F.col("d") < 0).alias("rtl"))
    return counted.select(*PAGE, ((F.col("ltr") >= 2) & (F.col("ltr") > F.col("rtl"))).alias("visual"))


def is_scanned(text: Column) -> Column:
    """A page with hardly any text has to be recognised."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < SCANNED


def without_running_heads(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, page, text, y, height) without tops that recur on two pages and bottoms that count pages."""
    norm = F.trim(F.regexp_replace(F.regexp_replace("text", r"\d+", "#"), r"\s+", " "))
    near_top, near_bottom = F.col("y") > F.col("height") - HEADER - 2, F.col("y") < FOOTER
    marked = lines.withColumn("_norm", norm).withColumn("_top", near_top)
    heads = marked.where("_top").groupBy("doc_id", "_norm").agg(F.countDistinct("page").alias("pages")).where("pages >= 2").select("doc_id", "_norm", F.lit(True).alias("_top"))
    kept = marked.join(heads, ["doc_id", "_norm", "_top"], "left_anti")
    counter = F.rlike("text", F.lit(r"(?i)^\s*(?:(?:page|עמוד)\s*)?\d+(?:\s*(?:/|of|מתוך)\s*\d+)?\s*$"))
    return kept.where(~(near_bottom & counter)).drop("_norm", "_top")


def boxes(words: DataFrame) -> DataFrame:
    """(doc_id, page, clause_id, block, x0, y0, x1, y1): one rectangle around each run of a clause's lines.

    ``words`` are (doc_id, page, clause_id, x, y, width, height). Words within half a height share a line; a line joins the block above
    it while the gap of baselines is at most 1.8 heights.
    """
    keys = [*PAGE, "clause_id"]
    down = Window.partitionBy(*keys).orderBy(F.desc("y"), "x")
    new_line = F.lag("y").over(down) - F.col("y") >= NEW_LINE * F.least(F.col("height"), F.lag("height").over(down))
    marked = words.withColumn("_b", F.coalesce(new_line.cast("int"), F.lit(1)))
    marked = marked.withColumn("line", F.sum("_b").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    hull = [F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"), F.max("height").alias("h")]
    lines = marked.groupBy(*keys, "line").agg(*hull)
    w = Window.partitionBy(*keys).orderBy("line")
    apart = F.lag("y0").over(w) - F.col("y0") > LINE_GAP * F.greatest(F.col("h"), F.lag("h").over(w))
    blocks = _islands(lines, keys, ["line"], apart, "block")
    return blocks.groupBy(*keys, "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def marks(boxes_: DataFrame, width: str = "page_width", height: str = "page_height") -> DataFrame:
    """The boxes padded and kept inside their page."""
    clamp = lambda c, most: F.greatest(F.lit(0.0), F.least(c, F.col(most).cast("double")))
    return boxes_.withColumns({"x0": clamp(F.col("x0") - PAD, width), "y0": clamp(F.col("y0") - PAD, height), "x1": clamp(F.col("x1") + PAD, width), "y1": clamp(F.col("y1") + PAD, height)})


def first_location(boxes_: DataFrame) -> DataFrame:
    """(doc_id, clause_id, page, x0, y0, x1, y1): where to look for a clause: its first page and there its highest box, as y grows
    upwards; of boxes of one height the leftmost."""
    box = F.struct("page", (-F.col("y0")).alias("_down"), "x0", "y0", "x1", "y1")
    return boxes_.groupBy("doc_id", "clause_id").agg(F.min(box).alias("b")).select("doc_id", "clause_id", *(f"b.{c}" for c in ("page", "x0", "y0", "x1", "y1")))
