"""Statute pages as they stand on a date: sections, chunks with stable references, and hashes.

A page is a tree whose notes say from when a wording holds, so it is read page by page in Arrow batches; references, repeats,
length limits and hashes are DataFrame work on the rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed values.
EFFECTIVE = re.compile(r"החל מיום\s+(\d{1,2})\.(\d{1,2})\.(\d{4})")
MARKER = re.compile(r"^\(?החל מיום\s+\d{1,2}\.\d{1,2}\.\d{4}\)?:?$")
LEAD = re.compile(r"^\(?החל מיום\s+\d{1,2}\.\d{1,2}\.\d{4}:?\s*")
INACTIVE = {"(בוטל).", "(בוטלה).", "(בטל).", "(בטלה).", "בוטל.", "בוטלה.", "בטל.", "בטלה."}
MERGED, APPENDIX = "הנוסח שולב ", "תוספת "
LEAST, MOST = 20, 6000


#: A space inside brackets or before punctuation, and around a joining mark; white space is one space by then.
CLOSE = re.compile(r" (?=[.,;:!?)\]}])|(?<=[\[({]) ")
QUOTED = re.compile(r" ?״ | ״")


def tidy(text: str) -> str:
    """White space collapsed, none inside brackets, before punctuation or around joining marks."""
    out = CLOSE.sub("", " ".join(text.split()).replace("־ ", "־"))
    return QUOTED.sub("״", out) if "״" in out else out


@dataclass
class Block:
    """A division of a page in document order; parts are (text, is a note)."""

    kind: str | None
    level: int | None
    parts: list[tuple[str, bool]] = field(default_factory=list)
    gone: bool = False

    def text(self) -> str:
        return tidy("".join(t for t, _ in self.parts))


class Page(HTMLParser):
    """Splits a page into blocks: numbered and content divisions by class, descriptions, and headings of the second level."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, Block | None, bool, bool]] = []  # tag, its block, is a note, is skipped

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "img", "hr", "input", "meta", "link"):
            return
        names = (dict(attrs).get("class") or "").split()
        block = None
        if tag in ("div", "p", "h2", "h3", "h4"):
            kind, level = (tag, None) if tag in ("h2", "h3") else (None, None)
            for name in names:
                if m := re.fullmatch(r"law-(number|content)(\d*)", name):
                    kind, level = m[1], int(m[2] or 1)
                    break
                if name in ("law-desc", "law-sec-desc"):
                    kind = "desc"
            block = Block(kind, level)
            self.blocks.append(block)
        self.open.append((tag, block, "law-note" in names, "mw-editsection" in names or tag in ("script", "style") or (tag == "sup" and "reference" in names)))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, *_ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if any(skip for *_, skip in self.open):
            return
        inner = next((b for _, b, _, _ in reversed(self.open) if b is not None), None)
        if inner is not None:
            note = any(n for _, _, n, _ in self.open)
            if inner.parts and inner.parts[-1][1] == note:
                inner.parts[-1] = (inner.parts[-1][0] + data, note)
            else:
                inner.parts.append((data, note))


def shares_wording(a: str, b: str) -> bool:
    """Whether a common beginning and a common end make up half of the shorter text."""
    n = min(len(a), len(b))
    start = next((i for i in range(n) if a[i] != b[i]), n)
    end = next((i for i in range(n - start) if a[-1 - i] != b[-1 - i]), n - start)
    return 2 * (start + end) >= n


def in_force(blocks: list[Block], as_of: str) -> list[Block]:
    """The blocks that hold on a date (YYYY-MM-DD): later wordings go, earlier ones go when a later one holds."""
    law = ("number", "content")
    for at, block in enumerate(blocks):
        if block.gone:
            continue
        parts = []
        for i, (text, note) in enumerate(block.parts):
            found = EFFECTIVE.search(text) if note else None
            if not found:
                parts.append((text, note))
                continue
            since = f"{found[3]}-{int(found[2]):02d}-{int(found[1]):02d}"
            marker = bool(MARKER.match(tidy(text)))
            if since > as_of:
                if marker and block.kind == "content":
                    block.gone = True
                    for other in blocks[at + 1 :]:
                        if other.kind in law and other.level <= block.level:
                            break
                        other.gone = other.gone or other.kind == "content"
            elif marker:
                if i == 0 and block.kind == "content":
                    _supersede(blocks, at, tidy("".join(t for t, _ in block.parts[1:])))
            else:
                parts.append((re.sub(r"\)$", "", LEAD.sub("", tidy(text))), False))
        block.parts = parts
    return [b for b in blocks if not b.gone]


def _supersede(blocks: list[Block], at: int, amended: str) -> None:
    between = []
    for other in reversed([b for b in blocks[:at] if not b.gone]):
        if other.kind in ("number", "content") and other.level > blocks[at].level:
            between.append(other)
        elif other.kind is not None:
            if other.kind == "content" and other.level == blocks[at].level and shares_wording(other.text(), amended):
                for b in (other, *between):
                    b.gone = True
            return


@dataclass
class Node:
    number: str
    title: str = ""
    content: str = ""
    children: list[Node] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.content = f"{self.content} {text}".strip()

    def lives(self) -> bool:
        """Prunes the children first; a node without any lives unless its text says that it is repealed or merged."""
        self.children = [c for c in self.children if c.lives()]
        self.content = tidy(self.content)
        return bool(self.children) or not (self.content in INACTIVE or self.content.startswith(MERGED))

    def rendered(self) -> str:
        return tidy(" ".join(x for x in (self.number, self.title, self.content, *(c.rendered() for c in self.children)) if x))


def blocks_of(html: str | None) -> list[Block]:
    page = Page()
    page.feed(html or "")
    page.close()
    return page.blocks


def sections_of(html: str | None, as_of: str) -> list[tuple[str, str]]:
    """(number, text) of the sections in force."""
    return outline(in_force(blocks_of(html), as_of))


def turns_of(blocks: list[Block]) -> list[str]:
    """The dates (YYYY-MM-DD) that notes of a page name, in order: between two of them no wording changes."""
    found = (EFFECTIVE.search(text) for block in blocks for text, note in block.parts if note)
    return sorted({f"{f[3]}-{int(f[2]):02d}-{int(f[1]):02d}" for f in found if f})


def outline(blocks: list[Block]) -> list[tuple[str, str]]:
    """(number, text) of the sections that blocks in force make up."""
    root = Node("")
    stack: list[tuple[int, Node]] = [(0, root)]
    pending: tuple[int, Node] | None = None
    appendix: Node | None = None
    for block in blocks:
        text = block.text()
        if block.kind == "h2":
            appendix, pending = (Node(text), None) if text.startswith(APPENDIX) else (None, pending)
            if appendix:
                root.children.append(appendix)
                stack = [(0, root), (1, appendix)]
        elif block.kind == "h3":
            if appendix and text and not appendix.title:
                appendix.title = text
        elif block.kind is None:
            if appendix and text and not text.startswith("[תיקון"):
                appendix.add(text)
        elif block.kind == "number":
            if number := tidy("".join(t for t, note in block.parts if not note)).removesuffix("."):
                while stack[-1][0] >= block.level and len(stack) > 1:
                    stack.pop()
                node = Node(number)
                stack[-1][1].children.append(node)
                stack.append((block.level, node))
                pending = (block.level, node)
        elif block.kind == "desc":
            if pending and text:
                pending[1].title = text
        elif pending and pending[0] == block.level:
            pending[1].add(text)
            pending = None
        elif text:
            stack[-1][1].add(text)
    root.children = [c for c in root.children if c.lives()]
    return [(c.number, c.rendered()) for c in root.children]


def split_text(text: str, most: int = MOST) -> list[str]:
    """Parts of at most ``most`` characters, cut at the last space in the second half, else hard."""
    out = []
    while len(text) > most:
        space = text.rfind(" ", 0, most + 1)
        end = space if space >= most / 2 else most
        out.append(text[:end].strip())
        text = text[end:].strip()
    return [*out, text] if text else out


def chunks(pages: DataFrame, as_of: str, key: str = "law_id", html: str = "html") -> DataFrame:
    """(key, ordinal, reference, section, text, hash): the chunks in force, in order. References repeat-proof by ``-INSTANCE-n``,
    parts by ``-Pn``; chunks under ``LEAST`` characters are left out before ordinals are given."""
    return _numbered(_sections(pages, lambda h: [(None, sections_of(h, as_of))], key, html), key).drop("since", "turn", "next")


#: Before all dates that a page names.
EARLIEST = "0001-01-01"


def _history(html: str | None) -> list[tuple[str, list[tuple[str, str]]]]:
    """(since, sections) of each time between dates that a page names; the page is read once."""
    blocks = blocks_of(html)
    copied = lambda: [Block(b.kind, b.level, list(b.parts), b.gone) for b in blocks]
    return [(since, outline(in_force(copied(), since))) for since in (EARLIEST, *turns_of(blocks))]


def chunk_intervals(pages: DataFrame, key: str = "law_id", html: str = "html") -> DataFrame:
    """(key, since, until, ordinal, reference, section, text, hash): each chunk with the dates from which and before which it stands like
    that; ``until`` is null for what still does. Times in which a chunk stays as it is are one row."""
    rows = _numbered(_sections(pages, _history, key, html), key)
    same = [key, "ordinal", "reference", "section", "text", "hash"]
    run = F.col("turn") - F.row_number().over(Window.partitionBy(*same).orderBy("turn"))
    runs = rows.withColumn("run", run).groupBy(*same, "run").agg(F.min("since").alias("since"), F.max(F.struct("turn", "next"))["next"].alias("until"))
    return runs.select(key, "since", "until", *same[1:])


def chunks_at(intervals: DataFrame, dates: DataFrame, key: str = "law_id", date: str = "as_of") -> DataFrame:
    """The chunks of ``chunk_intervals`` that stand on each date (key, date as YYYY-MM-DD) of ``dates``."""
    holds = (F.col("since") <= F.col(date)) & (F.col("until").isNull() | (F.col(date) < F.col("until")))
    return dates.join(intervals.hint("merge"), key).where(holds).drop("since", "until")


def _sections(pages: DataFrame, read: Callable[[str | None], list[tuple[str | None, list[tuple[str, str]]]]], key: str, html: str) -> DataFrame:
    """(key, since, turn, next, ord, section, parts) of what ``read`` makes of each page: ``turn`` numbers the page's times from 0, also one
    in which no section stands, and ``next`` is when the following one begins. A page's rows are dealt by its key once, for all that follows."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                times = read(h)
                begins = [since for since, _ in times]
                rows += [(k, since, turn, following, i, number, split_text(text)) for turn, ((since, found), following) in enumerate(zip(times, [*begins[1:], None], strict=True)) for i, (number, text) in enumerate(found)]
            kinds = (b.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [key, "since", "turn", "next", "ord", "section", "parts"])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, since string, turn int, next string, ord int, section string, parts array<string>").repartition(key)


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """(key, since, turn, next, ordinal, reference, section, text, hash) of the sections of each page and time."""
    base = F.concat(F.lit("IL-"), F.col(key).cast("string"), F.lit("-"), T.section_key("section", F.col("ord") + 1))
    rows = rows.withColumn("base", base)
    of = Window.partitionBy(key, "since", "base")
    unique = F.when(F.count(F.lit(1)).over(of) > 1, F.concat("base", F.lit("-INSTANCE-"), F.row_number().over(of.orderBy("ord")).cast("string"))).otherwise(F.col("base"))
    parts = rows.withColumn("unique", unique).select(key, "since", "turn", "next", "ord", "section", "unique", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "text")).where(F.length("text") >= LEAST)
    reference = F.when(F.col("n") == 1, F.col("unique")).otherwise(F.concat("unique", F.lit("-P"), (F.col("part") + 1).cast("string")))
    ordinal = F.row_number().over(Window.partitionBy(key, "since").orderBy("ord", "part")) - 1
    return parts.select(key, "since", "turn", "next", ordinal.alias("ordinal"), reference.alias("reference"), F.nullif("section", F.lit("")).alias("section"), "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))
