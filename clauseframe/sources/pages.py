"""HTML pages to rows: headings and paragraphs with their path. The markup is a tree, so it is read page by page in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.streams import small

LEVELS = {f"h{i}": i for i in range(1, 7)}
BLOCKS = {"p", "li", "td", "blockquote", *LEVELS}
SKIPPED = {"script", "style", "noscript", "template"}


class Sections(HTMLParser):
    """Collects (level, path, text): level 0 for a text block, 1 to 6 for a heading; path are the headings above it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, list[str], str]] = []
        self.above: list[tuple[int, str]] = []
        self.level, self.parts, self.skipped = 0, [], 0

    def close_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if not text:
            return
        if self.level:
            while self.above and self.above[-1][0] >= self.level:
                self.above.pop()
        self.rows.append((self.level, [t for _, t in self.above], text))
        if self.level:
            self.above.append((self.level, text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skipped += 1
        elif tag in BLOCKS:
            self.close_block()
            self.level = LEVELS.get(tag, 0)
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag in BLOCKS:
            self.close_block()
            self.level = 0

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)


def sections_of(html: str | None) -> list[tuple[int, list[str], str]]:
    parser = Sections()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser.rows


def sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, ord, level, path, text) of every heading and block. A null page has none."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = [(k, i, *r) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, r in enumerate(sections_of(h))]
            kinds = (b.schema.field(0).type, pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [key, "ord", "level", "path", "text"])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, ord int, level int, path array<string>, text string")
