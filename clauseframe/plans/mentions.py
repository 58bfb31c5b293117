"""All phrases of a lexicon found in one scan: texts become words, each distinct word is looked at once, and a tree of words follows them.

The phrases are those of ``lexicon.phrases.any_of`` and mean the same: ``Phrases.found`` gives what each name's pattern would match, from left to
right without overlaps, the longest phrase first where several begin at one place. The cost is one step a word and one a phrase that a word may
begin, however many names there are; the patterns would each read the text again. Texts go through Arrow batches, row by row, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from ..lexicon.phrases import MOST_PREFIXES, PREFIX_LETTERS

#: White space that may stand between the words of a phrase.
SPACE = " \t\n\x0b\f\r"
_RUN = re.compile(r"[^\W\d_]+")
#: Distinct words that a task remembers at most.
MOST_WORDS = 200_000


def folded(word: str) -> str:
    """The word without regard to case, character by character, as patterns compare it."""
    if word.isascii():
        return word.lower()
    upper = (c.upper() if len(c.upper()) == 1 else c for c in word)
    return "".join(c.lower()[0] for c in upper)


def runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of each run of letters."""
    out = []
    for m in _RUN.finditer(text):
        if m.group().isalpha():
            out.append(m.span())
        else:  # a number sign that the pattern takes for a letter
            at = m.start()
            for letter, part in groupby(m.group(), str.isalpha):
                n = len(list(part))
                if letter:
                    out.append((at, at + n))
                at += n
    return out


class Phrases:
    """(name, phrases) pairs as one tree of words; names are told by their place in the list, so they may repeat."""

    def __init__(self, named: Iterable[tuple[object, tuple[str, ...]]]):
        #: word -> number, of words that stand alone and of words that may go on
        self.whole: dict[str, int] = {}
        self.open: dict[str, int] = {}
        #: node -> ({word: node}, [(name, rank)] of the phrases that end there)
        self.nodes: list[tuple[dict[int, int], list[tuple[int, int]]]] = [({}, [])]
        self.kinds: dict[str, tuple[int, ...]] = {}
        self.size = 0
        for name, (_, phrases) in enumerate(named):
            for rank, phrase in enumerate(sorted(phrases, key=len, reverse=True)):
                self._add(name, rank, phrase)
            self.size = name + 1
        self.longest = max(map(len, self.open), default=0)

    def _add(self, name: int, rank: int, phrase: str) -> None:
        at = 0
        for word in phrase.split():
            bare = folded(word.rstrip("*"))
            if not bare.isalpha():
                raise ValueError(f"{phrase!r} has more than letters")
            words = self.open if word.endswith("*") else self.whole
            number = words.setdefault(bare, len(self.whole) + len(self.open))
            nexts = self.nodes[at][0]
            if number not in nexts:
                nexts[number] = len(self.nodes)
                self.nodes.append(({}, []))
            at = nexts[number]
        self.nodes[at][1].append((name, rank))

    def _kinds(self, word: str) -> tuple[int, ...]:
        """The numbers of the tree's words that a word of a text can be."""
        low, out = folded(word), set()
        for cut in range(MOST_PREFIXES + 1):
            rest = low[cut:]
            if rest in self.whole:
                out.add(self.whole[rest])
            out.update(self.open[rest[:n]] for n in range(1, min(len(rest), self.longest) + 1) if rest[:n] in self.open)
            if low[cut : cut + 1] not in PREFIX_LETTERS:
                break
        return tuple(out)

    def kinds_of(self, word: str) -> tuple[int, ...]:
        found = self.kinds.get(word)
        if found is None:
            if len(self.kinds) >= MOST_WORDS:
                self.kinds.clear()
            found = self.kinds[word] = self._kinds(word)
        return found

    def found(self, text: str | None) -> list[tuple[int, int, int]]:
        """(name, start, end) of every match, by start and name."""
        spans = runs(text or "")
        kinds = [self.kinds_of(text[s:e]) for s, e in spans]
        free, out, last = [0] * self.size, [], len(spans) - 1
        for i, (start, _) in enumerate(spans):
            best: dict[int, tuple[int, int]] = {}
            at, j = [0], i
            while at and kinds[j]:
                at = [self.nodes[node][0][k] for node in at for k in kinds[j] if k in self.nodes[node][0]]
                end = spans[j][1]
                for node in at:
                    for name, rank in self.nodes[node][1]:
                        best[name] = min(best.get(name, (rank, end)), (rank, end))
                if j == last or text[end : spans[j + 1][0]].strip(SPACE):
                    break
                j += 1
            for name in sorted(best):
                if start >= free[name]:
                    free[name] = best[name][1]
                    out.append((name, start, free[name]))
        return out


def _scan(df: DataFrame, keys: list[str], texts: tuple[str, ...], named: list[tuple[object, tuple[str, ...]]], more: dict[str, str], rows_of) -> DataFrame:  # noqa: ANN001
    slim = df.select(*keys, *texts)
    kinds = {"string": pa.string(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(named)
        for batch in batches:
            at, rows = [], []
            columns = [batch.column(t).to_pylist() for t in texts]
            for i in range(batch.num_rows):
                for t, values in zip(texts, columns, strict=True):
                    new = rows_of(t, values[i], phrases.found(values[i]))
                    rows += new
                    at += [i] * len(new)
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[i] for r in rows], kinds[k]) for i, k in enumerate(more.values()))], [*keys, *more])

    told = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name in keys), *(f"`{n}` {k}" for n, k in more.items())])
    return slim.mapInArrow(run, told)


def mentions(df: DataFrame, keys: list[str], text: str, named: list[tuple[object, tuple[str, ...]]]) -> DataFrame:
    """(keys, name, at, hit): every match, ``name`` as its place in ``named`` and ``at`` from 1. A null text has none."""
    return _scan(df, keys, (text,), named, {"name": "int", "at": "int", "hit": "string"}, lambda _, value, found: [(n, s + 1, value[s:e]) for n, s, e in found])


def counts(df: DataFrame, keys: list[str], texts: tuple[str, ...], named: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """(keys, field, name, n): how often each name occurs in each of the columns ``texts``, those that do."""

    def rows_of(field: str, _: str | None, found: list[tuple[int, int, int]]) -> list[tuple[str, str, int]]:
        n: dict[str, int] = {}
        for name, _s, _e in found:
            n[named[name][0]] = n.get(named[name][0], 0) + 1
        return [(field, name, k) for name, k in n.items()]

    return _scan(df, keys, texts, named, {"field": "string", "name": "string", "n": "int"}, rows_of)


def noted(df: DataFrame, text: str, named: list[tuple[object, tuple[str, ...]]]) -> DataFrame:
    """``df`` with ``hits``, array<struct<name, at, end>> of every match as ``mentions`` has it; ``end`` is the place after it."""
    kind = pa.list_(pa.struct([("name", pa.int32()), ("at", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(named)
        for batch in batches:
            hits = [[{"name": n, "at": s + 1, "end": e + 1} for n, s, e in phrases.found(value)] for value in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], [*batch.schema.names, "hits"])

    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{told}, hits array<struct<name:int,at:int,end:int>>")


def tallied(df: DataFrame, texts: tuple[str, ...], named: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """``df`` with, for each of the columns ``texts``, a column ``…_n``, array<struct<name, n>>: how often each name occurs, those that do."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(named)

        def tally(text: str | None) -> list[dict[str, object]]:
            n: dict[str, int] = {}
            for name, _s, _e in phrases.found(text):
                n[named[name][0]] = n.get(named[name][0], 0) + 1
            return [{"name": name, "n": k} for name, k in n.items()]

        for batch in batches:
            more = [pa.array(map(tally, batch.column(t).to_pylist()), kind) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *(f"{t}_n" for t in texts)])

    told = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"{t}_n array<struct<name:string,n:int>>" for t in texts)])
    return df.mapInArrow(run, told)
