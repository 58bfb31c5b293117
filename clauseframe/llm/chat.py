"""Chat formatting with a small compiled template language.

A template is parsed into a tree, constants are folded, and each node becomes a Python closure. The language has text,
``{{ expression }}``, ``{% for x in list %}``, ``{% if %} / {% elif %} / {% else %}``, ``{% set x = expression %}`` and
``{% generation %}``, whose text is under the loss mask. A ``-`` inside a tag's edge trims the white space beside it.
Expressions are literals, names, ``a.key``, ``a['key']``, ``not``, ``and``, ``or``, ``==``, ``!=``, ``+``, parentheses and
``| filter``. It is sandboxed by what it lacks: no calls, no attributes of Python objects, no imports, no unbounded loop.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

TURN_TEMPLATE = (
    "{% for m in messages %}<s>[ROLE]{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}</s>{% endfor %}"
)
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]")


class TemplateError(ValueError):
    """The template is not in the language."""


def escaper(controls: Iterable[str]) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """(escape, unescape): a backslash more, or less, after the first character of each control string.

    The first characters must not occur later in any control string, so that no two occurrences overlap.
    """
    heads = sorted({c[0] for c in controls})
    if any(h in c[1:] for h in heads for c in controls) or any(len(c) < 2 or "\\" in c for c in controls):
        raise ValueError("control strings must not overlap, hold a backslash or be one character long")
    either = "|".join(f"(?<={re.escape(h)})(\\\\*)(?={'|'.join(re.escape(c[1:]) for c in sorted(controls) if c[0] == h)})" for h in heads)
    more, less = re.compile(either), re.compile(either.replace("(\\\\*)", "\\\\(\\\\*)"))
    return lambda s: more.sub(lambda m: m[0] + "\\", s), lambda s: less.sub(lambda m: m[0][1:], s)


# ---- parsing -------------------------------------------------------------------------------------------------------

TAG = re.compile(r"(\s*)\{%-|\{%|(\s*)\{\{-|\{\{")
LEX = re.compile(r"\s*(?:(?P<string>'[^']*'|\"[^\"]*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+|.()\[\]=]))")
WORDS = {"and", "or", "not", "in", "true", "false", "none"}


def chunks(source: str) -> Iterator[tuple[str, str]]:
    """('text' | 'tag' | 'print', content), white space trimmed as the tags ask."""
    at, trim = 0, False
    while at < len(source):
        m = TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if trim else text
        if text:
            yield "text", text
        if not m:
            return
        kind, close = ("tag", "%}") if "%" in m[0] else ("print", "}}")
        end = source.find(close, m.end())
        if end < 0:
            raise TemplateError(f"no {close} after {m[0].strip()}")
        body = source[m.end() : end]
        trim = body.endswith("-")
        yield kind, body[:-1] if trim else body
        at = end + 2


class Expression:
    """Recursive descent over one expression; gives ('const', value), ('name', n), ('get', a, key) and so on."""

    def __init__(self, source: str):
        self.items, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = LEX.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.items.append(("end", ""))
        self.at = 0

    def take(self, *values: str) -> str | None:
        kind, value = self.items[self.at]
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing before {self.items[self.at][1]!r}")

    def name(self) -> str:
        kind, value = self.items[self.at]
        if kind != "name" or value in WORDS:
            raise TemplateError(f"a name is missing before {value!r}")
        self.at += 1
        return value

    def whole(self) -> tuple:
        out = self.either()
        if self.items[self.at][0] != "end":
            raise TemplateError(f"not understood: {self.items[self.at][1]!r}")
        return out

    def either(self) -> tuple:
        out = self.both()
        while self.take("or"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.negated()
        while self.take("and"):
            out = ("and", out, self.negated())
        return out

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        out = self.joined()
        if op := self.take("==", "!="):
            out = (op, out, self.joined())
        return out

    def joined(self) -> tuple:
        out = self.filtered()
        while self.take("+"):
            out = ("+", out, self.filtered())
        return out

    def filtered(self) -> tuple:
        out = self.atom()
        while self.take("|"):
            out = ("filter", self.name(), out)
        return out

    def atom(self) -> tuple:
        kind, value = self.items[self.at]
        if self.take("("):
            out = self.either()
            self.need(")")
        elif kind in ("string", "number"):
            self.at += 1
            out = ("const", value[1:-1] if kind == "string" else int(value))
        elif word := self.take("true", "false", "none"):
            out = ("const", {"true": True, "false": False, "none": None}[word])
        else:
            out = ("name", self.name())
        while op := self.take(".", "["):
            if op == ".":
                out = ("get", out, ("const", self.name()))
            else:
                out = ("get", out, self.either())
                self.need("]")
        return out


def parse(source: str) -> list[tuple]:
    """The template's tree: a list of nodes."""
    stream = chunks(source)

    def block(*ends: str) -> tuple[list[tuple], str]:
        nodes: list[tuple] = []
        for kind, body in stream:
            if kind == "text":
                nodes.append(("text", body))
            elif kind == "print":
                nodes.append(("print", Expression(body).whole()))
            else:
                word, _, rest = body.strip().partition(" ")
                if word in ends:
                    return nodes, body.strip()
                nodes.append(tag(word, rest))
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return nodes, ""

    def branches(condition: str) -> tuple:
        then, end = block("elif", "else", "endif")
        word, _, rest = end.partition(" ")
        other = [branches(rest)] if word == "elif" else block("endif")[0] if word == "else" else []
        return ("if", Expression(condition).whole(), then, other)

    def tag(word: str, rest: str) -> tuple:
        if word == "for":
            head = Expression(rest)
            name = head.name()
            head.need("in")
            return ("for", name, head.whole(), block("endfor")[0])
        if word == "if":
            return branches(rest)
        if word == "set":
            head = Expression(rest)
            name = head.name()
            head.need("=")
            return ("set", name, head.whole())
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


# ---- constants -----------------------------------------------------------------------------------------------------


def folded(e: tuple, filters: dict[str, Callable]) -> tuple:
    """The expression with every part that depends on nothing replaced by its value."""
    if e[0] in ("const", "name"):
        return e
    if e[0] == "filter":
        if e[1] not in filters:
            raise TemplateError(f"unknown filter {e[1]!r}")
        e = ("filter", e[1], folded(e[2], filters))
        parts = e[2:]
    else:
        e = (e[0], *(folded(x, filters) for x in e[1:]))
        parts = e[1:]
    return ("const", expression(e, filters)({})) if all(x[0] == "const" for x in parts) else e


def fold(nodes: list[tuple], filters: dict[str, Callable]) -> list[tuple]:
    """Constants printed as text, decided branches inlined, neighbouring texts joined."""
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "print":
            e = folded(node[1], filters)
            new = [("text", shown(e[1]))] if e[0] == "const" else [("print", e)]
        elif node[0] == "if":
            e, then, other = folded(node[1], filters), fold(node[2], filters), fold(node[3], filters)
            new = (then if e[1] else other) if e[0] == "const" else [("if", e, then, other)]
        elif node[0] == "for":
            new = [("for", node[1], folded(node[2], filters), fold(node[3], filters))]
        elif node[0] == "set":
            new = [("set", node[1], folded(node[2], filters))]
        elif node[0] == "generation":
            new = [("generation", fold(node[1], filters))]
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


# ---- closures ------------------------------------------------------------------------------------------------------


def shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def looked_up(value: object, key: object) -> object:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, list) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return None


def added(a: object, b: object) -> object:
    return a + b if isinstance(a, int) and isinstance(b, int) else shown(a) + shown(b)


def expression(e: tuple, filters: dict[str, Callable]) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    if kind == "filter":
        f, a = filters[e[1]], expression(e[2], filters)
        return lambda env: f(a(env))
    a = expression(e[1], filters)
    if kind == "not":
        return lambda env: not a(env)
    b = expression(e[2], filters)
    return {
        "get": lambda env: looked_up(a(env), b(env)),
        "and": lambda env: a(env) and b(env),
        "or": lambda env: a(env) or b(env),
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
        "+": lambda env: added(a(env), b(env)),
    }[kind]


class Output:
    """The text so far, its length, and the spans under the loss mask."""

    def __init__(self):
        self.parts: list[str] = []
        self.n, self.spans, self.depth = 0, [], 0

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.n += len(text)


def statement(node: tuple, filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    if node[0] == "text":
        return lambda env, out, t=node[1]: out.put(t)
    if node[0] == "print":
        e = expression(node[1], filters)
        return lambda env, out: out.put(shown(e(env)))
    if node[0] == "set":
        e = expression(node[2], filters)
        return lambda env, out: env.__setitem__(node[1], e(env))
    if node[0] == "if":
        e, then, other = expression(node[1], filters), sequence(node[2], filters), sequence(node[3], filters)
        return lambda env, out: then(env, out) if e(env) else other(env, out)
    if node[0] == "for":
        e, body = expression(node[2], filters), sequence(node[3], filters)

        def loop(env: dict, out: Output) -> None:
            items = e(env)
            items = items if isinstance(items, list) else []
            for i, x in enumerate(items):
                own = env | {node[1]: x, "loop": {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}}
                body(own, out)

        return loop
    body = sequence(node[1], filters)

    def generation(env: dict, out: Output) -> None:
        start, out.depth = out.n, out.depth + 1
        body(env, out)
        out.depth -= 1
        if not out.depth and out.n > start:
            out.spans.append((start, out.n))

    return generation


def sequence(nodes: list[tuple], filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    steps = [statement(x, filters) for x in nodes]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


def compiled(source: str, controls: Iterable[str] = CONTROLS) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """messages -> (text, spans under the loss mask: code points, end exclusive)."""
    filters = {"escape": (lambda f: lambda x: f(shown(x)))(escaper(controls)[0]), "trim": lambda x: shown(x).strip(), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower()}
    body = sequence(fold(parse(source), filters), filters)

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        body({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


# ---- Spark ---------------------------------------------------------------------------------------------------------


def format_chats(turns: DataFrame, template: str = TURN_TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): conv_id, formatted, loss (array of start, end).

    One shuffle on conv_id; each task then streams its sorted turns and holds one conversation at a time. Order: turn
    (null first), then role and text, so ties and repeated rows come out alike every time; each repeated row is a turn. A
    null text or role counts as empty. Turns with a null conv_id make one conversation. Other columns are not read. An
    empty table gives an empty table. A conversation is one text, so it has to fit a row, as its formatted text does.
    """
    compiled(template, controls)  # an error shows here, not in a task
    spark = turns.sparkSession
    by = ["conv_id", "turn", "role", "text"]
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.large_string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template, controls)
        current: list[dict] = []
        conv: int | None = None
        done: list[tuple] = []

        def close() -> None:
            if current:
                text, spans = render(current)
                done.append((conv, text, [{"start": s, "end": e} for s, e in spans]))
                current.clear()

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)
            done.clear()
            return batch

        for batch in batches:
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if c != conv:
                    close()
                    conv = c
                current.append({"role": role or "", "text": text or ""})
            if len(done) >= 1000:
                yield flushed()
        close()
        if done:
            yield flushed()

    ordered = turns.select(*by).repartition(partitions(spark), "conv_id").sortWithinPartitions(*by)
    return ordered.mapInArrow(run, "conv_id long, formatted string, loss array<struct<start:int,end:int>>")


TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](?:\[INST\](.*?)\[/INST\]|(.*?))</s>", re.DOTALL)


def read_back(text: str, controls: Iterable[str] = CONTROLS) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that ``TURN_TEMPLATE`` made."""
    unescape = escaper(controls)[1]
    return [(unescape(m[1]), unescape(m[2] if m[2] is not None else m[3])) for m in TURN.finditer(text)]


def chat_digest(turns: DataFrame) -> DataFrame:
    """The contract's columns, read back from what ``format_chats`` made."""
    formatted = format_chats(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unescape = escaper(CONTROLS)[1]
        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                back = read_back(text)
                rows.append((conv, len(back), "".join(f"{r}\n{t}\n" for r, t in back), "".join(unescape(text[s["start"] : s["end"]]) for s in loss), len(text)))
            names = ("conv_id", "n_turns", "turns", "loss", "formatted_chars")
            kinds = (pa.int64(), pa.int64(), pa.large_string(), pa.large_string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))

    back = formatted.mapInArrow(run, "conv_id long, n_turns long, turns string, loss string, formatted_chars long")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select("conv_id", "n_turns", digest("turns").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest("loss").alias("loss_sha256"), "formatted_chars")
