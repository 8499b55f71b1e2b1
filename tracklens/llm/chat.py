"""Chat formatting with a compiled template.

A small, sandboxed template language is parsed into a syntax tree, constants are folded, and the tree is compiled
into Python closures that render a conversation piece by piece.  Language: text, ``{{ expression }}``,
``{% for x in y %}``, ``{% if %} / {% elif %} / {% else %}``, ``{% set x = e %}``, ``{% generation %}`` (marks what
the assistant says; it is the loss mask), ``{# comment #}``.  Expressions: strings, integers, names, ``.field`` and
``['field']`` of mappings, ``+``, ``==``, ``!=``, ``and``, ``or``, ``not``, ``in``, parentheses and the filters ``trim``,
``upper``, ``lower``, ``length`` and ``escape``.  There are no calls and no attributes of Python objects, so a
template reaches nothing but its variables.

``escape`` puts a backslash after the ``<`` of every ``<|`` (after the backslashes already there), so control
strings cannot appear inside texts; ``unescape`` takes one away again.  Both are exact inverses.

Conversations are streamed: rows are dealt by conversation, sorted by turn, and a conversation is rendered turn by turn, so
its length is not bounded by memory.  Null texts and roles count as empty; repeated (conversation, turn) rows are all
formatted, ordered by role and text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, tasks_for, to_batch

CHATML = (
    "{% for message in messages %}<|im_start|>{{ message.role | escape }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content | escape }}{% endgeneration %}{% else %}{{ message.content | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)

PIECES = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.DOTALL)
LEXEMES = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[|.\[\]()+]))")
FILTERS: dict[str, Callable] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": lambda x: len(x), "escape": lambda x: escape(str(x))}
WORDS = {"and", "or", "not", "in", "true", "false"}


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


# ---- parsing: expressions become tuples ("const", v), ("name", n), ("field", e, f), ("filter", f, e), (operator, a, b)


class Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = LEXEMES.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def take(self, value: str | None = None) -> tuple[str | None, str]:
        kind, got = self.peek()
        if kind is None or value is not None and (got != value or kind == "text"):
            raise TemplateError(f"expected {value or 'an operand'}, found {got or 'the end'!r}")
        self.at += 1
        return kind, got

    def tree(self):
        e = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return e

    def chain(self, below: Callable, *signs: str):
        e = below()
        while self.peek()[0] in ("name", "sign") and self.peek()[1] in signs:
            sign = self.take()[1]
            e = (sign, e, below())
        return e

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.negated, "and")

    def negated(self):
        if self.peek() == ("name", "not"):
            self.take()
            return ("not", self.negated())
        return self.chain(self.sum, "==", "!=", "in")

    def sum(self):
        return self.chain(self.filtered, "+")

    def filtered(self):
        e = self.operand()
        while True:
            if self.peek() == ("sign", "|"):
                self.take()
                name = self.take()[1]
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                e = ("filter", name, e)
            elif self.peek() == ("sign", "."):
                self.take()
                kind, name = self.take()
                if kind != "name":
                    raise TemplateError("a field name must follow '.'")
                e = ("field", e, ("const", name))
            elif self.peek() == ("sign", "["):
                self.take()
                e = ("field", e, self.either())
                self.take("]")
            else:
                return e

    def operand(self):
        kind, got = self.take()
        if kind == "text":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), got[1:-1], flags=re.DOTALL))
        if kind == "number":
            return ("const", int(got))
        if kind == "name" and got in ("true", "false"):
            return ("const", got == "true")
        if kind == "name" and got not in WORDS:
            return ("name", got)
        if (kind, got) == ("sign", "("):
            e = self.either()
            self.take(")")
            return e
        raise TemplateError(f"unexpected {got!r}")


def parse(template: str) -> list:
    """Statements: ("out", e), ("for", name, e, body), ("if", [(e, body), ...]), ("set", name, e), ("generation", body)."""
    root: list = []
    stack: list[tuple[str, list, list]] = [("", root, [])]  # (closing word, body, statement)
    at = 0
    for m in [*PIECES.finditer(template), None]:
        text = template[at : m.start() if m else len(template)]
        if text:
            stack[-1][1].append(("out", ("const", text)))
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("out", Expression(m[1]).tree()))
        elif m[2] is not None:
            head, _, rest = m[2].strip().partition(" ")
            if head == "for":
                f = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
                if not f:
                    raise TemplateError(f"bad for: {rest!r}")
                body: list = []
                stack[-1][1].append(("for", f[1], Expression(f[2]).tree(), body))
                stack.append(("endfor", body, []))
            elif head == "if":
                body, arms = [], []
                arms.append((Expression(rest).tree(), body))
                stack[-1][1].append(("if", arms))
                stack.append(("endif", body, arms))
            elif head in ("elif", "else"):
                if stack[-1][0] != "endif":
                    raise TemplateError(f"{head} outside if")
                _, _, arms = stack.pop()
                body = []
                arms.append((Expression(rest).tree() if head == "elif" else ("const", True), body))
                stack.append(("endif", body, arms))
            elif head == "set":
                f = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.DOTALL)
                if not f:
                    raise TemplateError(f"bad set: {rest!r}")
                stack[-1][1].append(("set", f[1], Expression(f[2]).tree()))
            elif head == "generation":
                body = []
                stack[-1][1].append(("generation", body))
                stack.append(("endgeneration", body, []))
            elif len(stack) > 1 and head == stack[-1][0]:
                stack.pop()
            else:
                raise TemplateError(f"unexpected {head!r}")
    if len(stack) > 1:
        raise TemplateError(f"missing {stack[-1][0]}")
    return root


# ---- folding


def fold_expression(e):
    if e[0] in ("const", "name"):
        return e
    if e[0] == "filter":
        inner = fold_expression(e[2])
        return ("const", FILTERS[e[1]](inner[1])) if inner[0] == "const" else ("filter", e[1], inner)
    parts = [fold_expression(x) for x in e[1:]]
    if e[0] != "field" and all(p[0] == "const" for p in parts):
        return ("const", evaluate((e[0], *parts))({}))
    if e[0] in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (e[0] == "and") else parts[0]
    return (e[0], *parts)


def fold(body: list) -> list:
    """Constant expressions computed, dead branches dropped, neighbouring constant texts joined."""
    out: list = []

    def put(s) -> None:
        if s[0] == "out" and s[1][0] == "const":
            if out and out[-1][0] == "out" and out[-1][1][0] == "const":
                s = ("out", ("const", out.pop()[1][1] + s[1][1]))
            if not s[1][1]:
                return
        out.append(s)

    for s in body:
        if s[0] == "out":
            e = fold_expression(s[1])
            if e[0] == "const":
                e = ("const", shown(e[1]))
            put(("out", e))
        elif s[0] == "for":
            out.append(("for", s[1], fold_expression(s[2]), fold(s[3])))
        elif s[0] == "set":
            out.append(("set", s[1], fold_expression(s[2])))
        elif s[0] == "generation":
            out.append(("generation", fold(s[1])))
        else:
            arms = []
            for e, b in s[1]:
                e = fold_expression(e)
                if e[0] == "const" and not e[1]:
                    continue
                arms.append((e, fold(b)))
                if e[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    put(x)
            elif arms:
                out.append(("if", arms))
    return out


# ---- compiling


def shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def evaluate(e) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda v, c=e[1]: c
    if kind == "name":
        return lambda v, n=e[1]: v.get(n)
    if kind == "filter":
        return lambda v, f=FILTERS[e[1]], x=evaluate(e[2]): f("" if (got := x(v)) is None else got)
    if kind == "not":
        return lambda v, x=evaluate(e[1]): not x(v)
    a, b = evaluate(e[1]), evaluate(e[2])
    if kind == "field":
        return lambda v: x.get(b(v)) if isinstance(x := a(v), dict) else None
    if kind == "and":
        return lambda v: a(v) and b(v)
    if kind == "or":
        return lambda v: a(v) or b(v)
    if kind == "==":
        return lambda v: a(v) == b(v)
    if kind == "!=":
        return lambda v: a(v) != b(v)
    if kind == "in":
        return lambda v: a(v) in (b(v) or ())
    return lambda v: x + y if isinstance(x := a(v), int) and isinstance(y := b(v), int) else shown(a(v)) + shown(b(v))


def close_over(body: list) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    """A closure that yields (text, inside a generation marker) for its variables."""
    steps = [statement(s) for s in body]

    def run(v: dict, mask: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(v, mask)

    return run


def statement(s) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    if s[0] == "out":
        value = evaluate(s[1])

        def out(v, mask):
            if text := shown(value(v)):
                yield text, mask

        return out
    if s[0] == "set":

        def put(v, mask, name=s[1], value=evaluate(s[2])):
            v[name] = value(v)
            return iter(())

        return put
    if s[0] == "generation":
        inner = close_over(s[1])
        return lambda v, mask: inner(v, True)
    if s[0] == "for":
        many, inner = evaluate(s[2]), close_over(s[3])

        def loop(v, mask, name=s[1]):
            for x in many(v) or ():  # any iterable: a conversation may still be arriving
                v[name] = x
                yield from inner(v, mask)

        return loop
    arms = [(evaluate(e), close_over(b)) for e, b in s[1]]

    def branch(v, mask):
        for test, inner in arms:
            if test(v):
                yield from inner(v, mask)
                return

    return branch


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    run = close_over(fold(parse(template)))
    return lambda messages, **more: run({"messages": messages, **more}, False)


# ---- on Spark


class Turns:
    """Reads formatted output back: feeds on rendered pieces, gives (role, text) for every finished turn."""

    START, END = "<|im_start|>", "<|im_end|>\n"

    def __init__(self):
        self.rest: list[str] = []

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.rest.append(piece)
        if "|>" not in piece:
            return
        text = "".join(self.rest)
        while (end := text.find(self.END)) >= 0:
            if not text.startswith(self.START):
                raise ValueError("the output does not start with a turn")
            role, _, content = text[len(self.START) : end].partition("\n")
            yield unescape(role), unescape(content)
            text = text[end + len(self.END) :]
        self.rest = [text] if text else []


def ordered(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    slim = conversations.select(F.col(f"`{conv}`").cast("long").alias("c"), F.col(f"`{turn}`").cast("long").alias("t"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("r"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("x"))
    return slim.repartition(tasks_for(slim), "c").sortWithinPartitions("c", "t", "r", "x")


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
    for c, own in groupby(rows, key=lambda r: r[0]):
        yield c, ({"role": r, "content": x} for _, _, r, x in own)


def format_conversations(conversations: DataFrame, template: str = CHATML, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv_id, the formatted text and the loss spans (start, end code points of generation markers)."""
    slim = ordered(conversations, conv, turn, role, text)
    ddl = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"
    schema = arrow_schema(slim, ddl)

    def run(batches):
        render = compile_template(template)
        for c, messages in streamed(batches):
            out, spans, at = [], [], 0
            for piece, loss in render(messages):
                out.append(piece)
                if loss:
                    spans.append({"start": at, "end": at + len(piece)})
                at += len(piece)
            yield to_batch([(c, "".join(out), spans)], schema)

    return slim.mapInArrow(run, ddl)


def digest_conversations(conversations: DataFrame, template: str = CHATML, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Counts and digests of what the formatted output gives back, without holding a conversation in memory."""
    slim = ordered(conversations, conv, turn, role, text)
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = arrow_schema(slim, ddl)

    def run(batches):
        render, out = compile_template(template), []
        for c, messages in streamed(batches):
            turns, loss, reader = hashlib.sha256(), hashlib.sha256(), Turns()
            n = loss_chars = chars = 0
            for piece, masked in render(messages):
                chars += len(piece)
                for r, x in reader.feed(piece):
                    n += 1
                    turns.update(f"{r}\n{x}\n".encode("utf-8", "surrogatepass"))
                if masked:
                    said = unescape(piece)
                    loss_chars += len(said)
                    loss.update(said.encode("utf-8", "surrogatepass"))
            out.append((c, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 1000:
                yield to_batch(out, schema)
                out = []
        if out:
            yield to_batch(out, schema)

    return slim.mapInArrow(run, ddl)
