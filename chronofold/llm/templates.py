"""Operator 10: chat formatting with a compiled, sandboxed template language.

The language has literal text, `{{ expression }}`, `{% for x in y %}`, `{% if %} {% elif %} {% else %}`, `{% set x = e %}`
and `{% generation %} ... {% endgeneration %}`. Expressions are strings, integers, names, `a.b` (fields of a row and of
`loop` only), `==`, `!=`, `+`, `and`, `or`, `not`, parentheses and the filters `escape`, `line`, `trim`, `upper` and `lower`. There are
no calls, indexes or other attributes, so a template reaches nothing but the conversation. The source becomes a syntax
tree, constant parts are folded, and the tree becomes Python closures. A rendered conversation is a stream of
(text, under the generation marker) segments, so that even a conversation of very many turns needs the memory of one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import batch

CHATML = (
    "{% for message in messages %}{{ '<|im_start|>' + (message.role | line) + '\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}{{ '<|im_end|>' + '\n' }}{% endfor %}"
)


class TemplateError(ValueError):
    """The template uses what the language does not have."""


def escape(text: str) -> str:
    """Breaks every control string of a text: a backslash becomes two, `<|` gets one between."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def line(text: str) -> str:
    """As escape(), on one line."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    """The text that escape() or line() was given."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "line": line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


# --- syntax tree ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: str
    name: str


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: str
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition or None, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|().]))", re.S)


class Expression:
    """A recursive-descent reader of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"cannot read {source[at:]!r}")
            at = m.end()
            text, number, name, sign = m.groups()
            self.tokens.append(("text", text) if text else ("number", number) if number else ("name", name) if name else ("sign", sign))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or value is not None and token[1] != value:
            raise TemplateError(f"expected {value or 'more'}, found {token[1]!r}")
        self.at += 1
        return token

    def whole(self) -> object:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self) -> object:
        node = self.both()
        while self.peek() == ("name", "or"):
            self.take()
            node = Op("or", (node, self.both()))
        return node

    def both(self) -> object:
        node = self.negated()
        while self.peek() == ("name", "and"):
            self.take()
            node = Op("and", (node, self.negated()))
        return node

    def negated(self) -> object:
        if self.peek() == ("name", "not"):
            self.take()
            return Op("not", (self.negated(),))
        return self.compared()

    def compared(self) -> object:
        node = self.joined()
        while self.peek()[1] in ("==", "!=") and self.peek()[0] == "sign":
            kind = self.take()[1]
            node = Op(kind, (node, self.joined()))
        return node

    def joined(self) -> object:
        node = self.filtered()
        while self.peek() == ("sign", "+"):
            self.take()
            node = Op("+", (node, self.filtered()))
        return node

    def filtered(self) -> object:
        node = self.atom()
        while self.peek() == ("sign", "|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Filter(name, node)
        return node

    def atom(self) -> object:
        kind, value = self.take()
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(value))
        if kind == "name":
            if value in ("true", "false"):
                return Const(value == "true")
            if self.peek() == ("sign", "."):
                self.take()
                field = self.take()
                if field[0] != "name" or field[1].startswith("_"):
                    raise TemplateError(f"no field {field[1]!r}")
                return Field(value, field[1])
            return Name(value)
        if value == "(":
            node = self.either()
            self.take(")")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in TAG.finditer(source):
        parts += [("text", source[at : m.start()]), ("output", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    parts.append(("text", source[at:]))
    place = 0

    def body(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal place
        out: list = []
        while place < len(parts):
            kind, text = parts[place]
            place += 1
            if kind == "text":
                out += [Output(Const(text))] if text else []
            elif kind == "output":
                out.append(Output(Expression(text).whole()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return tuple(out), text
                out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), ""

    def statement(word: str, rest: str) -> object:
        if word == "for":
            m = re.fullmatch(r"(\w+) in (\w+)", rest.strip())
            if not m:
                raise TemplateError(f"cannot read for {rest!r}")
            return For(m[1], m[2], body(("endfor",))[0])
        if word == "set":
            name, _, value = rest.partition("=")
            if not name.strip().isidentifier():
                raise TemplateError(f"cannot set {name!r}")
            return Assign(name.strip(), Expression(value).whole())
        if word == "generation":
            return Generation(body(("endgeneration",))[0])
        if word == "if":
            branches, condition, end = [], Expression(rest).whole(), ""
            while end != "endif":
                inner, end = body(("elif", "else", "endif"))
                branches.append((condition, inner))
                if end.startswith("elif"):
                    condition = Expression(end[4:]).whole()
                elif end == "else":
                    inner, end = body(("endif",))
                    branches.append((None, inner))
            return If(tuple(branches))
        raise TemplateError(f"no statement {word!r}")

    return body(())[0]


# --- constant folding ------------------------------------------------------------------------------------------


def apply(kind: str, args: list) -> object:
    if kind == "+":
        return args[0] + args[1] if type(args[0]) is type(args[1]) else f"{args[0]}{args[1]}"
    return {"==": args[0] == args[-1], "!=": args[0] != args[-1], "not": not args[0], "and": args[0] and args[-1], "or": args[0] or args[-1]}[kind]


def fold(node: object) -> object:
    """The expression with all constant parts computed; joins of constants meet even across a name."""
    if isinstance(node, Filter):
        arg = fold(node.arg)
        return Const(FILTERS[node.name](str(arg.value))) if isinstance(arg, Const) else replace(node, arg=arg)
    if not isinstance(node, Op):
        return node
    args = tuple(fold(a) for a in node.args)
    if all(isinstance(a, Const) for a in args):
        return Const(apply(node.kind, [a.value for a in args]))
    if node.kind == "+" and isinstance(args[1], Const) and isinstance(args[0], Op) and args[0].kind == "+":
        left, last = args[0].args
        if isinstance(last, Const) and isinstance(last.value, str) and isinstance(args[1].value, str):
            return Op("+", (left, Const(last.value + args[1].value)))
    if node.kind in ("and", "or") and isinstance(args[0], Const):
        return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
    return Op(node.kind, args)


def folded(body: tuple) -> tuple:
    """The statements with folded expressions, decided branches taken and neighbouring constants joined."""
    out: list = []
    for s in body:
        if isinstance(s, (Output, Assign)):
            s = replace(s, value=fold(s.value))
        elif isinstance(s, (For, Generation)):
            s = replace(s, body=folded(s.body))
        elif isinstance(s, If):
            kept: list = []
            for condition, inner in s.branches:
                condition = fold(condition) if condition is not None else None
                if isinstance(condition, Const) and not condition.value:
                    continue
                always = condition is None or isinstance(condition, Const)
                kept.append((None if always else condition, folded(inner)))
                if always:
                    break
            if kept and kept[0][0] is None:
                out += kept[0][1]
                continue
            if not kept:
                continue
            s = If(tuple(kept))
        out.append(s)
    return joined(out)


def joined(body: list) -> tuple:
    """The statements with neighbouring constant outputs as one."""
    constant = lambda s: isinstance(s, Output) and isinstance(s.value, Const)
    out: list = []
    for s in body:
        if constant(s):
            before = str(out.pop().value.value) if out and constant(out[-1]) else ""
            s = Output(Const(before + str(s.value.value)))
        out.append(s)
    return tuple(out)


# --- closures ----------------------------------------------------------------------------------------------------

Segment = tuple[str, bool]
Scope = dict


def value_of(node: object) -> Callable[[Scope], object]:
    """A closure that computes an expression."""
    if isinstance(node, Const):
        constant = node.value
        return lambda scope: constant
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name, "")
    if isinstance(node, Field):
        of, name = node.of, node.name
        return lambda scope: row.get(name, "") if isinstance(row := scope.get(of), dict) else ""
    if isinstance(node, Filter):
        f, arg = FILTERS[node.name], value_of(node.arg)
        return lambda scope: f(str(arg(scope)))
    parts = [value_of(a) for a in node.args]
    kind = node.kind
    if kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    return lambda scope: apply(kind, [p(scope) for p in parts])


def closure(body: tuple, marked: bool = False) -> Callable[[Scope], Iterator[Segment]]:
    """A closure that yields the segments of statements."""
    steps: list[Callable[[Scope], Iterable[Segment]]] = []
    for s in body:
        if isinstance(s, Output) and isinstance(s.value, Const):
            steps.append(lambda scope, segment=(str(s.value.value), marked): (segment,))
        elif isinstance(s, Output):
            steps.append(lambda scope, f=value_of(s.value): ((str(f(scope)), marked),))
        elif isinstance(s, Assign):
            steps.append(lambda scope, f=value_of(s.value), name=s.name: scope.update({name: f(scope)}) or ())
        elif isinstance(s, Generation):
            steps.append(closure(s.body, True))
        elif isinstance(s, If):
            steps.append(branching([(value_of(c) if c is not None else None, closure(b, marked)) for c, b in s.branches]))
        else:
            steps.append(looping(s.name, s.over, closure(s.body, marked)))

    def run(scope: Scope) -> Iterator[Segment]:
        for step in steps:
            yield from step(scope)

    return run


def branching(branches: list) -> Callable[[Scope], Iterable[Segment]]:
    def run(scope: Scope) -> Iterable[Segment]:
        for condition, body in branches:
            if condition is None or condition(scope):
                return body(scope)
        return ()

    return run


def looping(name: str, over: str, body: Callable[[Scope], Iterator[Segment]]) -> Callable[[Scope], Iterator[Segment]]:
    """Rows may come from an iterator: one row is read ahead, for loop.last."""

    def run(scope: Scope) -> Iterator[Segment]:
        rows = iter(scope.get(over) or ())
        ahead = next(rows, None)
        index = 0
        while ahead is not None:
            row, ahead = ahead, next(rows, None)
            inner = {**scope, name: row, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": ahead is None}}
            yield from body(inner)
            index += 1

    return run


def compiled(source: str) -> Callable[[Iterable[dict]], Iterator[Segment]]:
    """Template source -> a function from the rows of a conversation to its segments."""
    run = closure(folded(parse(source)))
    return lambda messages: run({"messages": messages})


# --- Spark ----------------------------------------------------------------------------------------------------------

SEGMENTS = "conv_id long, segment long, text string, generated boolean"
SEGMENT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("generated", pa.bool_())])
FLUSH = 2000


def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, dict]]:
    for b in batches:
        for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            yield conv, {"role": role or "", "text": text or ""}


def by_conversation(rows: Iterator[tuple], key=lambda r: r[0]) -> Iterator[tuple[object, Iterator[tuple]]]:
    import itertools

    return itertools.groupby(rows, key)


def formatted(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """Formats conversations(conv_id, turn, role, text): rows (conv_id, segment, text, generated), in order per partition.

    The texts of a conversation's segments one after another are its formatted text; `generated` marks those under the
    template's generation marker. Turns stand by turn number, ties by role and text; null roles and texts are empty, a
    null conv_id is a conversation of its own. Repeated rows are turns each; an empty table gives no row. A conversation
    is sorted by Spark and streamed: its turns are never held together, however many there are.
    """
    compiled(template)  # a bad template fails here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        out: list[list] = [[], [], [], []]
        for conv, rows in by_conversation(turns(batches)):
            for k, (text, generated) in enumerate(render(row for _, row in rows)):
                for column, v in zip(out, (conv, k, text, generated), strict=True):
                    column.append(v)
                if len(out[0]) >= FLUSH:
                    yield batch(out, SEGMENT_SCHEMA)
                    out = [[], [], [], []]
        if out[0]:
            yield batch(out, SEGMENT_SCHEMA)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


class Reader:
    """Reads a formatted conversation back, segment by segment: its turns, and what stands under the marker."""

    def __init__(self) -> None:
        self.rest, self.turns, self.chars = "", 0, 0
        self.all_turns, self.loss, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0

    def feed(self, text: str, generated: bool) -> None:
        self.chars += len(text)
        if generated:
            plain = unescape(text)
            self.loss.update(plain.encode())
            self.loss_chars += len(plain)
        self.rest += text
        while (end := self.rest.find("<|im_end|>\n")) >= 0:
            head, _, said = self.rest[:end].removeprefix("<|im_start|>").partition("\n")
            self.all_turns.update(f"{unescape(head)}\n{unescape(said)}\n".encode())
            self.turns += 1
            self.rest = self.rest[end + len("<|im_end|>\n") :]


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of formatted(...)'s output, taken from the formatted text alone, partition by partition."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema]
        for conv, rows in by_conversation(rows_of(batches)):
            reader = Reader()
            for _, _, text, generated in rows:
                reader.feed(text, generated)
            values = (conv, reader.turns, reader.all_turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars)
            for column, v in zip(out, values, strict=True):
                column.append(v)
            if len(out[0]) >= FLUSH:
                yield batch(out, schema)
                out = [[] for _ in schema]
        if out[0]:
            yield batch(out, schema)

    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return segments.mapInArrow(run, kind)
