"""Chat formatting with a small sandboxed template language, compiled to Python closures.

Template text is split into literal text, ``{{ expression }}``, ``{% statement %}`` and ``{# comment #}``; a dash inside the
braces trims the white space on that side. Statements: ``for x in e … else … endfor``, ``if / elif / else / endif``, ``set x = e``, and
``generation … endgeneration``, whose output is marked as the text to learn. Expressions: strings, integers, true, false, none,
names, ``a.b``, ``a['b']``, ``a[0]``, ``not and or``, ``== != < <= > >=``, ``in``, ``is [not] defined|none``, ``+ - * %``, ``~`` (join as text),
``a if c else b``, lists and filters ``e | name``.

A template can reach nothing but the values it is given: attributes are looked up in mappings only, there are no calls besides the
filters in ``FILTERS``, and loops run over given lists only, so every template ends. The syntax tree is folded first (operators and filters over
constants, branches with constant conditions, neighbouring texts) and then turned into closures once per task.

``format_conversations`` renders each conversation in turn order from a sorted stream of rows: a message at a time is held, unless the template uses
``messages`` in another way than one loop. A digest of a whole conversation is sequential, so one conversation is one task's stream; its size costs time there,
not memory.

Rows of a conversation are ordered by turn, then role, then text, nulls first; repeated rows are turns of their own. Null texts and
roles count as empty. A null conversation id is one conversation. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from lumenframe.llm.common import named

# Control strings -------------------------------------------------------------------------------

# The marks of the default template, and other formats' control strings that texts may hold.
START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>"
_ESCAPE = re.compile(rf"([<\[])(\\*)({_CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_CONTROL})")


def escape_control(text: str) -> str:
    """Puts a backslash behind the first character of every control string, and of every one that has some already."""
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape_control(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def escape_line(text: str) -> str:
    """As escape_control, and on one line."""
    return escape_control(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape_control(text))


DEFAULT_TEMPLATE = """
{%- for message in messages -%}
  {{ '<|im_start|>' ~ (message.role | escape_line) ~ '\\n' }}
  {%- if message.role == 'assistant' -%}
    {% generation %}{{ message.text | escape_control }}{% endgeneration %}
  {%- else -%}
    {{ message.text | escape_control }}
  {%- endif -%}
  {{ '<|im_end|>' ~ '\\n' }}
{%- endfor -%}
"""

# Syntax tree -----------------------------------------------------------------------------------


class TemplateError(ValueError):
    """The template can't be compiled, or asks for something outside the sandbox."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    """An operator, a filter or a conditional over expressions."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Items:
    values: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple
    otherwise: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Undefined:
    def __bool__(self) -> bool:
        return False


UNDEFINED = _Undefined()


def _as_text(v: Any) -> str:
    return "" if v is UNDEFINED or v is None else "true" if v is True else "false" if v is False else str(v)


def _get(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key, UNDEFINED)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else UNDEFINED
    return UNDEFINED


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: _as_text(v).strip(),
    "upper": lambda v: _as_text(v).upper(),
    "lower": lambda v: _as_text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple, dict)) else 0,
    "first": lambda v: _get(v, 0),
    "last": lambda v: _get(v, -1),
    "string": _as_text,
    "escape_control": lambda v: escape_control(_as_text(v)),
    "escape_line": lambda v: escape_line(_as_text(v)),
}


def _number(v: Any) -> int:
    if isinstance(v, int):
        return int(v)
    raise TemplateError(f"not a number: {v!r}")


OPERATORS: dict[str, Callable[..., Any]] = {
    "~": lambda a, b: _as_text(a) + _as_text(b),
    "+": lambda a, b: a + b if isinstance(a, str) and isinstance(b, str) else _number(a) + _number(b),
    "-": lambda a, b: _number(a) - _number(b),
    "*": lambda a, b: _number(a) * _number(b),
    "%": lambda a, b: _number(a) % _number(b) if _number(b) else UNDEFINED,
    "neg": lambda a: -_number(a),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: _number(a) < _number(b),
    "<=": lambda a, b: _number(a) <= _number(b),
    ">": lambda a, b: _number(a) > _number(b),
    ">=": lambda a, b: _number(a) >= _number(b),
    "in": lambda a, b: (isinstance(a, str) if isinstance(b, str) else isinstance(b, (list, tuple, dict))) and a in b,
    "not": lambda a: not a,
    "is defined": lambda a: a is not UNDEFINED,
    "is none": lambda a: a is None,
    **{f"|{name}": f for name, f in FILTERS.items()},
}

# Parser ----------------------------------------------------------------------------------------

_PIECES = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>()\[\],.|=])|(?P<bad>\S))""", re.DOTALL)
_STRING_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one expression or statement."""

    def __init__(self, source: str):
        self.tokens = []
        for m in _TOKEN.finditer(source):
            if m["bad"]:
                raise TemplateError(f"unexpected {m['bad']!r} in {source!r}")
            if m["string"]:
                self.tokens.append(("string", re.sub(r"\\(.)", lambda e: _STRING_ESCAPES.get(e[1], e[1]), m["string"][1:-1], flags=re.DOTALL)))
            elif m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.at, self.source = 0, source

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing in {self.source!r}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError(f"a name is missing in {self.source!r}")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")

    def whole(self) -> Any:
        value = self.condition()
        self.end()
        return value

    def condition(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            return Op("if", (test, value, self.condition() if self.take("else") else Const("")))
        return value

    def either(self) -> Any:
        value = self.both()
        while self.take("or"):
            value = Op("or", (value, self.both()))
        return value

    def both(self) -> Any:
        value = self.negation()
        while self.take("and"):
            value = Op("and", (value, self.negation()))
        return value

    def negation(self) -> Any:
        return Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Any:
        value = self.joined()
        while True:
            if self.take("is"):
                negated, kind = self.take("not"), self.name()
                if kind not in ("defined", "none"):
                    raise TemplateError(f"unknown test {kind!r}")
                value = Op(f"is {kind}", (value,))
                value = Op("not", (value,)) if negated else value
            elif self.peek("not"):
                self.need("not"), self.need("in")
                value = Op("not", (Op("in", (value, self.joined())),))
            elif op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                value = Op(op, (value, self.joined()))
            else:
                return value

    def joined(self) -> Any:
        return self.chain(self.sum, "~")

    def sum(self) -> Any:
        return self.chain(self.product, "+", "-")

    def product(self) -> Any:
        return self.chain(self.sign, "*", "%")

    def chain(self, part: Callable[[], Any], *ops: str) -> Any:
        value = part()
        while op := self.take(*ops):
            value = Op(op, (value, part()))
        return value

    def sign(self) -> Any:
        return Op("neg", (self.sign(),)) if self.take("-") else self.filtered()

    def filtered(self) -> Any:
        value = self.path()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            value = Op(f"|{name}", (value,))
        return value

    def path(self) -> Any:
        value = self.atom()
        while True:
            if self.take("."):
                value = Get(value, Const(self.name()))
            elif self.take("["):
                value = Get(value, self.condition())
                self.need("]")
            else:
                return value

    def atom(self) -> Any:
        if self.take("("):
            value = self.condition()
            self.need(")")
            return value
        if self.take("["):
            values = []
            while not self.take("]"):
                values.append(self.condition())
                if not self.peek("]"):
                    self.need(",")
            return Items(tuple(values))
        if self.at >= len(self.tokens):
            raise TemplateError(f"a value is missing in {self.source!r}")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(text)
        if kind == "number":
            return Const(int(text))
        if kind == "name":
            fixed = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
            return Const(fixed[text]) if text in fixed else Name(text)
        raise TemplateError(f"unexpected {text!r} in {self.source!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of statements."""
    pieces: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _PIECES.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        left, right = (m[1], m[3]) if m[2] is not None else (m[4], m[6]) if m[5] is not None else (m[7], m[8])
        pieces.append(("text", text.rstrip() if left else text))
        if m[2] is not None:
            pieces.append(("emit", m[2]))
        elif m[5] is not None:
            pieces.append(("do", m[5]))
        at, trim = m.end(), bool(right)
    rest = source[at:].lstrip() if trim else source[at:]
    pieces.append(("text", rest))
    place = 0

    def body(*ends: str) -> tuple[tuple, str, _Expression | None]:
        nonlocal place
        out: list = []
        while place < len(pieces):
            kind, text = pieces[place]
            place += 1
            if kind == "text":
                out += [Text(text)] if text else []
            elif kind == "emit":
                out.append(Emit(_Expression(text).whole()))
            else:
                e = _Expression(text)
                word = e.name()
                if word in ends:
                    return tuple(out), word, e
                out.append(statement(word, e))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(out), "", None

    def closing(e: _Expression) -> None:
        e.end()

    def statement(word: str, e: _Expression) -> Any:
        if word == "for":
            name = e.name()
            e.need("in")
            over = e.whole()
            inside, end, rest = body("endfor", "else")
            closing(rest)
            otherwise: tuple = ()
            if end == "else":
                otherwise, _, rest = body("endfor")
                closing(rest)
            return For(name, over, inside, otherwise)
        if word == "if":
            branches, test, end = [], e.whole(), "elif"
            while True:
                inside, end, rest = body("elif", "else", "endif")
                branches.append((test, inside))
                if end == "elif":
                    test = rest.whole()
                    continue
                closing(rest)
                if end == "else":
                    inside, _, rest = body("endif")
                    closing(rest)
                    branches.append((Const(True), inside))
                return If(tuple(branches))
        if word == "set":
            name = e.name()
            e.need("=")
            return Set(name, e.whole())
        if word == "generation":
            closing(e)
            inside, _, rest = body("endgeneration")
            closing(rest)
            return Generation(inside)
        raise TemplateError(f"unknown statement {word!r}")

    return body()[0]


# Folding ---------------------------------------------------------------------------------------


def fold_expression(e: Any) -> Any:
    """The expression with everything that depends on constants only worked out."""
    if isinstance(e, Get):
        of, key = fold_expression(e.of), fold_expression(e.key)
        return Const(_get(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Get(of, key)
    if isinstance(e, Items):
        values = tuple(map(fold_expression, e.values))
        return Const([v.value for v in values]) if all(isinstance(v, Const) for v in values) else Items(values)
    if not isinstance(e, Op):
        return e
    args = tuple(map(fold_expression, e.args))
    if e.name in ("and", "or", "if") and isinstance(args[0], Const):
        true = bool(args[0].value)
        if e.name == "if":
            return args[1] if true else args[2]
        return args[1] if true == (e.name == "and") else args[0]
    if e.name in OPERATORS and all(isinstance(a, Const) for a in args):
        return Const(OPERATORS[e.name](*(a.value for a in args)))
    return Op(e.name, args)


def _pieces(e: Any) -> Iterator[Any]:
    """The parts of a text joined by ``~``, so that its constant parts can become literal text."""
    if isinstance(e, Op) and e.name == "~":
        for a in e.args:
            yield from _pieces(a)
    else:
        yield e


def fold(body: tuple) -> tuple:
    out: list = []

    def add(node: Any) -> None:
        if isinstance(node, Text):
            if out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + node.text)
            elif node.text:
                out.append(node)
        else:
            out.append(node)

    for node in body:
        if isinstance(node, Emit):
            for part in _pieces(fold_expression(node.value)):
                add(Text(_as_text(part.value)) if isinstance(part, Const) else Emit(part))
        elif isinstance(node, Set):
            add(Set(node.name, fold_expression(node.value)))
        elif isinstance(node, Generation):
            add(Generation(fold(node.body)))
        elif isinstance(node, For):
            add(For(node.name, fold_expression(node.over), fold(node.body), fold(node.otherwise)))
        elif isinstance(node, If):
            branches = []
            for test, inside in node.branches:
                test = fold_expression(test)
                if isinstance(test, Const) and not test.value:
                    continue
                branches.append((test, fold(inside)))
                if isinstance(test, Const):
                    break
            if branches and isinstance(branches[0][0], Const):
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                add(If(tuple(branches)))
        else:
            add(node)
    return tuple(out)


# Closures --------------------------------------------------------------------------------------


@dataclass
class Output:
    """Receives text; ``sink(piece, marked)`` is called for each piece, marked inside a generation block."""

    sink: Callable[[str, bool], None]
    done: Callable[[], None]
    marked: int = 0

    def write(self, text: str) -> None:
        if text:
            self.sink(text, self.marked > 0)


Value = Callable[[dict], Any]
Step = Callable[[dict, Output], None]


def _value(e: Any) -> Value:
    if isinstance(e, Const):
        return lambda scope, v=e.value: v
    if isinstance(e, Name):
        return lambda scope, n=e.name: scope.get(n, UNDEFINED)
    if isinstance(e, Get):
        of, key = _value(e.of), _value(e.key)
        return lambda scope: _get(of(scope), key(scope))
    if isinstance(e, Items):
        values = [_value(v) for v in e.values]
        return lambda scope: [v(scope) for v in values]
    args = [_value(a) for a in e.args]
    if e.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if e.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if e.name == "if":
        return lambda scope: args[1](scope) if args[0](scope) else args[2](scope)
    f = OPERATORS[e.name]
    if len(args) == 1:
        return lambda scope, a=args[0]: f(a(scope))
    return lambda scope, a=args[0], b=args[1]: f(a(scope), b(scope))


def _with_last(items: Iterable) -> Iterator[tuple[Any, bool]]:
    it = iter(items)
    for held in it:
        for following in it:
            yield held, False
            held = following
        yield held, True


def _step(node: Any) -> Step:
    if isinstance(node, Text):
        return lambda scope, out, t=node.text: out.write(t)
    if isinstance(node, Emit):
        return lambda scope, out, v=_value(node.value): out.write(_as_text(v(scope)))
    if isinstance(node, Set):
        v = _value(node.value)

        def assign(scope: dict, out: Output) -> None:
            scope[node.name] = v(scope)

        return assign
    if isinstance(node, Generation):
        inside = _steps(node.body)

        def generate(scope: dict, out: Output) -> None:
            out.marked += 1
            inside(scope, out)
            out.marked -= 1
            if not out.marked:
                out.done()

        return generate
    if isinstance(node, If):
        branches = [(_value(test), _steps(body)) for test, body in node.branches]

        def choose(scope: dict, out: Output) -> None:
            for test, inside in branches:
                if test(scope):
                    return inside(scope, out)

        return choose
    over, inside, otherwise = _value(node.over), _steps(node.body), _steps(node.otherwise)

    def loop(scope: dict, out: Output) -> None:
        items = over(scope)
        if isinstance(items, (str, int)) or items is None or items is UNDEFINED:
            items = ()
        index = 0
        for index, (item, last) in enumerate(_with_last(items), 1):
            mine = dict(scope)
            mine[node.name] = item
            mine["loop"] = {"index": index, "index0": index - 1, "first": index == 1, "last": last}
            inside(mine, out)
        if not index:
            otherwise(scope, out)

    return loop


def _steps(body: tuple) -> Step:
    steps = [_step(n) for n in body]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, out: Output) -> None:
        for s in steps:
            s(scope, out)

    return run


def _uses(node: Any, name: str) -> int:
    if isinstance(node, Name):
        return node.name == name
    if isinstance(node, (tuple, list)):
        return sum(_uses(n, name) for n in node)
    if hasattr(node, "__dataclass_fields__"):
        return sum(_uses(getattr(node, f), name) for f in node.__dataclass_fields__)
    return 0


@dataclass
class Template:
    """A compiled template; ``streams`` if it goes through the messages once, in one loop at its top."""

    source: str
    tree: tuple = field(init=False)
    run: Step = field(init=False, repr=False)
    streams: bool = field(init=False)

    def __post_init__(self) -> None:
        self.tree = fold(parse(self.source))
        self.run = _steps(self.tree)
        top = [n for n in self.tree if isinstance(n, For) and n.over == Name("messages")]
        self.streams = len(top) == 1 and _uses(self.tree, "messages") == 1

    def render(self, messages: Iterable[dict], out: Output, **values: Any) -> None:
        self.run({**values, "messages": messages if self.streams else list(messages)}, out)

    def text(self, messages: Iterable[dict], **values: Any) -> tuple[str, list[tuple[int, int]]]:
        """The whole output, and the spans that generation blocks have written."""
        pieces: list[str] = []
        spans: list[tuple[int, int]] = []
        size, begun = 0, None

        def sink(piece: str, marked: bool) -> None:
            nonlocal size, begun
            if marked and begun is None:
                begun = size
            pieces.append(piece)
            size += len(piece)

        def done() -> None:
            nonlocal begun
            spans.append((size if begun is None else begun, size))
            begun = None

        self.render(messages, Output(sink, done), **values)
        return "".join(pieces), spans


# Conversations ---------------------------------------------------------------------------------


class Reader:
    """Reads turns and marked text back from the output of the default template, as it is written."""

    def __init__(self) -> None:
        self.rest, self.mark = "", ""
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def sink(self, piece: str, marked: bool) -> None:
        self.chars += len(piece)
        self.rest += piece
        if marked:
            self.mark += piece
        while (end := self.rest.find(END + "\n")) >= 0:
            role, _, text = self.rest[len(START) : end].partition("\n")
            self.turns += 1
            self.turn_hash.update(f"{unescape_line(role)}\n{unescape_control(text)}\n".encode())
            self.rest = self.rest[end + len(END) + 1 :]

    def done(self) -> None:
        text = unescape_control(self.mark)
        self.loss_chars += len(text)
        self.loss_hash.update(text.encode())
        self.mark = ""

    def row(self) -> tuple:
        return self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def _messages(rows: Iterable[tuple]) -> Iterator[dict]:
    for _, turn, role, text in rows:
        yield {"turn": turn, "role": role or "", "text": text or ""}


def _sorted_turns(conversations: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    kinds = ("long", "long", "string", "string")
    rows = conversations.select(*(named(c).cast(k).alias(n) for c, k, n in zip(columns, kinds, ("conv_id", "turn", "role", "text"))))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _by_conversation(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[tuple]]]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=lambda r: r[0])


COLUMNS = ("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: str = DEFAULT_TEMPLATE, columns: tuple[str, str, str, str] = COLUMNS) -> DataFrame:
    """``conv_id, text, marked``: the formatted conversation and the spans (start, stop) under its generation marks."""
    Template(template)  # errors show here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        for conv, rows in _by_conversation(batches):
            text, spans = compiled.text(_messages(rows))
            marked = pa.array([[{"start": a, "stop": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([text], pa.string()), marked], names=["conv_id", "text", "marked"])

    return _sorted_turns(conversations, columns).mapInArrow(run, "conv_id long, text string, marked array<struct<start: long, stop: long>>")


def format_digests(conversations: DataFrame, columns: tuple[str, str, str, str] = COLUMNS) -> DataFrame:
    """Digests of every conversation, read back from its text in the default template while that is written."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(DEFAULT_TEMPLATE)
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

        for conv, rows in _by_conversation(batches):
            reader = Reader()
            compiled.render(_messages(rows), Output(reader.sink, reader.done))
            out.append((conv, *reader.row()))
            if len(out) == 4096:
                yield batch()
                out = []
        yield batch()

    return _sorted_turns(conversations, columns).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
