"""Chat formatting: a template compiler.

The language: text, {{ expression }}, {% for x in expression %}, {% if %} / {% elif %} / {% else %},
{% set name = expression %} and {% generation %}, whose output is marked for the loss. Expressions have names,
attributes of records, literals, + == != and or not, parentheses and filters (upper, lower, trim, length,
escape). There is no call, no import and no attribute of a Python object: a template sees the values it is given and
nothing else. parse() builds a tree, fold() computes what is constant, and compile() makes one closure a node.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
#: Strings that mark turns; inside texts they are broken up by the escape character.
CONTROLS = ("###", "</turn>", ": ")


class TemplateError(ValueError):
    pass


# --- escapes ------------------------------------------------------------------------------------

_BREAK = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))


def escape(text: str) -> str:
    """No control string is left in the result; unescape() gives the text back."""
    return _BREAK.sub(lambda m: "\\\\" if m.group() == "\\" else f"{m.group()}\\", text)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(\\)?", lambda m: m.group(1) or "", text)


FILTERS: dict[str, Callable[[Any], Any]] = {"upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "trim": lambda x: str(x).strip(), "length": len, "escape": lambda x: escape(str(x))}

# --- parser: nodes are tuples, the first item names the kind -------------------------------------

_TAG = re.compile(r"(?s)\{\{(.*?)\}\}|\{%(.*?)%\}")
_LEX = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<op>==|!=|[+|().])|(?P<name>[A-Za-z_]\w*))")


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = _LEX.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:].strip()!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    def __init__(self, source: str):
        self.tokens, self.i = _lex(source), 0
        self.tree = self.either()
        if self.i < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.i][1]!r}")

    def take(self, *texts: str) -> str | None:
        if self.i < len(self.tokens) and self.tokens[self.i][0] in ("op", "name") and self.tokens[self.i][1] in texts:
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def next(self, *kinds: str) -> tuple[str, str]:
        if self.i >= len(self.tokens) or self.tokens[self.i][0] not in kinds:
            raise TemplateError(f"{' or '.join(kinds)} expected")
        self.i += 1
        return self.tokens[self.i - 1]

    def _left(self, below: Callable, *operators: str):
        tree = below()
        while op := self.take(*operators):
            tree = (op, tree, below())
        return tree

    def either(self):
        return self._left(self.both, "or")

    def both(self):
        return self._left(self.negated, "and")

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self._left(self.sum, "==", "!=")

    def sum(self):
        return self._left(self.filtered, "+")

    def filtered(self):
        tree = self.atom()
        while True:
            if self.take("|"):
                name = self.next("name")[1]
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                tree = ("filter", name, tree)
            elif self.take("."):
                tree = ("get", tree, self.next("name")[1])
            else:
                return tree

    def atom(self):
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError(") expected")
            return tree
        kind, text = self.next("str", "int", "name")
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
        return ("const", int(text) if kind == "int" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    root: list = []
    open_: list[tuple[str, list]] = [("", root)]
    body, at = root, 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            body.append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(("out", _Expression(m[1]).tree))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for" and (f := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
            inner: list = []
            body.append(("for", f[1], _Expression(f[2]).tree, inner))
            open_.append(("for", inner))
        elif word == "if":
            inner, cases = [], []
            cases.append((_Expression(rest).tree, inner))
            body.append(("if", cases))
            open_.append(("if", inner))
        elif word in ("elif", "else") and open_[-1][0] == "if":
            inner = []
            open_.pop()
            open_[-1][1][-1][1].append((_Expression(rest).tree if word == "elif" else ("const", True), inner))
            open_.append(("if", inner))
        elif word == "set" and (f := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)):
            body.append(("set", f[1], _Expression(f[2]).tree))
        elif word == "generation":
            inner = []
            body.append(("generation", inner))
            open_.append(("generation", inner))
        elif word.startswith("end") and len(open_) > 1 and word[3:] == open_[-1][0]:
            open_.pop()
        else:
            raise TemplateError(f"unexpected {m[0]!r}")
        body = open_[-1][1]
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} is not closed")
    if at < len(source):
        body.append(("text", source[at:]))
    return ("body", root)


# --- folding and closures -----------------------------------------------------------------------

_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else f"{_string(a)}{_string(b)}",
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def _string(x: Any) -> str:
    return "" if x is None else str(x)


def fold(node):
    """The same tree with constant expressions computed, dead branches dropped and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "get":
        return ("get", fold(node[1]), node[2])
    if kind == "filter":
        x = fold(node[2])
        return ("const", FILTERS[node[1]](x[1])) if x[0] == "const" else ("filter", node[1], x)
    if kind == "not":
        x = fold(node[1])
        return ("const", not x[1]) if x[0] == "const" else ("not", x)
    if kind in ("and", "or"):
        a, b = fold(node[1]), fold(node[2])
        return (b if bool(a[1]) == (kind == "and") else a) if a[0] == "const" else (kind, a, b)
    if kind in _OPERATORS:
        a, b = fold(node[1]), fold(node[2])
        return ("const", _OPERATORS[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind == "out":
        x = fold(node[1])
        return ("text", _string(x[1])) if x[0] == "const" else ("out", x)
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), _folded(node[3]))
    if kind == "generation":
        return ("generation", _folded(node[1]))
    if kind == "if":
        cases = []
        for test, inner in node[1]:
            test = fold(test)
            if test[0] != "const" or test[1]:
                cases.append((test, _folded(inner)))
            if test[0] == "const" and test[1]:
                break
        return ("body", cases[0][1]) if cases and cases[0][0][0] == "const" else ("if", cases)
    return ("body", _folded(node[1]))


def _folded(nodes: list) -> list:
    out: list = []
    for x in map(fold, nodes):
        for y in x[1] if x[0] == "body" else [x]:
            if y[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + y[1])
            elif y != ("text", ""):
                out.append(y)
    return out


Emit = Callable[[str, bool], None]


def _value(node) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "get":
        of, key = _value(node[1]), node[2]
        return lambda env: x.get(key) if isinstance(x := of(env), dict) else None
    if kind == "filter":
        of, f = _value(node[2]), FILTERS[node[1]]
        return lambda env: f("" if (x := of(env)) is None else x)
    if kind == "not":
        of = _value(node[1])
        return lambda env: not of(env)
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    f = _OPERATORS[kind]
    return lambda env: f(a(env), b(env))


def _closure(node) -> Callable[[dict, Emit, bool], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, emit, loss, t=node[1]: emit(t, loss)
    if kind == "out":
        value = _value(node[1])
        return lambda env, emit, loss: emit(_string(value(env)), loss)
    if kind == "set":
        value, name = _value(node[2]), node[1]
        return lambda env, emit, loss: env.__setitem__(name, value(env))
    if kind == "for":
        name, items, inner = node[1], _value(node[2]), _sequence(node[3])

        def loop(env, emit, loss):
            for x in items(env) or ():
                inner({**env, name: x}, emit, loss)

        return loop
    if kind == "generation":
        inner = _sequence(node[1])
        return lambda env, emit, loss: inner(env, emit, True)
    if kind == "if":
        cases = [(_value(t), _sequence(b)) for t, b in node[1]]

        def choose(env, emit, loss):
            for test, inner in cases:
                if test(env):
                    return inner(env, emit, loss)

        return choose
    return _sequence(node[1])


def _sequence(nodes: list) -> Callable[[dict, Emit, bool], None]:
    steps = [_closure(x) for x in nodes]

    def run(env, emit, loss):
        for f in steps:
            f(env, emit, loss)

    return run


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from values to the formatted text and its generation spans (code points, end exclusive)."""
    run = _closure(fold(parse(source)))

    def render(values: dict) -> tuple[str, list[tuple[int, int]]]:
        parts, spans, at = [], [], 0

        def emit(text: str, loss: bool) -> None:
            nonlocal at
            if loss and text:
                spans.append((at, at + len(text)))
            parts.append(text)
            at += len(text)

        run(dict(values), emit, False)
        return "".join(parts), spans

    return render


_TURN = re.compile(r"(?s)### (.*?): (.*?)</turn>\n")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of what TEMPLATE has formatted."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


# --- on Spark -----------------------------------------------------------------------------------


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _format(template: str, digest: bool):
    def run(batches):
        render, out = compile_template(template), []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"] if digest else ["conv_id", "formatted", "loss"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()] if digest else [pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        batch = lambda: pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        size = 0
        for conv, rows in groupby(_rows(batches), lambda r: r[0]):
            formatted, spans = render({"messages": [{"role": r[2] or "", "text": r[3] or ""} for r in rows]})
            if digest:
                turns = read_back(formatted)
                loss = "".join(unescape(formatted[a:b]) for a, b in spans)
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
            else:
                out.append((conv, formatted, [list(x) for x in spans]))
            size += len(formatted)
            if size > 4_000_000 or len(out) >= 5000:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return run


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss (generation spans): a row per conversation of conversations(conv_id, turn, role, text).

    Turns come in the order of turn (nulls first), then role, then text. Null roles and texts are empty. Rows without
    conv_id are one conversation. One conversation is held in memory at a time, as it is one row of the result.
    """
    return _sorted(conversations).mapInArrow(_format(template, False), "conv_id long, formatted string, loss array<array<long>>")


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""
    return _sorted(conversations).mapInArrow(_format(TEMPLATE, True), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra))


