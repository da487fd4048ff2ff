"""One structural index of a page, and path expressions over it.

``page_index`` walks a page once and gives its elements in document order with the interval of their descendants and of their
texts. A path expression, kept as layout data, is compiled to a predicate over these intervals: a node lies below another if its number
is in the other's interval, so steps, predicates and texts are column expressions and the page is never parsed again. Elements can
also be exploded to a node table and joined in SQL.

Supported paths: ``/``, ``//``, ``./``, ``.//`` and unions; names, ``*``, ``@name`` and ``text()`` steps; predicates with ``and``, ``or``,
``not()``, positions, ``@name``, paths, ``=``, ``!=``, ``contains``, ``starts-with``, ``concat``, ``normalize-space`` and ``translate``.
``text()`` is the text of an element before its first child. Anything else is an error when the layout is built.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape as _unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.functions.text import _col, clean

# number (from 1), last number below it, parent, name, attributes, first text and text past the last below it (from 0).
NODE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("pre", "last", "parent")]).add("tag", "string").add("attrs", T.MapType(T.StringType(), T.StringType())).add("t0", "integer").add("t1", "integer")
PAGE = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("texts", T.ArrayType(T.StringType()))])

# Elements without content, with raw content, and those whose start ends an open paragraph.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = {"script": True, "style": True, "title": False, "textarea": False}  # whether references stay as they are
BLOCKS = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre",
                    "section", "table", "ul"))
# A start tag that ends an open element of these names, up to the element that holds both.
SIBLINGS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "td": (("td", "th"), ("tr", "table")),
            "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "thead": (("thead", "tbody"), ("table",)), "tbody": (("thead", "tbody"), ("table",)), "tfoot": (("thead", "tbody"), ("table",))}
# End tags of other elements do not reach across these.
SCOPES = frozenset(("article", "aside", "body", "div", "dl", "footer", "form", "header", "html", "li", "main", "nav", "ol", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))

SLICE_BYTES = 1 << 20  # of markup whose nodes a worker holds at a time

_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}


class _Nodes:
    """Nodes and texts of the pages of a batch, in flat lists."""

    def __init__(self):
        self.pre, self.last, self.parent, self.tag, self.t0, self.t1 = [], [], [], [], [], []
        self.names, self.values, self.attribute_ends = [], [], [0]
        self.texts, self.node_ends, self.text_ends, self.missing = [], [0], [0], []

    def page(self, html: str | None) -> None:
        self.missing.append(html is None)
        if html:
            self._walk(html)
        self.node_ends.append(len(self.pre))
        self.text_ends.append(len(self.texts))

    def _walk(self, html: str) -> None:
        base, first_text = len(self.pre), len(self.texts)
        stack: list[tuple[str, int]] = []  # name and place of open elements
        closed = html.rfind(">") + 1  # beyond the last of them there is no tag
        texts, tag, at = self.texts, self.tag, 0

        def text(part: str, raw: bool = False) -> None:
            if part and not part.isspace():
                texts.append(_unescape(part) if "&" in part and not raw else part)

        def close(count: int) -> None:
            while len(stack) > count:
                _, k = stack.pop()
                self.last[k] = len(self.pre) - base
                self.t1[k] = len(texts) - first_text

        def end(names: tuple[str, ...], until: frozenset | tuple[str, ...]) -> None:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in names:
                    close(depth)
                    return
                if stack[depth][0] in until:
                    return

        while True:
            m = _TOKEN.search(html, at, closed)
            text(html[at : m.start() if m else len(html)])
            if m is None:
                break
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                end((name,), () if name in SCOPES else SCOPES - {name})
                continue
            if name in BLOCKS:
                end(("p",), SCOPES)
            if name in SIBLINGS:
                end(*SIBLINGS[name])
            k = len(self.pre)
            self.pre.append(k - base + 1)
            self.last.append(k - base + 1)
            self.parent.append(stack[-1][1] - base + 1 if stack else 0)
            tag.append(name)
            self.t0.append(len(texts) - first_text)
            self.t1.append(len(texts) - first_text)
            if m[3] and not m[3].isspace():
                found = {}
                for a in _ATTRIBUTE.finditer(m[3]):
                    value = a[2] or ""
                    if value[:1] in "\"'" and value:
                        value = value[1:-1]
                    found[a[1].lower()] = _unescape(value) if "&" in value else value
                self.names += found
                self.values += found.values()
            self.attribute_ends.append(len(self.names))
            if name in VOID:
                continue
            stack.append((name, k))
            if name in RAW:
                stop = _RAW_END[name].search(html, at)
                text(html[at : stop.start() if stop else len(html)], RAW[name])
                close(len(stack) - 1)
                at = html.find(">", stop.start()) + 1 if stop else len(html)
                if not at:
                    break
        close(0)

    def arrow(self) -> pa.StructArray:
        ints = lambda values: pa.array(np.array(values, np.int32))
        attributes = pa.MapArray.from_arrays(ints(self.attribute_ends), pa.array(self.names, pa.string()), pa.array(self.values, pa.string()))
        nodes = pa.StructArray.from_arrays([ints(self.pre), ints(self.last), ints(self.parent), pa.array(self.tag, pa.string()), attributes, ints(self.t0), ints(self.t1)], names=[f.name for f in NODE])
        lists = [pa.ListArray.from_arrays(ints(self.node_ends), nodes), pa.ListArray.from_arrays(ints(self.text_ends), pa.array(self.texts, pa.string()))]
        return pa.StructArray.from_arrays(lists, names=["nodes", "texts"], mask=pa.array(self.missing, pa.bool_()))


def _slices(html: pa.Array) -> Iterator[pa.Array]:
    """A batch in stretches of about ``SLICE_BYTES``, one page at least: nodes take many times the room of their markup, so a worker holds those
    of a stretch and not of a batch, however many pages a batch has."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(html), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    if not len(html):
        yield html
    while at < len(html):
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield html.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])


@F.arrow_udf(PAGE)
def _index_batch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for html in batches:
        for part in _slices(html):
            found = _Nodes()
            for value in part.to_pylist():
                found.page(value)
            yield found.arrow()


def page_index(html) -> Column:
    """``struct<nodes, texts>`` of a page; null for a null page, and empty lists for one without markup or text.

    Texts are the stretches between tags that hold more than white space, with their references replaced (not in scripts and styles)."""
    return _index_batch(_col(html))


# ---------------------------------------------------------------- paths


@dataclass(frozen=True)
class Step:
    child: bool  # one level below, or at any depth
    name: str  # element, "*", "@attribute" or "text()"
    predicates: tuple = ()


@dataclass(frozen=True)
class Path:
    """One alternative of an expression."""

    steps: tuple[Step, ...]


_WORDS = re.compile(r"""\s*(?:(?P<text>"[^"]*"|'[^']*')|(?P<number>\d+)|(?P<word>@?[A-Za-z_][\w.-]*)|(?P<sign>//|/|\.//|\./|\.|\*|\[|\]|\(|\)|,|=|!=|\|))""")


class _Reader:
    """Reads an expression into nested tuples."""

    def __init__(self, source: str):
        self.source, self.words, at = source, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _WORDS.match(source, at)
            if m is None:
                raise ValueError(f"cannot read the path {self.source!r} at {at}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.words.append(("end", ""))
        self.at = 0

    def peek(self) -> str:
        kind, word = self.words[self.at]
        return word if kind in ("sign", "word") else kind

    def take(self, *allowed: str) -> str:
        kind, word = self.words[self.at]
        if allowed and word not in allowed and kind not in allowed:
            raise ValueError(f"{self.source!r}: {word or 'the end'!r} where {' or '.join(allowed)} belongs")
        self.at += 1
        return word

    def union(self) -> tuple[Path, ...]:
        found = [self.path()]
        while self.peek() == "|":
            self.take()
            found.append(self.path())
        return tuple(found)

    def path(self) -> Path:
        first = self.peek()
        child = self.take() in ("/", "./") if first in ("/", "//", ".//", "./") else True
        steps = [self.step(child)]
        while self.peek() in ("/", "//"):
            steps.append(self.step(self.take() == "/"))
        return Path(tuple(steps))

    def step(self, child: bool) -> Step:
        name = self.take("*", "word")
        if name == "text":
            self.take("(")
            self.take(")")
            name = "text()"
        predicates = []
        while self.peek() == "[":
            self.take()
            predicates.append(("position", int(self.take())) if self.words[self.at][0] == "number" else self.any())
            self.take("]")
        return Step(child, name if name[0] == "@" else name.lower(), tuple(predicates))

    def any(self) -> tuple:
        found = [self.every()]
        while self.peek() == "or":
            self.take()
            found.append(self.every())
        return found[0] if len(found) == 1 else ("or", *found)

    def every(self) -> tuple:
        found = [self.compared()]
        while self.peek() == "and":
            self.take()
            found.append(self.compared())
        return found[0] if len(found) == 1 else ("and", *found)

    def compared(self) -> tuple:
        left = self.value()
        if self.peek() in ("=", "!="):
            return (self.take(), left, self.value())
        return left

    def value(self) -> tuple:
        kind, word = self.words[self.at]
        if kind == "text":
            self.take()
            return ("text", word[1:-1])
        if word == "(":
            self.take()
            inner = self.any()
            self.take(")")
            return inner
        if word == ".":
            self.take()
            return ("self",)
        if kind == "word" and self.words[self.at + 1][1] == "(" and word != "text":
            self.take()
            self.take()
            parts = [] if self.peek() == ")" else [self.any()]
            while self.peek() == ",":
                self.take()
                parts.append(self.any())
            self.take(")")
            return (word, *parts)
        if word.startswith("@"):
            self.take()
            return ("attribute", word[1:].lower())
        return ("path", self.path())


ARGUMENTS = {"contains": (2, 2), "starts-with": (2, 2), "concat": (2, 99), "normalize-space": (0, 1), "translate": (3, 3), "not": (1, 1)}


def _check(node: tuple, source: str) -> None:
    kind = node[0]
    if kind in ("text", "self", "attribute", "position"):
        return
    if kind == "path":
        for step in node[1].steps:
            for predicate in step.predicates:
                _check(predicate, source)
        return
    if kind not in ("and", "or", "=", "!=") and (kind not in ARGUMENTS or not ARGUMENTS[kind][0] <= len(node) - 1 <= ARGUMENTS[kind][1]):
        raise ValueError(f"{source!r}: {kind}() with {len(node) - 1} arguments is not supported")
    for part in node[1:]:
        _check(part, source)


@lru_cache(maxsize=1024)
def compiled(source: str) -> tuple[Path, ...]:
    """The alternatives of an expression; an error if it is not supported."""
    reader = _Reader(source)
    found = reader.union()
    reader.take("end")
    for path in found:
        _check(("path", path), source)
        if any(s.name.startswith("@") or s.name == "text()" for s in path.steps[:-1]):
            raise ValueError(f"{source!r}: only the last step may be an attribute or text")
    return found


# ---------------------------------------------------------------- evaluation


@dataclass(frozen=True)
class Page:
    """Column expressions over a ``page_index`` column."""

    nodes: Column
    texts: Column

    @classmethod
    def of(cls, index) -> Page:
        column = _col(index)
        return cls(column["nodes"], column["texts"])

    def text(self, node: Column) -> Column:
        """All text below a node, cleaned."""
        return clean(F.array_join(F.slice(self.texts, node["t0"] + 1, node["t1"] - node["t0"]), " "))

    def raw_text(self, node: Column) -> Column:
        return F.array_join(F.slice(self.texts, node["t0"] + 1, node["t1"] - node["t0"]), "")

    def lead_text(self, node: Column) -> Column:
        """Text of a node before its first child, cleaned."""
        after = F.try_element_at(self.nodes, node["pre"] + 1)
        stop = F.when(after["parent"] == node["pre"], after["t0"]).otherwise(node["t1"])
        return clean(F.array_join(F.slice(self.texts, node["t0"] + 1, stop - node["t0"]), " "))

    def below(self, node: Column | None) -> Column:
        """All nodes below one, or all of the page."""
        return self.nodes if node is None else F.slice(self.nodes, node["pre"] + 1, node["last"] - node["pre"])

    def select(self, source: str, within: Column | None = None) -> Column:
        """Nodes that a path leads to, in the order of the page; from the page, or from a node."""
        paths = [p.steps[:-1] if p.steps[-1].name[0] == "@" or p.steps[-1].name == "text()" else p.steps for p in compiled(source)]
        if not all(paths):
            raise ValueError(f"{source!r} leads to the attributes of the node itself")
        return F.filter(self.below(within), lambda n: _any([self._reaches(n, steps, within) for steps in paths]))

    def first(self, source: str, within: Column | None = None) -> Column:
        return F.try_element_at(self.select(source, within), F.lit(1))

    def values(self, source: str, within: Column | None = None) -> Column:
        """What a path gives as text: attributes where it ends in one (nodes without it are left out), else cleaned texts."""
        ends = {p.steps[-1].name for p in compiled(source)}
        attributes = {e for e in ends if e[0] == "@"}
        if not attributes:
            return F.transform(self.select(source, within), self.lead_text if ends == {"text()"} else self.text)
        if len(ends) > 1:
            raise ValueError(f"{source!r} mixes attributes and texts")
        name = attributes.pop()[1:]
        if all(len(p.steps) == 1 for p in compiled(source)):  # of the node itself
            return F.array_compact(F.array(F.try_element_at(within["attrs"], F.lit(name))))
        return F.array_compact(F.transform(self.select(source, within), lambda n: F.try_element_at(n["attrs"], F.lit(name))))

    def value(self, source: str, within: Column | None = None) -> Column:
        """The first of the values; null if there is none."""
        return F.try_element_at(self.values(source, within), F.lit(1))

    def _reaches(self, node: Column, steps: tuple[Step, ...], within: Column | None) -> Column:
        """Whether the steps lead from ``within`` (or the page) to the node; read from the last step back."""
        *before, last = steps
        test = self._matches(node, last)
        if before:
            if last.child:
                parent = F.try_element_at(self.nodes, F.nullif(node["parent"], F.lit(0)))
                return test & F.coalesce(self._reaches(parent, tuple(before), within), F.lit(False))
            above = F.slice(self.nodes, 1, node["pre"] - 1)
            return test & F.exists(above, lambda up: (up["last"] >= node["pre"]) & self._reaches(up, tuple(before), within))
        if last.child:
            return test & (node["parent"] == (F.lit(0) if within is None else within["pre"]))
        if within is None:
            return test
        return test & (node["pre"] > within["pre"]) & (node["pre"] <= within["last"])

    def _matches(self, node: Column, step: Step) -> Column:
        named = F.lit(True) if step.name == "*" else node["tag"] == step.name
        for k, predicate in enumerate(step.predicates):
            if predicate[0] == "position":
                earlier = Step(True, step.name, step.predicates[:k])
                same = F.filter(F.slice(self.nodes, 1, node["pre"]), lambda n: (n["parent"] == node["parent"]) & self._matches(n, earlier))  # noqa: B023
                named = named & (F.size(same) == predicate[1])
            else:
                named = named & self._holds(node, predicate)
        return named

    def _holds(self, node: Column, test: tuple) -> Column:
        kind, *parts = test
        if kind in ("and", "or"):
            found = [self._holds(node, p) for p in parts]
            out = found[0]
            for more in found[1:]:
                out = out & more if kind == "and" else out | more
            return out
        if kind == "not":
            return ~self._holds(node, parts[0])
        if kind == "attribute":
            return F.map_contains_key(node["attrs"], F.lit(parts[0]))
        if kind == "path":
            steps = parts[0].steps
            if steps[-1].name.startswith("@"):
                last = Step(steps[-2].child, steps[-2].name, (*steps[-2].predicates, ("attribute", steps[-1].name[1:]))) if len(steps) > 1 else None
                if last is None:
                    return self._holds(node, ("attribute", steps[0].name[1:]))
                steps = (*steps[:-2], last)
            if steps[-1].name == "text()":
                return self._string(node, test) != ""
            return F.exists(self.below(node), lambda n: self._reaches(n, steps, node))
        if kind in ("=", "!="):
            left, right = (self._string(node, p) for p in parts)
            same = left == right
            # A missing attribute is neither equal nor unequal to anything.
            there = [F.map_contains_key(node["attrs"], F.lit(p[1])) for p in parts if p[0] == "attribute"]
            return _every([same if kind == "=" else ~same, *there])
        if kind in ("contains", "starts-with"):
            whole, part = (self._string(node, p) for p in parts)
            return F.contains(whole, part) if kind == "contains" else F.startswith(whole, part)
        return self._string(node, test) != ""

    def _string(self, node: Column, value: tuple) -> Column:
        kind, *parts = value
        if kind == "text":
            return F.lit(parts[0])
        if kind == "attribute":
            return F.coalesce(F.try_element_at(node["attrs"], F.lit(parts[0])), F.lit(""))
        if kind == "self":
            return self.raw_text(node)
        if kind == "concat":
            return F.concat(*[self._string(node, p) for p in parts])
        if kind == "normalize-space":
            return clean(self._string(node, parts[0] if parts else ("self",)))
        if kind == "translate":
            return F.translate(self._string(node, parts[0]), parts[1][1], parts[2][1])
        if kind == "path":
            steps, read = parts[0].steps, self.raw_text
            if steps[-1].name == "text()":
                steps, read = steps[:-1], self.lead_text
                if not steps:
                    return read(node)
            found = F.try_element_at(F.filter(self.below(node), lambda n: self._reaches(n, steps, node)), F.lit(1))
            return F.coalesce(read(found), F.lit(""))
        raise ValueError(f"{kind} gives no text")


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` and the lambdas in it use it."""
    return F.try_element_at(F.transform(F.array(value), fn), F.lit(1))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for more in tests[1:]:
        out = out | more
    return out


def _every(tests: list[Column]) -> Column:
    out = tests[0]
    for more in tests[1:]:
        out = out & more
    return out


def node_table(pages: DataFrame, index: str = "page") -> DataFrame:
    """Every node of the pages as a row (``pages`` without ``index``, the node's fields and its text), to join in SQL by intervals."""
    page = Page.of(index)
    keep = [c for c in pages.columns if c != index]
    return pages.select(*keep, F.explode(F.transform(page.nodes, lambda n: F.struct(n.alias("n"), page.text(n).alias("text")))).alias("x")).select(*keep, "x.n.*", "x.text")
