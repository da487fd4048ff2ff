"""Text, hash and language columns."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters collapsed as white space, and the kana/ideograph ranges.
SPACE_CLASS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK_CLASS = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"
KANA_CLASS = r"[\x{3040}-\x{30ff}]"

# Block tags whose content is never visible text.
HIDDEN_TAGS = ("script", "style", "nav", "header", "footer", "noscript")

EXCERPT_WORDS = 25
MEANINGFUL_CHARS = 45
MEANINGFUL_CJK = 18
LANGUAGE_LABELS = {"ja": "Japanese", "jp": "Japanese", "zh": "Chinese", "ko": "Korean", "pt": "Portuguese"}


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean(value) -> Column:
    """Collapse runs of white space, trim, and read a missing value as empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(value), F.lit("")), SPACE_CLASS + "+", " "))


def _ranges(points) -> str:
    spans, start, last = [], None, None
    for point in points:
        if start is None:
            start = last = point
        elif point == last + 1:
            last = point
        else:
            spans.append((start, last))
            start = last = point
    if start is not None:
        spans.append((start, last))
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)


def _normal_class() -> str:
    """Characters NFKC neither changes nor composes with a neighbour, in the common blocks."""
    blocks = [(0x00, 0x17F), (0x370, 0x52F), (0x2010, 0x2027), (0x3001, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
    keep = [p for a, b in blocks for p in range(a, b + 1)
            if unicodedata.is_normalized("NFKC", chr(p)) and not unicodedata.combining(chr(p))]
    return "[" + _ranges(keep) + "]"


NORMAL_TEXT = "^" + _normal_class() + "*$"


@F.pandas_udf(T.StringType())
def _nfkc_batch(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(value) -> Column:
    """NFKC form; only rows that may change are sent to Python, the others travel as null."""
    text = _col(value)
    return F.coalesce(_nfkc_batch(F.when(~text.rlike(NORMAL_TEXT), text)), text)


REFERENCE = r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"


@lru_cache(maxsize=1)
def _named() -> str:
    """Names of character references and their text, as the standard lists them, in JSON."""
    return json.dumps({name: value for name, value in html5.items() if name.endswith(";")})


@lru_cache(maxsize=1)
def _legacy() -> str:
    """Numbers 128 to 159 are read as Windows-1252, as browsers do."""
    return json.dumps({str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160)})


def _referred(reference: Column) -> Column:
    """Text of one character reference; an unknown name stays as it is, a number that is no character becomes U+FFFD."""
    name = F.substr(reference, F.lit(2))
    hexadecimal = F.conv(F.regexp_extract(reference, "^&#[xX]([0-9a-fA-F]+);", 1), 16, 10)
    number = F.coalesce(F.nullif(F.regexp_extract(reference, "^&#([0-9]+);", 1), F.lit("")), hexadecimal).try_cast("bigint")
    usable = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    old = F.try_element_at(F.from_json(F.lit(_legacy()), "map<string,string>"), number.cast("string"))
    by_name = F.coalesce(F.try_element_at(F.from_json(F.lit(_named()), "map<string,string>"), name), reference)
    return F.when(number.isNull(), by_name).when(usable, F.coalesce(old, char)).otherwise("\ufffd")


def unescape(value) -> Column:
    """Replace named and numeric character references, each once; a reference needs its semicolon."""
    out = _col(value)
    found = F.transform(F.regexp_extract_all(out, F.lit(REFERENCE), F.lit(0)), _referred)
    joined = F.array_join(F.zip_with(F.split(out, REFERENCE), found, lambda piece, char: F.concat(piece, F.coalesce(char, F.lit("")))), "")
    return F.when(F.contains(out, F.lit("&")), joined).otherwise(out)


def html_to_text(value) -> Column:
    """Visible text of markup, without script, style and page furniture."""
    out = F.coalesce(_col(value), F.lit(""))
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    for tag in HIDDEN_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", " ")
    return clean(unescape(F.regexp_replace(out, r"(?s)<[^>]*>", " ")))


def content_hash(title, text) -> Column:
    return F.sha2(F.concat(clean(title), F.lit("\n"), clean(text)), 256)


def signature(title, text) -> Column:
    """Hash of the case-folded document. lower() stands in for full case folding, which
    differs only for letters that fold to several characters, such as the sharp s."""
    return F.sha2(F.concat(F.lower(clean(title)), F.lit("\n"), F.lower(clean(text))), 256)


def words(value) -> Column:
    cleaned = clean(value)
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def excerpt(title, text) -> Column:
    """Source excerpt of which title plus quoted words stay within EXCERPT_WORDS."""
    body = words(text)
    room = F.greatest(F.lit(0), F.lit(EXCERPT_WORDS) - F.size(words(title)))
    cut = F.concat(F.array_join(F.slice(body, F.lit(1), room), " "),
                   F.when(F.size(body) > room, "…").otherwise(""))
    return F.when((room > 0) & (F.size(body) > 0), F.concat(F.lit("Source excerpt: “"), cut, F.lit("”"))).otherwise(
        "Read the linked announcement for the details.")


def publication_label(published_text, precision) -> Column:
    published = _col(published_text)
    return (F.when(published.isNull() | (published == ""), "publication time unconfirmed")
            .when(_col(precision) == "day", F.concat(F.substring(published, 1, 10), F.lit(" (date only; time unconfirmed)")))
            .otherwise(published))


def has_cjk(value) -> Column:
    return F.coalesce(_col(value), F.lit("")).rlike(CJK_CLASS)


def infer_language(language, text) -> Column:
    """The stated language, or Japanese when the text holds kana and none is stated."""
    stated = clean(language)
    return F.when((stated == "") & F.coalesce(_col(text), F.lit("")).rlike(KANA_CLASS), "ja").otherwise(stated)


def is_meaningful(value) -> Column:
    text = F.coalesce(_col(value), F.lit(""))
    return (F.char_length(text) >= MEANINGFUL_CHARS) | (F.regexp_count(text, F.lit(CJK_CLASS)) >= MEANINGFUL_CJK)


def needs_translation(publisher, language) -> Column:
    return _col(publisher) & ~F.startswith(F.lower(F.coalesce(_col(language), F.lit("en"))), F.lit("en"))


def language_label(language) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in LANGUAGE_LABELS.items() for x in pair])
    code = F.lower(F.coalesce(_col(language), F.lit("")))
    return F.coalesce(F.try_element_at(labels, code), code)


def clamp_num(value, default, low, high, integer: bool = False) -> Column:
    """Parse and clamp a setting; anything that is not a finite number gives the default."""
    number = _col(value).try_cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    kept = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("double") if integer else number
    return F.when(bad, F.lit(float(default))).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), kept)))


def story_anchor(identity, prefix: str = "") -> Column:
    """Readable, unique anchor of a story, after the ``prefix`` of its product."""
    text = _col(identity)
    slug = F.substring(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", ""), 1, 45)
    return F.concat(F.lit(prefix), F.when(slug == "", "item").otherwise(slug), F.lit("-"),
                    F.substring(F.sha2(text, 256), 1, 10))


def ordered_union(*arrays) -> Column:
    """Concatenate lists, keeping the first occurrence of each item."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(_col(a), empty) for a in arrays]))


_TOKEN = re.compile(r"\w+|\W")
_WORD = re.compile(r"\w")


class _Names:
    """A trie over the tokens of names (words, and every other character), which gives their labels."""

    LABEL = ""  # no token is empty

    def __init__(self, aliases: dict[str, str]):
        self.root: dict = {}
        for name, label in aliases.items():
            node = self.root
            for token in _TOKEN.findall(name.lower()):
                node = node.setdefault(token, {})
            node[self.LABEL] = label

    def replaced(self, text: str) -> str:
        """At the leftmost place where a name stands as whole words, the longest one gives way to its label; then on behind it."""
        tokens, out, at = _TOKEN.findall(text), [], 0
        folded = [t.lower() for t in tokens]
        if self.root.keys().isdisjoint(folded):
            return text
        word = [bool(_WORD.match(t)) for t in tokens]
        while at < len(tokens):
            node, end, label, k = self.root, 0, None, at
            while k < len(tokens) and (at == 0 or not word[at - 1]) and folded[k] in node:
                node = node[folded[k]]
                k += 1
                if self.LABEL in node and (k == len(tokens) or not word[k]):
                    end, label = k, node[self.LABEL]
            out.append(tokens[at] if label is None else label)
            at = end or at + 1
        return "".join(out)


def apply_aliases(value, aliases: dict[str, str]) -> Column:
    """Replace whole names by display labels in one walk: the leftmost name, the longest of those that begin there; a label is never
    replaced again. The cost of a headline does not depend on the number of names. Of names that differ in case only the last counts."""
    if any(not k.strip() or not v.strip() for k, v in aliases.items()):
        raise ValueError("aliases must map non-empty names to non-empty labels")
    names = _Names(aliases)

    @F.arrow_udf(T.StringType())
    def labelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else names.replaced(t) for t in texts.to_pylist()], pa.string())

    return labelled(_col(value)) if aliases else _col(value)
