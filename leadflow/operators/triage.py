"""Explainable event scoring from a rule table."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.text import _col, clean, nfkc
from leadflow.rules import DEFAULT_EVENT_LABEL, DEFAULT_RULES, DEFAULT_SECTION, EVENT_LABELS, RuleSet

# Discount of a body-only signal, priority bonus, context scores and their wording.
BODY_DISCOUNT, PRIORITY_BONUS, MAX_SCORE, TOP_REASONS = 8, 8, 100, 3
MACRO_SCORE, BUSINESS_SCORE = 24, 18
MACRO_REASON = "Macro or market context; no specific corporate-event signal"
BUSINESS_REASON = "General business context; no specific corporate-event signal"
NO_REASON = "No recognised corporate or market signal"
PRIORITY_REASON = "Priority-name match (+8); identity supplied by the caller"
MIN_ATTENTION = 35


# References, flags and nested classes: patterns with them are left as they are.
UNREAD = r"\\[1-9kQ]|\(\?[a-zA-Z-]|\(\?<[^!=]|(?<!\\)\[[^\]]*(?<!\\)\["


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at the bars that lie outside brackets and parentheses."""
    parts, depth, in_class, at = [""], 0, False, 0
    while at < len(pattern):
        piece = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        at += len(piece)
        if in_class:
            in_class = piece != "]"
        elif piece == "[":
            in_class = True
        elif piece in "()":
            depth += 1 if piece == "(" else -1
        elif piece == "|" and not depth:
            parts.append("")
            continue
        parts[-1] += piece
    return parts


def _first_letters(alternative: str) -> set[str] | None:
    """Characters with which a match of the alternative begins; None if that cannot be read from it."""
    rest = re.sub(r"^(?:\\b|\(\?<![^()]*\))*", "", alternative)
    opened = re.match(r"\((?:\?:)?(?!\?)", rest)
    if opened:
        inner, depth = rest[opened.end() :], 1
        for end, sign in enumerate(inner):
            depth += (sign == "(") - (sign == ")")
            if not depth:
                break
        after = inner[end + 1 :]
        if depth or re.search(r"[\\\[][()]", inner) or after[:1] in ("*", "{"):
            return None
        found = [_first_letters(part) for part in _alternatives(inner[:end])]
        if after[:1] == "?":
            found.append(_first_letters(after[1:]) if after[1:2] not in ("?", "+") else None)
        return None if None in found else set().union(*found)
    if not rest or not rest[0].isalnum() or rest[1:2] in ("?", "*", "{"):
        return None
    return {rest[0]}


@lru_cache(maxsize=256)
def _regex(pattern: str) -> str:
    """The pattern for matches without case. An alternative is tried only where a character stands with which it can begin: most places of a
    text fail in a test of a class and not in one comparison for each word of the vocabulary. The matches are the same."""
    if re.search(UNREAD, pattern):
        return "(?iU)" + pattern
    groups: list[tuple[str, set[str], list[str]]] = []
    for part in _alternatives(pattern):
        first = _first_letters(part)
        kind = "any" if not first else "letter" if any(c <= "\x7f" or c.lower() != c.upper() for c in first) else "script"
        if kind != "any" and part[0].isalnum() and groups and groups[-1][0] == kind and groups[-1][2][-1][0].isalnum():  # neighbours share their test
            groups[-1][1].update(first)
            groups[-1][2].append(part)
        else:
            groups.append((kind, first or set(), [part]))
    tests = {"any": "", "letter": "(?=[{}])", "script": r"(?-iU:(?=[^\x00-\x7f]))"}
    return "(?iU)" + "|".join(tests[kind].format("".join(sorted(first))) + (f"(?:{'|'.join(parts)})" if len(parts) > 1 else parts[0]) for kind, first, parts in groups)


MAX_WORDS = 64  # strings that a stretch of a pattern may stand for

# Letters outside ASCII that a match without case takes for one inside, and what they stand for; and others that have one capital each.
FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")
PLAIN_LETTERS = "áàâãçéêíóôõúü"


def _strings(item: tuple) -> set[str] | None:
    """All strings a part of a pattern matches, in lower case; None if they are many or cannot be listed."""
    kind, value = str(item[0]), item[1]
    if kind == "LITERAL":
        letter = chr(value)
        return {letter.lower()} if letter.isascii() or letter.lower() in PLAIN_LETTERS or letter.lower() == letter.upper() else None
    if kind == "IN":
        found = [_strings(x) if str(x[0]) == "LITERAL" else None for x in value]
        return None if None in found else set().union(*found)
    if kind in ("SUBPATTERN", "BRANCH"):
        found = [_runs(part) for part in (value[1] if kind == "BRANCH" else [value[3]])]
        whole = [run[0] if len(run) == 1 else None for run in found]
        out = None if None in whole else set().union(*whole)
        return out if out is not None and len(out) <= MAX_WORDS else None
    if kind == "MAX_REPEAT" and tuple(value[:2]) == (0, 1):
        once = _runs(value[2])
        return {""} | once[0] if len(once) == 1 and once[0] is not None else None
    return {""} if kind in ("AT", "ASSERT", "ASSERT_NOT") else None


def _runs(sequence) -> list[set[str] | None]:
    """The strings of each stretch between parts that cannot be listed, which are None."""
    runs: list[set[str] | None] = [{""}]
    for item in sequence:
        found = _strings(item)
        if found is None:
            runs += [None, {""}]
        elif len(runs[-1]) * len(found) <= MAX_WORDS:
            runs[-1] = {a + b for a, b in product(runs[-1], found)}
        else:
            runs += [None, found]
    return runs if len(runs) == 1 else [r for r in runs if r != {""}]


def _worth(words: set[str]) -> tuple[int, bool]:
    """How rare the strings are: the length of the shortest, and that it is not a letter."""
    return min((len(w), not w.isalnum()) for w in words) if words else (0, False)


def _needed(sequence) -> set[str]:
    """Strings of which every match of a sequence holds one; the empty one if there is nothing to go by."""
    best = max([r for r in _runs(sequence) if r], key=_worth, default={""})
    for item in sequence:
        kind, value = str(item[0]), item[1]
        inner = None
        if kind == "BRANCH":
            inner = set().union(*[_needed(part) for part in value[1]])
        elif kind == "SUBPATTERN":
            inner = _needed(value[3])
        elif kind == "MAX_REPEAT" and value[0] > 0:
            inner = _needed(value[2])
        best = inner if inner and _worth(inner) > _worth(best) else best
    return best


@lru_cache(maxsize=256)
def _words(pattern: str) -> tuple[str, ...]:
    """Strings in lower case, one of which is in every text that the pattern matches without case; none if that cannot be said."""
    if re.search(UNREAD, pattern):
        return ()
    try:
        found = _needed(parser.parse(pattern))
    except (re.error, OverflowError):
        return ()
    shortest = {w for w in found if not any(o != w and o in w for o in found)}
    return tuple(sorted(shortest)) if "" not in shortest else ()


def _fold(text) -> Column:
    return F.lower(F.translate(_col(text), *FOLDED))


MAX_SCREENED = 62  # bits of a long


def _screen(patterns: list[str], folded: Column) -> tuple[Column, dict[str, int]]:
    """(bits of a text, bit of a pattern): for patterns whose matches hold one of a few strings, whether a text has one.

    The strings of a pattern are looked for in one pass over a batch, which is many times cheaper than to try the pattern; patterns of which
    nothing is known are left out."""
    known = [p for p in dict.fromkeys(patterns) if _words(p)][:MAX_SCREENED]
    searches = ["|".join(re.escape(w) for w in _words(p)) for p in known]

    @F.arrow_udf("long")
    def screen(texts: pa.Array) -> pa.Array:
        bits = np.zeros(len(texts), np.int64)
        for k, search in enumerate(searches):
            bits |= pc.fill_null(pc.match_substring_regex(texts, search), True).to_numpy(zero_copy_only=False).astype(np.int64) << k
        return pa.array(bits)

    return screen(folded), {p: 1 << k for k, p in enumerate(known)}


ADDED = ("attention_score", "attention_reasons", "event_type", "category", "market_relevant")


def triage(leads: DataFrame, rules: RuleSet = DEFAULT_RULES, matched: str = "tickers") -> DataFrame:
    """Add attention_score, attention_reasons, event_type, category and market_relevant to leads that
    carry their matched names."""
    return with_name_bonus(score_texts(leads, rules), matched)


def with_name_bonus(scored: DataFrame, matched: str = "tickers") -> DataFrame:
    """A name match adds eight whether or not there is an event."""
    named = F.size(F.coalesce(F.col(matched), F.array().cast("array<string>"))) > 0
    score = F.least(F.lit(MAX_SCORE), F.col("attention_score") + F.when(named, PRIORITY_BONUS).otherwise(0))
    reasons = F.when(named, F.concat("attention_reasons", F.array(F.lit(PRIORITY_REASON)))).otherwise(F.col("attention_reasons"))
    return scored.withColumns({"attention_score": score, "attention_reasons": reasons})


def score_texts(leads: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Scores without names: the texts need not travel to the join that brings the names.

    All rules run in one projection over the row's own text: no join and no shuffle. A headline
    signal counts its full score, a body signal eight less; the best three signals are the
    reasons."""
    base = leads.withColumn("_h", clean(nfkc(F.coalesce("title", F.lit(""))))).withColumn("_b", clean(nfkc(F.coalesce("text", F.lit("")))))
    base = base.withColumn("_all", F.trim(F.concat_ws(" ", "_h", "_b")))
    patterns = [rules.business, rules.macro, *[p for r in rules.rules for p in (r.pattern, r.strip, r.context) if p]]
    bits, known = _screen(patterns, _fold("_all"))
    base = base.withColumn("_bits", bits)
    # Headline and body are parts of the whole text, so that a string that is not there is in neither.
    may = lambda pattern: F.col("_bits").bitwiseAND(known[pattern]) != 0 if pattern in known else F.lit(True)
    said = lambda pattern: may(pattern) & F.col("_all").rlike(_regex(pattern))
    business = said(rules.business)

    hits = []
    for order, rule in enumerate(rules.rules):
        head, body, maybe = F.col("_h"), F.col("_b"), may(rule.pattern)
        if rule.strip:  # what is left of a text may match where the whole did not
            head, body = (F.when(may(rule.strip), F.regexp_replace(c, _regex(rule.strip), "")).otherwise(c) for c in (head, body))
            maybe = maybe | may(rule.strip)
        if rule.context:
            unclear = said(rule.context) & ~business
            head, body = (F.when(unclear, F.regexp_replace(c, _regex(rule.strip_context), "")).otherwise(c) for c in (head, body))
            maybe = maybe | may(rule.context)
        hit = lambda score, where, order=order, rule=rule: F.struct(
            F.lit(-score).alias("rank"), F.lit(order).alias("order"), F.lit(rule.event_type).alias("event_type"),
            F.lit(rule.category).alias("category"), F.lit(f"{rule.event_type} signal in {where}").alias("reason"))
        hits.append(F.when(maybe, F.when(head.rlike(_regex(rule.pattern)), hit(rule.score, "headline"))
                           .when(body.rlike(_regex(rule.pattern)), hit(rule.score - BODY_DISCOUNT, "article text"))))
    scored = base.withColumn("_hits", F.array_sort(F.array_compact(F.array(*hits))))

    best = F.try_element_at("_hits", F.lit(1))
    fallback = lambda score, kind, reason, relevant: F.struct(
        F.lit(score).alias("score"), F.lit(kind).alias("event_type"), F.lit(DEFAULT_SECTION).alias("category"),
        F.array(F.lit(reason)).alias("reasons"), F.lit(relevant).alias("relevant"))
    found = F.struct((-best["rank"]).alias("score"), best["event_type"].alias("event_type"), best["category"].alias("category"),
                     F.transform(F.slice("_hits", 1, TOP_REASONS), lambda h: h["reason"]).alias("reasons"), F.lit(True).alias("relevant"))
    scored = scored.withColumn(
        "_t", F.when(F.size("_hits") > 0, found)
        .when(said(rules.macro), fallback(MACRO_SCORE, "Macro/markets", MACRO_REASON, True))
        .when(business, fallback(BUSINESS_SCORE, "General business", BUSINESS_REASON, True))
        .otherwise(fallback(0, "Other", NO_REASON, False)))
    return scored.select(
        *[c for c in leads.columns if c not in ADDED], F.col("_t.score").alias("attention_score"), F.col("_t.reasons").alias("attention_reasons"),
        F.col("_t.event_type").alias("event_type"), F.col("_t.category").alias("category"), F.col("_t.relevant").alias("market_relevant"))


def event_label(text, labels=EVENT_LABELS) -> Column:
    """Name of the first rule that matches."""
    value, out = _col(text), F.lit(DEFAULT_EVENT_LABEL)
    for name, pattern in reversed(labels):
        out = F.when(value.rlike(_regex(pattern)), name).otherwise(out)
    return out


def passes_attention(score, relevant, retain_all, minimum=MIN_ATTENTION) -> Column:
    """Keep a lead unless it is irrelevant or scores low; some sources keep everything."""
    least = minimum if isinstance(minimum, Column) else F.lit(minimum)
    return F.coalesce(_col(retain_all), F.lit(False)) | (_col(relevant) & (_col(score) >= least))
