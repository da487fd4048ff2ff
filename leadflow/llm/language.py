"""Language identification: averaged hashed subword embeddings with a linear softmax.

A subword is a run of two to four bytes of the lower-cased text that holds a break (any ASCII byte but a letter) at its first
or last place only. Subwords are hashed into buckets of small vectors; a text is the mean of its subwords' vectors, and a linear
layer with softmax names the language. The model is trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows; a temperature is fitted on rows kept out of training, and texts below a calibrated score are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructType

from leadflow.llm.support import text_buffer, uniform, windows

UNKNOWN = "und"
BUCKETS = 1 << 15
DIMENSION = 16
SAMPLE_PER_LANGUAGE = 300  # bound of the training sample: rows of one language
MAX_LANGUAGES = 2_000  # more distinct labels than this are an error
EPOCHS = 12
RATE = 0.3
HOLD_BACK = 0.25  # share of the sample used to calibrate
LOST_SHARE = 0.001  # share of rightly named calibration texts that rejection may lose
MAX_THRESHOLD = 0.5

_BREAKS = np.ones(256, dtype=bool)
_BREAKS[0x41:0x5B] = _BREAKS[0x61:0x7B] = _BREAKS[0x80:] = False
_NORMAL = np.where(_BREAKS, 0x20, np.arange(256)).astype(np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """``vectors`` holds a row per bucket; ``weights`` is None where they are folded into it."""

    languages: tuple[str, ...]
    vectors: np.ndarray
    weights: np.ndarray | None
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, means: np.ndarray) -> np.ndarray:
        return (means if self.weights is None else means @ self.weights) + self.bias


def subwords(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of subword: their buckets and the places (from ``lo``) where they begin; none spans two rows."""
    raw = data[lo:hi]
    code, inside = _NORMAL[raw], ~_BREAKS[raw]
    row = np.searchsorted(offsets, np.arange(lo, hi), side="right") if len(offsets) > 2 else None
    for length in (2, 3, 4):
        if len(raw) < length:
            continue
        last = len(raw) - length + 1
        keep = inside[:last] | inside[length - 1 :] if length == 2 else inside[1 : last + 1].copy()
        if length == 4:
            keep &= inside[2 : last + 2]
        if row is not None:
            keep &= row[:last] == row[length - 1 :]
        value = np.full(last, length, dtype=np.uint32) * np.uint32(0x9E3779B1)
        for k in range(length):
            value = (value ^ code[k : last + k]) * np.uint32(0x01000193)
        at = np.flatnonzero(keep)
        value = value[at]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x85EBCA6B)
        yield value >> np.uint32(32 - 15), at


def text_means(texts: pa.Array, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector of the subwords of every row, and the number of subwords."""
    data, offsets = text_buffer(pc.utf8_lower(texts))
    sums, counts = np.zeros((len(texts), vectors.shape[1])), np.zeros(len(texts), dtype=np.int64)
    for lo, hi in windows(data, offsets, _BREAKS, 1 << 18):
        for buckets, at in subwords(data, offsets, lo, hi):
            if not len(at):
                continue
            row = np.searchsorted(offsets, at + lo, side="right") - 1
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            sums[row[first]] += np.add.reduceat(vectors[buckets], first, axis=0)
            counts[row[first]] += np.diff(np.r_[first, len(row)])
    return sums / np.maximum(counts, 1)[:, None], counts


@arrow_udf(StructType().add("buckets", ArrayType(IntegerType())).add("shares", ArrayType(FloatType())))
def _features(texts: pa.Array) -> pa.Array:
    data, offsets = text_buffer(pc.utf8_lower(texts))
    rows = []
    for i in range(len(texts)):
        counts = np.zeros(BUCKETS)
        own = data[offsets[i] : offsets[i + 1]]
        ends = np.array([0, len(own)])
        for lo, hi in windows(own, ends, _BREAKS):
            for buckets, _ in subwords(own, ends, lo, hi):
                counts += np.bincount(buckets, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        rows.append({"buckets": used.astype(np.int32), "shares": (counts[used] / max(1.0, counts.sum())).astype(np.float32)})
    return pa.array(rows, type=pa.struct([("buckets", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))]))


def _softmax(logits: np.ndarray) -> np.ndarray:
    out = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return out / out.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], held: list[bool], seed: int = 11) -> LanguageModel:
    """``rows``: language, buckets and shares of each sampled text; ``held`` marks the rows kept for calibration."""
    languages = tuple(sorted({r[0] for r in rows}))
    number = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    weights = rng.normal(0, 0.5, (DIMENSION, max(1, len(languages))))
    bias = np.zeros(max(1, len(languages)))
    fit = [r for r, out in zip(rows, held) if not out and len(r[1])] or [r for r in rows if len(r[1])]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(fit)):
            name, buckets, shares = fit[k]
            mean = shares @ vectors[buckets]
            error = _softmax(mean @ weights + bias)
            error[number[name]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            vectors[buckets] -= rate * (shares / (shares @ shares))[:, None] * back
    kept = [r for r, out in zip(rows, held) if out and len(r[1])]
    temperature, threshold = 1.0, 0.0
    if kept and len(languages) > 1:
        logits = np.array([r[2] @ vectors[r[1]] for r in kept]) @ weights + bias
        truth = np.array([number[r[0]] for r in kept])
        scale = np.geomspace(0.25, 8, 61)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(kept)), truth] + 1e-12).mean() for t in scale]
        temperature = float(scale[int(np.argmin(loss))])
        shares = _softmax(logits / temperature)
        right = shares.argmax(axis=1) == truth
        if right.any():
            threshold = float(min(MAX_THRESHOLD, np.quantile(shares.max(axis=1)[right], LOST_SHARE)))
    if len(languages) <= DIMENSION:
        return LanguageModel(languages, (vectors @ weights).astype(np.float32), None, bias, temperature, threshold)
    return LanguageModel(languages, vectors.astype(np.float32), weights, bias, temperature, threshold)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Train on at most about ``per_language`` distinct texts of each language, chosen by the hash of the text.

    Rows without text or label are left out. What comes to the driver is the hashed counts of the sample, not texts."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return train([], [])
    share = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, per_language / n)))])
    sample = (rows.withColumn("place", uniform("lang", "text")).filter(F.col("place") < share[F.col("lang")])
              .dropDuplicates(["lang", "place"]).withColumn("found", _features("text"))
              .select("lang", "place", "found.buckets", "found.shares").orderBy("place", "lang").limit(2 * per_language * len(counts)).collect())
    found = [(r["lang"], np.array(r["buckets"], dtype=np.int64), np.array(r["shares"], dtype=np.float64)) for r in sample]
    return train(found, [(r["place"] * 1e6) % 1 < HOLD_BACK for r in sample])


def predict(model: LanguageModel, text: str | Column = "text") -> Column:
    """Column ``struct<lang_pred, score, accepted>`` of a text column.

    A null text, one without a letter, and every text under a model that learned nothing, is ``und`` with score 0. ``accepted`` is
    false for those and for scores below the calibrated threshold. Any text is read whole; ties go to the first language by name."""

    @arrow_udf(StructType().add("lang_pred", "string").add("score", "double").add("accepted", "boolean"))
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = texts.fill_null("")
            letter = np.asarray(pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False), dtype=bool) if len(texts) else np.zeros(0, bool)
            if not model.languages:
                letter[:] = False
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            else:
                means, _ = text_means(texts, model.vectors)
                shares = _softmax(model.logits(means) / model.temperature)
                best = shares.argmax(axis=1) if len(texts) else np.zeros(0, int)
                score = np.where(letter, shares.max(axis=1, initial=0), 0.0)
            names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, letter)]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(letter & (score >= model.threshold))],
                                             names=["lang_pred", "score", "accepted"])

    return named(text)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """True for rows kept out of training: remainder of the CRC-32 of the id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == part, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Every row with ``held_out``, ``lang_pred``, ``score`` and ``accepted``; trained on the rows not held out.

    One row out per row in, repeated rows included; a null id is not held out."""
    model = fit(docs.filter(~held_out(doc_id)), text, lang)
    return (docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), predict(model, F.col(text)).alias("found"))
            .select("doc_id", "held_out", "found.lang_pred", "found.score", "found.accepted"))


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The rows whose language is accepted, with the columns they came with. Null, empty and letterless texts are not accepted; equal texts share a
    decision, so repeated rows all stay or go; an empty table stays empty."""
    model = fit(docs.filter(~held_out(doc_id)), text, lang)
    return docs.filter(predict(model, F.col(text))["accepted"])
