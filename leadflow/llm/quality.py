"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Every text gives counts, the counts a vector of transformed statistics. For each group of language and source the centre and
scatter are those of the rows with the smallest Mahalanobis distances (three quarters of the group), found by concentration steps
from two deterministic starts, of which the smaller determinant wins; one reweighting step follows. Rows far from the centre are
rejected. Everything is a DataFrame expression; the iterated tables hold numbers only, never texts.

* Ranks inside a group are never sorted in one task: squared distances are counted by logarithmic class, and the concentration
  set is the smallest run of whole classes that holds the wanted share.
* A group of fewer than ``min_rows`` rows shares one estimate with the other small groups of its language, and languages that
  are still too small share one; where even that is too small, only the base rules decide.
* Scatter gets a floor per statistic (``FLOORS``), so that statistics that are constant in clean text stay usable.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.support import row_key, written

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
MIN_WORDS = 10
SHARE = 0.75  # share of a group that the concentration set holds
STEPS = 3  # concentration steps from each start
MIN_ROWS = 50
CLASSES = 16  # distance classes per unit of the logarithm
REJECT_TAIL = 1e-7  # chi-square tail beyond which a row is an outlier
WEIGHT_TAIL = 0.025  # tail left out of the reweighted estimate
# Statistics and the standard deviation that their scatter has at least.
STATISTICS = ("word_length", "symbols", "capitals", "repeats")
FLOORS = (0.12, 0.25, 0.25, 0.25)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words inside windows that occur at least twice: sorted by hash, equal neighbours name their places."""
    def places(rows: Column) -> Column:
        found = F.transform(rows, lambda r, i: F.when((F.get(rows, i - 1)["h"] == r["h"]) | (F.get(rows, i + 1)["h"] == r["h"]), r["p"]))
        return F.sort_array(F.filter(found, lambda p: p.isNotNull()))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    width = F.lit(WINDOW)
    return let(pairs, lambda rows: let(places(rows), lambda at: F.aggregate(
        F.transform(at, lambda p, i: F.coalesce(F.least(F.get(at, i + 1) - p, width), width)), F.lit(0), lambda a, b: a + b)))


def _repeated(words: Column) -> Column:
    """Number of words in windows of five found twice or more; ``words`` are hashes."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(
        let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w))))


def text_counts(text: Column) -> Column:
    """Struct of the base counts of a text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).alias("n"), _repeated(h).alias("r")))
    of_lines = let(lines, lambda one: F.size(one) - F.size(F.array_distinct(one)))
    return F.struct(
        of_words.alias("w"), of_lines.cast("long").alias("n_dup_lines"),
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))).cast("long").alias("n_capitals"))


def with_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One narrow row per row of ``docs``: id, key of the row, group columns and counts."""
    return (docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, lang, source, text).alias("row_key"),
                        F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("?")).alias("lang"),
                        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("?")).alias("source"), text_counts(F.col(text)).alias("c"))
            .select("doc_id", "row_key", "lang", "source", F.col("c.w.n").cast("long").alias("n_words"), "c.word_chars", "c.n_symbols", "c.n_dup_lines",
                    F.col("c.w.r").cast("long").alias("n_repeat_words"), "c.n_capitals"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def statistics() -> list[Column]:
    """Transformed statistics; the added constants draw short texts, whose ratios are noisy, towards the centre."""
    words, chars = F.col("n_words") + 20.0, F.col("word_chars") + 100.0
    return [F.log(chars / words), F.asinh(10 * F.col("n_symbols") / words), F.log((F.col("n_capitals") + 5.0) / chars),
            F.asinh(5 * (F.col("n_repeat_words") + F.col("n_dup_lines")) / words)]


# ---------------------------------------------------------------- chi-square values


def chi_square_below(x: float, k: int) -> float:
    """P(X <= x) for k degrees of freedom: series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = 1 / a
    n = 1
    while term > total * 1e-16:
        term *= half / (a + n)
        total += term
        n += 1
    return total * math.exp(a * math.log(half) - half - math.lgamma(a))


def chi_square_quantile(share: float, k: int) -> float:
    lo, hi = 0.0, 1.0
    while chi_square_below(hi, k) < share and hi < 1e4:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_below(mid, k) < share else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float, k: int) -> float:
    """Factor that makes the scatter of the ``share`` nearest rows that of a normal distribution."""
    return share / chi_square_below(chi_square_quantile(share, k), k + 2)


# ---------------------------------------------------------------- estimates


def _assign(rows: DataFrame, min_rows: int) -> DataFrame:
    """Name of the group that each pair of language and source takes its estimate from; null if none is large enough."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("own", F.col("n") >= min_rows)
    by_lang = sizes.filter(~F.col("own")).groupBy("lang").agg(F.sum("n").alias("n_lang")).withColumn("pooled", F.col("n_lang") >= min_rows)
    rest = by_lang.filter(~F.col("pooled")).agg(F.coalesce(F.sum("n_lang"), F.lit(0)) >= min_rows).first()[0]  # one row
    return sizes.join(by_lang, "lang", "left").select("lang", "source", F.when(F.col("own"), F.concat("lang", F.lit("\n"), "source"))
                      .when(F.col("pooled"), F.col("lang")).when(F.lit(bool(rest)), F.lit("*")).alias("g"))


def _factored(params: DataFrame, p: int, factor: float) -> DataFrame:
    """Adds the lower Cholesky factor ``l_i_j`` of the scatter ``s_i_j`` (times ``factor``, plus floors) and its log-determinant."""
    for j in range(p):
        inner = [F.col(f"l_{j}_{k}") ** 2 for k in range(j)]
        params = params.withColumn(f"l_{j}_{j}", F.sqrt(reduce(lambda a, b: a - b, inner, F.col(f"s_{j}_{j}") * factor + FLOORS[j] ** 2)))
        if j + 1 < p:
            params = params.withColumns({f"l_{i}_{j}": reduce(lambda a, b: a - b, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)],
                                                              F.col(f"s_{i}_{j}") * factor) / F.col(f"l_{j}_{j}") for i in range(j + 1, p)})
    return params.withColumn("log_det", 2 * reduce(lambda a, b: a + b, [F.log(f"l_{j}_{j}") for j in range(p)])).drop(*[f"s_{i}_{j}" for i in range(p) for j in range(i + 1)])


def _distanced(rows: DataFrame, params: DataFrame, on: list[str], p: int, how: str = "inner") -> DataFrame:
    """Joins centre and factor to the rows and adds the squared Mahalanobis distance ``d2``."""
    out = rows.join(params, on, how)
    for i in range(p):
        out = out.withColumn(f"z_{i}", reduce(lambda a, b: a - b, [F.col(f"l_{i}_{k}") * F.col(f"z_{k}") for k in range(i)], F.col(f"x_{i}") - F.col(f"m_{i}")) / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"z_{i}") ** 2 for i in range(p)]))


def _moments(rows: DataFrame, by: list[str], p: int) -> DataFrame:
    """Mean and scatter of each group, summed around the present centre ``m_i``, in one aggregation."""
    c = [F.col(f"x_{i}") - F.col(f"m_{i}") for i in range(p)]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.first(f"m_{i}").alias(f"o_{i}") for i in range(p)], *[F.avg(c[i]).alias(f"a_{i}") for i in range(p)],
                                 *[F.avg(c[i] * c[j]).alias(f"q_{i}_{j}") for i in range(p) for j in range(i + 1)])
    return sums.select(*by, "n", *[(F.col(f"o_{i}") + F.col(f"a_{i}")).alias(f"m_{i}") for i in range(p)],
                       *[(F.col(f"q_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}")).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)])


def _start(rows: DataFrame, p: int) -> DataFrame:
    """Two starts per group: medians with spreads between quartiles, and plain means with the plain scatter."""
    middle = rows.groupBy("g").agg(F.count("*").alias("size"), *[F.percentile_approx(f"x_{i}", [0.25, 0.5, 0.75], 2000).alias(f"p_{i}") for i in range(p)])
    robust = middle.select("g", "size", F.lit(0).alias("start"), *[F.col(f"p_{i}")[1].alias(f"m_{i}") for i in range(p)],
                           *[(((F.col(f"p_{i}")[2] - F.col(f"p_{i}")[0]) / 1.349) ** 2 if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)])
    centred = rows.withColumns({f"m_{i}": F.lit(0.0) for i in range(p)})
    plain = _moments(centred, ["g"], p).withColumnRenamed("n", "size").withColumn("start", F.lit(1))
    return robust.unionByName(plain)


def estimate(rows: DataFrame, p: int, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate of each group ``g`` of ``rows`` (columns ``g``, ``x_i``).

    Every step is two passes over the rows and one small table; that table is written, so that lineage stays short and the
    planner knows its size when it chooses the join."""
    scale = consistency(share, p)
    params = written(_factored(_start(rows, p), p, 1.0), "mcd-start")
    keys = ["g", "start"]
    for _ in range(steps):
        classed = _distanced(rows, params, ["g"], p).withColumn("class", F.floor(F.log(F.col("d2") + 1e-9) * CLASSES))
        counts = classed.groupBy(*keys, "class").agg(F.count("*").alias("n"), F.first("size").alias("size"))
        # Classes of one group are at most a few hundred, so this window has a bounded group.
        run = counts.selectExpr(*keys, "class", "size", "sum(n) OVER (PARTITION BY g, start ORDER BY class) AS upto")
        cut = run.filter(F.col("upto") >= F.ceil(F.lit(share) * F.col("size"))).groupBy(*keys).agg(F.min("class").alias("cut"))
        bounds = written(params.join(cut, keys), "mcd-cut")
        near = _distanced(rows, bounds, ["g"], p).filter(F.floor(F.log(F.col("d2") + 1e-9) * CLASSES) <= F.col("cut"))
        moments = _moments(near, keys, p).drop("n").join(params.select(*keys, "size"), keys)
        params = written(_factored(moments, p, scale), "mcd-step")
    best = params.groupBy("g").agg(F.min(F.struct("log_det", "start")).alias("b")).select("g", F.col("b.start").alias("start"))
    params = written(params.join(best, keys).drop("start"), "mcd-best")
    inside = _distanced(rows, params, ["g"], p).filter(F.col("d2") <= chi_square_quantile(1 - WEIGHT_TAIL, p))
    return written(_factored(_moments(inside, ["g"], p).drop("n"), p, consistency(1 - WEIGHT_TAIL, p)), "mcd-weighted")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
          min_rows: int = MIN_ROWS, tail: float = REJECT_TAIL) -> DataFrame:
    """One row per row of ``docs``: id, row key, counts, ``base_failed``, ``distance`` and ``kept``.

    Null or empty texts and texts under ten words fail the base rules. Null languages and sources are groups of their own.
    ``distance`` is null where no estimate exists or the base rules failed; such rows are kept unless they failed. Repeated rows
    get the same verdict. Other columns of ``docs`` are not read."""
    p = len(STATISTICS)
    counted = with_counts(docs, doc_id, text, lang, source).withColumn("base_failed", base_failed())
    rows = written(counted.select("*", *[s.alias(f"x_{i}") for i, s in enumerate(statistics())]), "quality-counts")
    sound = rows.filter(~F.col("base_failed"))
    groups = written(_assign(sound, min_rows).filter("g IS NOT NULL"), "quality-groups")
    params = estimate(sound.join(groups, ["lang", "source"]).select("g", *[f"x_{i}" for i in range(p)]), p)
    limit = chi_square_quantile(1 - tail, p)
    far = _distanced(rows.join(groups, ["lang", "source"], "left"), params, ["g"], p, "left")
    distance = F.when(~F.col("base_failed"), F.sqrt("d2"))
    return far.select("doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(True))).alias("kept"), distance.alias("distance"))


def keep_sound(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **rules) -> DataFrame:
    """The rows that pass, with the columns they came with. Equal rows share a verdict, so the key of the row decides."""
    good = judge(docs, doc_id, text, lang, source, **rules).filter("kept").select(F.col("row_key").alias("_sound")).distinct()
    return docs.join(good, row_key(doc_id, lang, source, text) == F.col("_sound"), "left_semi")
