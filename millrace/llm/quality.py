"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every document gets scores (``RULES``); a rule rejects scores above its cutoff. Cutoffs are
chosen per stratum (language) on labelled documents held out for it: for each rule and each
cutoff of its grid, the good documents that it would reject are counted, and an exact
binomial test asks whether its false rejection rate could still be above ``alpha`` over the
number of rules. The tests of a rule go from its loosest cutoff to the strictest and end at
the first that fails (a fixed sequence needs no further correction); over strata and rules
the level is divided by their number (Bonferroni). So, with probability ``1 - delta`` over
the labels, in every stratum at most a share ``alpha`` of the good documents is rejected by
the rules together. A stratum or rule with too few labels gets no cutoff and rejects nothing.

Rows: one per input row. Null or blank text has no words and fails the base rules. A null
stratum is a stratum of its own. Repeated label rows of an id count once, of contradicting
ones the good one; ids that repeat among the documents count as often as they occur.
An empty table, or one without labels, gives no cutoffs. Columns added to ``docs`` are named
``__q`` so that no column of ``docs`` clashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_text, materialise
from millrace.llm.native import WHITE, indices, let, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ALPHA, DELTA = 0.02, 0.05
#: Score and grid of cutoffs, loosest first, per rule.
RULES = {
    "symbols": (lambda f: f["n_symbols"] / f["n_words"], (2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1)),
    "exclamations": (lambda f: f["n_exclaim"] / f["n_words"], (2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2)),
    "upper_case": (lambda f: f["n_upper"] / f["word_chars"], (0.9, 0.7, 0.5, 0.4, 0.3, 0.2)),
    "repeated_lines": (lambda f: f["n_dup_lines"] / f["n_lines"], (0.8, 0.7, 0.6, 0.5, 0.4, 0.35)),
    "repeated_words": (lambda f: f["n_repeat_words"] / f["n_words"], (0.15, 0.10, 0.05)),
}
#: Stratum rows that are broadcast at most; more of them are joined by shuffle.
BROADCAST_STRATA = 50_000


def repeat_words(w: Column, width: int = 5) -> Column:
    """Words within windows of ``width`` words that occur twice or more in the text.

    Windows are compared by 64-bit hashes, sorted with their places, so the work follows the
    length of the text also where all of it repeats."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    windows = let(hashes, lambda h: F.transform(indices(F.size(h) - (width - 1)),
                                                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))

    def covered(places: Column) -> Column:
        """``places``: sorted starts of repeated windows."""
        step = F.transform(places, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - p, F.lit(width))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(pairs, lambda p: F.sort_array(F.transform(
            F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"])))
        return let(places, covered)

    return let(windows, lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(repeated(win)))


def features(docs: DataFrame, stratum: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` (columns ``keep``) with the struct ``__q``: stratum, features, base verdict, scores."""
    t = F.col("__q_text")
    own_lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    rows = docs.select(*keep, F.col(stratum).cast("string").alias("__q_stratum"), as_text().alias("__q_text"))
    rows = rows.withColumn("__q_f", let(words(t), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeat_words(w).cast("bigint").alias("n_repeat_words"))))
    rows = rows.withColumn("__q_l", let(own_lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"),
                                                                     (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("bigint")
    f = {"n_words": F.col("__q_f.n_words"), "n_repeat_words": F.col("__q_f.n_repeat_words"), "n_lines": F.col("__q_l.n_lines"), "n_dup_lines": F.col("__q_l.n_dup_lines"),
         "word_chars": (F.char_length(t) - count("[\\x20\\x09-\\x0D]")), "n_symbols": count("[#*$%&|<>]"), "n_exclaim": count("[!?]"), "n_upper": count("[A-Z]")}
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])
    q = F.struct(F.col("__q_stratum").alias("stratum"), *[c.alias(n) for n, c in f.items()], failed.alias("base_failed"))
    return rows.select(*keep, q.alias("__q"))


def _score(rule: str) -> Column:
    return F.when(F.col("__q.n_words") > 0, RULES[rule][0](F.col("__q")))


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series of the gamma function moved up by ten (error below 1e-12)."""
    x = n.cast("double") + 11.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    for k in range(1, 11):
        series = series - F.log(n.cast("double") + float(k))
    return series


def binomial_p_value(r: Column, n: Column, rate: float) -> Column:
    """P(X <= r) for X of the binomial distribution with n draws of probability ``rate``, 1 from the mean on.

    The terms fall from r downwards by ratios that shrink; they are added until they can add
    nothing in double precision, and what a geometric series could still add is added too."""
    top = F.exp(_log_factorial(n) - _log_factorial(r) - _log_factorial(n - r) + r * math.log(rate) + (n - r) * math.log1p(-rate))
    steps = F.sequence(F.lit(0), F.least(r, F.lit(20_000).cast("bigint")).cast("int"))
    ratio = lambda i: i.cast("double") * (1 - rate) / ((n - i + 1).cast("double") * rate)
    total = F.aggregate(steps, F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
                        lambda a, k: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * ratio(r - k)).alias("t")),
                        lambda a: a["s"] + F.when(r > 20_000, a["t"] / (1 - ratio(r))).otherwise(0.0))
    return F.when(r >= n * rate, 1.0).otherwise(F.least(F.lit(1.0), top * total))


def thresholds(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id") -> DataFrame:
    """``(__t_stratum, cutoffs)``: a map from rule to cutoff, rules without one missing."""
    good = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
                  .where(F.col("quality") == 1).select(F.col("doc_id").alias("__g_id")))
    held = scored.where(~F.col("__q.base_failed")).join(good, F.col(id_col) == F.col("__g_id"), "left_semi")
    grid = [(rule, c) for rule, (_, cutoffs) in RULES.items() for c in cutoffs]
    counts = held.groupBy(F.col("__q.stratum").alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((_score(rule) > c).cast("bigint")).alias(f"r{k}") for k, (rule, c) in enumerate(grid)])
    counts = materialise(counts, "quality-counts")  # a row per stratum
    level = delta / max(1, counts.count() * len(RULES))
    tests = counts.select("stratum", "n", F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"r{k}").alias("r")) for k, (rule, c) in enumerate(grid)])).alias("x"))
    passed = tests.select("stratum", "x.*", (binomial_p_value(F.col("x.r"), F.col("n"), alpha / len(RULES)) <= level).alias("ok"))
    # The rejections, and so the p-values, only grow from cutoff to stricter cutoff: the strictest that passes ends the sequence.
    best = passed.where("ok").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    best = best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    return best.select(F.col("stratum").alias("__t_stratum"), "cutoffs")


def judge(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``scored`` with ``__kept``: base rules passed and no score above its stratum's cutoff."""
    cutoffs = materialise(cutoffs.withColumnRenamed("cutoffs", "__t_cutoffs"), "quality-cutoffs")
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(_score(rule) > F.col("__t_cutoffs")[rule], F.lit(False))
    return (scored.join(cutoffs, F.col("__q.stratum").eqNullSafe(F.col("__t_stratum")), "left")
                  .withColumn("__kept", ~F.col("__q.base_failed") & ~over).drop("__t_stratum", "__t_cutoffs"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the counts, ``base_failed``, ``kept``."""
    scored = materialise(features(docs), "quality-scores")
    out = judge(scored, thresholds(scored, labels))
    return out.select("doc_id", *[f"__q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that all rules keep, with the columns of ``docs``."""
    names = docs.columns
    # Scores are computed again for the verdict: cheaper than a copy of all texts in the shared folder.
    cutoffs = thresholds(features(docs), labels, alpha, delta)
    return judge(features(docs, keep=tuple(names)), cutoffs).where("__kept").select(*names)
