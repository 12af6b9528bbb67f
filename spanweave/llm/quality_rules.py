"""Quality rules with risk-controlled thresholds (native: DataFrame functions only).

Each rule compares one ratio of a document with a cutoff out of a fixed grid.  The grids are walked together in ``STEPS`` steps from lenient
to strict: the policy of a step rejects what any rule rejects at its cutoff of that step.  Labelled documents are the holdout (grid
and steps do not depend on them); of equal texts one counts, as copies are no draws of their own.

For each stratum the steps are tested in order: the exact binomial tail must reject "the policy would reject more than ``risk`` of the good documents"
at ``level`` divided by the number of strata (Bonferroni).  The first failure ends the sequence, which needs no correction among the
steps.  A cutoff no stricter than a certified step's rejects no more than that step, so among these each rule takes freely the one that catches
most bad documents net of good ones, or none.  With probability ``1 - level`` no stratum loses more than ``risk`` of its good documents.
(Without errors a step needs log(level / strata) / log(1 - risk) good documents: 59 for one stratum, 90 for five.)

Strata are the languages with ``least`` labelled texts; all others, and null, make up one stratum that is certified on their own labels.

Defined results
* null or blank text: all counts 0, base_failed, not kept;
* without labels no cutoff is certified and only the base rules reject;
* repeated document rows are judged alike; labels of one document or text that disagree count as good;
* an empty table gives an empty result; other columns of the input are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_small

WORD = r"[^\x20\x09-\x0D]+"
#: rule -> (numerator, denominator, cutoffs in percent); a document fails if 100 * numerator > cutoff * denominator
RULES = {
    "symbols": ("n_symbols", "word_chars", (2, 3, 5, 8, 12, 16, 20, 25, 30, 40)),
    "dup_lines": ("n_dup_lines", "n_lines", (5, 10, 15, 20, 30, 40, 50, 60)),
    "repeats": ("n_repeat_words", "n_words", (5, 10, 15, 20, 25, 30, 40)),
    "capitals": ("n_upper", "word_chars", (10, 20, 30, 40, 50, 60, 70, 80)),
    "marks": ("n_marks", "n_words", (20, 40, 60, 80, 100, 120, 150, 180)),
    "digits": ("n_digits", "word_chars", (10, 20, 30, 40, 50)),
}
#: The stratum of all languages with few labels.
POOLED = "*"
STEPS = 10
#: A table of at most so many strata is broadcast; a larger one is joined with salted keys.
BROADCAST_STRATA = 10_000


def step_of(rule: str, cutoff: float) -> int:
    """The first step whose policy has a cutoff of this rule that is at least as strict."""
    lenient_first = sorted(RULES[rule][2], reverse=True)
    return next(k for k in range(1, STEPS + 1) if _at(lenient_first, k) <= cutoff)


def _at(lenient_first: list[float], step: int) -> float:
    """A rule's cutoff at a step; the last step has the strictest."""
    return lenient_first[-(-step * len(lenient_first) // STEPS) - 1]


def _fails(rule: str, cutoff: Column | float) -> Column:
    num, den, _ = RULES[rule]
    return 100 * F.col(num) > (F.lit(float(cutoff)) if not isinstance(cutoff, Column) else cutoff) * F.col(den)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, lang``, a hash of the text and the counts of each document; whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select("doc_id", "lang", t.alias("t"))
    d = d.select("doc_id", "lang", F.xxhash64("t").alias("text_key"), "t", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("w")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1))))
    d = d.select(
        "doc_id", "lang", "text_key",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit(r"[!?|]")).cast("long").alias("n_marks"),
        F.regexp_count("t", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        lines.alias("ls"), grams.alias("g"),
    )
    # equal hashes meet after the sort; most documents have no repeated window and skip it
    repeated = F.when(F.size("g") > F.size(F.array_distinct("g")), F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.select("*", repeated.alias("s")).drop("g")
    at = F.filter(F.transform("s", lambda x, k: F.when((x.h == F.get("s", k - 1).h) | (x.h == F.get("s", k + 1).h), x.i)), lambda x: x.isNotNull())
    d = d.select("*", F.sort_array(at).alias("p")).drop("s")
    covered = F.aggregate(
        "p", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.cast("int").alias("last"), (acc.n + F.least(F.lit(3), p - acc.last)).cast("long").alias("n")),
        lambda acc: acc.n,
    )
    return d.select(
        "doc_id", "lang", "text_key", "n_words", "word_chars", "n_symbols",
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("ls").cast("long").alias("n_lines"), "n_upper", "n_marks", "n_digits",
    )


def base_failed(least_words: int = 50, most_repeats: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """By Stirling's series at x + 16 (x of 1 and more)."""
    y = x + 16.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y)
    return series - F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0.0), lambda acc, i: acc + F.log(x + i))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding: the term at k times the sum of the ratios of the terms below it.

    Terms more than 12 deviations below the mean or below k are less than rounding and are not summed.
    """
    k, n = k.cast("double"), n.cast("double")
    mean, far = n * p, 12.0 * F.sqrt(n * p * (1 - p)) + 50.0
    at_k = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(p) + (n - k) * F.log1p(-p)
    terms = F.least(k, far + F.greatest(F.lit(0.0), k - mean)).cast("long")
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        term = acc.term * (k - j + 1) * (1 - p) / ((n - k + j) * p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))
    tail = F.exp(at_k + F.log(F.aggregate(steps, zero, step, lambda acc: acc["sum"])))
    return F.when((n <= 0) | (k >= n) | (k > mean + far), F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def strata_of(labelled: DataFrame, least: int = 200) -> DataFrame:
    """``lang`` of the languages with labelled texts enough for a stratum of their own."""
    return labelled.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("lang", F.col("lang").alias("stratum"))


def cutoffs(labelled: DataFrame, risk: float = 0.05, level: float = 0.05, stage=lambda df, name: df) -> DataFrame:
    """``stratum, rule, cutoff, n_good, n_false, n_caught, steps`` of the cutoffs taken, from rows of counts with ``quality`` and ``stratum``.

    ``n_false`` of ``n_good`` good holdout documents fail at the cutoff; the steps up to ``steps`` are certified.
    """
    tests = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.lit(step_of(rule, c)).alias("step"), _fails(rule, c).alias("fails"))
        for rule, (_, _, grid) in RULES.items() for c in grid
    ], *[
        F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("double").alias("cutoff"), F.lit(k).alias("step"), F.exists(F.array(*[_fails(r, _at(sorted(g, reverse=True), k)) for r, (_, _, g) in RULES.items()]), lambda x: x).alias("fails"))
        for k in range(1, STEPS + 1)
    ])
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    counted = labelled.select("stratum", "quality", F.explode(tests).alias("r")).groupBy("stratum", "r.rule", "r.cutoff", "r.step").agg(
        F.count(F.when(good, 1)).alias("n_good"), F.count(F.when(good & F.col("r.fails"), 1)).alias("n_false"), F.count(F.when(bad & F.col("r.fails"), 1)).alias("n_caught"),
    )
    counted = stage(counted, "rule-tests")  # a few dozen rows for each stratum
    n_strata = counted.select("stratum").distinct().count()
    joint = counted.where("rule is null").withColumn("p_value", binomial_tail(F.col("n_false"), F.col("n_good"), F.lit(risk)))
    so_far = Window.partitionBy("stratum").orderBy("step")
    passed = F.min((F.col("p_value") <= level / max(1, n_strata)).cast("int")).over(so_far)
    certified = joint.withColumn("ok", passed).where("ok = 1").groupBy("stratum").agg(F.max("step").alias("steps"))
    useful = counted.where("rule is not null").join(certified, "stratum").where("step <= steps").withColumn("gain", F.col("n_caught") - 10 * F.col("n_false")).where("gain > 0")
    best = Window.partitionBy("stratum", "rule").orderBy(F.col("gain").desc(), F.col("n_false"), F.col("cutoff").desc())
    return useful.withColumn("k", F.row_number().over(best)).where("k = 1").select("stratum", "rule", "cutoff", "n_good", "n_false", "n_caught", "steps")


def holdout(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of labelled documents that pass the base rules, with ``quality``; one row for each text."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = counts.where(~base_failed()).join(known, "doc_id")
    return labelled.groupBy("text_key").agg(F.max(F.struct("quality", *[c for c in counts.columns if c != "text_key"])).alias("x")).select("x.*")


def verdicts(counts: DataFrame, labels: DataFrame, stage=lambda df, name: df, least: int = 200, **parameters) -> DataFrame:
    """Adds ``stratum``, ``base_failed`` and ``kept`` to the counts."""
    labelled = stage(holdout(counts, labels), "rule-holdout")
    own = stage(strata_of(labelled, least), "rule-strata")
    few = own.count() <= BROADCAST_STRATA

    def placed(rows: DataFrame) -> DataFrame:
        return join_small(rows, own, "lang", few, "left", ("doc_id",)).withColumn("stratum", F.coalesce("stratum", F.lit(POOLED)))

    chosen = cutoffs(placed(labelled), stage=stage, **parameters)
    wide = stage(chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"c_{r}") for r in RULES]), "rule-cutoffs")
    # a stratum without a certified step has no row, and no rule rejects there
    out = join_small(placed(counts), wide, "stratum", few, "left", ("doc_id",))
    fails = [F.coalesce(_fails(rule, F.col(f"c_{rule}")), F.lit(False)) for rule in RULES]
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~F.exists(F.array(*fails), lambda x: x)).drop(*[f"c_{r}" for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, stage=lambda df, name: df, **parameters) -> DataFrame:
    return verdicts(stage(features(docs), "rule-counts"), labels, stage, **parameters)
