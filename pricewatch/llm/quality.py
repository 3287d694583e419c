"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Base rules are fixed. Every further rule is a score that is high for bad text, with a fixed grid of
cutoffs. Labelled documents are the holdout: no cutoff was fitted on them. In every stratum a
cutoff is certified when its false rejections (good documents above it) are so few that the exact
binomial test rejects "more than ``risk`` of good documents are rejected" at level
``delta / (strata * rules)``: Bonferroni over strata and rules; along a grid false rejections only
grow as the cutoff falls, so testing from the lenient end in fixed sequence needs no further
correction. Of the certified cutoffs the one with the greatest gain (bad documents rejected less
``good_weight`` times good ones) is used, the most lenient of equals; a rule without gain, or a
stratum with too few labels to certify anything, rejects nothing beyond the base rules.

The test inverts to one number per stratum, the most false rejections that still pass, found by
summing binomial terms in log space up to the mean. No part of it is an approximation.

Null text has no words; a null stratum is a stratum of its own; documents with a null or unlabelled
id take no part in the labels; of repeated labels of one id every row counts; scores of empty texts
are 0. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS, _SHOUT, _UPPER = "#*$%&|<>", "!", "A-Z"

#: Cutoffs of every rule, lenient to strict; a document above the cutoff is rejected.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.03),
    "shout_share": (0.3, 0.2, 0.15, 0.1, 0.05, 0.03),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_share": (0.5, 0.4, 0.3, 0.2),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _held(text: Column | str, characters: str) -> Column:
    """How many characters of this class (as in a regular expression) the text holds."""
    return F.length(F.regexp_replace(text, F.lit(f"[^{characters}]+"), F.lit(""))).cast("long")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base counts, the rule scores and ``base_failed`` to every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    marks = F.regexp_replace(text, F.lit(f"[^{_SYMBOLS}{_SHOUT}{_UPPER}]+"), F.lit(""))
    split = docs.withColumns(
        {"_words": F.array_remove(F.split(text, SPACE), ""), "_lines": lines, "_marks": marks}
    )
    counted = split.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _held("_marks", _SYMBOLS),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_lines": F.size("_lines"),
            "_shouts": _held("_marks", _SHOUT),
            "_upper": _held("_marks", _UPPER),
            "_windows": _window_texts(F.col("_words")),
        }
    )
    return _with_repeats(counted).drop("_words", "_lines", "_marks").withColumns(
        {
            "base_failed": (F.col("n_words") < 50)
            | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbol_share": _share(F.col("n_symbols"), F.col("word_chars")),
            "shout_share": _share(F.col("_shouts"), F.col("word_chars")),
            "upper_share": _share(F.col("_upper"), F.col("word_chars")),
            "dup_line_share": _share(F.col("n_dup_lines"), F.col("_n_lines")),
            "repeat_share": _share(F.col("n_repeat_words"), F.col("n_words")),
        }
    ).drop("_n_lines", "_shouts", "_upper")


def _window_texts(words: Column) -> Column:
    """The three words of every window, joined by a space (words hold none, so equal means equal)."""
    following = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    third = F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0)))
    pairs = F.zip_with(words, following, lambda a, b: F.concat(a, F.lit(" "), b))
    whole = F.zip_with(pairs, third, lambda a, b: F.concat(a, F.lit(" "), b))  # null where a window is short
    return F.slice(whole, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def _with_repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words: words in windows of ``_windows`` that occur twice or more."""
    numbered = F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    unique = F.size(F.array_distinct("_windows")) == F.size("_windows")
    df = df.withColumn("_sorted", F.when(~unique, F.sort_array(numbered)))

    def start(row: Column, i: Column) -> Column:
        twin = (F.get("_sorted", i - 1)["w"] == row["w"]) | (F.get("_sorted", i + 1)["w"] == row["w"])
        return F.when(twin, row["i"])

    df = df.withColumn("_starts", F.sort_array(F.array_compact(F.transform("_sorted", start))))
    covered = F.transform("_starts", lambda s, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - s, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, n: a + n)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0))).drop("_windows", "_sorted", "_starts")


def most_false_rejections(n: Column, risk: float, level: Column) -> Column:
    """Largest k with P(X <= k) <= level for X binomial(n, risk); -1 if there is none."""
    odds = F.log(F.lit(risk / (1 - risk)))
    first = F.struct(
        (n * F.log(F.lit(1 - risk))).cast("double").alias("term"),
        F.lit(0.0).alias("tail"),
        F.lit(-1).cast("long").alias("k"),
    )

    def step(state: Column, i: Column) -> Column:
        tail = state["tail"] + F.exp(state["term"])
        following = state["term"] + odds + F.log((n - i).cast("double") / (i + 1))
        return F.struct(
            F.coalesce(following, F.lit(float("-inf"))).alias("term"),
            tail.alias("tail"),
            F.when(tail <= level, i).otherwise(state["k"]).alias("k"),
        )

    upto = F.sequence(F.lit(0).cast("long"), F.least(n, F.ceil(n * risk)).cast("long"))
    return F.aggregate(upto, first, step, lambda s: s["k"])


def learn_cutoffs(
    scored: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, good_weight: int = 10,
    id_col: str = "doc_id", stratum_col: str = "lang",
) -> DataFrame:
    """stratum, rule, cutoff: one row for every rule that is used in a stratum."""
    marks = labels.select(F.col("doc_id").alias("_labelled"), (F.col("quality") == 1).alias("_good"))
    labelled = scored.join(marks, scored[id_col] == marks["_labelled"]).where("_good is not null")
    grid = F.array(*[
        F.struct(
            F.lit(rule).alias("rule"), F.lit(float(cutoff)).alias("cutoff"),
            (F.col(rule) > cutoff).alias("above"),
        )
        for rule, cutoffs in GRIDS.items() for cutoff in cutoffs
    ])
    tests = (
        labelled.select(F.col(stratum_col).alias("stratum"), "_good", F.explode(grid).alias("t"))
        .groupBy("stratum", "t.rule", "t.cutoff")
        .agg(
            F.count_if("_good").alias("n_good"),
            F.count_if(F.col("_good") & F.col("t.above")).alias("false_rejections"),
            F.count_if(~F.col("_good") & F.col("t.above")).alias("bad_rejected"),
        )
    )
    tests = stored(tests, "cutoff-tests")  # strata * grid rows
    strata = tests.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))
    level = F.lit(delta) / (F.col("strata") * len(GRIDS))
    limits = (
        tests.groupBy("stratum").agg(F.max("n_good").alias("n_good"))
        .join(strata, F.lit(True))
        .select("stratum", most_false_rejections(F.col("n_good"), risk, level).alias("limit"))
    )
    certified = (
        tests.join(limits, tests["stratum"].eqNullSafe(limits["stratum"])).drop(limits["stratum"])
        .where(F.col("false_rejections") <= F.col("limit"))
        .withColumn("gain", F.col("bad_rejected") - good_weight * F.col("false_rejections"))
        .where("gain > 0")
    )
    return certified.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff"))


def judged(scored: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """Adds ``kept``: false if a base rule or a certified cutoff rejects the row."""
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"_cut_{rule}") for rule in GRIDS]
    )
    rejected = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.col(rule) > F.col(f"_cut_{rule}"), F.lit(False)) for rule in GRIDS],
    )
    return (
        scored.join(wide, scored[stratum_col].eqNullSafe(wide["_stratum"]), "left")
        .withColumn("kept", ~(F.col("base_failed") | rejected))
        .drop("_stratum", *[f"_cut_{rule}" for rule in GRIDS])
    )


def verdicts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk
) -> DataFrame:
    """doc_id, the counts, ``base_failed`` and ``kept`` of every row; texts are read once."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.col(stratum_col).alias("_lang")
    )
    scored = stored(with_counts(rows, "_text").drop("_text"), "quality-scores")
    cutoffs = learn_cutoffs(scored, labels, stratum_col="_lang", **risk)
    return judged(scored, cutoffs, stratum_col="_lang").select("doc_id", *COUNTS, "base_failed", "kept")


def kept(docs: DataFrame, labels: DataFrame, **risk) -> DataFrame:
    """Rows of ``docs`` that pass, with their own columns; no text is shuffled.

    A filter over the verdict alone would be pushed below the counts and compute every count again
    for each use; one that also reads a row number cannot be pushed below the numbering.
    """
    rows = docs.select("doc_id", F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    scored = stored(with_counts(rows, "_text").drop("_text"), "quality-scores")  # numbers meet the labels, not texts
    cutoffs = stored(learn_cutoffs(scored, labels, stratum_col="_lang", **risk), "cutoffs")
    own = docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    verdict = judged(with_counts(own, "_text"), cutoffs, "_lang").select(
        "_doc", "kept", F.monotonically_increasing_id().alias("_row")
    )
    return verdict.where(F.col("kept") & (F.col("_row") >= 0)).select("_doc.*")
