"""Risk-controlled quality rules, with DataFrame functions only.

Five measures of a text each cross up to eight fixed levels; the worst one gives the text's severity, 0 to 8. A
threshold t rejects severities of at least t. For each stratum and each t, the labelled good documents are a holdout:
k of n would be rejected. A threshold is proven when the exact binomial tail P(X <= k | n, risk) is at most
`error / tests`, where `tests` counts all (stratum, threshold) pairs (Bonferroni). The smallest proven threshold of a
stratum is used: with probability 1 - `error`, in no stratum are more than `risk` of the good documents rejected by
the method. A stratum with too few labels to prove any threshold rejects nothing beyond the base rules.

Null or empty text has no words and fails the base rules. A null stratum is a stratum of its own. Repeated rows are
judged one by one and each give a row; a document labelled several times counts as good only if all its labels do.
Tables without rows give no rows. Columns other than the three named ones are carried on (`apply_rules`) or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Fixed levels of each measure, strictest first; the sign tells which side is bad.
LEVELS = {
    "symbols_pm": (1, (5, 10, 20, 50, 100, 150, 200, 300)),
    "word_len_high": (1, (580, 600, 620, 640, 655, 670, 685, 700)),
    "word_len_low": (-1, (445, 440, 435, 430, 425, 420, 415, 410)),
    "dup_lines_pm": (1, (10, 15, 20, 25, 30, 40, 50, 60)),
    "repeat_pm": (1, (120, 130, 140, 150, 160, 170, 180, 190)),
}
N_LEVELS = 8
#: Strata up to which their thresholds are broadcast (some 40 bytes each); beyond, they are joined by shuffle.
MAX_BROADCAST_STRATA = 50_000


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    windows = f"sequence(1, size(__words) - {WINDOW - 1})"
    # each window with its place, sorted; places of those that have an equal neighbour; the words that they cover
    repeats = f"""
        aggregate(
          sort_array(transform(
            flatten(transform(
              array(sort_array(transform({windows}, i -> struct(array_join(slice(__words, i, {WINDOW}), ' ') AS w, i AS i)))),
              s -> filter(s, (e, j) -> (j > 0 AND s[j - 1].w = e.w) OR (j < size(s) - 1 AND s[j + 1].w = e.w)))),
            e -> e.i)),
          struct(cast(-{WINDOW} AS int) AS last, 0L AS n),
          (a, p) -> struct(p AS last, a.n + least({WINDOW}, p - a.last) AS n),
          a -> a.n)"""
    out = (
        docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("__words", F.array_remove(F.split(spaced, " "), ""))
        .withColumn("__lines", lines)
        .withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("__hashes", F.expr(f"CASE WHEN size(__words) > {WINDOW} THEN transform({windows}, i -> xxhash64(slice(__words, i, {WINDOW}))) END"))
        .withColumn("word_chars", F.length(F.translate("__text", " \t\n\x0b\x0c\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("n_repeat_words", F.expr(f"CASE WHEN size(array_distinct(__hashes)) < size(__hashes) THEN {repeats} ELSE 0L END"))
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).drop("__text", "__words", "__lines", "__hashes")


def severity() -> Column:
    """0 to 8, from the counts; 0 for a text without words."""
    n = F.col("n_words")
    per = lambda c, by: F.floor(by * F.col(c) / n)
    measure = {"symbols_pm": per("n_symbols", 1000), "word_len_high": per("word_chars", 100), "word_len_low": per("word_chars", 100), "dup_lines_pm": per("n_dup_lines", 1000), "repeat_pm": per("n_repeat_words", 1000)}
    crossed = [sum((F.when(sign * measure[name] > sign * x, 1).otherwise(0) for x in levels), F.lit(0)) for name, (sign, levels) in LEVELS.items()]
    return F.when(n > 0, F.greatest(*crossed)).otherwise(0)


def _ln_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series eight steps on, to some 1e-13."""
    x = n.cast("double") + 9
    tail = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    shift = sum((F.log(n.cast("double") + i) for i in range(1, 9)), F.lit(0.0))
    return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + tail - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X ~ Binomial(n, p): the largest term by logarithms, the others by their ratios to it."""
    top = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    step = lambda a, i: F.struct(
        (a["t"] * i * (1 - p) / ((n - i + 1) * p)).alias("t"), (a["s"] + a["t"] * i * (1 - p) / ((n - i + 1) * p)).alias("s")
    )
    terms = F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.exp(top) * F.aggregate(terms, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda a: a["s"])


def thresholds(judged: DataFrame, labels: DataFrame, stratum: str, risk: float, error: float) -> DataFrame:
    """A row (stratum, threshold) for each stratum with a proven threshold. judged has doc_id, stratum, severity, base_failed."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("__q")).filter("__q = 1").select("doc_id")
    held = judged.filter(~F.col("base_failed")).select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("__s"), "severity").join(good, "doc_id", "left_semi")
    counts = held.groupBy("__s").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("severity") >= t, 1)).alias(f"k{t}") for t in range(1, N_LEVELS + 1)])
    tests = counts.agg((F.count("*") * N_LEVELS).alias("tests"))
    cases = counts.crossJoin(F.broadcast(tests)).select("__s", "n", "tests", F.expr(f"stack({N_LEVELS}, {', '.join(f'{t}, k{t}' for t in range(1, N_LEVELS + 1))}) AS (t, k)"))
    proven = cases.filter(F.col("k") < risk * F.col("n")).filter(binomial_tail(F.col("k"), F.col("n"), risk) <= error / F.col("tests"))
    return proven.groupBy("__s").agg(F.min("t").alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.01, error: float = 0.05) -> DataFrame:
    """doc_id, the counts, severity, threshold (null: none proven), base_failed, kept: a row for each row of docs."""
    measured = with_counts(docs.select("doc_id", "text", F.col(stratum).alias("__stratum"))).withColumn("severity", severity()).drop("text")
    judged = _store.written(measured, "quality-counts")
    return _verdict(judged, _cutoffs(judged, labels, risk, error), "__stratum").drop("__stratum")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.01, error: float = 0.05) -> DataFrame:
    """The rows of docs that are kept, with their own columns. The texts are measured once and written, not shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    measured = with_counts(docs.select("doc_id", "text", F.col(stratum).alias("__stratum"), row)).withColumn("severity", severity())
    judged = _store.written(measured.select("doc_id", "__stratum", "severity", "base_failed", "__row"), "quality-counts")
    return _verdict(judged, _cutoffs(judged.drop("__row"), labels, risk, error), "__stratum").filter("kept").select("__row.*")


def _cutoffs(judged: DataFrame, labels: DataFrame, risk: float, error: float) -> DataFrame:
    cut = _store.written(thresholds(judged, labels, "__stratum", risk, error), "quality-thresholds")
    return F.broadcast(cut) if cut.count() <= MAX_BROADCAST_STRATA else cut


def _verdict(judged: DataFrame, cut: DataFrame, stratum: str) -> DataFrame:
    own = judged.withColumn("__s", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    rejected = F.coalesce(F.col("severity") >= F.col("threshold"), F.lit(False))
    return own.join(cut, "__s", "left").drop("__s").withColumn("kept", ~F.col("base_failed") & ~rejected)
