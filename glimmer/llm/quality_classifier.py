"""Document quality from a classifier and from the sites' hierarchy, by empirical Bayes.

Evidence of a document: logistic regressions on its distinct words (A-Z lower-cased) and on a few shapes of its text
(shares of capitals, symbols and exclamations, mean word length); one for quality, one for toxicity, whose probabilities of
"good" are multiplied. They are fitted on at most `fit_rows` labelled documents, those with the smallest hashes of their
doc_id (rows alike in doc_id and text are one document, with their number as weight), and on all features of these that
`LEAST` documents have and whose counts differ significantly between the classes. Words are told apart by 64-bit hashes.

Sites: a host's mean quality is shrunk toward the global mean, a path's (here host and language) toward its host's.
Labelled documents enter with their label, others with the classifier's probability. Strengths of both priors come
from the data, by the moments of the groups' means. p_host and p_path of a document leave out its own value, so that its
evidence counts once. The posterior log-odds are its own evidence plus the difference between its path's and the global
log-odds. All site figures are grouped aggregates over all documents.

Null and empty texts have no evidence of their own but the classes' shares. Null hosts and paths are groups of their
own. Repeated rows are scored one by one; a document labelled several times is good only if all its labels are. With
no labels the evidence is 0 and every document is kept at even odds. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store, _text

FIT_ROWS = 20_000
#: A feature's documents at least, and twice the log-likelihood ratio of its counts against the classes' shares.
LEAST, SIGNIFICANT = 5, 16.0
#: Of the regressions: weight of the squared coefficients (in documents), and steps.
RIDGE, STEPS = 1.0, 300
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"#*$%&|<>")] = 2
_KIND[list(b"!?")] = 3


def _features(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of a slice, each once, in the order of texts: hashes, or places in known (sorted ones)."""
    w = _text.split(texts, _text.WORDS_LOWER)
    n = len(w.counts)
    raw = _text.split(texts, _text.WORDS)
    kinds = _KIND[raw.data]
    chars = np.diff(np.concatenate(([0], np.cumsum(raw.ends - raw.starts)))[raw.firsts])
    inside = np.repeat(np.arange(n), pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    shapes = []  # numbers below 64, which hardly a word's hash is
    for kind, base in ((1, 0), (2, 16), (3, 32)):
        share = np.bincount(inside[kinds == kind], minlength=n) / np.maximum(chars, 1)
        shapes.append(base + np.minimum(np.ceil(share * 20), 15).astype(np.int64))
    shapes.append(48 + np.minimum(chars // np.maximum(w.counts, 1), 15))
    some = np.flatnonzero(w.counts > 0)
    owner = np.concatenate([np.repeat(np.arange(n), w.counts), *[some] * 4])
    feature = np.concatenate([w.hashes(), *[x[some].astype(np.uint64) for x in shapes]])
    if known is not None:
        at = np.minimum(np.searchsorted(known, feature), max(len(known) - 1, 0))
        hit = np.flatnonzero(known[at] == feature) if len(known) else np.zeros(0, np.int64)
        pairs = np.unique(owner[hit] * max(len(known), 1) + at[hit])
        return pairs // max(len(known), 1), pairs % max(len(known), 1)
    order = np.lexsort((feature, owner))
    owner, feature = owner[order], feature[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])
    return owner[new], feature[new]


_CLASSES = ("quality", "toxic")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a slice that have each feature: all, of quality 1, of toxic 1."""
    for batch in batches:
        for part in _text.slices(batch, "text"):
            owner, feature = _features(part.column("text"))
            weight = part.column("weight").to_numpy(zero_copy_only=False)[owner]
            known, back = np.unique(feature, return_inverse=True)
            ones = [weight, *[weight * (part.column(c).to_numpy(zero_copy_only=False)[owner] == 1) for c in _CLASSES]]
            sums = [np.bincount(back, weights=x, minlength=len(known)).astype(np.int64) for x in ones]
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), *map(pa.array, sums)], ["feature", "n", *_CLASSES])


def _surprise(n: Column, k: Column, share: float) -> Column:
    """Twice the log-likelihood ratio of k of n documents in a class against its share."""
    term = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    return 2 * (term(k, n * share) + term(n - k, n * (1 - share)))


def labelled(labels: DataFrame) -> DataFrame:
    """(id, quality, toxic) for each labelled document: the worst of its labels."""
    worst = [F.min(F.coalesce(F.col("quality"), F.lit(0)).cast("int")).alias("quality"), F.max(F.coalesce(F.col("toxic"), F.lit(0)).cast("int")).alias("toxic")]
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*worst)


def _regression(owner: np.ndarray, feature: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a ridge logistic regression on binary features, by Adam on all rows."""
    good, n = (y * weight).sum(), weight.sum()
    w, bias = np.zeros(width), float(np.log((good + 1) / (n - good + 1)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(owner, weights=w[feature], minlength=len(y)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.append(np.bincount(feature, weights=off[owner], minlength=width) + RIDGE * w, off.sum()) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """At most fit_rows rows (id, h, quality, toxic, weight, text), in the order of hashes; weight: the rows of docs alike in id and text."""
    ids = labelled(labels).orderBy(F.xxhash64("id"), "id").limit(fit_rows)  # the bound that allows the broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    alike = texts.join(F.broadcast(ids), "id").groupBy("id", "h", *_CLASSES)
    own = _store.written(alike.agg(F.count("*").alias("weight"), F.min("text").alias("text")), "quality-sample")
    if own.count() <= fit_rows:
        return own
    first = own.select("id", "h").orderBy(F.xxhash64("id"), "id", "h").limit(fit_rows)
    return _store.written(own.join(F.broadcast(first), ["id", "h"], "left_semi"), "quality-sample")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, list[tuple[np.ndarray, float]]]:
    """Hashes of features, sorted; and for the log-odds of quality 1 and of toxic 0 their weights and the intercept."""
    own = sample(docs, labels, fit_rows)
    classes = own.groupBy(*_CLASSES).agg(F.sum("weight").alias("count")).toPandas()
    total = float(classes["count"].sum())
    shares = [float((classes[c] * classes["count"]).sum()) / max(total, 1) for c in _CLASSES]
    counts = own.mapInArrow(_counts, "feature long, n long, quality long, toxic long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *_CLASSES)])
    tests = [(_surprise(F.col("n"), F.col(c), x) > SIGNIFICANT if 0 < x < 1 else F.lit(False)).alias(f"by_{c}") for c, x in zip(_CLASSES, shares, strict=True)]
    # features of at most fit_rows documents
    picked = counts.filter(F.col("n") >= LEAST).select("feature", *tests).filter("by_quality OR by_toxic").toPandas()
    picked["key"] = picked["feature"].to_numpy(np.int64).view(np.uint64)
    picked = picked.sort_values("key")
    known = picked["key"].to_numpy()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                owner, at = _features(part.column("text"), known)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in (*_CLASSES, "weight")], lists], [*_CLASSES, "weight", "features"])

    # at most fit_rows rows; in a fixed order, so that runs agree to the last digit
    rows = own.orderBy("id", "h").mapInArrow(kept, "quality int, toxic int, weight long, features array<int>").toPandas() if total else None
    out = []
    for name in _CLASSES:
        weights, bias, chosen = np.zeros(len(known)), 0.0 if name == "quality" else 30.0, picked[f"by_{name}"].to_numpy(bool)
        if rows is not None:
            feature = np.concatenate([np.zeros(0, np.int64), *rows["features"]]).astype(np.int64)
            owner = np.repeat(np.arange(len(rows)), np.fromiter(map(len, rows["features"]), np.int64, len(rows)))
            own = chosen[feature] if len(known) else np.zeros(0, bool)
            y = rows[name].to_numpy(np.float64)
            place = np.cumsum(chosen) - 1
            weights[chosen], bias = _regression(owner[own], place[feature[own]] if len(known) else feature, y if name == "quality" else 1 - y, rows["weight"].to_numpy(np.float64), int(chosen.sum()))
        out.append((weights, bias))
    return known, out


def evidence(docs: DataFrame, model: tuple[np.ndarray, list[tuple[np.ndarray, float]]], host: str, path: str) -> DataFrame:
    """doc_id, host, path, p_text (probability of quality 1 and toxic 0, by the text) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, models = shared.value
        for batch in batches:
            for part in _text.slices(batch, "text"):
                owner, at = _features(part.column("text"), known)
                p = np.ones(part.num_rows)
                for w, bias in models:
                    p /= 1 + np.exp(-np.clip(np.bincount(owner, weights=w[at] if len(w) else None, minlength=part.num_rows) + bias, -30, 30))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), part.column("path"), pa.array(p)], ["doc_id", "host", "path", "p_text"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, host string, path string, p_text double")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str, n: str) -> Column:
    """Of the prior that groups share, in documents: by the variance of their means beyond what sampling gives."""
    m = F.sum(F.col(mean) * F.col(n)) / F.sum(n)
    within = F.sum(F.col(mean) * (1 - F.col(mean))) / F.sum(n)
    spread = F.var_pop(mean) - within
    return F.least(F.lit(1e6), F.greatest(F.lit(1.0), m * (1 - m) / F.greatest(spread, F.lit(1e-9)) - 1))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, p_text (classifier alone), p_host and p_path (sites, without the document), p_good, kept: a row for each row of docs."""
    _store.small_batches(docs.sparkSession)
    scored = _store.written(evidence(docs, fit(docs, labels, fit_rows), host, path), "quality-evidence")
    value = F.coalesce(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double"), F.col("p_text"))
    known = scored.join(labelled(labels), F.col("doc_id") == F.col("id"), "left").select("doc_id", "host", "path", "p_text", value.alias("v"))
    paths = known.groupBy("host", "path").agg(F.sum("v").alias("s"), F.count("*").cast("double").alias("n"))
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    within = paths.withColumn("m", F.col("s") / F.col("n"))
    # one row each, of global figures
    overall = hosts.withColumn("m", F.col("hs") / F.col("hn")).agg(((F.sum("hs") + 0.5) / (F.sum("hn") + 1)).alias("p_all"), _strength(hosts, "m", "hn").alias("k_host"))
    nested = within.agg(_strength(within, "m", "n").alias("k_path"))
    sites = (
        paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
        .crossJoin(F.broadcast(overall))
        .crossJoin(F.broadcast(nested))
        .select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "s", "n", "hs", "hn", "p_all", "k_host", "k_path")
    )
    # without the document's own value
    host_mean = (F.col("hs") - F.col("v") + F.col("k_host") * F.col("p_all")) / (F.col("hn") - 1 + F.col("k_host"))
    path_mean = (F.col("s") - F.col("v") + F.col("k_path") * F.col("p_host")) / (F.col("n") - 1 + F.col("k_path"))
    joined = known.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")), "left")
    joined = joined.withColumn("p_host", _inside(host_mean)).withColumn("p_path", _inside(path_mean))
    p_good = 1 / (1 + F.exp(-(_logit(_inside(F.col("p_text"))) + _logit(F.col("p_path")) - _logit(F.col("p_all")))))
    return joined.withColumn("p_good", p_good).select("doc_id", "p_text", "p_host", "p_path", "p_good", (F.col("p_good") >= 0.5 - 1e-9).alias("kept"))


def _inside(p: Column) -> Column:
    """A probability away from 0 and 1, for its log-odds."""
    return F.greatest(F.lit(1e-13), F.least(F.lit(1 - 1e-13), p))
