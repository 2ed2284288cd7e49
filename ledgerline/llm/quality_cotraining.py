"""Quality classification by co-training of two views.

View one is the text's content, as figures of its letters, words and lines,
each cut into bins. View two is page metadata: source, language, length. Each
view is a naive Bayes classifier: a table of log-odds per value, so it is fitted
from counts alone. Both start from labelled rows. In each round each view
labels the unlabelled rows it is surest of, over all of the corpus, and the
other view counts them in; the share grows from round to round. Pseudo-labels
together weigh as much as the labels. After the rounds each view is calibrated
on labelled rows kept apart; a document's score adds the calibrated log-odds of
both and takes the prior off once.

Only labelled rows are sampled (`labelled_rows`, by hash). A round is one pass
over the written figures, whose counts are combined in the tasks: content
counts are a fixed number of sums, metadata counts one row for each (source,
language, length) that occurs. Every source and language has its own weight.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowest, materialise, materialise_texts, text_or_empty

LABELLED_ROWS = 20_000
ROUNDS = 5
ADDED_SHARE = 0.05  # of the unlabelled rows, by each view, more in each round
CERTAIN = 2.2  # log-odds beyond which a view is sure: nine in ten
BINS = 32  # of each content figure
CONTENT = (
    "letters", "digits", "upper", "marks", "spaces", "mean_word", "long_words", "distinct_words", "top_word",
    "lines", "repeated_lines", "ends_mark", "log_words", "rare_marks",
)
META = ("source", "lang", "size")
SMOOTHING = 4.0  # labels of average kind that each value is given
STEP = 0.05  # log-odds in a range when thresholds are found
_FAR = 40.0  # log-odds are held within this
_COMMON_MARKS = b".,;:'\"-?()"


def content_figures(text: str) -> list[float]:
    """Figures of the content view; zeros for an empty text."""
    raw = text.encode("utf-8")
    n = len(raw)
    if n == 0:
        return [0.0] * len(CONTENT)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    spaces = count[[9, 10, 11, 12, 13, 32]].sum()
    letters = upper + lower + count[128:].sum()
    marks = n - letters - digits - spaces
    rare = marks - sum(count[b] for b in _COMMON_MARKS)
    words = raw.split()
    kinds = Counter(words)
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_kinds = len(set(lines))
    return [
        letters / n, digits / n, upper / max(1, letters), marks / n, spaces / n, (n - spaces) / w / 10,
        sum(c for k, c in kinds.items() if len(k) > 14) / w, len(kinds) / w, max(kinds.values(), default=0) / w,
        len(lines) / w, 1 - line_kinds / max(1, len(lines)),
        sum(c for k, c in kinds.items() if k[-1:] in b"!%$#&*|") / w, np.log1p(w) / 10, rare / n,
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, content array<float>, source, lang (text, never null), size (bits
    of the length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures = [[float(x) for x in content_figures(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(figures, pa.list_(pa.float32())), *batch.columns[2:]], ["doc_id", "content", *META]
            )

    text = text_or_empty(docs)
    name = lambda c: F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("null")).alias(c)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), name("source"), name("lang"),
        F.ceil(F.log2(F.length(text) + 1)).cast("int").alias("size"),
    )
    return rows.mapInArrow(run, "doc_id long, content array<float>, source string, lang string, size int")


# ---------------------------------------------------------------- content view


def binned(content: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each figure, numbered over all figures."""
    bins = [np.searchsorted(edges[f], content[:, f]) + f * BINS for f in range(len(CONTENT))]
    return np.stack(bins, axis=1) if len(content) else np.zeros((0, len(CONTENT)), np.int64)


def log_odds(good: np.ndarray, bad: np.ndarray, g: float, b: float) -> np.ndarray:
    """Of each value, over the prior: g and b good and bad labels in all."""
    share = g / (g + b)
    return np.log((good + SMOOTHING * share) / (bad + SMOOTHING * (1 - share)) * (b / g))


@dataclass
class Content:
    edges: np.ndarray  # BINS - 1 bounds of each figure
    weight: np.ndarray  # by bin
    prior: float

    def raw(self, content: np.ndarray) -> np.ndarray:
        return np.clip(self.prior + self.weight[binned(content, self.edges)].sum(1), -_FAR, _FAR)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, len(CONTENT))


# ---------------------------------------------------------------------- rounds


def threshold(found: list[tuple[float, int]], share: float, upper: bool) -> float:
    """The log-odds that about `share` of the rows lie at or beyond, on one
    side, but never within CERTAIN; `found` counts rows by log-odds."""
    total, beyond = sum(n for _, n in found), 0
    limit = CERTAIN if upper else -CERTAIN
    best = float("inf") if upper else -float("inf")
    for value, n in sorted(found, reverse=upper):
        beyond += n
        if (value < limit if upper else value > limit) or (beyond > share * total and np.isfinite(best)):
            break
        best = value
    return best


def _meta_weights(counts: DataFrame, g: float, b: float) -> dict[str, DataFrame]:
    """Of (source, lang, size, good, bad): a table value -> weight per column."""
    share = g / (g + b)
    weight = F.log((F.sum("good") + SMOOTHING * share) / (F.sum("bad") + SMOOTHING * (1 - share)) * (b / g))
    return {c: materialise(counts.groupBy(c).agg(weight.alias(f"{c}_weight")), f"co-{c}") for c in META}


def _meta_scored(rows: DataFrame, weights: dict[str, DataFrame], prior: float) -> DataFrame:
    """`rows` with meta: log-odds of the metadata view; unseen values weigh 0."""
    total = F.lit(prior)
    for c in META:
        rows = rows.join(weights[c], c, "left")
        total = total + F.coalesce(F.col(f"{c}_weight"), F.lit(0.0))
    rows = rows.withColumn("meta", F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), total)))
    return rows.drop(*[f"{c}_weight" for c in META])


def _range(x: Column) -> Column:
    return F.round(x / STEP).cast("int")


def _content_pass(rows: DataFrame, view: Content) -> DataFrame:
    """One pass over (content, source, lang, size, label): counts n of rows by
    (source, lang, size, at), `at` the range of the content log-odds; and, with
    at null, counts by content bin of rows labelled good and bad by the other
    view."""
    places = len(CONTENT) * BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, places), np.int64)
        for batch in batches:
            content = _matrix(batch.column(0), batch.num_rows)
            at = np.rint(view.raw(content) / STEP).astype(np.int32)
            label = batch.column(4).to_numpy(zero_copy_only=False)
            bins = binned(content, view.edges)
            for k in (0, 1):
                sums[k] += np.bincount(bins[label == k].ravel(), minlength=places)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:4], pa.array(at), pa.nulls(n, pa.int32()), pa.array(np.ones(n, np.int64)), pa.array(np.zeros(n, np.int64))],
                names,
            )
        used = np.flatnonzero(sums.sum(0))
        none = [pa.nulls(len(used), t) for t in (pa.string(), pa.string(), pa.int32(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(used.astype(np.int32)), pa.array(sums[1][used]), pa.array(sums[0][used])], names)

    names = [*META, "at", "bin", "good", "bad"]
    found = rows.select("content", *META, "label").mapInArrow(
        run, "source string, lang string, size int, at int, bin int, good long, bad long"
    )
    return found.groupBy(*META, "at", "bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


@dataclass
class Views:
    content: Content
    meta: dict[str, DataFrame]
    prior: float  # of the metadata view


def co_train(rows: DataFrame, labelled: list, rounds: int = ROUNDS, share: float = ADDED_SHARE) -> Views:
    """Both views after `rounds` rounds. rows: unlabelled (content, source,
    lang, size); labelled: rows with quality beside these."""
    spark = rows.sparkSession
    y = np.array([r.quality for r in labelled], float)
    content = np.array([r.content for r in labelled], float).reshape(-1, len(CONTENT))
    edges = np.stack([np.quantile(content[:, f], np.arange(1, BINS) / BINS) for f in range(len(CONTENT))])
    bins = binned(content, edges)
    places = len(CONTENT) * BINS
    given = [np.bincount(bins[y == k].ravel(), minlength=places).astype(float) for k in (0, 1)]
    g, b = float(y.sum()), float(len(y) - y.sum())
    prior = float(np.log(g / b))
    told = [(r.source, r.lang, r.size, float(r.quality), 1.0 - r.quality) for r in labelled]
    told = spark.createDataFrame(told, "source string, lang string, size int, good double, bad double")
    cells = materialise(rows.groupBy(*META).agg(F.count("*").alias("n")), "co-cells")

    view = Content(edges, log_odds(given[1], given[0], g, b), prior)
    views = Views(view, _meta_weights(told, g, b), prior)
    for r in range(1, rounds + 1):
        wanted = share * r * g / (g + b), share * r * b / (g + b)
        # the metadata view's sure cells, from counts by cell
        scored = materialise(_meta_scored(cells, views.meta, views.prior), "co-scored")
        found = [(x.at * STEP, x.n) for x in scored.groupBy(_range(F.col("meta")).alias("at")).agg(F.sum("n").alias("n")).collect()]
        high, low = threshold(found, wanted[0], True), threshold(found, wanted[1], False)
        at = _range(F.col("meta")) * STEP
        label = F.when(at >= high, 1).when(at <= low, 0).otherwise(-1).cast("int")
        sure = scored.select(*META, label.alias("label"))
        counted = materialise(_content_pass(rows.join(sure, [*META]), views.content), "co-counts")
        # what it taught the content view
        taught = [np.zeros(places), np.zeros(places)]
        for x in counted.where("bin is not null").select("bin", "good", "bad").collect():  # one row a bin at most
            taught[1][x.bin], taught[0][x.bin] = x.good, x.bad
        # the content view's sure rows, counted by cell and range
        by_range = counted.where("at is not null")
        found = [(x.at * STEP, x.n) for x in by_range.groupBy("at").agg(F.sum("good").alias("n")).collect()]
        high, low = threshold(found, wanted[0], True), threshold(found, wanted[1], False)
        is_good, is_bad = F.col("at") * STEP >= high, F.col("at") * STEP <= low
        sums = by_range.agg(F.sum(F.when(is_good, F.col("good"))).alias("g"), F.sum(F.when(is_bad, F.col("good"))).alias("b")).first()
        scale = (g + b) / max(1.0, (sums.g or 0) + (sums.b or 0), g + b)
        pseudo = by_range.where(is_good | is_bad).select(
            *META, F.when(is_good, F.col("good") * scale).otherwise(0.0).alias("good"),
            F.when(is_bad, F.col("good") * scale).otherwise(0.0).alias("bad"),
        )
        both = g + (sums.g or 0) * scale, b + (sums.b or 0) * scale
        meta, meta_prior = _meta_weights(told.unionByName(pseudo), *both), float(np.log(both[0] / both[1]))
        labels = [t.sum() / len(CONTENT) for t in taught]
        scale = (g + b) / max(g + b, sum(labels))
        good, bad = given[1] + taught[1] * scale, given[0] + taught[0] * scale
        both = g + labels[1] * scale, b + labels[0] * scale
        view = Content(edges, log_odds(good, bad, *both), float(np.log(both[0] / both[1])))
        views = Views(view, meta, meta_prior)
    return views


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 25) -> np.ndarray:
    """Newton's method with an L2 penalty on all but the constant."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibration(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(shift, slope) of a view's log-odds, from labelled rows kept apart."""
    shift, slope = _logistic(np.c_[np.ones(len(raw)), raw], y, 0.1)
    return float(shift), max(0.0, float(slope))


def score(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, content_score, metadata_score, quality_score, keep (half or
    more) of every row.

    labels: (doc_id, quality 0/1); null labels are left out, of several the
    greatest counts. Null text counts as empty, null source or lang is a value
    of its own; rows without a doc_id are unlabelled; repeated rows score alike;
    of rows that share a labelled doc_id the one of least figures is learned
    from; other columns are not read, whatever they are called; an empty table
    gives an empty result; with fewer than 8 labels, or of one class only, every
    score is the share of good labels (0.5 if none)."""
    table = materialise_texts(features(docs), "quality-features")
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    one = F.min(F.struct("content", *META, "quality")).alias("r")
    found = materialise(table.join(known, "doc_id").groupBy("doc_id").agg(one).select("doc_id", "r.*"), "quality-labelled")
    mark = F.xxhash64(F.lit("co-training"), "doc_id")
    rows = lowest(found, mark, "doc_id", labelled_rows).collect()
    y = np.array([r.quality for r in rows], float)
    base = float(y.mean()) if len(y) else 0.5
    apart = np.arange(len(y)) % 4 == 3  # every fourth labelled row only calibrates
    if len(y) < 8 or len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        same = F.lit(base)
        return table.select(
            "doc_id", same.alias("content_score"), same.alias("metadata_score"), same.alias("quality_score"),
            (same >= 0.5).alias("keep"),
        )
    unlabelled = table.join(known.select("doc_id"), "doc_id", "left_anti")
    views = co_train(unlabelled, [r for r, a in zip(rows, apart, strict=True) if not a], rounds)

    kept = docs.sparkSession.createDataFrame(
        [(i, r.source, r.lang, r.size) for i, r in enumerate(rows) if apart[i]], "row int, source string, lang string, size int"
    )
    meta = {r.row: r.meta for r in _meta_scored(kept, views.meta, views.prior).collect()}
    raw = np.array([meta[i] for i in np.flatnonzero(apart).tolist()])
    shift_m, slope_m = calibration(raw, y[apart])
    figures = np.array([r.content for r in rows], float)
    shift_c, slope_c = calibration(views.content.raw(figures[apart]), y[apart])
    prior, content = float(np.log(base / (1 - base))), views.content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigmoid = lambda z: pa.array(1 / (1 + np.exp(-z)))
        for batch in batches:
            a = slope_c * content.raw(_matrix(batch.column(1), batch.num_rows)) + shift_c
            m = slope_m * batch.column(2).to_numpy(zero_copy_only=False) + shift_m
            both = a + m - prior
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sigmoid(a), sigmoid(m), sigmoid(both), pa.array(both >= 0)],
                ["doc_id", "content_score", "metadata_score", "quality_score", "keep"],
            )

    scored = _meta_scored(table, views.meta, views.prior).select("doc_id", "content", "meta")
    return scored.mapInArrow(run, "doc_id long, content_score double, metadata_score double, quality_score double, keep boolean")
