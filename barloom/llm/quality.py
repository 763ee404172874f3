"""Quality scores of documents by Bradley-Terry ranking over preference pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.batches import bounded_sample, by_pieces, input_columns, lean
from barloom.session import kept

#: Labelled documents of each class that pairs are made of, and partners of each.
SAMPLE_PER_CLASS, PARTNERS = 10_000, 4
RIDGE = 1e-4

FEATURES = (
    "log_words log_chars mean_word distinct_words distinct_pairs upper digits stops symbols spaces lines odd_words caps_words marked_words".split()
)

_CLASS = np.zeros(256, np.int64)  # of a byte: 0 letter, 1 upper, 2 digit, 3 common stop, 4 other symbol, 5 space, 6 line end
_CLASS[33:127] = 4
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 0
_CLASS[:33] = 5
_CLASS[10] = 6
_CLASS[127:] = 0
_SYMBOLS = bytes(b for b in range(33, 127) if _CLASS[b] == 4)


def features(text: str | None) -> list[float]:
    """Shares and sizes that do not depend on the language; all 0 without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    n = len(words)
    odd = sum(1 for w in words if not w.strip(_SYMBOLS))
    marked = sum(1 for w in words if w[-1] in _SYMBOLS)
    caps = sum(map(bytes.isupper, words))
    return [
        float(np.log1p(n)), float(np.log1p(len(raw))), len(raw) / n, len(set(words)) / n, len(set(zip(words, words[1:]))) / n,
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], odd / n, caps / n, marked / n,
    ]


def featured(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, x)`` with the features of every whole text."""
    source = input_columns(documents, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, 1):
            made = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return source.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class Ranking:
    """Weights on the standardised features, and the score above which a document is good."""

    centre: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float

    def worth(self, x: str = "x"):
        """The Bradley-Terry score, as a column."""
        terms = [(F.col(x)[i] - c) / s * w for i, (c, s, w) in enumerate(zip(self.centre, self.spread, self.weights))]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total

    def score(self, x: str = "x"):
        """From 0 to 1; 0.5 lies at the threshold."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.lit(self.threshold) - self.worth(x)))))


def fit(labelled: DataFrame, sample: int = SAMPLE_PER_CLASS, partners: int = PARTNERS) -> Ranking:
    """Learn from ``(x, label)`` rows with label 1 (preferred) or 0; other labels are ignored.

    Pairs are drawn between bounded samples of the two classes, ``sample`` rows
    each, where copies are drawn each on their own: every row of the larger sample
    meets ``partners`` of the other. The logistic loss on the difference of features
    is minimised without an intercept, half of the pairs turned round. The
    threshold is the quantile of the scores of all rows, to a hundred-thousandth of
    their number, that leaves the share of label 0 below. With one class only, every document counts as good.
    """
    rows = kept(labelled.select("x", F.col("label").cast("int").alias("label")).filter("label IN (0, 1)"), "labelled")
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    d = len(FEATURES)
    if not n.get(0) or not n.get(1):
        return Ranking((0.0,) * d, (1.0,) * d, (0.0,) * d, -1.0 if n.get(0, 0) == 0 else 1.0)
    shape = rows.agg(*[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    centre = tuple(float(shape[f"avg{i}"]) for i in range(d))
    spread = tuple(float(shape[f"stddev_pop{i}"]) or 1.0 for i in range(d))
    order = Window.orderBy(F.xxhash64("x"), "x")
    drawn = {}
    for k in (0, 1):
        some = bounded_sample(rows.filter(F.col("label") == k).select("x"), sample, "x", alike=False)
        drawn[k] = kept(some.select((F.row_number().over(order) - 1).alias("i"), "x"), "drawn")
    sizes = {k: drawn[k].count() for k in (0, 1)}
    more, fewer = (1, 0) if sizes[1] >= sizes[0] else (0, 1)
    met = drawn[more].withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(partners - 1)))).withColumn("j", (F.col("i") + F.col("t") * 7919) % sizes[fewer])
    pairs = met.join(drawn[fewer].select(F.col("i").alias("j"), F.col("x").alias("y")), "j")
    sign = F.when((F.col("i") + F.col("t")) % 2 == 0, 1.0).otherwise(-1.0)
    toward = sign if more == 1 else -sign
    difference = F.array(*[sign * (F.col("x")[i] - F.col("y")[i]) / spread[i] for i in range(d)])
    data = kept(pairs.select(difference.alias("difference"), (toward > 0).cast("double").alias("label")), "pairs")
    learner = LogisticRegression(featuresCol="features", labelCol="label", fitIntercept=False, standardization=False, regParam=RIDGE, maxIter=60)
    weights = tuple(float(w) for w in learner.fit(data.select(array_to_vector("difference").alias("features"), "label")).coefficients)
    ranking = Ranking(centre, spread, weights, 0.0)
    # between the last score of the share and the next one, as the exact quantile lies
    total = n[0] + n[1]
    last, following = rows.agg(F.percentile_approx(ranking.worth(), [(n[0] - 0.5) / total, (n[0] + 0.5) / total], 100_000).alias("cuts")).first().cuts
    cut = last + (following - last) * n[1] / total
    return Ranking(centre, spread, weights, float(cut))


def classify(documents: DataFrame, labels: DataFrame, learn_from, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``(doc_id, score, predicted)`` of every row, learned from the labels of rows where ``learn_from`` holds.

    ``learn_from`` is a condition on ``doc_id``. Null and empty texts are scored
    by features of 0, very long ones by those of the whole text; a document with
    several labels teaches each of them; rows that repeat stay, and teach as often
    as they occur. An empty table gives no rows. Only the named columns are read.
    """
    rows = kept(featured(documents, doc_id, text), "features")
    known = input_columns(labels, doc_id=doc_id, label=label).filter("label IN (0, 1)").distinct()
    ranking = fit(rows.filter(learn_from).join(known, "doc_id").select("x", "label"))
    scored = rows.select("doc_id", ranking.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, learn_from, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``documents`` whose score reaches the threshold, with the columns as they were."""
    known = input_columns(labels, doc_id=doc_id, label=label).filter("label IN (0, 1)").distinct()
    rows = kept(featured(documents, doc_id, text).filter(learn_from).join(known, "doc_id").select("x", "label"), "features")
    ranking = fit(rows)
    names = documents.columns
    private = [f"_{i}" for i in range(len(names))]
    plain = documents.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, private)])
    good = _scored(plain, ranking, private[names.index(text)]).filter("score >= 0.5")
    return good.select(*[F.col(p).alias(c) for p, c in zip(private, names)])


def _scored(documents: DataFrame, ranking: Ranking, text: str) -> DataFrame:
    """``documents`` with ``x`` and ``score``, in one pass that leaves the text where it is."""
    names = documents.columns
    at = names.index(text)
    schema = documents.withColumn("x", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, at):
            made = [features(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*names, "x"])

    return documents.mapInArrow(lean(run), schema).withColumn("score", ranking.score("x"))
