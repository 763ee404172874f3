"""Language identification by mixture inference over character n-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import by_pieces, input_columns

GRAM = 3
#: Hash buckets of the n-grams; a model is languages x buckets numbers, checked against the bound.
BUCKETS = 1 << 15
MAX_MODEL_CELLS = 64_000_000
SMOOTHING = 0.1
ROUNDS = 25
UNKNOWN = "und"


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the lower-cased, space-framed text."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(codes) < GRAM:
        return np.zeros(BUCKETS, np.int64)
    h = codes[: len(codes) - GRAM + 1].copy()
    for i in range(1, GRAM):
        h = h * np.uint64(0x9E3779B1) + codes[i : len(codes) - GRAM + 1 + i]
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return np.bincount((h >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)


class Model:
    """Smoothed n-gram probabilities of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.p = (smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float64)

    def mixture(self, counts: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The languages a text is made of, by place, and their shares.

        Expectation-maximisation estimates the shares of all languages; of the
        sets that take the largest shares first, the one with the highest
        penalised likelihood is chosen, and its shares are estimated anew.
        """
        at = np.flatnonzero(counts)
        c, p = counts[at].astype(np.float64), self.p[:, at]
        shares = _shares(p, c, np.full(len(p), 1 / len(p)))
        order = np.argsort(-shares, kind="stable")
        penalty = 0.5 * np.log(c.sum() + 1)
        ceiling = c @ np.log(shares @ p)  # no smaller set can be likelier
        best = None
        for n in range(1, len(order) + 1):
            chosen = order[:n]
            if best is not None and ceiling - n * penalty <= best[0]:
                break
            own = np.ones(1) if n == 1 else _shares(p[chosen], c, shares[chosen] / shares[chosen].sum())
            value = c @ np.log(own @ p[chosen]) - n * penalty
            if best is None or value > best[0]:
                best = value, chosen, own
            if shares[order[n:]].sum() < 1e-6:
                break
        return [int(i) for i in best[1]], best[2]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        chosen, shares = self.mixture(gram_counts(text))
        top = int(np.argmax(shares))
        return self.languages[chosen[top]], float(min(1.0, shares[top]))


def _shares(p: np.ndarray, c: np.ndarray, start: np.ndarray) -> np.ndarray:
    shares, total = start, c.sum()
    for _ in range(ROUNDS):
        weighted = shares[:, None] * p
        new = weighted @ (c / weighted.sum(axis=0)) / total
        moved = np.abs(new - shares).max()
        shares = new
        if moved < 1e-4:
            break
    return np.maximum(shares, 1e-12)


def train(documents: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count the n-grams of all rows with a text and a language.

    Tasks add up their own rows first and send at most languages x buckets
    counts; only the sums come to the driver.
    """
    rows = input_columns(documents, text=text, lang=lang).filter("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for batch in by_pieces(batches, 0):
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[name] += gram_counts(t)
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])

    summed = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    languages = sorted(r.lang for r in rows.select("lang").distinct().limit(MAX_MODEL_CELLS // BUCKETS + 1).collect())
    if len(languages) * BUCKETS > MAX_MODEL_CELLS:
        raise ValueError(f"more than {MAX_MODEL_CELLS // BUCKETS} languages")
    counts = np.zeros((len(languages), BUCKETS))
    place = {name: i for i, name in enumerate(languages)}
    for r in by_lang.toLocalIterator():
        got = np.array(r.counts, np.int64)
        counts[place[r.lang], got[:, 0]] = got[:, 1]
    return Model(languages, counts)


def predict(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every whole text.

    ``score`` is the share of the predicted language. Null texts, texts without
    a letter and an empty model give ``und`` with score 0; of equal shares the
    first language by name wins. Rows that repeat stay.
    """
    source = input_columns(documents, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, 1):
            made = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
