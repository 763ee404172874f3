from __future__ import annotations

import random

import pytest


WORDS = [a + b + c for a in ("th", "on", "re", "ver", "mi", "sol") for b in ("a", "e", "ou") for c in ("n", "st", "ble", "r", "tion")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_hash string, k string, label int"


@pytest.fixture(scope="session")
def documents(spark):
    """``documents([(doc_id, text), …])`` with further columns, some named as operators name theirs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t), "x", "y", 3) for i, t in rows], DOCUMENTS)

    return make
