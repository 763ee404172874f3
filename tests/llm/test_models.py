"""Quality, language and secret models: what they learn, and their edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from barloom import session
from barloom.llm import decontaminate, langid, quality, secret_scan, sentencepiece
from barloom.llm.queries import model_path
from tests.llm.conftest import prose


def good_and_bad(n):
    rng = random.Random(9)
    out = []
    for i in range(n):
        text = prose(rng, rng.randrange(20, 200))
        if i % 4 == 0:
            text = rng.choice([lambda t: " ".join(w + "###" for w in t.split()), lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(t.split()[:2] * 60)])(text)
        out.append((i, text, int(i % 4 != 0)))
    return out


def test_quality_on_held_out_rows(spark, documents):
    rows = good_and_bad(400)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, None), (None, 1), (2, 7)], "doc_id bigint, quality int")
    df = documents([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, rows[1][1]), (1, rows[1][1])])
    got = quality.classify(df, labels, F.col("doc_id") % 3 != 1).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r.doc_id is not None and r.doc_id % 3 == 1 and r.doc_id < 400]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    good = quality.keep_good(df, labels, F.col("doc_id") % 3 != 1)
    assert good.columns == df.columns
    assert sorted(str(r.doc_id) for r in good.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


@pytest.mark.parametrize("labels,predicted", [([], 1), ([(0, 1), (1, 1)], 1), ([(0, 0), (1, 0)], 0)])
def test_quality_without_two_classes(spark, documents, labels, predicted):
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = quality.classify(documents([(0, "a b"), (1, None)]), frame, F.lit(True)).collect()
    assert [r.predicted for r in got] == [predicted] * 2
    assert quality.classify(documents([]), frame, F.lit(True)).collect() == []


def test_ranking_loss_is_at_its_minimum(spark, monkeypatch):
    """A step along any weight raises the penalised loss over the pairs that the fit draws."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    label = (x @ rng.normal(size=x.shape[1]) + rng.normal(size=300) > 0).astype(int)
    frame = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, label)], "x array<double>, label int")
    written = {}
    monkeypatch.setattr(quality, "kept", lambda df, name: written.setdefault(name, original(df, name)) if name == "pairs" else original(df, name))
    original = session.kept
    ranking = quality.fit(frame)
    pairs = written["pairs"].collect()
    d, won = np.array([r.difference for r in pairs]), np.array([r.label for r in pairs])
    assert len(pairs) == quality.PARTNERS * max(label.sum(), 300 - label.sum())

    def loss(w):
        return np.mean(np.logaddexp(0, -(2 * won - 1) * (d @ w))) + quality.RIDGE / 2 * w @ w

    weights = np.array(ranking.weights)
    for step in np.eye(len(weights)) * 0.05:
        assert min(loss(weights + step), loss(weights - step)) > loss(weights)
    score = (x - np.array(ranking.centre)) / np.array(ranking.spread) @ weights
    assert np.mean((score >= ranking.threshold) == (label == 1)) > 0.8
    assert abs(np.mean(score < ranking.threshold) - np.mean(label == 0)) < 0.02


def test_the_threshold_leaves_all_of_the_share_below(spark):
    # two classes that every weight tells apart, 24 and 96 rows
    rows = [([float(i >= 24) * 10 + i / 1000] * len(quality.FEATURES), int(i >= 24)) for i in range(120)]
    frame = spark.createDataFrame(rows, "x array<double>, label int")
    scored = frame.select("label", quality.fit(frame).score().alias("score")).collect()
    assert [r.label for r in scored] == [int(r.score >= 0.5) for r in scored]
    # rows that were not learnt from fall on the side that they are nearer to
    between = spark.createDataFrame([([x] * len(quality.FEATURES),) for x in (1.0, 9.9)], "x array<double>").select(quality.fit(frame).score().alias("score"))
    assert [r.score >= 0.5 for r in between.collect()] == [False, True]


def test_quality_learns_from_classes_that_are_mostly_copies(spark):
    copies = spark.range(100_000).select(F.array(*[F.lit(0.5 + i) for i in range(len(quality.FEATURES))]).alias("x"), F.lit(0).alias("label"))
    others = spark.range(500).select(F.array(*[F.rand(i) * 3 for i in range(len(quality.FEATURES))]).alias("x"), F.lit(1).alias("label"))
    for sample in (20, 1000):
        ranking = quality.fit(copies.unionByName(others), sample=sample)
        assert any(ranking.weights)


def test_user_columns_named_like_inner_ones_stay(spark):
    rows = [(i, "good text about things " * 5 if i % 2 else "$$ ## 1 1 1", 777, "h", [1], 0.1, "own", 2.0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, hit_runs string, item_ids array<int>, score double, __x string, __text double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    good = quality.keep_good(docs, labels, F.lit(True))
    assert good.schema == docs.schema and {r.n_words for r in good.collect()} == {777}
    items = spark.createDataFrame([(1, "text about things good text about things good text about")], "item_id bigint, text string")
    clean = decontaminate.decontaminate(docs, items)
    assert clean.schema == docs.schema
    assert {(r.n_words, r["__x"]) for r in clean.collect()} == {(777, "own")} and clean.count() == 30
    found = decontaminate.find_hits(docs, items).collect()
    assert {r.n_words for r in found} == {20, 3}
    coded = sentencepiece.encode(docs, sentencepiece.Vocabulary.load(model_path()))
    assert [c for c in coded.columns if c != "ids"] == docs.columns and {r["__text"] for r in coded.collect()} == {2.0}


LANGS = {"xx": "abcde", "yy": "fghij", "zz": "klmno"}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(4)
    rows = [(i, speech(rng, lang, 40), lang) for i, lang in enumerate(list(LANGS) * 30)]
    frame = spark.createDataFrame([*rows, (500, None, "xx"), (501, "abc", None)], "doc_id bigint, text string, lang string")
    model = langid.train(frame)
    assert model.languages == ["xx", "yy", "zz"]
    mixed = speech(rng, "yy", 60) + " " + speech(rng, "zz", 30)
    tests = [(1, speech(rng, "xx", 30)), (2, mixed), (3, None), (4, ""), (5, "123 !?"), (None, speech(rng, "zz", 5)), (6, "Ab"), (6, "Ab"), (7, "é")]
    got = langid.predict(spark.createDataFrame([(*t, "x") for t in tests], "doc_id bigint, text string, score string"), model).collect()
    assert [r.lang_pred for r in got[:6]] == ["xx", "yy", "und", "und", "und", "zz"] and got[6:8] == [got[6]] * 2
    assert got[0].score > 0.95 and 0.55 < got[1].score < 0.8 and got[2].score == 0.0 and all(0 <= r.score <= 1 for r in got)
    chosen, shares = model.mixture(langid.gram_counts(mixed))
    assert [model.languages[i] for i in chosen] == ["yy", "zz"] and abs(shares.sum() - 1) < 1e-6
    nothing = langid.train(frame.limit(0))
    assert nothing.predict("abc") == ("und", 0.0)


def test_mixture_maximises_the_likelihood():
    """Shares from expectation-maximisation against a grid of shares."""
    import numpy as np

    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(50), size=2)
    c = rng.multinomial(2000, 0.3 * p[0] + 0.7 * p[1]).astype(float)
    shares = langid._shares(p, c, np.array([0.5, 0.5]))
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([c @ np.log(a * p[0] + (1 - a) * p[1]) for a in grid])]
    assert abs(shares[0] - best) < 0.01


def secrets_corpus(rng, n):
    rows = []
    for i in range(n):
        words = prose(rng, 40).split()
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        words.insert(10, [f'token = "{hexes}"', f"password={hexes[:18]}", "AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16)), "".join(rng.choice("0123456789") for _ in range(16)), f"{'verylongname'}.{i}1234567890@mail.example.com"][i % 5])
        rows.append((i, " ".join(words)))
    return rows


def test_secrets(documents):
    rng = random.Random(5)
    rows = secrets_corpus(rng, 300)
    found = secret_scan.scan(documents([*rows, (900, None), (901, ""), (None, rows[0][1]), (0, rows[0][1])]), learn_from=F.col("doc_id") % 3 != 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    got = found.collect()
    assert sum(r.doc_id == 0 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1 and not any(r.doc_id in (900, 901) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id % 3 == 1 and r.label is not None]
    assert len(held) > 80 and sum(r.is_secret == (r.label == 1) for r in held) >= 0.97 * len(held)
    assert {r.doc_id % 5 for r in held if r.is_secret} == {0, 1, 2}


def test_secrets_edge_cases(documents):
    assert secret_scan.scan(documents([])).collect() == []
    assert secret_scan.scan(documents([(1, None), (2, "no finding here")])).collect() == []
    one = secret_scan.scan(documents([(1, 'x token: "abcdef0123456789" password=abcdef0123456789,zyxwvu9876543210')])).collect()
    assert sorted((r.word_no, r.finding, r.is_secret) for r in one) == [(2, "abcdef0123456789", True), (3, "abcdef0123456789", True), (3, "zyxwvu9876543210", True)]


def test_secrets_without_digits_and_with_signs(documents):
    """Values of any form after a credential's name, and keys that have no digit."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(16))
    base = "".join(rng.choice(letters) for _ in range(22))
    cases = [
        (key, key, 10), (f"secret={base}", base, 10), ("password=p@ss!w#rd", "p@ss!w#rd", 10), ('token = "zq!x"', "zq!x", 12), ("pwd: kx@7#q", "kx@7#q", 11),
        ('{"password":"a,b;c=d"}', "a,b;c=d", 10), ("passwd='qzx jkw vvb'", "qzx jkw vvb", 10), ("auth=abcdefgh1234!x#y", "abcdefgh1234!x#y", 10), ("api_key=k", "k", 10), (base, base, 10),
    ]
    rows = secrets_corpus(rng, 300)
    for i, (text, _, _) in enumerate(cases):
        words = prose(rng, 40).split()
        rows.append((1000 + i, " ".join([*words[:10], text, *words[10:]])))
    rows += [(2000 + i, prose(rng, 20) + " vermistthonmin reonsolverthan") for i in range(5)]
    got = secret_scan.scan(documents(rows)).collect()
    found = {(r.doc_id, r.word_no, r.finding): r for r in got if r.doc_id >= 1000}
    assert {k for k in found if k[0] < 2000} == {(1000 + i, no, value) for i, (_, value, no) in enumerate(cases)}
    assert all(r.is_secret for k, r in found.items() if k[0] < 1009)
    assert {(k[2], r.is_secret) for k, r in found.items() if k[0] >= 2000} == {("vermistthonmin", False), ("reonsolverthan", False)}
