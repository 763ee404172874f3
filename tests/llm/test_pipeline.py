"""The registered queries, and the pipeline against the operators' brute-force versions."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
import public_tokenizers
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from barloom.llm import decontaminate, quality
from barloom.llm.queries import QUERIES
from tests.llm.conftest import prose
from tests.llm.test_decontaminate import brute_force as hits
from tests.llm.test_line_dedup import brute_force as lines_left
from tests.llm.test_simhash import plain_fingerprint, plain_groups

SMALL = "/root/testdata/sf0.001"


def test_ten_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_classifier", "fuzzy_lines", "near_duplicates", "decontamination", "tokens"]


COLUMNS = {
    "op3": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op4": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5": ["query_id", "rank", "vec_id", "score"],
    "op6": ["page_id", "url", "text", "n_chars"],
    "op7": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8": ["doc_id", "fingerprint", "component_id"],
    "op9": ["doc_id", "held_out", "score", "predicted"],
    "op10": ["doc_id", "held_out", "lang_pred", "score"],
    "op11": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
    "op12": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13": ["item_id", "rank", "doc_id", "score"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_a_row_for_each_of_their_table(spark, name):
    df = QUERIES[name](spark, SMALL)
    op = name.split("_")[0]
    assert df.columns == COLUMNS.get(op, df.columns)
    rows = df.collect()
    if op in ("op5", "op2"):
        assert rows
    elif op == "op12":
        # a row for each node; the root holds every conversation
        root, *others = sorted(rows, key=lambda r: r.depth)
        assert root.parent_conv_id is None and root.n_convs == spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct().count()
        assert len({(r.conv_id, r.depth) for r in rows}) == len(rows) and all(r.depth > 0 and r.parent_conv_id is not None for r in others)
    elif op == "op13":
        # up to 50 documents for each item
        ranks = defaultdict(list)
        for r in rows:
            ranks[r.item_id].append(r.rank)
        assert ranks and set(ranks) <= {r.item_id for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id").collect()}
        assert all(sorted(own) == list(range(1, len(own) + 1)) and len(own) <= 50 for own in ranks.values())
    else:
        source = spark.read.parquet(f"{SMALL}/{'pages' if op in ('op3', 'op6') else 'documents'}.parquet")
        assert len(rows) == source.count() and None not in {r[0] for r in rows}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    item = prose(rng, 14)
    shared = prose(rng, 25)
    rows = []
    for i in range(120):
        lines = [prose(rng, rng.randrange(15, 40)) for _ in range(4)]
        if i % 5 == 0:
            lines = [" ".join(w + "%%%" for w in line.split()) for line in lines]
        if i % 7 == 1:
            lines[1] += " " + item
        if i % 6 == 2:
            lines[2] = shared + " end"
        rows.append([i, "\n".join(lines)])
    for i in (31, 62, 93):
        rows.append([200 + i, rows[i][1].replace(" ", "  ", 1) if i == 62 else rows[i][1]])
    rows += [[300, None], [301, ""], [None, rows[3][1]]]
    path = tmp_path_factory.mktemp("tables")
    write = lambda r, schema, name: spark.createDataFrame(r, schema).write.parquet(f"file://{path}/{name}.parquet")
    write([(*r, "en", "src1", len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint", "documents")
    write([(i, int(i % 5 != 0), 0) for i in range(120)], "doc_id bigint, quality int, toxic int", "labels")
    write([(1, item), (2, None)], "item_id bigint, text string", "benchmark")
    return f"file://{path}", rows, item


def test_each_stage_equals_its_brute_force_version(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict((f.__name__, f) for _, f in corpus_pipeline.STAGES)
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    good = stage["quality_classifier"](spark, docs, path)
    assert good.columns == docs.columns
    kept = text(good)
    assert all(i in kept for i in range(120) if i % 5) and not any(i in kept for i in range(0, 120, 5))
    scored = quality.classify(docs, spark.read.parquet(f"{path}/labels.parquet"), corpus_pipeline.crc_of() % 3 != 1)
    assert set(kept) == {r.doc_id for r in scored.collect() if r.predicted}

    named = good.filter("doc_id IS NOT NULL")
    lines = stage["fuzzy_lines"](spark, named, path)
    assert lines.columns == docs.columns
    want = lines_left(sorted(text(named).items()))
    assert text(lines) == want

    near = stage["near_duplicates"](spark, lines, path)
    ids = sorted(want)
    groups = plain_groups([plain_fingerprint(want[i]) for i in ids])
    want = {ids[n]: want[ids[n]] for n in range(len(ids)) if groups[n] == n}
    assert near.columns == docs.columns and text(near) == want

    clean = stage["decontamination"](spark, near, path)
    left = text(clean)
    assert clean.columns == docs.columns and set(left) <= set(want)
    for i, t in want.items():
        n, hit, *_ = hits(t, [(1, item)])
        assert (i in left) == (hit <= 0.5 * n)
        assert hit or left[i] == t
    assert not any(hits(t, [(1, item)])[1] for t in left.values())

    out = {r.doc_id: r for r in stage["tokens"](spark, clean, path).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(out) == set(left)
    for i, r in out.items():
        assert r.ids == library.encode(left[i] or "") and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids).encode()).hexdigest()


def test_run_takes_the_stages_in_turn(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, path)
    assert sorted(map(str, corpus_pipeline.run(spark, path).collect())) == sorted(map(str, docs.collect()))


def test_stages_take_empty_tables(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, path).collect() == []


def test_cutting_keeps_the_rest_of_a_text():
    assert decontaminate._cut("x one Two, y", [[1, 2]]) == "x , y"
