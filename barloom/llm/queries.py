"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import context_mixing, decontaminate, html_text, knn, langid, lexical, line_dedup, prefix_trie, quality, secret_scan, sentencepiece, simhash, warc
from barloom.session import kept, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    """Where the public tokenizer file lies; its package is only asked when a query runs."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def crc_of(doc_id: str = "doc_id"):
    """crc32 of an id as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those kept, and the hash of the text that is left."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("bigint")
    kept_lines = line_dedup.deduplicate(documents.select("doc_id", "text", n_lines.alias("n_lines")))
    return kept_lines.select("doc_id", "n_lines", n_lines.alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their scores; documents whose crc32 leaves 1 by 3 teach nothing."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), learn_from=crc_of() % 3 != 1)
    return found.select("doc_id", "word_no", "finding", F.coalesce(crc_of() % 3 == 1, F.lit(False)).alias("held_out"), "label", "score", "is_secret")


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = shared_dir(spark, "warc")
    written = warc.write_archives(warc.page_records(pages), folder, warc.train_dictionary(pages))
    kept(written, "archives")
    read = warc.read_archives(spark, folder, payloads=False)
    return read.select(warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").alias("refers_to"))


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = sentencepiece.Vocabulary.load(model_path())
    return sentencepiece.encode(documents, vocabulary, into=None, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = knn.quantised(table(spark, sf_dir, "embeddings"))
    return knn.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


@query
def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.summary(decontaminate.find_hits(documents, table(spark, sf_dir, "benchmark")))


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query
def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_of() % 3 != 1)
    return scored.select("doc_id", F.coalesce(crc_of() % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents.filter(crc_of() % 4 != 2))
    found = langid.predict(documents, model)
    return found.select("doc_id", F.coalesce(crc_of() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = context_mixing.trained_and_scored(documents, crc_of() % 7 != 2)
    return scored.select("doc_id", F.coalesce(crc_of() % 7 == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_lead(lists))


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op5_voronoi_knn"] = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
asked AS (SELECT * FROM good WHERE vec_id % 100 = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM asked q JOIN good d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v))
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored) WHERE n <= 10"""

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL["op7_decontamination"] = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, size, list_slice(w, pos, pos + size - 1) AS words
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS pos FROM (SELECT *, least(10, len(w)) AS size FROM item_words WHERE len(w) > 0))),
docs AS (SELECT doc_id, row_number() OVER () AS row, coalesce({_WORDS}, []) AS w FROM documents),
places AS (
  SELECT row, size, pos, list_slice(w, pos, pos + size - 1) AS words
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS pos FROM docs CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT row, pos, p.size, item_id FROM places p JOIN windows i ON p.size = i.size AND p.words = i.words),
hit AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(pos, pos + size)) AS place FROM found) GROUP BY row),
listed AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN listed USING (row)"""

ORACLE_SQL["op12_prefix_trie"] = """
WITH numbered AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS r, coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY i) AS w FROM numbered GROUP BY c),
crc AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 4 AS h FROM own),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(list_slice(b.w, 1, a.h), []), list_slice(a.w, a.h + 1, len(a.w))) AS w
  FROM crc a LEFT JOIN own b ON b.c = a.c - a.c % 20),
prefixes AS (SELECT c, len(w) = d AS ends, d, list_slice(w, 1, d) AS p FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, any_value(d) AS d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ids FROM prefixes GROUP BY p),
children AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
known AS (
  SELECT p, d, conv_id, n, ids, coalesce(n_children, 0) AS n_children,
    CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(p[d].x, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM nodes LEFT JOIN children USING (p)),
subtrees AS (
  SELECT list_slice(p, 1, e) AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM known) GROUP BY 1)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n AS n_convs, k.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(k.ids) AS ends_sha256
FROM known k JOIN subtrees s ON s.p = k.p LEFT JOIN nodes u ON k.d > 0 AND u.p = list_slice(k.p, 1, k.d - 1)"""

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL["op13_lexical_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT row, doc_id, len(w) AS n FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
postings AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM postings, totals GROUP BY term),
scored AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score
  FROM postings JOIN weights USING (term) JOIN lengths USING (row) JOIN wanted USING (term), totals GROUP BY item_id, row)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50"""
