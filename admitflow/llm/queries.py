"""Registered queries of the training-data operators: each applies its
operator to its whole table; ``ORACLES`` has DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import (backoff_lm, bottomk_dedup, chat_hmm, hard_negatives, lz_fingerprint, ngram_join, nra_topk, packing, pii,
               sentencepiece_backend, subvector_kmeans, token_store, toxicity)
from .common import Scratch
from .encoding import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and canonical text of every conversation, read as transcripts;
    learned from those whose crc32(conv_id as text) mod 5 is not 0."""
    ship_package(spark)
    texts = chat_hmm.transcripts(_table(spark, sf_dir, "conversations"))
    texts = Scratch(spark, "op1").table(texts.withColumn("held_out", ~chat_hmm.in_training(texts["conv_id"])), "texts")
    return chat_hmm.format_chats(texts, chat_hmm.train(texts.where("not held_out")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 3-word shingles at 0.9."""
    ship_package(spark)
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"), Scratch(spark, "op2"), n=3, num=90, den=100, second=3)


def op3_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth vector."""
    ship_package(spark)
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nra_topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), Scratch(spark, "op3"), k=10, scale=1024)


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to and read back from token files."""
    ship_package(spark)
    docs = _table(spark, sf_dir, "documents")
    manifest = token_store.write_tokens(docs, Scratch(spark, "op4"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_store.read_tokens(manifest)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 tokens."""
    ship_package(spark)
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, Scratch(spark, "op5"), tokenizer_path("byte_bpe_50k.json"), end_id=0, window=1024)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    ship_package(spark)
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.toxicity_scores(docs, labels, Scratch(spark, "op6"), folds=5, held=0)


def op7_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    ship_package(spark)
    return backoff_lm.score_documents(_table(spark, sf_dir, "documents"), Scratch(spark, "op7"), folds=7, held=2)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, compared with SentencePiece and decoded."""
    ship_package(spark)
    return sentencepiece_backend.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of every document and of its edited text."""
    ship_package(spark)
    return lz_fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op11_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 4-word shingles at 0.8, one kept."""
    ship_package(spark)
    return bottomk_dedup.near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark, "op11"), n=4, num=80, den=100)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every fiftieth vector; every seventh label is moved on."""
    ship_package(spark)
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0, Scratch(spark, "op12"))


def op13_subvector_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all vectors after three rounds."""
    ship_package(spark)
    return subvector_kmeans.centroid_clusters(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op13"), k=16, rounds=3, dims=64, scale=64)


QUERIES = {
    "op1_chat_hmm": op1_chat_hmm,
    "op2_ngram_join": op2_ngram_join,
    "op3_nra_topk": op3_nra_topk,
    "op4_token_file": op4_token_file,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_backoff_lm": op7_backoff_lm,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_lz_fingerprint": op9_lz_fingerprint,
    "op10_pii": op10_pii,
    "op11_bottomk": op11_bottomk,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_subvector_kmeans": op13_subvector_kmeans,
}


def _kmeans_sql(rounds: int) -> str:
    """The rounds as one table expression after another."""
    parts = ["""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS k, vec_id,
                   list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = 64
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS c, e
            FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v)
            QUALIFY c < 16)"""]
    for r in range(rounds + 1):
        parts.append(f"""
        a{r} AS MATERIALIZED (
            SELECT v.k, v.vec_id, v.e, c.c, c.e AS centre,
                   CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
            FROM v CROSS JOIN c{r} AS c
            QUALIFY row_number() OVER (PARTITION BY v.k ORDER BY d, c.c) = 1)""")
        if r < rounds:
            parts.append(f"""
        c{r + 1} AS MATERIALIZED (
            SELECT o.c, coalesce(n.e, o.e) AS e
            FROM c{r} AS o LEFT JOIN (
                SELECT c, list(x ORDER BY i) AS e
                FROM (SELECT c, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x
                      FROM (SELECT c, unnest(e) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i)
                GROUP BY c) AS n ON o.c = n.c)""")
    return ",".join(parts) + f"""
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(centre, ',')) AS centroid_sha256
        FROM a{rounds}"""

def _groups_sql(n: int, num: int, more: str) -> str:
    """Documents linked by n-word shingles at num / 100."""
    gram = " || chr(1) || ".join(f"ws[i + {j}]" for j in range(n))
    return f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(ws) >= {n} THEN list_distinct(list_transform(range(1, len(ws) - {n} + 2), lambda i: {gram}))
                   WHEN len(ws) > 0 THEN [array_to_string(ws, chr(1))] ELSE [] END AS g
            FROM w),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= {num} * (a.n + b.n - count(*))),
        reach(a, b) AS (
            SELECT doc_id, doc_id FROM s
            UNION
            SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
        smallest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id{more}
        FROM s JOIN smallest ON s.doc_id = smallest.a"""


ORACLES: dict[str, str] = {
    "op3_nra_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
                   CAST(coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
            WHERE q.vec_id % 100 = 0),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM pairs)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op2_ngram_join": _groups_sql(3, 90, ""),
    "op11_bottomk": _groups_sql(4, 80, ", s.doc_id = component_id AS kept"),
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                   CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
            FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE a.vec_id % 50 = 0),
        p AS (
            SELECT anchor_id, id, score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.id AS positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
               s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
                     AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        QUALIFY rank <= 3""",
    "op13_subvector_kmeans": _kmeans_sql(3),
}
