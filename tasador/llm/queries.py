"""The operators of this subpackage applied to their whole tables, and SQL where it says the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tasador.llm import (
    kmeans_tree,
    langid,
    linededup,
    minhash,
    packing,
    phrases,
    pieces,
    quality,
    secrets,
    sharding,
    sitestyle,
    turntrie,
    vafile,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return sitestyle.main_text(table(spark, sf_dir, "pages"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge encoding of every text: ids and decoded text as digests."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digest_documents(table(spark, sf_dir, "documents"), path)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return kmeans_tree.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest inner products of every twentieth vector."""
    return vafile.top_products(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that repeat earlier ones."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of equal bytes, equal texts together."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of every lang."""
    return phrases.collocations(table(spark, sf_dir, "documents"), fewest=100, best=2000)


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return turntrie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_pieces": op2_pieces,
    "op3_packing": op3_packing,
    "op4_kmeans_tree": op4_kmeans_tree,
    "op5_minhash": op5_minhash,
    "op6_vafile": op6_vafile,
    "op7_secrets": op7_secrets,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_lines": op10_lines,
    "op11_shards": op11_shards,
    "op12_phrases": op12_phrases,
    "op13_turn_trie": op13_turn_trie,
}

ORACLES: dict[str, str] = {
    "op6_vafile": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)
                    OR abs(floor(64 * CAST(x AS DOUBLE))) > sqrt(pow(2, 62) / len(embedding)))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(
                CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v ON q.vec_id <> v.vec_id
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
                vec_id, score
            FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 20
    """,
    "op10_lines": """
        WITH raw AS (
            SELECT doc_id, text, CAST(unnest(range(len(l))) AS BIGINT) AS n, unnest(l) AS raw
            FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
        ), lines AS (SELECT doc_id, n, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM raw),
        firsts AS (
            SELECT line, min(struct_pack(d := doc_id, n := n)) AS place FROM lines WHERE line <> '' GROUP BY line
        ), variants AS (
            SELECT line, place, i, hash(line[1:i - 1] || line[i + 1:]) AS v
            FROM (SELECT line, place, unnest(range(1, length(line) + 1)) AS i FROM firsts WHERE length(line) >= 12)
            UNION ALL SELECT line, place, 0, hash(line) FROM firsts WHERE length(line) >= 12
        ), replaced AS (SELECT v, i, min(place) AS earliest FROM variants WHERE i > 0 GROUP BY v, i),
        whole AS (SELECT v, min(place) AS earliest FROM variants WHERE i = 0 GROUP BY v),
        longer AS (SELECT v, min(place) AS earliest FROM variants WHERE i > 0 GROUP BY v),
        near AS (
            SELECT line FROM variants JOIN replaced USING (v, i) WHERE earliest < place
            UNION SELECT line FROM variants JOIN whole USING (v) WHERE i > 0 AND earliest < place
            UNION SELECT line FROM variants JOIN longer USING (v) WHERE i = 0 AND earliest < place
        ), told AS (
            SELECT l.doc_id, l.n, l.raw, l.line, l.line <> '' AND (
                l.line IN (SELECT line FROM near) OR f.place <> struct_pack(d := l.doc_id, n := l.n)) AS dropped
            FROM lines l LEFT JOIN firsts f USING (line)
        ), per_doc AS (
            SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (dropped) AS n_dropped,
                coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (NOT dropped), '') AS text
            FROM told GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
            CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, p.text
        FROM documents d LEFT JOIN per_doc p USING (doc_id)
    """,
}
