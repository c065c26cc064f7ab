"""One registered query per operator, and the pipeline: thin projections onto their contracts."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimspark.llm.attention import text_scores
from claimspark.llm.alignment import aligned_documents
from claimspark.llm.ball_tree import top_k
from claimspark.llm.bestfit import best_fit_documents
from claimspark.llm.manifest import manifest_proofs
from claimspark.llm.ngram_join import ngram_components
from claimspark.llm.packing import packed_documents
from claimspark.llm.pieces import piece_digests
from claimspark.llm.sketches import text_sketches
from claimspark.llm.substrings import with_cuts
from claimspark.llm.token_files import token_files
from claimspark.llm.toxicity import toxicity_scores
from claimspark.llm.warc import archived_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages"), min_bytes=0)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_sketches(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packed_documents(_table(spark, sf_dir, "documents"), tokenizer, end_id=1, capacity=2048)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = with_cuts(_table(spark, sf_dir, "documents"), window=35)
    return cut.select("doc_id", "cuts.n_words", "cuts.n_removed", "cuts.kept_sha256")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_files(_table(spark, sf_dir, "documents"), tokenizer, end_id=2)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_proofs(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return aligned_documents(_table(spark, sf_dir, "documents"), *paths)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return best_fit_documents(_table(spark, sf_dir, "documents"), tokenizer, end_id=1, capacity=4096)


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_top_k": op1_top_k,
    "op2_warc": op2_warc,
    "op3_fingerprints": op3_fingerprints,
    "op4_ngram_join": op4_ngram_join,
    "op5_packing": op5_packing,
    "op6_pieces": op6_pieces,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_manifest": op11_manifest,
    "op12_alignment": op12_alignment,
    "op13_best_fit": op13_best_fit,
}

ORACLES: dict[str, str] = {
    "op1_top_k": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), q AS (SELECT * FROM e WHERE vec_id % 50 = 0), s AS (
            SELECT q.vec_id AS query_id, e.vec_id,
                list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * e.v[i]))::BIGINT AS score
            FROM q JOIN e ON q.vec_id <> e.vec_id
        )
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5""",
    "op2_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                sha1(coalesce(html, '')) AS h
            FROM pages
        ), f AS (SELECT h, min(page_id) AS first_page FROM p GROUP BY h)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr(
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(h, 10 * (i // 8)::BIGINT + 1, 10))::UBIGINT
                    >> (35 - 5 * (i % 8))::UBIGINT) & 31)::INTEGER, 1)), '') AS payload_digest,
            CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_page THEN first_page END AS refers_to
        FROM p JOIN f USING (h)""",
    "op11_manifest": r"""
        WITH RECURSIVE
        d AS (
            SELECT row_number() OVER () AS rid, source, doc_id, text,
                concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'),
                    coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
                list_reduce(
                    list_concat([4294967295::UBIGINT], list_transform(split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
                    lambda c, b: list_reduce(
                        list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                        lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) % 2 = 1 AS even
            FROM documents
        ),
        l AS (
            SELECT rid, source, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS kept,
                sha256(head || coalesce(strlen(kept) || ':' || kept, '-')) AS changed
            FROM d
        ),
        p AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
                count(*) OVER (PARTITION BY source) AS n
            FROM l
        ),
        nodes(source, lvl, idx, n, digest) AS (
            SELECT source, 0, idx, n, leaf FROM p
            UNION ALL
            SELECT source, lvl + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
            FROM nodes WHERE n > 1 GROUP BY source, lvl, idx // 3
        ),
        subroots AS (
            SELECT source, lvl AS height, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place,
                count(*) OVER () AS n
            FROM nodes WHERE n = 1
        ),
        tops(lvl, idx, n, digest) AS (
            SELECT 0, place, n, digest FROM subroots
            UNION ALL
            SELECT lvl + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
            FROM tops WHERE n > 1 GROUP BY lvl, idx // 3
        ),
        runs AS (
            SELECT p.rid, o.lvl AS step, o.idx, o.idx = p.idx // (3 ** o.lvl)::BIGINT AS own, o.digest
            FROM p JOIN nodes o ON o.source IS NOT DISTINCT FROM p.source AND o.n > 1
                AND o.idx // 3 = p.idx // (3 ** (o.lvl + 1))::BIGINT
            UNION ALL
            SELECT p.rid, s.height + o.lvl, o.idx, o.idx = s.place // (3 ** o.lvl)::BIGINT, o.digest
            FROM p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
            JOIN tops o ON o.n > 1 AND o.idx // 3 = s.place // (3 ** (o.lvl + 1))::BIGINT
        ),
        packed AS (
            SELECT rid, step, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (NOT own), '') AS others,
                list(CASE WHEN NOT own THEN digest END ORDER BY idx) AS run
            FROM runs GROUP BY ALL
        ),
        folds(rid, step, digest) AS (
            SELECT rid, 0, changed FROM p
            UNION ALL
            SELECT f.rid, f.step + 1, sha256(array_to_string(list_transform(k.run, lambda x: coalesce(x, f.digest)), ''))
            FROM folds f JOIN packed k ON k.rid = f.rid AND k.step = f.step
        ),
        roots AS (SELECT digest AS root FROM tops WHERE n = 1),
        ends AS (SELECT rid, arg_max(digest, step) AS folded_root FROM folds GROUP BY 1),
        proofs AS (SELECT rid, sha256(string_agg(others, '' ORDER BY step)) AS proof_sha256 FROM packed GROUP BY 1)
        SELECT p.doc_id, p.leaf, s.digest AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
            folded_root, folded_root = root AS verified
        FROM p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN ends USING (rid)
        LEFT JOIN proofs USING (rid), roots""",
}
