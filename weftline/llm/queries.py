"""Queries of the training-data operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import blocknorm, blocktext, bpe, filter_audit, host_reputation, ivfpq, langid, line_dedup, mixing, repetition, simhash, token_histogram, warc
from weftline.staging import stage

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in a task for each core at least: a table of a few row groups is dealt anew, so that work on its texts is shared."""
    df = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tokenizer(name: str = VOCABULARY) -> tuple[bytes, str]:
    """Ranks and pattern of a public tokenizer."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document that its url numbers, and takes that one's outcome."""
    return host_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), document=host_reputation.document_of())


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(documents(spark, sf_dir).select("doc_id", "text"), drop_text=True).drop("longest_repeat")


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocktext.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = langid.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.copies(rows).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer()
    hist = token_histogram.histogram(bpe.lengths(documents(spark, sf_dir).select("text"), ranks, pattern))
    return token_histogram.suffix_sums(stage(hist, "histogram"))  # it is read twice; encoding is done once


def op9_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(spark, warc.write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer()
    return bpe.digests(documents(spark, sf_dir).select("doc_id", "text"), ranks, pattern)


def op11_block_norm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknorm.summary(blocknorm.fit(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.digests(docs, line_dedup.bitmaps(docs))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.run(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ivfpq_search, op2_host_reputation, op3_suffix_repetition, op4_simhash_components, op5_main_text, op6_language_id, op7_source_mix, op8_token_histogram, op9_warc_shards, op10_merge_replay, op11_block_norm_clusters, op12_line_dedup, op13_filter_audit)
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: Windows of min_words found twice cover what repeats of at least min_words cover; a window of max_repeat + 1 found twice is a longer repeat.
_OP3 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, i, hash(w[i : i + k - 1]) AS h, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, (VALUES (3), ({repetition.MIN_WORDS}), ({repetition.MAX_REPEAT + 1})) v(k))),
r AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, s) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, k, sum(least(k, coalesce(nxt - i, k))) AS covered FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id, k ORDER BY i) AS nxt FROM r) GROUP BY doc_id, k),
p AS (SELECT doc_id, coalesce(max(covered) FILTER (k = 3), 0)::BIGINT AS three, coalesce(max(covered) FILTER (k = {repetition.MIN_WORDS}), 0)::BIGINT AS covered, coalesce(max(covered) FILTER (k = {repetition.MAX_REPEAT + 1}), 0) AS over FROM c GROUP BY doc_id),
l AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT *, NOT base_failed AND over = 0 AND covered_words <= {repetition.MAX_COVERED} * n_words AS kept FROM (
SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(three, 0) AS n_repeat_words, coalesce(covered, 0) AS covered_words, coalesce(over, 0) AS over,
  len(w) < 50 OR 100 * coalesce(three, 0) > 50 * len(w) AS base_failed
FROM t LEFT JOIN p ON t.doc_id = p.doc_id LEFT JOIN l ON t.doc_id = l.doc_id)
"""

_OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT sha, unhex(sha)::BIT::VARCHAR AS bits FROM (SELECT DISTINCT sha FROM p)),
d AS (SELECT sha, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1) FOR i IN range(0, 32)], '') AS payload_digest FROM b),
f AS (SELECT sha, min(page_id) AS first_id FROM p GROUP BY sha)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN d ON p.sha = d.sha JOIN f ON p.sha = f.sha
"""

ORACLE: dict[str, str] = {"op2_host_reputation": host_reputation.ORACLE, "op3_suffix_repetition": "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed, kept FROM (" + _OP3 + ")", "op7_source_mix": mixing.ORACLE, "op9_warc_shards": _OP9, "op11_block_norm_clusters": blocknorm.ORACLE, "op12_line_dedup": line_dedup.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
