"""Raw documents to a deduplicated, mixed and encoded corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows to the shared folder and reads them back as the next one's docs, and deletes
what a stage has left there once its rows are written. All stages but the last return the
columns of ``documents`` with the values that came in, also where an operator adds columns
of the same names. An empty table goes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import staging
from weftline.llm import bpe, langid, mixing, nearcopies, repetition, simhash
from weftline.llm.queries import documents, tokenizer

#: A prediction of lower score is rejected; four equally likely languages score 0.25.
LEAST_SCORE = 0.5


def _beside(docs: DataFrame, added: Sequence[str], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f's rows with the columns and values of docs, also where f adds columns of the same names."""
    apart = {c: f"_weftline_own_{c}" for c in docs.columns if c in added}
    out = f(docs.withColumnsRenamed(apart))
    return out.select(*(F.col(apart.get(c, c)).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have too few words and go. Rows are judged one by one, so null ids, repeated rows
    and ties change nothing; a long text is judged whole, by a suffix array of its own.
    """
    return _beside(docs, repetition.ADDED, lambda d: repetition.judge(d).filter("kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: not ``und``, and a score of LEAST_SCORE or more.

    Null texts and texts without a letter are ``und`` and go, as does every text where no document names a language.
    Of equally likely languages the first by name counts. A long text is read in pieces. Null and repeated ids change nothing.
    """
    told = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return _beside(docs, langid.ADDED, lambda d: langid.identify(d)[0].filter(told))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id: within op4's bits, or of five-word similarity 0.8 or more.

    Null ids come last, then texts by hash decide; of rows equal in id and text one stays. Null and empty texts are one
    group, by their fingerprint. Long texts are compared whole.
    """
    return simhash.survivors(docs, more=nearcopies.links(docs)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, not at all or up to three times.

    A null source is a source, a null or empty text has no words; null ids and repeated rows are rows like others, and
    rows equal in all columns are copies of one row. A long text is one row.
    """
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with n_tokens, and digests of the ids and of the bytes that these decode to.

    A null text is empty; null and repeated ids are carried; a long text is encoded whole, its words by parts.
    Columns of docs that are named like an added one are not read.
    """
    ranks, pattern = tokenizer()
    return bpe.digests(docs.select("doc_id", "lang", "source", "text"), ranks, pattern)


STAGES = [("quality rules", quality), ("language ID", language), ("SimHash near-dedup", near_duplicates), ("mixing sources to target weights", mixture), ("byte-level BPE encoding and decoding", encoding)]

#: Suffix arrays, a fitted classifier, components and BPE have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, f in STAGES:
        since, read = staging.mark(), docs
        docs = staging.stage(f(spark, read, sf_dir), name.split()[0].lower())
        staging.release(spark, since, keep=docs)
        staging.drop(read)
    return docs
