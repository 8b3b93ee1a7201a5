"""A corpus-cleaning pipeline over ``documents``; each stage calls one operator of stopwise.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. Between stages the rows are written as Parquet to the shared folder
and read again, so a lost executor never costs an earlier stage.

1. toxicity: documents whose score reaches the threshold of their language go.
2. n-gram Jaccard join: of documents linked by five-word shingles at 0.8, the smallest id stays.
3. secret scans: values judged to be secrets are replaced by a mark; no document goes.
4. mixing: 90 % of the tokens, by target weights of domains and languages, each document at most once.
5. byte-level BPE: token counts and digests of ids and decoded bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm import bpe, mixing, ngram_join, secrets, toxicity
from stopwise.llm.queries import WEIGHTS, domain_of, held_out, small_batches, table
from stopwise.session import materialize


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.redact(docs, secrets.train(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, share=0.9, weights=WEIGHTS, max_epochs=1, seed=7, domain=domain_of(F.col("source")), epoch_col=None)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("secret scans", without_secrets),
    ("mixing to target weights", mixed),
    ("byte-level BPE", encoded),
]

#: Models and merge queues have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
