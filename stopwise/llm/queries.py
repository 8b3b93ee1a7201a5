"""Registered queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm import (
    bpe,
    embeddings,
    filter_audit,
    fingerprints,
    mixing,
    ngram_join,
    oracles,
    secrets,
    tokens,
    toxicity,
    urls,
    warc,
    whitening,
    word_bpe,
)


#: Rows of an Arrow batch. Texts are long, and a batch is held several times over.
BATCH_ROWS = 1000
#: Rows of a Parquet batch, whose texts lie in one array of the heap, which is copied to one twice as long as it grows.
READ_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Production settings of the mix. A source's domain follows from its number.
DOMAINS = ("web", "books", "code", "forum")
WEIGHTS = {
    "domain": {"web": 0.4, "books": 0.3, "code": 0.2, "forum": 0.1},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
}
#: url rules: host, path, action
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int")
    return F.get(F.array(*[F.lit(d) for d in DOMAINS]), F.pmod(F.coalesce(number, F.lit(0)), F.lit(len(DOMAINS))))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_ids(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_dedup(table(spark, sf_dir, "embeddings"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on labelled rows outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.learn(table(spark, sf_dir, "documents"), labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "rejected")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind", "digest", "score", "secret")


TOKEN_LIMIT = 4096


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), list(RULES))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_histories(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, share=0.6, weights=WEIGHTS, max_epochs=2, seed=7, domain=domain_of(F.col("source")))
    return mixed.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", F.col("_epoch").cast("long").alias("epoch"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return word_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_embeddings": op2_embeddings,
    "op3_fingerprints": op3_fingerprints,
    "op4_secret_scan": op4_secret_scan,
    "op5_token_counts": op5_token_counts,
    "op6_url_filter": op6_url_filter,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_filter_audit": op11_filter_audit,
    "op12_whitening": op12_whitening,
    "op13_word_bpe": op13_word_bpe,
}

SQL: dict[str, str] = {
    "op1_ngram_join": oracles.NGRAM_JOIN,
    "op2_embeddings": oracles.EMBEDDINGS,
    "op6_url_filter": oracles.url_filter(RULES),
    "op7_warc": oracles.WARC,
    "op8_mixing": oracles.mix(0.6, WEIGHTS, 2, 7, DOMAINS),
    "op11_filter_audit": oracles.FILTER_AUDIT,
}
