"""Documents to training tokens: language, near-duplicates, personal data, mixture and byte-pair encoding.

Each stage takes and returns rows of ``documents``; the last gives token ids. ``run`` applies them in turn and
keeps every stage's rows as a Parquet table in the shared checkpoint folder, so that a lost executor costs no
more than a stage's own tasks and no stage computes its predecessors again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import bpe, langid, mixing, pii, simhash
from scholia.plans.lineage import dropped, written

#: A document's language must be so many times as probable as by chance; texts that mix languages share it among them, and stay.
LEAST_RATIO = 1.2
#: A text that fills a window goes if it is gibberish, letters in no language's order, with this probability.
GIBBERISH = 0.95
#: Texts are near copies from this Jaccard similarity of their sets of so many words in a row.
SHINGLE, SIMILARITY = 5, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, gibberish, and those whose language stays doubtful."""
    net = langid.fit(docs, reject=True)
    languages = sum(k != langid.UNKNOWN for k in net.labels)
    return langid.keep_identified(docs, net, least=min(0.9, LEAST_RATIO / max(1, languages)), gibberish=GIBBERISH)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates one document stays."""
    return simhash.drop_near_duplicates(docs, shingle=SHINGLE, threshold=SIMILARITY)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by the name of its kind."""
    masked = pii.mask(docs, pii.trained())
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the mixture draws them, in shuffled shards; those without words are left out."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text that they decode to."""
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixture", mix_sources),
    ("tokens", encode),
]

#: Trained networks and tokenizers can't be said in SQL; tests compare with plain forms instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            # Rows of the stage before have been read for the last time.
            if before is not None:
                dropped(before)
            before = docs
    return docs
