"""The corpus pipeline: good documents, one of each group of near copies, no secrets, mixed to weights, encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs. All stages but the last return the columns of documents.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from docketlens.llm.bpe import encode_texts
from docketlens.llm.common import shared_folder
from docketlens.llm.mixing import take
from docketlens.llm.ngram_join import keep_one
from docketlens.llm.quality_rules import keep_good
from docketlens.llm.secrets import redact

#: The stages need more than SQL can say (trees, decoding, Newton's method, a tokenizer).
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines of their host go from the others."""
    return keep_good(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return keep_one(docs, words=5, percent=75)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return take(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each text; the tokenizer file is one that every executor has."""
    import public_tokenizers

    return encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_join", ngram_join),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each result written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{number}_{name}")
        docs = spark.read.parquet(path)
    return docs
