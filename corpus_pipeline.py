"""Training-corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last return the columns of the
documents they get, whatever other columns these have.

Odd rows, in every stage: an empty table gives an empty table; rows with null ids stay rows of their own, and null texts read as
empty texts (they stay null where a stage keeps texts); repeated rows are rows of their own, but for the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stmtflow.llm import mixing, ngram_join, packing, pii_spans, toxicity
from stmtflow.llm.catalog import TOKENIZER
from stmtflow.llm.common import id_remainder, table
from stmtflow.session import materialize, shared_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go.

    Empty and null texts score the rate of toxic labels among texts without telling words; without labels nothing goes.
    """
    learn = id_remainder("doc_id", 5) != 0
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), learn))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id (a null id only if there is no other).

    Equal texts are a group, also empty ones, and null and empty texts are equal; repeated rows leave one.
    """
    return ngram_join.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; null texts stay null, and ``n_chars`` follows the text."""
    return pii_spans.redact(docs, pii_spans.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from not at all to twice.

    Documents without words weigh nothing and are not taken; a null source is a source of its own.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; a document without text is its end token alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# SQL expresses none of the fitted stages; tests/llm hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stage results are Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), shared_path(spark, "pipeline", name, unique=True))
    return STAGES[-1][1](spark, docs, sf_dir)
