"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

toxicity -> near copies -> benchmark passages -> personal data -> packing. All but the last return the
columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, ngram_join, packing, pii, textops, toxicity


def _names(docs: DataFrame) -> list[str]:
    """The columns of docs, quoted: a name may hold a dot."""
    return [f"`{c}`" for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of all labelled ones does not call toxic; null and empty texts are judged as empty."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = textops.unused(docs, "score"), textops.unused(docs, "predicted")
    return toxicity.score(docs, model, into=(score, predicted)).where(F.col(predicted) == 0).drop(score, predicted)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by shingles of five words and a similarity of 0.8.

    Documents without words link with nothing and stay, as do those with a null doc_id; rows that repeat the
    doc_id that stays all stay.
    """
    groups = ngram_join.join(docs, width=5, percent=80)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(_names(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered by tiles to 0.6 or more."""
    matches = textops.unused(docs, "matches")
    return decontaminate.tile(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=matches).where(F.size(matches) == 0).drop(matches)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced by their kinds, and n_chars anew."""
    spans = textops.unused(docs, "pii"), textops.unused(docs, "terms")
    return pii.sanitise(pii.detect(docs, into=spans), columns=spans).withColumn("n_chars", F.length("text").cast("long")).select(_names(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens with their ids, sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: No stage but the first filter can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    home, docs = textops.shared_dir(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = textops.stored(docs, f"{home}/{k}_{name}")
    return docs
