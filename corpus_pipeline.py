"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next one.

Low-quality documents go, toxic ones go, one document of each group of near copies stays, personal data is
replaced by its kind, and what is left is packed into sequences. The first four stages return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import jaccard, packing, pii, quality, toxicity
from sievework.llm.tables import Scratch, sized, unused
from sievework.shipping import ship


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are more likely good than low, by their text and their site. Null texts are empty ones; repeated rows are judged alike."""
    ship(spark)
    made = tuple(unused(docs.columns, "evidence", "prior", "p_low", "keep"))
    return quality.judge(docs, _labels(spark, sf_dir), made=made).where(F.col(made[3])).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a toxicity score under one half. Null texts are empty ones; repeated rows are judged alike."""
    ship(spark)
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    made = unused(docs.columns, "score", "predicted")
    return toxicity.score(docs, model, score_col=made[0], predicted_col=made[1]).where(F.col(made[1]) == 0).select(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each component of texts linked by five-word shingles at 0.8.

    Of rows with one id one stays; rows without an id stay. Texts don't move while the ids that go, or the
    repeated ones, are few enough for a broadcast.
    """
    ship(spark)
    scratch = Scratch(spark, "near")
    joined = scratch.keep(jaccard.join(docs, n=5, percent=80).select("doc_id", "component_id"))
    goes = scratch.keep(joined.where("component_id <> doc_id").select("doc_id").distinct())
    again = scratch.keep(joined.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = docs.join(sized(goes), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    once = sized(again)
    return kept.join(once, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(once, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; the number of characters follows. Null texts stay null, and no row goes."""
    ship(spark)
    rows = pii.redact(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else rows


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences: a row for each piece. Null texts are empty ones, whose one token is packed."""
    ship(spark)
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("personal data", personal_data_stage),
    ("best-fit packing", packing_stage),
]

#: Classifiers, a tokenizer and a genetic algorithm can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, "stage")
    return docs
