"""From raw documents to token ids, in five stages.

Every stage takes (spark, documents, folder of the tables) and works on all that its predecessor kept; the result is
written as Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.llm import dart_minhash, exact_dedup, mixing, piece_transducer, quality_fm
from bandwise.llm.common import fresh, remainder, table
from bandwise.session import write_through


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It learns as in op1, from labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    machine = quality_fm.fit(docs, labels)
    (score,) = fresh(docs, "__score")
    scored = quality_fm.score(docs, machine, output=score)
    return scored.where(F.col(score) >= quality_fm.THRESHOLD).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return dart_minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt to domains, languages and sources by the root of their supply: a document of
    a small source comes twice, and of a large one those behind the cut go."""
    path = {"domain": mixing.domain(), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, path)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return piece_transducer.encode(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("pieces", pieces)]

#: Trained classifiers, dart signatures and transducers have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = write_through(docs, f"pipeline-{name}")
    return docs
