"""The corpus pipeline: documents -> toxicity -> near duplicates -> repeated passages -> mixing -> packing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.mixing import mix_sources
from quarrylight.llm.ngram_join import ngram_jaccard_join
from quarrylight.llm.ordering import fresh
from quarrylight.llm.packing import pack_documents
from quarrylight.llm.substring_dedup import remove_repeats
from quarrylight.llm.toxicity import fit, score_toxicity

#: Not expressible: compression lengths and packing have no SQL.
ORACLE_SQL: str | None = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It is trained on the labelled documents of the folder.

    Null, empty and wordless texts stay, and so does all where labels of either
    class are missing.  Rows without id and repeated rows are judged as any
    other.  Very long texts are scored whole.  An empty table gives an empty
    one; extra columns stay.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where("not toxic").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class connected by n-gram Jaccard links the document with the least id stays.

    Rows without id, text or words stay, and repeated rows of an id that stays.
    Very long texts are compared whole.  An empty table gives an empty one;
    extra columns stay.
    """
    classes = ngram_jaccard_join(docs, n=3, threshold=0.5)
    (i,) = fresh(docs, "n_id")
    gone = classes.where("class_id < doc_id").select(F.col("doc_id").alias(i))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(i), "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur before are cut; a document that had nothing else goes.

    n_chars of a document that loses words is new.  Rows without id, text or
    words stay as they are; equal rows of one id all stay.  Very long texts are
    searched whole.  An empty table gives an empty one; extra columns stay.
    """
    return remove_repeats(docs, least=50)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get shares by the square root of their size.

    A document may come several times, as equal rows, or not at all.  Null and
    empty sources are one source; a null text counts no characters; rows
    without id come first in the order.  An empty table gives an empty one;
    extra columns stay.
    """
    return mix_sources(docs, alpha=0.5, epochs=1.0, seed=7).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens.

    Null, empty and wordless texts are in no window; rows without id come first
    with a null id; repeated rows are packed each.  Texts longer than a window
    go over several.  An empty table gives no window; extra columns are not
    read.
    """
    return pack_documents(docs, capacity=2048)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; between stages documents are written as Parquet and read again.

    They go to the shared folder of spark.checkpoint.dir, or where none is set,
    as in local tests, to a temporary folder.  What each stage does with nulls,
    repeated rows and long texts is said there; an empty table gives no window.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="pipeline-")
    base = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
