"""Relevance: nDCG, recall, precision and MRR against judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("ndcg", "recall", "mrr", "precision")


def evaluate(results: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """One row a judged query: query_id, ndcg, recall, precision (all at k), mrr (of the whole list).

    results: (query_id, citation, rank from 1); judgments: (query_id, citation,
    grade), relevant above 0.  A query without results scores 0; results of
    unjudged queries don't count.
    """
    gain = lambda g: F.pow(F.lit(2.0), g) - 1.0
    discount = lambda r: F.log2(r.cast("double") + 1.0)
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "citation")
    ideal = judgments.withColumn("r", F.row_number().over(best)).groupBy("query_id").agg(F.sum(F.when(F.col("r") <= k, gain(F.col("grade")) / discount(F.col("r"))).otherwise(0.0)).alias("idcg"), F.count(F.when(F.col("grade") > 0, 1)).alias("relevant"))
    found = results.join(judgments.where("grade > 0"), ["query_id", "citation"]).groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain(F.col("grade")) / discount(F.col("rank"))).otherwise(0.0)).alias("dcg"), F.count(F.when(F.col("rank") <= k, 1)).alias("hits"), F.min("rank").alias("first")
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(0.0)
    return ideal.join(found, "query_id", "left").select("query_id", ratio("dcg", "idcg").alias("ndcg"), ratio("hits", "relevant").alias("recall"), (F.coalesce("hits", F.lit(0)) / k).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.avg(m).alias(m) for m in METRICS])


def regressions(current: dict[str, float], baseline: dict[str, float], tolerance: float = 0.02) -> list[str]:
    """The metrics that fell by more than the tolerance."""
    return [m for m in METRICS if current[m] + tolerance < baseline[m]]


def golden_run(engine, cases: list[dict], k: int = 5, caller=None) -> tuple[dict[str, float], DataFrame]:
    """(mean metrics, metrics by query) of an engine on cases {"query": text, "relevant": {citation: grade}}.

    Keyword searches; a case's number is its query_id.  Golden sets are small:
    their queries run one by one.
    """
    from ..plans.request import Caller, SearchRequest

    found, judged = [], []
    for i, case in enumerate(cases):
        hits = engine.search(SearchRequest(query=case["query"], mode="keyword", top_k=max(k, 10)), caller or Caller())
        found += [(i, r["citation_id"], n) for n, r in enumerate(hits.select("citation_id").collect(), 1)]
        judged += [(i, c, float(g)) for c, g in case["relevant"].items()]
    spark = engine.chunks.sparkSession
    per_query = evaluate(spark.createDataFrame(found, "query_id long, citation string, rank int"), spark.createDataFrame(judged, "query_id long, citation string, grade double"), k)
    return mean_metrics(per_query).first().asDict(), per_query
