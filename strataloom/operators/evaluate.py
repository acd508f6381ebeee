"""Evaluation of answers: metadata of questions, grouped means, best and worst, offline retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import METRICS


def known(metric: str) -> Column:
    """A metric with NaN as null."""
    return F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))


def with_metadata(results: DataFrame, golden: DataFrame) -> DataFrame:
    """Results (user_input, ...) with question_type and difficulty; the last golden row of a question by ``ord`` counts, others are Unknown."""
    last = golden.groupBy("question").agg(F.max_by(F.struct("question_type", "difficulty"), "ord").alias("g"))
    met = results.join(last, results["user_input"] == last["question"], "left")
    return met.withColumns({"question_type": F.coalesce("g.question_type", F.lit("Unknown")), "difficulty": F.coalesce("g.difficulty", F.lit("Unknown"))}).drop("g", "question")


def grouped_means(results: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """(grouping, value, n, means): over all rows, by question type and by difficulty, in one pass."""
    rows = results.select("question_type", "difficulty", *(known(m).alias(m) for m in metrics))
    keys = [F.col("question_type"), F.col("difficulty")]
    sets = rows.groupingSets([[], [keys[0]], [keys[1]]], *keys).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "question_type").otherwise("difficulty")
    return sets.select(kind.alias("grouping"), F.when(F.col("g") == 1, F.col("question_type")).when(F.col("g") == 2, F.col("difficulty")).otherwise("").alias("value"), "n", *metrics)


def best_and_worst(results: DataFrame, metric: str = "faithfulness") -> DataFrame:
    """(which, user_input, score): the rows of the highest and lowest value; ties by the question, NaN last."""
    rows = results.select("user_input", known(metric).alias("m")).where("m IS NOT NULL")
    one = rows.agg(F.max(F.struct(F.col("m"), F.col("user_input"))).alias("hi"), F.min(F.struct(F.col("m"), F.col("user_input"))).alias("lo"))
    both = F.array(F.struct(F.lit("best").alias("which"), F.col("hi.user_input").alias("user_input"), F.col("hi.m").alias("score")), F.struct(F.lit("worst").alias("which"), F.col("lo.user_input").alias("user_input"), F.col("lo.m").alias("score")))
    return one.where("hi IS NOT NULL").select(F.explode(both).alias("x")).select("x.*")


def retrieval_scores(retrieved: DataFrame, required: DataFrame) -> DataFrame:
    """(question_id, n_required, n_retrieved, n_hit, recall, precision) from pairs (question_id, chunk_id): offline stand-ins, not model-judged scores."""
    need, got = required.distinct(), retrieved.select("question_id", "chunk_id").distinct()
    sides = need.withColumn("need", F.lit(1)).join(got.withColumn("got", F.lit(1)), ["question_id", "chunk_id"], "full")
    sums = sides.groupBy("question_id").agg(F.count("need").alias("n_required"), F.count("got").alias("n_retrieved"), F.count_if(F.col("need").isNotNull() & F.col("got").isNotNull()).alias("n_hit"))
    share = lambda n: F.when(F.col(n) > 0, F.round(F.col("n_hit") / F.col(n), 6))
    return sums.withColumns({"recall": share("n_required"), "precision": share("n_retrieved")})


def funnel(**stages: DataFrame) -> DataFrame:
    """(stage, n): how many rows each stage has."""
    out = None
    for name, rows in stages.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.union(one)
    return out
