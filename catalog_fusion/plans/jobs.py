"""The batch jobs, for ``spark-submit``: merge, train, predict, recommend.

    spark-submit --py-files catalog_fusion.zip catalog_fusion/plans/jobs.py merge raw/ --output titles
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_fusion.functions.parse import parse_release_moment
from catalog_fusion.functions.requests import TOP_N, parse_json_requests, window_error
from catalog_fusion.plans.fuse import load_merged, merge_sources
from catalog_fusion.plans.rating_model import RatingModel, TREE_ROUNDS
from catalog_fusion.scratch import job_scratch, materialize
from catalog_fusion.sources.scan import Source, discover
from catalog_fusion.sources.sink import write_report


def merge(spark: SparkSession, inputs: Sequence[str], output: str) -> DataFrame:
    """Merge tables, or all tables below the given folders; returns the report."""
    sources = []
    for path in inputs:
        # A folder of tables is searched; a single table is found as itself.
        sources += discover(spark, path) or [Source(path)]
    return merge_sources(spark, sources, output).as_frame(spark)


def train(spark: SparkSession, titles: str, model: str, rounds: int = TREE_ROUNDS) -> DataFrame:
    """Train on a merged table, save the model and its report; returns the report."""
    with job_scratch(spark):
        fitted = RatingModel.fit(load_merged(spark, titles), rounds=rounds)
        fitted.save(model)
        report = fitted.report_frame(spark)
        write_report(report, f"{model}.metrics")
    return report


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines requests with defaults filled in, valid or not.

    Without a release hour, the time in the release date counts.
    """
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = parse_json_requests(lines.withColumnRenamed("value", "body"))
    moment = parse_release_moment(F.col("release_date"))
    stated = F.get_json_object("body", "$.release_hour").isNotNull()
    return parsed.withColumns(
        {
            "release_hour": F.when(stated, F.col("release_hour")).otherwise(
                F.coalesce(F.hour(moment), F.col("release_hour"))
            ),
            "release_date": F.coalesce(F.date_format(moment, "yyyy-MM-dd"), F.col("release_date")),
        }
    )


def predict(spark: SparkSession, model: str, requests: str, output: str) -> DataFrame:
    """Score every valid request; rejected ones are kept beside, with the reason."""
    parsed = read_requests(spark, requests)
    parsed.filter(F.col("reject_reason").isNotNull()).write.mode("overwrite").json(f"{output}.rejected")
    valid = parsed.filter(F.col("reject_reason").isNull()).drop("body", "reject_reason")
    with job_scratch(spark):
        scored = RatingModel.load(spark, model).predict_requests(valid)
        scored.withColumn("predicted_rating", F.round("predicted_rating", 3)).write.mode("overwrite").parquet(output)
    return spark.read.parquet(output)


def judge_windows(parsed: DataFrame) -> DataFrame:
    """Parsed requests, those without a usable window rejected as well."""
    return parsed.withColumn("reject_reason", F.coalesce(F.col("reject_reason"), window_error()))


def recommend(spark: SparkSession, model: str, requests: str, output: str, top_n: int | None = None) -> DataFrame:
    """The best slots of every valid request, by its own ``top_n`` unless one is given."""
    judged = judge_windows(read_requests(spark, requests))
    judged.filter(F.col("reject_reason").isNotNull()).write.mode("overwrite").json(f"{output}.rejected")
    valid = judged.filter(F.col("reject_reason").isNull()).drop("body", "reject_reason")
    with job_scratch(spark):
        # Written once, so that a recomputed task cannot number its requests anew.
        valid = materialize(valid.withColumn("request_id", F.monotonically_increasing_id()), "requests")
        limit = F.col("top_n") if top_n is None else top_n
        slots = RatingModel.load(spark, model).recommend(valid, top_n=limit)
        slots.write.mode("overwrite").parquet(output)
    return spark.read.parquet(output)


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    job = jobs.add_parser("merge")
    job.add_argument("inputs", nargs="+")
    job.add_argument("--output", required=True)
    job = jobs.add_parser("train")
    job.add_argument("titles")
    job.add_argument("--model", required=True)
    job.add_argument("--rounds", type=int, default=TREE_ROUNDS)
    for name in ("predict", "recommend"):
        job = jobs.add_parser(name)
        job.add_argument("requests", help="JSON lines")
        job.add_argument("--model", required=True)
        job.add_argument("--output", required=True)
        if name == "recommend":
            job.add_argument("--top-n", type=int, help=f"default: as each request says, else {TOP_N}")
    given = vars(parser.parse_args(arguments))
    run = {"merge": merge, "train": train, "predict": predict, "recommend": recommend}[given.pop("job")]
    run(SparkSession.builder.getOrCreate(), **given).show(truncate=False)


if __name__ == "__main__":
    main()
