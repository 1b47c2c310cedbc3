"""Ranking and finalization of root-cause candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import RootCauseConfig

NO_CAUSE, LOW, CONFIDENT = "no_confident_root_cause", "low_confidence", "confident"


def rank_hypotheses(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Rank the candidates of each incident by combined confidence, then title.

    Candidates: incident_id, title, confidence, temporal_score,
    dependency_score (null where nobody rated them). ``scores`` hold the
    package's own temporal_score and dependency_score.
    """
    own = scores.select(
        "incident_id", F.col("temporal_score").alias("_t"), F.col("dependency_score").alias("_d")
    )
    df = candidates.join(own, "incident_id", "left").fillna(0.0, ["_t", "_d"])

    def merged(rated: str, package: str) -> Column:
        return F.coalesce(F.round((F.col(rated) + F.col(package)) / 2, 4), F.col(package))

    df = df.withColumns({"temporal_score": merged("temporal_score", "_t"), "dependency_score": merged("dependency_score", "_d")})
    combined = F.round(0.5 * F.col("confidence") + 0.25 * F.col("temporal_score") + 0.25 * F.col("dependency_score"), 4)
    w = Window.partitionBy("incident_id").orderBy(F.desc("combined"), "title")
    return df.withColumn("combined", combined).withColumn("rank", F.row_number().over(w)).drop("_t", "_d")


def sufficient(packages: DataFrame, cfg: RootCauseConfig = RootCauseConfig()) -> DataFrame:
    """Incidents whose package has enough quality (``score``) and any signal (``signals``)."""
    return packages.filter((F.coalesce("score", F.lit(0)) >= cfg.min_quality) & (F.coalesce("signals", F.lit(0)) > 0))


def finalize(ranked: DataFrame, quality: DataFrame, cfg: RootCauseConfig = RootCauseConfig()) -> DataFrame:
    """Result per incident from its ranked candidates.

    ``ranked`` may carry ``claimed_status``, the status asked for by whoever
    proposed the candidates. Candidates per incident are a short list.
    """
    if "claimed_status" not in ranked.columns:
        ranked = ranked.withColumn("claimed_status", F.lit(CONFIDENT))
    top = F.col("rank") == 1
    agg = ranked.groupBy("incident_id").agg(
        F.max(F.when(top, F.col("title"))).alias("_title"),
        F.max(F.when(top, F.col("combined"))).alias("_combined"),
        F.max(F.when(top, F.col("claimed_status"))).alias("_claimed"),
        F.array_sort(F.collect_list(F.when(~top, F.struct("rank", "title")))).alias("_rest"),
    )
    df = agg.join(quality.select("incident_id", F.col("score").alias("evidence_quality")), "incident_id", "left")
    poor = (F.coalesce("evidence_quality", F.lit(0)) < cfg.min_quality) | (F.col("_combined") < cfg.min_confidence)
    status = (
        F.when(poor, NO_CAUSE)
        .when((F.col("_combined") < cfg.confident) | (F.col("_claimed") == NO_CAUSE), LOW)
        .otherwise(F.col("_claimed"))
    )
    return df.select(
        "incident_id",
        status.alias("status"),
        F.when(~poor, F.col("_title")).alias("primary_title"),
        F.when(poor, 0.0).otherwise(F.col("_combined")).alias("confidence"),
        F.col("_rest.title").alias("alternatives"),
        F.coalesce("evidence_quality", F.lit(0)).alias("evidence_quality"),
    )
