"""Sampling experiment: geographic features on a training frame, undersampling, one model and many, recall and intervals.

All (fraction, seed) models of a group are learned in the same jobs from one stored frame. Samples are hash thresholds:
those of one seed lie inside one another as the fraction grows, and no sample is ever copied. Scores of each finished
group are stored under the run's path, so a run that was cut short goes on with the groups that are missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.functions.hashing import uniform
from tidemark.operators import boosting, geo, metrics, models, sampling, stats
from tidemark.session import durable, scratch_path

GROUP = 30  # models that are learned together


def attach_geography(df: DataFrame, keys: Sequence[str], radii: Sequence[float] = (0.01, 0.03), sizes: Sequence[int] = geo.KMEANS_SIZES,
                     cluster_sizes: Sequence[int] = (), radius: float = 0.03, min_samples: int = 50,
                     population: DataFrame | None = None, cell: str = "last_order_h3_level_8") -> tuple[DataFrame, list[str]]:
    """Rows with coordinates, with cluster numbers, neighbour counts and (given a lookup) the population of their cell;

    and the names of the new columns.
    """
    out = durable(geo.kmeans_clusters(df, keys, sizes))
    names = [f"cluster_kmeans_{k}" for k in sizes]
    if cluster_sizes:
        out = durable(geo.density_clusters(out, keys[0], radius, min_samples, list(cluster_sizes)))
        names += [f"{c}_{n}" for n in cluster_sizes for c in ("cluster", "outlier_score")]
    out = geo.radius_density(out, radii)
    names += [f"density_count_radius_{r}" for r in radii]
    if population is not None:
        out = geo.cell_population(out, population, cell)
        names.append("h38_population")
    return durable(out), names


def _in_sample(target: str, keys: Sequence[str], fraction: float, seed: int) -> Column:
    return (F.col(target) == 1) | ((F.col(target) == 0) & (uniform(seed, *keys) < fraction))


def _stored(spark, path: str) -> DataFrame | None:
    """A table that was written to its end, or None."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def simulate_scores(df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str], params: models.TreeParams,
                    seeds: int = 30, fractions: Sequence[float] = (0.07,), path: str | None = None) -> DataFrame:
    """(fraction, seed, keys..., target, score) of all validation rows of every sample, stored.

    Samples differ by seed and fraction, the train/validation split is the same for all. With `path`, groups of models
    whose scores are there already are not learned again.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "simulation")
    vectors, _names = models.assemble(models.train_valid(df, keys, stratum=target), features, [*keys, target, "is_valid"])
    vectors = durable(vectors.withColumn(models.LABEL, F.col(target).cast("double")))
    runs = [(f, s) for f in fractions for s in range(seeds)]
    out = []
    for at in range(0, len(runs), GROUP):
        part, place = runs[at : at + GROUP], f"{path}/scores-{at // GROUP}"
        if _stored(spark, place) is None:
            role = F.when(F.col("is_valid"), boosting.STOPS).otherwise(boosting.TRAINS)
            fitted = models.boosted_trees(params).fit_many(vectors, [F.when(_in_sample(target, keys, f, s), role) for f, s in part])
            valid = vectors.filter("is_valid")
            found = [
                F.struct(F.lit(float(f)).alias("fraction"), F.lit(s).alias("seed"), _in_sample(target, keys, f, s).alias("there"), m.scores(spark, F.col(models.FEATURES)).alias("score"))
                for (f, s), m in zip(part, fitted, strict=True)
            ]
            rows = valid.select(*keys, target, F.explode(F.array(*found)).alias("run")).filter("run.there")
            rows.select("run.fraction", "run.seed", *keys, target, "run.score").write.mode("overwrite").parquet(place)
        out.append(place)
    return spark.read.parquet(*out)


def simulate_recall(df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str], params: models.TreeParams,
                    seeds: int = 30, fraction: float = 0.07, path: str | None = None) -> DataFrame:
    """Recall per seed."""
    scores = simulate_scores(df, keys, target, features, params, seeds, [fraction], path)
    return recall_by_run(scores, target).select("seed", "tp", "fn", "recall")


def recall_by_run(scores: DataFrame, target: str) -> DataFrame:
    """Confusion counts and rates of each (fraction, seed)."""
    return metrics.confusion_rates(scores, target, "score", ["fraction", "seed"])


def recall_interval(runs: DataFrame) -> DataFrame:
    """Mean recall over the seeds and its interval, for each fraction."""
    return stats.confidence_interval(runs, "recall", ["fraction"])


def cluster_recall(scored: DataFrame, frame: DataFrame, keys: Sequence[str], cluster: str, target: str, score: str) -> DataFrame:
    """Centre, mean score and recall of each geographic cluster: scored rows meet their place by key."""
    places = frame.select(*keys, "cust_lat", "cust_long", cluster)
    return metrics.cluster_evaluation(scored.select(*keys, target, score).join(places, list(keys)), cluster, target, score)


@dataclass(frozen=True)
class Experiment:
    """What a run of the experiment leaves behind."""

    frame: DataFrame  # rows with their geographic features
    scores: DataFrame  # validation scores of the single model
    quality: DataFrame  # its metrics, and those of the mean
    clusters: DataFrame
    runs: DataFrame  # confusion counts and rates by fraction and seed
    intervals: DataFrame


def run_experiment(df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str], params: models.TreeParams,
                   cluster: str = "cluster_kmeans_10", fraction: float = 0.07, seed: int = 2, seeds: int = 30,
                   fractions: Sequence[float] = (0.07,), path: str | None = None, **geography) -> Experiment:
    """From stage features to intervals: attach geography, undersample, fit, evaluate by cluster, simulate."""
    frame, names = attach_geography(df, keys, **geography)
    used = [*features, *names]
    sample = durable(sampling.undersample(frame, target, keys, fraction, seed))
    valid, _model, _names = models.fit_single(sample, keys, target, used, params, True, "score")
    valid = durable(valid.select(*keys, target, "score"))
    mean = durable(stats.with_baseline(sample, target, "preds_benchmark").select(target, "preds_benchmark"))
    quality = metrics.metrics_table({
        "model": metrics.binary_metrics(valid, target, "score"),
        "benchmark": metrics.binary_metrics(mean, target, "preds_benchmark"),
    })
    scores = simulate_scores(frame, keys, target, used, params, seeds, fractions, path)
    runs = durable(recall_by_run(scores, target))
    return Experiment(frame, valid, quality, cluster_recall(valid, frame, keys, cluster, target, "score"), runs, recall_interval(runs))
