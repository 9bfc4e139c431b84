"""End-to-end flows made of the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from tasteloom.operators import als, fm, forest, tune
from tasteloom.operators.encode import dense_index, ordinal_encode
from tasteloom.operators.evaluate import abs_error_percentiles, require_passed, rmse, validation_gate
from tasteloom.operators.knn import knn
from tasteloom.operators.recommend import attach_dimension, decode_index, general_recommendation, item_dimension
from tasteloom.operators.split import feature_target_split, hash_split, leave_last_out, part
from tasteloom.session import write_once


@dataclass
class Recommendations:
    """Recommendation rows, the one-row metrics table of the run, and the most recommended items of
    each group where quotas were given."""
    rows: DataFrame
    metrics: DataFrame
    general: DataFrame | None = None


def check_gate(metrics: DataFrame, targets: DataFrame | None) -> None:
    """Raise when a metric of the run misses its target (metric, direction, base_value)."""
    if targets is None:
        return
    names = [f.name for f in metrics.schema.fields if isinstance(f.dataType, NumericType)]
    long = metrics.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("current_value"))
                                             for n in names])))
    require_passed(validation_gate(long, targets))


def als_recommend(rows: DataFrame, keys: Sequence[str], n: int = 10, user: str = "user_id",
                  item: str = "item_id", group: str = "grp", solver: str = "spark", quotas: Mapping[str, int] | None = None,
                  targets: DataFrame | None = None, asked: str | None = None, **settings) -> Recommendations:
    """Clean interactions -> user and item codes -> implicit ALS -> top-N -> labels and groups.

    Users and items may have any kind of key; both are coded for the training and decoded at the end.
    Duplicate (user, item) rows stay separate observations. With `quotas` the items recommended most
    often in each group are counted as well; with `targets` the metrics must pass the gate. `asked`, a
    condition on `id`, says for which user codes lists are made; all users train the model.
    """
    coded, ratings = coded_ratings(rows, keys, user, item)
    factors = als.train(part(ratings, "train"), solver, **settings)
    metrics = als.metrics_row(als.score(factors, part(ratings, "test")), n, **settings)
    check_gate(metrics, targets)
    return als_decode(als.top_n_blocked(factors, n, asked), coded, metrics, user, item, group, quotas)


def coded_ratings(rows: DataFrame, keys: Sequence[str], user: str, item: str) -> tuple[DataFrame, DataFrame]:
    """The rows with `user_code` and `item_code`, written once, and the split ratings made of them."""
    rows = write_once(rows, "als-input")
    coded = ordinal_encode(rows, item, dense_index(rows, item), "item_code")
    coded = write_once(ordinal_encode(coded, user, dense_index(rows, user), "user_code"), "als-ratings")
    extra = [k for k in keys if k not in ("user", "item", "q")]
    ratings = coded.select(F.col("user_code").cast("int").alias("user"), F.col("item_code").cast("int").alias("item"),
                           F.col("q").cast("float").alias("q"), *extra)
    return coded, hash_split(ratings, keys)


def als_decode(recs: DataFrame, coded: DataFrame, metrics: DataFrame, user: str, item: str, group: str,
               quotas: Mapping[str, int] | None = None) -> Recommendations:
    """Labels and groups in place of the codes of (user, item, rating, rank)."""
    dimension = write_once(item_dimension(coded, F.col("item_code").cast("int").alias("item"), F.col(item).alias("_item"),
                                          F.col(group).alias("_group")), "dimension")
    users = write_once(item_dimension(coded, F.col("user_code").cast("int").alias("user"), F.col(user).alias("_user")), "users")
    decoded = attach_dimension(recs, dimension, "item").join(users, "user").select(
        F.col("_user").alias(user), F.col("_item").alias(item), F.col("_group").alias(group), "rating", "rank")
    if not quotas:
        return Recommendations(decoded, metrics)
    decoded = write_once(decoded, "recommended")
    return Recommendations(decoded, metrics, general_recommendation(decoded, dict(quotas), group, item))


def als_tune(rows: DataFrame, keys: Sequence[str], n: int = 10, user: str = "user_id", item: str = "item_id",
             group: str = "grp", **grid) -> tuple[Recommendations, DataFrame]:
    """Grid search on the train rows; the refitted best model's lists and its one metrics row on the
    test rows, and the trials."""
    coded, ratings = coded_ratings(rows, keys, user, item)
    train = write_once(part(ratings, "train"), "als-train")
    factors, trials = als.grid_search(train, keys, **grid)
    best = tune.best_trial(trials, "minimize", "rmse").first()
    metrics = als.metrics_row(als.score(factors, part(ratings, "test")), n, best["rank"], best["max_iter"],
                              best["reg_param"], best["alpha"])
    return als_decode(als.top_n_blocked(factors, n), coded, metrics, user, item, group), trials


def fm_recommend(rows: DataFrame, order: Sequence[str], k: int = 10, metric: str = "ip",
                 solver: str = "alternating", user: str = "user_id", item: str = "item_id",
                 group: str = "grp", targets: DataFrame | None = None, asked: str | None = None,
                 **settings) -> Recommendations:
    """Clean interactions -> leave-last-out -> factors -> exact search -> labels and groups. `asked`, a
    condition on `id`, says for which user codes lists are made; all users train the model."""
    split = write_once(leave_last_out(rows, order, user), "fm-split")
    train, test = part(split, "train"), part(split, "test")
    model = fm.train_fm(train, solver=solver, user=user, item=item, **settings)
    metrics = fm.score(model, test, user=user, item=item)
    check_gate(metrics, targets)
    users, items = fm.latent_tables(model.user_factors, model.item_factors)
    queries = users.toDF("id", "vec")
    near = knn(queries if asked is None else queries.where(asked), items.toDF("id", "vec"), k, metric)
    flat = near.select(F.col("query_id").alias("row"), F.col("item_id").alias("label"), "distance", "rank")
    decoded = decode_index(flat, model.index.stacked, model.index.nb_users)
    labelled = decoded.withColumnsRenamed({"user_id": user, "item_id": item})
    dimension = write_once(item_dimension(split, F.col(item).cast("string").alias(item), group), "dimension")
    found = attach_dimension(labelled, dimension, item)
    return Recommendations(found.select(user, group, item, "distance", "rank"), metrics)


def fm_search(train: DataFrame, test: DataFrame, ranges: Mapping[str, tuple[float, float]],
              fixed: Mapping[str, object] | None = None, solver: str = "alternating", max_jobs: int = 6,
              max_parallel_jobs: int = 3, seed: int = 17, strategy: str = "random") -> DataFrame:
    """Trials of a factorization machine over ranges of hyperparameters, by hold-out RMSE. The rows are
    indexed and laid out once for all trials."""
    tune.check_ranges(ranges, fm.tunable(solver))  # before any job runs
    data = fm.prepare(train, solver)

    def trial(drawn: Mapping[str, float]) -> float:
        model = fm.train_fm(data, solver=solver, **fm.settings({**(fixed or {}), **drawn}, solver))
        return fm.score(model, test).first()["rmse"]
    return tune.range_search(train.sparkSession, trial, ranges, max_jobs, max_parallel_jobs, seed, fm.tunable(solver), strategy)


def forest_search(train: DataFrame, test: DataFrame, features: Sequence[str], ranges: Mapping[str, tuple[float, float]],
                  share: float = 0.5, max_jobs: int = 6, max_parallel_jobs: int = 3, seed: int = 17, **fixed) -> DataFrame:
    """Trials of a random forest over ranges, by a percentile of the absolute hold-out error."""
    names = {"n_estimators": "trees", "min_samples_leaf": "min_leaf"}
    data = forest.prepare(train, features)  # once for all trials

    def trial(drawn: Mapping[str, float]) -> float:
        model = forest.train_forest(data, features, **fixed, **{names[k]: v for k, v in drawn.items()})
        return abs_error_percentiles(forest.predict(model, test), "prediction", "target", [share]).first()["value"]
    return tune.range_search(train.sparkSession, trial, ranges, max_jobs, max_parallel_jobs, seed, names)


def knn_search(queries: DataFrame, items: DataFrame, truth: DataFrame, ranges: Mapping[str, tuple[float, float]],
               metric: str = "ip", max_jobs: int = 6, max_parallel_jobs: int = 3, seed: int = 17) -> DataFrame:
    """Trials of the neighbour search over `k` and `sample_size`, by the share of `truth` (query_id,
    item_id) that is found."""
    total = truth.count()

    def trial(drawn: Mapping[str, float]) -> float:
        found = knn(queries, items, int(drawn.get("k", 10)), metric,
                    sample_size=int(drawn["sample_size"]) if "sample_size" in drawn else None)
        return found.join(truth, ["query_id", "item_id"], "left_semi").count() / max(1, total)
    return tune.range_search(queries.sparkSession, trial, ranges, max_jobs, max_parallel_jobs, seed, ("k", "sample_size"))


def forest_regression(rows: DataFrame, features: Sequence[str], target: str, keys: Sequence[str],
                      shares: Sequence[float] = (0.1, 0.5, 0.9), **settings) -> Recommendations:
    """Split, train a forest, and report error percentiles and RMSE on the test rows."""
    split = write_once(feature_target_split(rows, target, keys), "forest-rows")
    model = forest.train_forest(part(split, "train"), features, **settings)
    scored = write_once(forest.predict(model, part(split, "test")), "forest-scored")
    errors = abs_error_percentiles(scored, "prediction", "target", shares)
    named = errors.select(F.concat(F.lit("abs_error_p"), F.round(F.col("share") * 100).cast("int").cast("string"))
                          .alias("metric"), "value")
    overall = rmse(scored, "prediction", "target").select(F.lit("rmse").alias("metric"), F.col("rmse").alias("value"))
    return Recommendations(scored, named.unionByName(overall))


def damped_means(train: DataFrame, dampings: Sequence[float], overall: float, item: str = "item_id",
                 value: str = "q") -> DataFrame:
    """(item, trial, reg, prediction): each item's mean value, drawn to the overall mean by `reg`
    rows. The sums are taken once for all dampings."""
    sums = train.groupBy(item).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    trials = F.array(*[F.struct(F.lit(n).alias("trial"), F.lit(float(d)).alias("reg")) for n, d in enumerate(dampings)])
    mean = (F.col("_sum") + F.col("reg") * F.lit(overall)) / (F.col("_n") + F.col("reg"))
    return sums.select(item, "_sum", "_n", F.inline(trials)).select(item, "trial", "reg", mean.alias("prediction"))
