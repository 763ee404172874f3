"""Out-of-sample predictions by expanding walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.history import calendar_bounded
from barloom.operators.features import CLOSE, FEATURE_COLUMNS
from barloom.operators.models import LogisticRegression, Model, kind_of, predicts_values, rows_needed
from barloom.operators.splits import PLAN_COLUMNS, Splitter, out_of_sample, short_histories, walk_forward_folds, with_plan
from barloom.operators.targets import TARGET_HORIZON, make_dataset
from barloom.session import kept, shared_dir

#: Pooled fits that are under way at the same time, and training rows for each of a fit's tasks: at
#: most the first number, and at least the second where cores would stand idle.
FITS_AT_ONCE, ROWS_PER_TASK, LEAST_ROWS = 8, 50_000, 2_000


def by_history(rows: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Spread histories over ``spark.sql.shuffle.partitions`` tasks, for learned models.

    Windows and fits by ``keys`` reuse this partitioning, so it replaces their
    shuffle. A fixed number of partitions is not merged at run time: merging
    looks at bytes, and a fit takes long for few bytes.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys)


def walk_forward_scores(
    dataset: DataFrame, model: Model, splitter: Splitter, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """One row per test date: ``fold``, ``proba_up``, ``prediction``, ``close`` and the label ``y``.

    The close rides along so that a backtest needs no join with the bars. History
    models get each history once and walk its folds inside the task, so training
    rows are shuffled once, not once per fold. A history that a model cannot be
    fitted to gives no rows; :func:`unfit_histories` tells which and why. Models
    of values have no ``proba_up``: their ``prediction`` is the predicted target.
    """
    if kind_of(model) == "pooled":
        return _pooled_scores(dataset, model, splitter, keys)
    if kind_of(model) == "moments":
        return _moment_scores(dataset, model, splitter, keys)
    planned = with_plan(dataset, splitter, keys)
    if kind_of(model) == "rule":
        return out_of_sample(planned).select(
            *keys,
            "date",
            CLOSE,
            "fold",
            model.probability().alias("proba_up"),
            model.label().alias("prediction"),
            "y",
        )
    if not calendar_bounded(planned):
        raise ValueError("history models need daily bars: an intraday history is not bounded by the calendar; use a pooled model")
    needed = rows_needed(model)
    values = predicts_values(model)
    out, fit = ("prediction", model.fit_predict) if values else ("proba_up", model.fit_score)
    rows = planned.select(*keys, "date", CLOSE, "pos", *PLAN_COLUMNS, *FEATURE_COLUMNS, "y")
    schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [
            T.StructField("date", rows.schema["date"].dataType),
            T.StructField(CLOSE, T.DoubleType()),
            T.StructField("fold", T.IntegerType()),
            T.StructField(out, T.DoubleType()),
            T.StructField("y", T.DoubleType()),
        ]
    )
    names = schema.fieldNames()

    def score_history(history: pd.DataFrame) -> pd.DataFrame:
        history = history.sort_values("date", kind="stable")
        pos, y = history["pos"].to_numpy(), history["y"].to_numpy(dtype=float)
        x = history[FEATURE_COLUMNS].to_numpy(dtype=float)
        folds, first, size, gap = (int(history[c].iloc[0]) for c in PLAN_COLUMNS)
        parts = []
        for fold in range(folds):
            end = first + fold * size
            train = (pos < end) & ~np.isnan(y)
            test = (pos >= end + gap) & (pos < end + gap + size)
            if min(np.count_nonzero(y[train] == c) for c in (0.0, 1.0)) < needed:
                return pd.DataFrame(columns=names)
            if test.any():
                part = history.loc[test, [*keys, "date", CLOSE, "y"]].copy()
                part["fold"] = fold
                part[out] = fit(x[train], y[train], x[test])
                parts.append(part)
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)

    scored = rows.groupBy(*keys).applyInPandas(score_history, schema)
    if values:
        return scored.select(*keys, "date", CLOSE, "fold", "prediction", "y")
    return scored.withColumn("prediction", (F.col("proba_up") > 0.5).cast("int")).select(
        *keys, "date", CLOSE, "fold", "proba_up", "prediction", "y"
    )


def logistic_fits(dataset: DataFrame, model: LogisticRegression, splitter: Splitter, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``(keys, fold, n, centre, spread, weights, intercept)``: what each fold's fit learned.

    ``weights`` belong to the standardised features; histories that cannot be
    fitted give no rows.
    """
    planned = with_plan(dataset, splitter, keys)
    rows = planned.select(*keys, "date", "pos", *PLAN_COLUMNS, *FEATURE_COLUMNS, "y")
    arrays = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("centre", "spread", "weights")]
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("fold", T.IntegerType()), T.StructField("n", T.LongType()), *arrays, T.StructField("intercept", T.DoubleType())])
    names, needed = schema.fieldNames(), rows_needed(model)

    def fit_history(history: pd.DataFrame) -> pd.DataFrame:
        history = history.sort_values("date", kind="stable")
        pos, y = history["pos"].to_numpy(), history["y"].to_numpy(dtype=float)
        x = history[FEATURE_COLUMNS].to_numpy(dtype=float)
        folds, first, size, _ = (int(history[c].iloc[0]) for c in PLAN_COLUMNS)
        out = []
        for fold in range(folds):
            train = (pos < first + fold * size) & ~np.isnan(y)
            if min(np.count_nonzero(y[train] == c) for c in (0.0, 1.0)) < needed:
                return pd.DataFrame(columns=names)
            centre, spread, weights, intercept = model.fit(x[train], y[train])
            out.append((*(history[k].iloc[0] for k in keys), fold, int(train.sum()), centre.tolist(), spread.tolist(), weights.tolist(), intercept))
        return pd.DataFrame(out, columns=names)

    return rows.groupBy(*keys).applyInPandas(fit_history, schema)


def calibration_report(dataset: DataFrame, model, splitter: Splitter, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``(keys, fold, part, n_held, ups_held, total, test_mean, rising)``: the inner fits of a calibrated model.

    ``total`` is the sum of a part's calibrated values over its own rows, which
    is fixed by their labels if the curve is the optimum; ``test_mean`` the mean
    of its values on the fold's test rows, whose mean over the parts is the score's.
    """
    planned = with_plan(dataset, splitter, keys)
    rows = planned.select(*keys, "date", "pos", *PLAN_COLUMNS, *FEATURE_COLUMNS, "y")
    schema = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL("fold int, part int, n_held bigint, ups_held bigint, total double, test_mean double, rising boolean").fields])
    names, needed = schema.fieldNames(), rows_needed(model)

    def report_history(history: pd.DataFrame) -> pd.DataFrame:
        history = history.sort_values("date", kind="stable")
        pos, y = history["pos"].to_numpy(), history["y"].to_numpy(dtype=float)
        x = history[FEATURE_COLUMNS].to_numpy(dtype=float)
        folds, first, size, gap = (int(history[c].iloc[0]) for c in PLAN_COLUMNS)
        out = []
        for fold in range(folds):
            end = first + fold * size
            train, test = (pos < end) & ~np.isnan(y), (pos >= end + gap) & (pos < end + gap + size)
            if min(np.count_nonzero(y[train] == c) for c in (0.0, 1.0)) < needed or not test.any():
                return pd.DataFrame(columns=names)
            own = tuple(history[k].iloc[0] for k in keys)
            out += [(*own, fold, part, *found) for part, found in enumerate(model.inner_report(x[train], y[train], x[test]))]
        return pd.DataFrame(out, columns=names)

    return rows.groupBy(*keys).applyInPandas(report_history, schema)


def steepest_descent(dataset: DataFrame, fits: DataFrame, splitter: Splitter, c: float = 1.0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``(keys, fold, gradient)``: the largest slope of the penalised loss at each fit.

    Computed from the training rows and the reported weights alone, so it tells
    whether a fit is the optimum, whatever solver made it.
    """
    on = [*keys, "fold"]
    train = walk_forward_folds(dataset, splitter, keys).filter("role = 'train'").select(*keys, "date", "fold")
    rows = train.join(dataset.select(*keys, "date", *FEATURE_COLUMNS, "y"), [*keys, "date"]).join(fits, on)
    scaled = F.zip_with(F.zip_with(F.array(*FEATURE_COLUMNS), "centre", lambda x, m: x - m), "spread", lambda x, d: x / d)
    margin = F.aggregate(F.zip_with("z", "weights", lambda z, w: z * w), F.col("intercept"), lambda total, x: total + x)
    placed = rows.select(*on, scaled.alias("z"), "weights", "intercept", "y").select(*on, (1 / (1 + F.exp(-margin)) - F.col("y")).alias("error"), "weights", F.array_append("z", F.lit(1.0)).alias("z"))
    each = placed.select(*on, "error", "weights", F.posexplode("z").alias("i", "z"))
    # the intercept comes last and is not penalised
    pull = F.coalesce(F.get(F.first("weights"), F.col("i")), F.lit(0.0)) / c
    slopes = each.groupBy(*on, "i").agg(F.abs(F.sum(F.col("error") * F.col("z")) + pull).alias("slope"))
    return slopes.groupBy(*on).agg(F.max("slope").alias("gradient"))


def unfit_histories(dataset: DataFrame, model: Model, splitter: Splitter, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``(keys, n, reason)`` of the histories that give no scores.

    ``n`` counts labelled rows, or the rows of the rarer class in the first
    training part. Later parts contain the first, so what suffices there
    suffices in all. With a pooled model folds are cut on the dates of the pool:
    its histories have no scores if the pool has too few dates or a fold with too
    few rows of a class (``n`` is that number), or if they have no row on a test
    date (``n`` is 0).
    """
    if kind_of(model) == "pooled":
        return _unfit_in_pools(dataset, model, splitter, keys)
    short = short_histories(dataset, splitter, keys).withColumn("reason", F.lit("too few rows"))
    needed = rows_needed(model)
    if not needed:
        return short
    first = F.col("pos") < F.col("first_train")
    classes = [F.count_if(first & (F.col("y") == c)).alias(f"n{c}") for c in (0, 1)]
    rare = F.least("n0", "n1")
    counted = with_plan(dataset, splitter, keys).groupBy(*keys).agg(*classes).filter(rare < needed)
    reason = F.when(rare == 0, "one class").otherwise("too few rows of a class")
    return short.unionByName(counted.select(*keys, rare.alias("n"), reason.alias("reason")))


# --- models of moments ------------------------------------------------------------


def moment_fits(dataset: DataFrame, model: Model, splitter: Splitter, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``(keys, fold, n, weights)`` of a moment model, the intercept as last weight.

    The training rows are cut at the ends of the folds' training parts. One
    aggregate gives the sums of products of every slice, running sums over the
    slices those of every fold, and each fold is one small system of equations:
    no row is read twice or fitted again, however many folds there are.
    """
    planned = with_plan(dataset, splitter, keys).filter("y IS NOT NULL")
    after = F.floor((F.col("pos") - F.col("first_train")) / F.col("test_size")) + 1
    slices = planned.withColumn("fold", F.when(F.col("pos") < F.col("first_train"), 0).otherwise(after).cast("int")).filter("fold < folds")
    columns = [*(F.col(f"`{c}`") for c in model.columns), F.lit(1.0)]
    size = len(columns)
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(columns[i] * columns[j]).alias(f"_p{k}") for k, (i, j) in enumerate(upper)] + [F.sum(c * F.col("y")).alias(f"_q{k}") for k, c in enumerate(columns)]
    names = [f"_p{k}" for k in range(len(upper))] + [f"_q{k}" for k in range(size)]
    sliced = slices.groupBy(*keys, "fold").agg(F.count("*").alias("n"), F.max("folds").alias("folds"), *sums)
    so_far = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    running = sliced.select(*keys, "fold", F.sum("n").over(so_far).alias("n"), F.array(*(F.sum(c).over(so_far) for c in names)).alias("sums"))
    schema = T.StructType([*(running.schema[k] for k in keys), T.StructField("fold", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def solve(frames):
        for frame in frames:
            weights = []
            for n, flat in zip(frame["n"], frame["sums"]):
                flat = np.asarray(flat, float)
                products = np.zeros((size, size))
                for (i, j), x in zip(upper, flat):
                    products[i, j] = products[j, i] = x
                weights.append(np.asarray(model.solve(int(n), products, flat[len(upper) :]), float).tolist())
            yield frame[[*keys, "fold", "n"]].assign(weights=weights)

    return running.mapInPandas(solve, schema)


def _moment_scores(dataset: DataFrame, model: Model, splitter: Splitter, keys: Sequence[str]) -> DataFrame:
    rows = kept(dataset.select(*keys, "date", CLOSE, *model.columns, "y"), "moment-rows")
    fits = moment_fits(rows, model, splitter, keys).drop("n")
    tests = out_of_sample(with_plan(rows, splitter, keys)).select(*keys, "date", CLOSE, "fold", *model.columns, "y")
    row = F.array(*(F.col(f"`{c}`") for c in model.columns), F.lit(1.0))
    dot = F.aggregate(F.zip_with(row, "weights", lambda x, w: x * w), F.lit(0.0), lambda total, x: total + x)
    return tests.join(fits, [*keys, "fold"]).select(*keys, "date", CLOSE, "fold", dot.alias("prediction"), "y")


# --- pooled models ----------------------------------------------------------------


def _pool_plan(rows: DataFrame, splitter: Splitter, keys: Sequence[str]) -> DataFrame:
    """One row per pool and fold: test dates, last training date, class counts and a fingerprint of the training rows.

    Folds are cut by date: the dates on which any symbol has a labelled row
    are planned as one history per pool (the keys without the symbol), so no
    fit sees a row that is later than its training part. A date's rows are
    counted once; the folds add up dates.
    """
    axis = [*(k for k in keys if k != "symbol"), "_pool"]
    mark = F.when(F.col("y").isNotNull(), F.xxhash64("symbol", "date", *FEATURE_COLUMNS, "y"))
    counts = [F.count_if(F.col("y") == c).alias(f"n{c}") for c in (0, 1)]
    dates = rows.withColumn("_pool", F.lit(0)).groupBy(*axis, "date").agg(F.max("y").alias("y"), F.count("y").alias("n"), *counts, F.bit_xor(mark).alias("mark"))
    planned = with_plan(dates.withColumnRenamed("n", "rows"), splitter, axis)
    tests = out_of_sample(planned).groupBy(*axis, "fold").agg(F.min("date").alias("begin"), F.max("date").alias("end"))
    cut = F.col("first_train") + F.col("fold") * F.col("test_size")
    folds = planned.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("folds") - 1)))
    added = [F.sum(c).alias(c) for c in ("rows", "n0", "n1")]
    trained = folds.filter((F.col("pos") < cut) & F.col("y").isNotNull()).groupBy(*axis, "fold").agg(F.max("date").alias("until"), *added, F.bit_xor("mark").alias("mark"))
    return tests.join(trained, [*axis, "fold"]).drop("_pool")


def training_scores(dataset: DataFrame, model: Model, splitter: Splitter, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """What each fold's fit of a pooled model gives for the rows it was fitted to; columns as of the test scores."""
    return _pooled_scores(dataset, model, splitter, keys, on_training=True)


def _pooled_scores(dataset: DataFrame, model: Model, splitter: Splitter, keys: Sequence[str], on_training: bool = False) -> DataFrame:
    """Scores of one MLlib fit per fold over all symbols.

    The number of fits is the number of pools times folds; folds of different
    pools that train on the same rows share one fit. Each fit's thread scores its
    own test rows and writes them, so neither models nor a union over folds is in
    the caller's plan. A fold whose training part has too few rows of a class
    ends its pool, as it would a history; :func:`unfit_histories` lists it.
    """
    pool = [k for k in keys if k != "symbol"]
    rows = kept(dataset.select(*keys, "date", CLOSE, *FEATURE_COLUMNS, "y"), "pooled-rows", by=pool)
    jobs = _pool_plan(rows, splitter, keys).orderBy(*pool, "fold").collect()
    needed, values = rows_needed(model), predicts_values(model)
    ended = {tuple(j[k] for k in pool) for j in jobs if min(j.n0, j.n1) < needed}
    shared: dict[tuple, list] = {}
    for job in jobs:
        if tuple(job[k] for k in pool) not in ended:
            shared.setdefault((job.mark, job.rows, job.n0, job.n1), []).append(job)
    out = ["prediction"] if values else ["proba_up", "prediction"]
    schema = T.StructType([*(rows.schema[k] for k in keys), rows.schema["date"], rows.schema[CLOSE], *T.StructType.fromDDL("fold int, " + ("prediction double" if values else "proba_up double, prediction int")).fields, rows.schema["y"]])
    folder = shared_dir(rows.sparkSession, "fold-scores")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    each = max(1, cores // max(1, min(FITS_AT_ONCE, len(shared))))
    data = rows.withColumn("features", array_to_vector(F.array(*FEATURE_COLUMNS)))
    # the learner need not read the labels to know their number
    label = F.col("y").cast("double") if values else F.col("y").cast("double").alias("label", metadata={"ml_attr": {"type": "nominal", "name": "label", "vals": ["0.0", "1.0"]}})

    def within(job):
        here = F.lit(True)
        for k in pool:
            here = here & F.col(k).eqNullSafe(F.lit(job[k]))
        return here

    def fit_and_score(numbered):
        number, same = numbered
        first = same[0]
        train = data.filter(within(first) & (F.col("date") <= first.until) & F.col("y").isNotNull()).select("symbol", "date", "features", label.alias("label") if values else label)
        tasks = max(-(-first.rows // ROWS_PER_TASK), min(each, -(-first.rows // LEAST_ROWS)))
        dealt = train.repartition(tasks, "symbol", "date").sortWithinPartitions("symbol", "date")
        made = model.estimator(first.rows).fit(dealt)
        for i, job in enumerate(same):
            wanted = (F.col("date") <= job.until) & F.col("y").isNotNull() if on_training else F.col("date").between(job.begin, job.end)
            test = data.filter(within(job) & wanted).withColumn("fold", F.lit(job.fold))
            scored = made.transform(test)
            if not values:
                scored = scored.withColumn("proba_up", vector_to_array("probability")[1]).withColumn("prediction", (F.col("proba_up") > 0.5).cast("int"))
            scored.select(*keys, "date", CLOSE, "fold", *out, "y").coalesce(tasks).write.parquet(f"{folder}/fit={number}/{i}")

    with ThreadPoolExecutor(FITS_AT_ONCE) as workers:
        list(workers.map(fit_and_score, enumerate(shared.values())))
    if not shared:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def _unfit_in_pools(dataset: DataFrame, model: Model, splitter: Splitter, keys: Sequence[str]) -> DataFrame:
    pool = [k for k in keys if k != "symbol"]
    rows = kept(dataset.select(*keys, "date", *FEATURE_COLUMNS, "y"), "pooled-rows")
    plan = _pool_plan(rows, splitter, keys)
    rare = F.least("n0", "n1")
    # of each pool: the dates of its tests, and its first fold with too few rows of a class
    found = plan.groupBy(*pool).agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min(F.when(rare < rows_needed(model), F.struct("fold", rare.alias("rare")))).alias("short"))
    sized = rows.groupBy(*keys).agg(F.count("y").alias("labelled"))
    placed = sized.join(found, pool, "left") if pool else sized.join(F.broadcast(found))
    tested = rows.join(found, pool) if pool else rows.join(F.broadcast(found))
    tested = tested.filter(F.col("date").between(F.col("begin"), F.col("end"))).groupBy(*keys).agg(F.count("*").alias("tested"))
    reason = (
        F.when(F.col("begin").isNull(), F.struct(F.col("labelled").alias("n"), F.lit("too few rows in its pool").alias("reason")))
        .when(F.col("short").isNotNull(), F.struct(F.col("short.rare").alias("n"), F.concat(F.when(F.col("short.rare") == 0, "one class").otherwise("too few rows of a class"), F.lit(" in fold "), F.col("short.fold").cast("string"), F.lit(" of its pool")).alias("reason")))
        .when(F.col("tested").isNull(), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit("no row on a test date").alias("reason")))
    )
    listed = placed.join(tested, list(keys), "left").withColumn("why", reason).filter("why IS NOT NULL")
    return listed.select(*keys, "why.n", "why.reason")


def _embargoed(splitter: Splitter, target: str) -> Splitter:
    return replace(splitter, gap=max(splitter.gap, TARGET_HORIZON[target]))


def _dataset(bars: DataFrame, model: Model, target: str, keys: Sequence[str], score_neutral: bool) -> DataFrame:
    if kind_of(model) != "rule":
        if target == "return" and not predicts_values(model):
            raise ValueError("the model classifies: use a direction or threshold target, or a model of values")
        if kind_of(model) == "history":
            bars = by_history(bars.select(*keys, "date", CLOSE), keys)
    return make_dataset(bars, target, keys, keep_unlabelled=score_neutral)


def run_walk_forward(
    bars: DataFrame,
    model: Model,
    splitter: Splitter,
    target: str = "direction",
    keys: Sequence[str] = ("symbol",),
    score_neutral: bool = False,
    embargo: bool = False,
) -> DataFrame:
    """Class predictions ``(keys, date, close, fold, prediction)`` for every test date.

    ``score_neutral`` also predicts the rows whose target is NULL (with the
    ``threshold`` target: days whose future move turns out small). By default
    they are left out of the test rows as well. ``embargo`` widens the gap to
    the rows the target looks ahead, so no training label reaches the test block.
    Models of values predict the target itself, such as the next return.
    """
    splitter = _embargoed(splitter, target) if embargo else splitter
    dataset = _dataset(bars, model, target, keys, score_neutral)
    return walk_forward_scores(dataset, model, splitter, keys).select(*keys, "date", CLOSE, "fold", "prediction")


def run_walk_forward_proba(
    bars: DataFrame,
    model: Model,
    splitter: Splitter,
    target: str = "direction",
    keys: Sequence[str] = ("symbol",),
    score_neutral: bool = False,
    embargo: bool = False,
) -> DataFrame:
    """P(up) as ``(keys, date, close, fold, proba_up)`` for every test date."""
    if predicts_values(model):
        raise ValueError("the model predicts values, not P(up)")
    splitter = _embargoed(splitter, target) if embargo else splitter
    dataset = _dataset(bars, model, target, keys, score_neutral)
    return walk_forward_scores(dataset, model, splitter, keys).select(*keys, "date", CLOSE, "fold", "proba_up")


def threshold_signal(scores: DataFrame, cut: float = 0.50) -> DataFrame:
    """``prediction`` = 1 where ``proba_up`` is strictly above ``cut``."""
    return scores.withColumn("prediction", (F.col("proba_up") > cut).cast("int"))


def long_share(scores: DataFrame, cut: float = 0.50, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Percentage of days with a long signal."""
    share = F.avg((F.col("proba_up") > cut).cast("double")) * 100.0
    return scores.groupBy(*keys).agg(share.alias("long_pct"))
