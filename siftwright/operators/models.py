"""Can the label be predicted at all? Out-of-fold scores, shuffled-label nulls, importance.

Fits are Spark ML jobs over the whole matrix. Driver threads only submit independent fits, so
folds, draws and models overlap on the executors. Scores are tables, written once and reused.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize, settle
from .evaluate import score_metrics
from .features import fill_with_indicator, null_columns, one_hot
from .forest_effects import binned_rows, shapley_sums, swapped_scores
from .integrity import union_all
from .many_fits import fit_many, held_out_scores
from .many_trees import Growth, forest_blocks, forest_scores, forest_trees
from .ordering import add_position
from .profile import row_count


# ------------------------------------------------------------------ splits and shuffles
def _shuffle_hash(seed: Column | int | str, key: str) -> Column:
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", s.cast("string"), F.col(key).cast("string")))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, *, by: Sequence[str] = (), name: str = "fold") -> DataFrame:
    """Fold number 0..k-1 per row, dealt in hash order within each label; the same in any engine.

    ``by`` deals separately inside further groups, such as the draws of a permutation test.
    """
    hashed = df.withColumn("__h", _shuffle_hash(seed, key))
    placed = add_position(hashed, ["__h", key], [*by, label], name="__pos")
    return placed.withColumn(name, ((F.col("__pos") - 1) % k).cast("int")).drop("__h", "__pos")


def permute_labels(df: DataFrame, key: str, label: str, draws: int) -> DataFrame:
    """Shuffled labels in long form: (draw, key, label), every draw with the true class counts.

    Keys are put in hash order; the first rows take the first class and so on, which deals every
    arrangement of the labels with equal chance.
    """
    df = materialize(df.select(key, label), "true-labels")
    classes = df.groupBy(label).agg(row_count().alias("n")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("v"), "n"))).alias("c"))
    ends = classes.select(F.transform("c", lambda x, i: F.struct(
        x.getField("v").alias("v"),
        F.aggregate(F.slice("c", 1, i + 1), F.lit(0).cast("bigint"), lambda a, y: a + y.getField("n")).alias("end"),
    ))).scalar()
    keyed = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    placed = add_position(keyed.withColumn("__h", _shuffle_hash(F.col("draw"), key)), ["__h", key], ["draw"], name="__pos")
    dealt = placed.withColumn("__ends", ends)
    at = F.get(F.filter("__ends", lambda e: F.col("__pos") <= e.getField("end")), F.lit(0)).getField("v")
    return dealt.select("draw", key, at.alias(label))


def base_rate_scores(folded: DataFrame, key: str, label: str, fold: str = "fold") -> DataFrame:
    """The no-skill model: every row gets the label mean of the other folds."""
    per = folded.groupBy(fold).agg(F.sum(label).alias("y"), F.count(label).alias("n"))
    total = folded.agg(F.struct(F.sum(label).alias("y"), F.count(label).alias("n"))).scalar()
    outside = per.select(fold, F.try_divide(total.getField("y") - F.col("y"), total.getField("n") - F.col("n")).alias("score"))
    # one row per fold
    return folded.select(key, label, fold).join(F.broadcast(outside), fold)


# ------------------------------------------------------------------ design matrix and estimators
@dataclass(frozen=True)
class Matrix:
    """Assembled features with their names; ``data`` holds key, label, the columns and ``features``."""

    data: DataFrame
    key: str
    label: str
    names: list[str] = field(default_factory=list)


def design_matrix(df: DataFrame, key: str, label: str, numeric: Sequence[str], categorical: Mapping[str, Sequence[str]] | None = None) -> Matrix:
    """One-hot categories (first one dropped), gap indicators, medians in the gaps, one vector.

    ``categorical`` maps a column to its levels. Medians are those of all rows; a column without any value has none and
    is 0 beside its indicator. Scaling is part of the estimators and is fitted inside folds.
    """
    categorical = dict(categorical or {})
    wide = df.select(key, label, *numeric, *categorical)
    gaps = null_columns(wide, numeric) if numeric else []
    wide = fill_with_indicator(wide, list(numeric), gaps)
    wide = wide.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in gaps})
    names = [*numeric, *[f"{c}_nobase" for c in gaps]]
    for c, values in categorical.items():
        wide = one_hot(wide, c, values)
        names += [f"{c}_{v}" for v in sorted(values)[1:]]
    wide = wide.drop(*categorical)
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(wide)
    return Matrix(assembled.select(key, label, *names, "features"), key, label, names)


def logistic(rows: float, *, c: float = 1.0, weight: str | None = None, tol: float = 1e-6) -> Estimator:
    """L2 logistic regression on standardised features; the penalty matches inverse strength ``c``.

    ``rows`` is the number of training rows (or their total weight); ``tol`` ends the fit.
    """
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    lr = LogisticRegression(
        featuresCol="scaled", labelCol="label", regParam=1.0 / (c * max(rows, 1.0)), elasticNetParam=0.0,
        standardization=False, maxIter=200, tol=tol)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[scaler, lr])


def forest(trees: int = 500, *, min_leaf: int = 5, depth: int = 15, seed: int = 42) -> Estimator:
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, minInstancesPerNode=min_leaf, maxDepth=depth,
        featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=1024)


def boosting(rounds: int = 100, *, step: float = 0.1, depth: int = 5, seed: int = 42) -> Estimator:
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, stepSize=step, maxDepth=depth, seed=seed)


def balanced_weight(df: DataFrame, label: str) -> Column:
    """Weight n / (2 * rows of the class), so both classes count the same."""
    s = df.agg(F.struct(row_count().alias("n"), F.count_if(F.col(label) == 1).alias("p"))).scalar()
    n, p = s.getField("n"), s.getField("p")
    return F.when(F.col(label) == 1, F.try_divide(n, 2 * p)).otherwise(F.try_divide(n, 2 * (n - p)))


def cost_weight(label: str, loss: float = 5.0, offer: float = 1.0) -> Column:
    """Positives weigh the loss, negatives the offer."""
    return F.when(F.col(label) == 1, F.lit(float(loss))).otherwise(F.lit(float(offer)))


def logistic_parameters(matrix: Matrix, *, c: float = 1.0, weight: Callable[[DataFrame], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """A fit over all rows as a stored table (parameter, center, scale, coefficient), and the rows it was fitted on.

    Coefficients act on (x - center) / scale; the intercept's row has center 0 and scale 1. The
    rows carry ``label``, ``w`` and the columns named in ``matrix.names``.
    """
    rows = matrix.data.withColumn("label", F.col(matrix.label))
    rows = materialize(rows.withColumn("w", weight(rows) if weight else F.lit(1.0)), "fit-rows")
    total = rows.agg(F.sum("w")).first()[0] or 0.0
    scaler, lr = logistic(float(total), c=c, weight="w", tol=1e-12).fit(rows).stages
    found = [(n, float(m), float(s), float(b)) for n, m, s, b in zip(matrix.names, scaler.mean, scaler.std, lr.coefficients)]
    schema = "parameter string, center double, scale double, coefficient double"
    table = rows.sparkSession.createDataFrame([*found, ("intercept", 0.0, 1.0, float(lr.intercept))], schema)
    return materialize(table, "coefficients"), rows


def logistic_gradient(rows: DataFrame, coefficients: DataFrame, *, c: float = 1.0) -> DataFrame:
    """Gradient of the penalised log-likelihood at stored ``coefficients``, per unit of weight: zero in each row at the optimum.

    One aggregate over ``rows`` (label, w and a column for each parameter but the intercept), with
    no part of the fit in it. ``calibration`` is the weighted mean score, which at the optimum is
    the weighted share of positives. A feature without spread has no term.
    """
    stored = coefficients.collect()
    slopes = [r for r in stored if r["parameter"] != "intercept"]
    start = next(r["coefficient"] for r in stored if r["parameter"] == "intercept")
    scaled = {r["parameter"]: (F.col(r["parameter"]).cast("double") - r["center"]) / r["scale"] if r["scale"] > 0 else F.lit(0.0) for r in slopes}
    score = F.lit(start)
    for r in slopes:
        score = score + scaled[r["parameter"]] * r["coefficient"]
    left = rows.select("w", "label", (1 / (1 + F.exp(-score))).alias("p"), *[x.alias(f"z_{n}") for n, x in scaled.items()])
    pull = F.col("w") * (F.col("label") - F.col("p"))
    sums = left.agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("p")).alias("scored"), F.sum(pull).alias("intercept"),
                    *[F.sum(pull * F.col(f"z_{n}")).alias(f"g_{n}") for n in scaled])
    parts = [F.struct(F.lit("intercept").alias("parameter"), F.col("intercept").alias("g"))]
    parts += [F.struct(F.lit(r["parameter"]).alias("parameter"), (F.col(f"g_{r['parameter']}") - r["coefficient"] / c).alias("g")) for r in slopes]
    return sums.select("total", "scored", F.explode(F.array(*parts)).alias("r")).select(
        "r.parameter", F.try_divide("r.g", "total").alias("gradient"), F.try_divide("scored", "total").alias("calibration"))


def positive_probability(model: Model, rows: DataFrame, *keep: str) -> DataFrame:
    scored = model.transform(rows)
    return scored.select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def _parallel(spark, fn: Callable, items: Sequence, threads: int) -> list:
    run = inheritable_thread_target(spark)(fn)
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(items) or 1))) as pool:
        return list(pool.map(run, items))


def _fold_table(data: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """The folded matrix, written once and cached: fits neither repeat its lineage nor its shuffles.

    Read back, its partitions follow the data's size instead of the shuffle width, which is what
    the many small passes of an iterative fit pay for.
    """
    return settle(lambda: stratified_folds(data, key, "label", k, seed), "folds").persist(StorageLevel.MEMORY_AND_DISK)


# ------------------------------------------------------------------ out-of-fold scores
def _forests(rows: DataFrame, key: str, k: int, estimator: RandomForestClassifier) -> tuple[DataFrame, DataFrame, Growth]:
    """Blocks of the rows (key, label, fold, array ``x``) and the trees of all folds, grown together and stored, not held by the driver."""
    blocks, growth = forest_blocks(
        rows, key, k, trees=estimator.getNumTrees(), depth=estimator.getMaxDepth(), min_leaf=estimator.getMinInstancesPerNode(), seed=estimator.getSeed())
    blocks = materialize(blocks, "forest-blocks")
    return blocks, materialize(forest_trees(blocks, growth, packed=True), "forest-trees"), growth


def _forest_scores(data: DataFrame, key: str, k: int, estimator: RandomForestClassifier) -> DataFrame:
    """Held-out scores of the estimator's forest for all folds, stored; blocks and trees are removed."""
    rows = data.select(key, F.col("label").cast("int").alias("label"), "fold", vector_to_array("features").alias("x"))
    return settle(lambda: forest_scores(*_forests(rows, key, k, estimator), key), "forest-scores")


def _plain_logistic(estimator: Estimator) -> bool:
    """Whether this is :func:`logistic` without weights."""
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else []
    return [type(s) for s in stages] == [StandardScaler, LogisticRegression] and not stages[1].isSet("weightCol")


def _logistic_scores(data: DataFrame, key: str, k: int, c: float) -> DataFrame:
    """Held-out scores of :func:`logistic` for all folds, fitted together by Newton steps until no slope is left.

    Spark's own fit stops when the loss hardly falls, which for a few rows with a large standardised value is far from the
    optimum; and its probability is 1 less the other, so that a margin below -37 scores exactly 0.
    """
    rows = data.select(key, "label", "fold", "features", vector_to_array("features").alias("x")).withColumns({
        "ys": F.array(F.col("label").cast("int")), "fs": F.array("fold")})
    fits = fit_many(rows, 1, k, c=c, own_rows=True)
    found = [fits.raw(0, f) for f in range(k)]

    def of_fold(values: Sequence) -> Column:
        return F.get(F.array(*values), F.col("fold"))

    slopes = of_fold([F.array(*[F.lit(float(v)) for v in slope]) for _, slope in found])
    start = of_fold([F.lit(float(v)) for v, _ in found])
    margin = start + F.aggregate(F.zip_with("x", slopes, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.select(key, "label", "fold", (1 / (1 + F.exp(-margin))).alias("score"))


def oof_scores(
    matrix: Matrix,
    estimators: Mapping[str, Callable[[float], Estimator]],
    *,
    k: int = 5,
    seed: int = 42,
    weights: Mapping[str, Callable[[DataFrame], Column]] | None = None,
    weighted: Mapping[str, str] | None = None,
    threads: int = 4,
) -> DataFrame:
    """Every row scored by models that never saw it: (model, key, label, fold, score).

    ``estimators`` maps a name to a function of the training weight: the number of training rows,
    or for models named in ``weighted`` the sum of that weight column over them. ``weights``
    makes weight columns from the training rows of each fold. The matrix is cached during the
    fits and the scores are written once. Forests, and logistic models without weights, are fitted for all folds together.
    """
    spark = matrix.data.sparkSession
    data = matrix.data.withColumnsRenamed({matrix.label: "label"}) if matrix.label != "label" else matrix.data
    data = _fold_table(data, matrix.key, k, seed)
    try:
        def one(task: tuple[str, int]) -> DataFrame:
            name, f = task
            train = data.where(F.col("fold") != f)
            train = train.withColumns({c: make(train) for c, make in (weights or {}).items()})
            of = (weighted or {}).get(name)
            total = train.agg(F.sum(of) if of else row_count()).first()[0] or 0.0
            model = estimators[name](float(total)).fit(train)
            held = data.where(F.col("fold") == f)
            scored = positive_probability(model, held, matrix.key, "label", "fold")
            return scored.select(F.lit(name).alias("model"), matrix.key, "label", "fold", "score")

        made = {name: make(1.0) for name, make in estimators.items() if name not in (weighted or {})}
        together = {}
        for name, e in made.items():
            if isinstance(e, RandomForestClassifier):
                together[name] = _forest_scores(data, matrix.key, k, e)
            elif _plain_logistic(e):
                together[name] = _logistic_scores(data, matrix.key, k, 1.0 / e.getStages()[1].getRegParam())
        tasks = [(name, f) for name in estimators if name not in together for f in range(k)]
        parts = _parallel(spark, one, tasks, threads)
        kind = data.schema["label"].dataType
        parts += [scored.select(F.lit(name).alias("model"), matrix.key, F.col("label").cast(kind), "fold", "score") for name, scored in together.items()]
        return materialize(union_all(parts), "oof")
    finally:
        data.unpersist()


def model_comparison(scores: DataFrame) -> DataFrame:
    """Pooled metrics of every model and whether it is the best by AUC (the no-skill model cannot be)."""
    m = score_metrics(scores, "score", "label", ["model"])
    best = m.where(F.col("model") != "no-skill").agg(F.max_by("model", F.struct("roc_auc", "model"))).scalar()
    return m.withColumn("best", F.col("model") == best)


def fold_comparison(scores: DataFrame) -> DataFrame:
    """Mean and sd of the AUC over folds per model; not comparable with the pooled AUC."""
    per = score_metrics(scores, "score", "label", ["model", "fold"])
    return per.groupBy("model").agg(
        F.avg("roc_auc").alias("fold_mean_auc"), F.stddev_pop("roc_auc").alias("fold_sd_auc"), row_count().alias("folds"))


def label_null(matrix: Matrix, *, draws: int = 20, k: int = 5, seed: int = 42) -> DataFrame:
    """AUC of a logistic model on shuffled labels, one row per draw; the null's model is named.

    Folds are dealt per draw within the shuffled labels, as for the true ones. The fits of all
    draws and folds share their passes over the rows.
    """
    scores = null_scores(matrix, draws=draws, k=k, seed=seed)
    return score_metrics(scores, "score", "label", ["draw"]).select(
        "draw", F.lit("logistic").alias("null_model"), "roc_auc")


def null_rows(matrix: Matrix, *, draws: int, k: int, seed: int) -> DataFrame:
    """Stored rows of the matrix with a shuffled label and a fold for every draw: (key, features, x, ys, fs)."""
    shuffled = permute_labels(matrix.data.select(matrix.key, matrix.label), matrix.key, matrix.label, draws)
    folded = stratified_folds(shuffled, matrix.key, matrix.label, k, seed, by=["draw"])

    def per_draw(c: str) -> Column:
        return F.array(*[F.max(F.when(F.col("draw") == d, F.col(c))).cast("int") for d in range(draws)])

    wide = folded.groupBy(matrix.key).agg(per_draw(matrix.label).alias("ys"), per_draw("fold").alias("fs"))
    rows = matrix.data.select(matrix.key, "features", vector_to_array("features").alias("x"))
    return materialize(rows.join(wide, matrix.key), "null-matrix")


def null_scores(matrix: Matrix, *, draws: int, k: int, seed: int) -> DataFrame:
    """Held-out scores under shuffled labels: (draw, label, score)."""
    rows = null_rows(matrix, draws=draws, k=k, seed=seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return materialize(held_out_scores(rows, fit_many(rows, draws, k), draws), "null-scores")
    finally:
        rows.unpersist()


def label_signal(matrix: Matrix, estimators: Mapping[str, Callable[[float], Estimator]], *, draws: int = 20, k: int = 5, seed: int = 42, threads: int = 4) -> DataFrame:
    """The whole test as one call: pooled and per-fold AUC of every model against the shuffled-label band."""
    scores = oof_scores(matrix, estimators, k=k, seed=seed, threads=threads)
    null = materialize(label_null(matrix, draws=draws, k=k, seed=seed), "null-auc")
    band = null.agg(F.struct(
        F.min("roc_auc").alias("lo"), F.max("roc_auc").alias("hi"), row_count().alias("n"),
        F.array_sort(F.collect_list("roc_auc")).alias("draws"))).scalar()
    table = model_comparison(scores).join(fold_comparison(scores), "model")
    out = table.withColumn("__draws", band.getField("draws"))
    beaten = F.size(F.filter("__draws", lambda a: a >= F.col("roc_auc")))
    return out.select(
        "model", "n", "positives", F.col("roc_auc").alias("pooled_auc"), "fold_mean_auc", "fold_sd_auc", "average_precision",
        "brier", "best", F.lit("logistic").alias("null_model"), band.getField("lo").alias("null_min"),
        band.getField("hi").alias("null_max"), (beaten / band.getField("n")).alias("share_ge_model"),
        ((beaten + 1) / (band.getField("n") + 1)).alias("p_adjusted"),
        # the chance of a false signal stays at or below 1 in 20; fewer than 19 draws can show none
        ((beaten + 1) / (band.getField("n") + 1) <= 0.05).alias("signal"))


# ------------------------------------------------------------------ importance
def _donors(rows: DataFrame, key: str, repeats: int, seed: int, by: Sequence[str] = (), own: Sequence[str] = ()) -> DataFrame:
    """A random one-to-one pairing of rows per repeat, inside the groups of ``by``: (rep, key, donor vector ``z``) with the columns ``by`` and ``own`` of the row."""
    by = list(by)
    reps = rows.select(*by, key, "x", *[c for c in own if c != "x"], F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    a = reps.withColumn("__h", _shuffle_hash(F.concat(F.lit(f"{seed}a"), F.col("rep").cast("string")), key)).select(*by, key, *own, "rep", "__h")
    b = reps.withColumn("__h", _shuffle_hash(F.concat(F.lit(f"{seed}b"), F.col("rep").cast("string")), key)).select(*by, key, "x", "rep", "__h")
    left = add_position(a, ["__h", key], [*by, "rep"], name="__pos").select(*by, "rep", key, *own, "__pos")
    right = add_position(b, ["__h", key], [*by, "rep"], name="__pos").select(*by, "rep", "__pos", F.col("x").alias("z"))
    return left.join(right, [*by, "rep", "__pos"]).drop("__pos")


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """Over all cores before every row is multiplied by the features; its few bytes would else share a task. ``by`` keeps rows together."""
    spark = rows.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(width, *by)


def permutation_importance(model: Model, held: DataFrame, key: str, names: Sequence[str], *, repeats: int = 5, seed: int = 42) -> DataFrame:
    """AUC lost on held-out rows when one feature takes another row's value.

    All features and repeats are scored in one pass over rows x features x repeats.
    """
    rows = materialize(held.select(key, "label", vector_to_array("features").alias("x")), "importance-rows")
    paired = _spread(rows.join(_donors(rows.select(key, "x"), key, repeats, seed), key))
    d = len(names)
    each = paired.select("rep", "label", "x", "z", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("j"))
    mixed = F.transform("x", lambda v, i: F.when(i == F.col("j"), F.get("z", i)).otherwise(v))
    scored = positive_probability(model, each.select("rep", "j", "label", array_to_vector(mixed).alias("features")), "rep", "j", "label")
    plain = positive_probability(model, rows.select("label", array_to_vector("x").alias("features")), "label")
    base = score_metrics(plain, "score", "label").select("roc_auc").scalar()
    drops = score_metrics(scored, "score", "label", ["j", "rep"]).select("j", (base - F.col("roc_auc")).alias("drop"))
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("j"))
    return drops.groupBy("j").agg(F.avg("drop").alias("perm_importance"), F.stddev_pop("drop").alias("sd")).select(
        name.alias("feature"), "perm_importance", "sd").orderBy(F.desc("perm_importance"), "feature")


def cross_importance(matrix: Matrix, estimator: Callable[[float], Estimator], *, k: int = 5, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Permutation importance averaged over folds, so that every row is held out exactly once. The forests of all folds are grown and scored together."""
    data = _fold_table(matrix.data.withColumnRenamed(matrix.label, "label"), matrix.key, k, seed)
    try:
        n = data.count()
        made = estimator(n * (k - 1) / k)
        if isinstance(made, RandomForestClassifier):
            return _over_folds(settle(lambda: _forest_importance(data, matrix.key, matrix.names, k, made, repeats, seed), "importance"))

        def one(f: int) -> DataFrame:
            model = (estimator(n * (k - 1) / k) if f else made).fit(data.where(F.col("fold") != f))
            held = data.where(F.col("fold") == f)
            return materialize(permutation_importance(model, held, matrix.key, matrix.names, repeats=repeats, seed=seed), "importance")

        # one model at a time: a forest's trees grow with the rows, and the driver holds them until its fold is stored
        parts = union_all([one(f) for f in range(k)])
    finally:
        data.unpersist()
    return _over_folds(parts)


def _over_folds(parts: DataFrame) -> DataFrame:
    return parts.groupBy("feature").agg(
        F.avg("perm_importance").alias("perm_importance"), F.stddev_pop("perm_importance").alias("fold_sd"))


def _given_label(label: str) -> Column:
    """The label as a number; a row without one is an error, as in Spark's own fits."""
    return F.coalesce(F.col(label).cast("int"), F.raise_error("Labels MUST NOT be Null or NaN").cast("int")).alias("label")


def _forest_importance(data: DataFrame, key: str, names: Sequence[str], k: int, estimator: RandomForestClassifier, repeats: int, seed: int) -> DataFrame:
    """:func:`permutation_importance` in every fold, by the forest that did not see it: (fold, feature, perm_importance)."""
    rows = data.select(key, _given_label("label"), "fold", vector_to_array("features").alias("x"))
    _, trees, growth = _forests(rows, key, k, estimator)
    binned = materialize(binned_rows(rows, growth), "importance-rows")
    scored = swapped_scores(_donors(binned, key, repeats, seed, ["fold"], ["label", "x"]), trees, growth)
    auc = materialize(score_metrics(scored, "score", "label", ["fold", "j", "rep"]).select("fold", "j", "rep", "roc_auc"), "importance-auc")
    base = auc.where("j < 0").select("fold", F.col("roc_auc").alias("base"))
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("j"))
    return auc.where("j >= 0").join(base, "fold").groupBy("fold", name.alias("feature")).agg(F.avg(F.col("base") - F.col("roc_auc")).alias("perm_importance"))


def sampled_shapley(model: Model, rows: DataFrame, key: str, names: Sequence[str], *, repeats: int = 4, seed: int = 42) -> DataFrame:
    """Mean absolute Shapley contribution per feature for any model, by sampled feature orders.

    Each repeat walks from another row's values to the row's own, one feature at a time in hash
    order; a feature's contribution is the change of the score at its step. The contributions of
    one walk add up to the difference of the two scores exactly.
    """
    vectors = materialize(rows.select(key, vector_to_array("features").alias("x")), "shapley-rows")
    d = len(names)
    # by key, so that all steps of a row are scored and added up where the row is
    paired = _spread(vectors.join(_donors(vectors, key, repeats, seed), key), key)
    order = F.array_sort(F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda i: F.struct(F.xxhash64(F.lit(seed), F.col("rep"), F.col(key), i).alias("h"), i.alias("i"))))
    walk = paired.withColumn("order", F.transform(order, lambda s: s.getField("i")))
    walk = walk.withColumn("rank", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.array_position("order", i)))
    steps = walk.select(key, "x", "z", "rank", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("s"))
    # own values for the first s features of the order, the donor's for the rest
    mixed = F.transform("x", lambda v, i: F.when(F.get("rank", i) <= F.col("s"), v).otherwise(F.get("z", i)))
    scored = positive_probability(model, steps.select(key, "s", "rank", array_to_vector(mixed).alias("features")), key, "s", "rank")

    def gained(j: int) -> Column:
        """What the score gains where feature j takes its own value: the score of that step less the one before."""
        at = F.get("rank", F.lit(j))
        return F.sum(F.when(at == F.col("s"), F.col("score")).when(at == F.col("s") + 1, -F.col("score")).otherwise(0.0)) / repeats

    per_row = scored.groupBy(key).agg(*[gained(j).alias(f"c{j}") for j in range(d)])
    means = per_row.agg(*[F.avg(F.abs(f"c{j}")).alias(f"c{j}") for j in range(d)])
    # one row, kept for the shares: the scores are made once
    stored = materialize(means, "shapley-means")
    return _shares(stored.select(F.inline(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"c{j}").alias("mean_abs")) for j in range(d)]))), names)


def _shares(per: DataFrame, names: Sequence[str]) -> DataFrame:
    total = per.agg(F.sum("mean_abs")).scalar()
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("j"))
    return per.select(name.alias("feature"), "mean_abs", F.try_divide("mean_abs", total).alias("share")).orderBy(
        F.desc("share"), "feature")


def forest_shapley(matrix: Matrix, estimator: RandomForestClassifier, *, repeats: int = 4, seed: int = 42) -> DataFrame:
    """:func:`sampled_shapley` of the estimator's forest on all rows, which neither the driver nor Spark's model holds: trees and walks meet as tables."""
    # one forest, which leaves out no row: fold 0 has none
    rows = matrix.data.select(
        matrix.key, _given_label(matrix.label), F.lit(1).alias("fold"), vector_to_array("features").alias("x"))

    def means() -> DataFrame:
        stored = materialize(rows, "shapley-rows")
        _, trees, growth = _forests(stored, matrix.key, 1, estimator)
        binned = materialize(binned_rows(stored.select(matrix.key, "x"), growth), "shapley-bins")
        sums = shapley_sums(_donors(binned, matrix.key, repeats, seed, own=["x"]), matrix.key, trees, growth, repeats=repeats, seed=seed)
        return sums.select("j", (F.col("sum_abs") / F.col("rows")).alias("mean_abs"))

    return _shares(settle(means, "shapley-means"), matrix.names)
