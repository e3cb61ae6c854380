"""Class decisions, blends, metrics over the fixed classes, and bootstrap intervals.

Metrics come from confusion counts on the full grid of classes: a class that is absent scores 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.functions.hashing import uniform
from tidemark.sources.storage import stored

#: Bins of distinct chances, each of which one task orders.
BINS = 512


def best_class(classes: tuple[str, ...] = C.CLASSES) -> Column:
    """The class of the largest chance, ties to the earlier class."""
    listed = F.array(*(F.struct(F.coalesce(F.col(c), F.lit(float("-inf"))).alias("p"), F.lit(-i).alias("i")) for i, c in enumerate(classes)))
    return F.element_at(F.array(*map(F.lit, classes)), 1 - F.array_max(listed)["i"])


def argmax_labels(chances: DataFrame) -> DataFrame:
    return chances.select("client_id", best_class().alias("prediction"))


def blend(tables: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Weighted mean of chance tables; weights of 0, below, or of absent tables are left out."""
    used = {n: w for n, w in weights.items() if n in tables and w > 0}
    if not used:
        raise ValueError("no table has a positive weight")
    total = sum(used.values())
    parts = [tables[n].select("client_id", *((F.col(c) * (w / total)).alias(c) for c in C.CLASSES)) for n, w in used.items()]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked.groupBy("client_id").agg(*(F.sum(c).alias(c) for c in C.CLASSES))


def adjust_none(chances: DataFrame, weight: float = 0.8) -> DataFrame:
    """The chance of `none` times weight, rows normalised again."""
    own = {c: F.col(c) * (weight if c == C.NONE else 1.0) for c in C.CLASSES}
    total = sum(list(own.values())[1:], own[C.CLASSES[0]])
    return chances.select("client_id", *((v / total).alias(c) for c, v in own.items()))


def from_scores(scores: DataFrame, none: DataFrame) -> DataFrame:
    """Chances from scores (client_id, seed, family, score) and (client_id, seed, p_none): for each seed a
    client's scores sum to 1 - p_none; the seeds are averaged."""
    by = ["client_id", "seed"]
    share = scores.withColumn("share", F.try_divide("score", F.sum("score").over(Window.partitionBy(*by))))
    wide = share.groupBy(*by).agg(*(F.max(F.when(F.col("family") == f, F.col("share"))).alias(f) for f in C.FAMILIES)).join(none, by)
    return wide.groupBy("client_id").agg(*(F.avg(F.col(f) * (1 - F.col("p_none"))).alias(f) for f in C.FAMILIES), F.avg("p_none").alias(C.NONE))


def softmax(rows: DataFrame, score: str = "score", by: str = "client_id") -> DataFrame:
    """Adds p: the softmax of score over the rows of a client."""
    w = Window.partitionBy(by)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return rows.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def softmax_gradient(rows: DataFrame) -> DataFrame:
    """Adds grad and hess of the softmax loss over a client's candidates; y is 1 for the true one."""
    return softmax(rows).withColumns({"grad": F.col("p") - F.col("y"), "hess": F.col("p") * (1 - F.col("p")) + 1e-6})


def confusion(pairs: DataFrame, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """by, truth, prediction, n on the full grid of classes (truth and prediction as they are found)."""
    counts = pairs.groupBy(*by, "truth", "prediction").agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))
    spark = pairs.sparkSession
    one = spark.range(len(C.CLASSES)).select(F.element_at(F.array(*map(F.lit, C.CLASSES)), F.col("id").cast("int") + 1).alias("c"))
    grid = one.select(F.col("c").alias("truth")).crossJoin(one.select(F.col("c").alias("prediction")))
    if by:
        grid = F.broadcast(grid)
        grid = pairs.select(*by).distinct().crossJoin(grid)
    return grid.join(counts, [*by, "truth", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_f1(pairs: DataFrame, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """by, label, f1, support for every class; 0 where a class is neither true nor predicted."""
    cells = confusion(pairs, by, weight)
    ends = F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).alias("p")), F.struct(F.col("prediction").alias("label"), F.lit(0).alias("t"), F.col("n").alias("p"))))
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)
    sums = cells.withColumn("hit", hit).select(*by, "hit", ends.alias("end")).groupBy(*by, "end.label").agg((F.sum("hit") / 2).alias("tp"), F.sum("end.t").alias("support"), F.sum("end.p").alias("n_predicted"))
    return sums.where(F.col("label").isin(*C.CLASSES)).select(*by, "label", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("n_predicted")), F.lit(0.0)).alias("f1"), "support")


def macro_f1(pairs: DataFrame, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    return class_f1(pairs, by, weight).groupBy(*by).agg((F.sum("f1") / len(C.CLASSES)).alias("macro_f1"), F.sum("support").alias("n"))


def accuracy(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*by).agg(F.avg((F.col("truth") == F.col("prediction")).cast("double")).alias("accuracy"))


def auc(rows: DataFrame) -> DataFrame:
    """Exact area under the ROC curve of p for y in (0, 1), by rank sums with mid-ranks.

    Equal chances are counted first. Distinct chances fall into BINS bins of about equal size, whose sums are
    added up in order; within its bin a chance is ranked by a window, so no task orders all of them.
    """
    steps = stored(rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("k")), "steps")
    edges = steps.agg(F.percentile_approx("p", [i / BINS for i in range(1, BINS)], 10_000)).first()[0] or []
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e < F.col("p"))) if edges else F.lit(0)
    steps = steps.withColumn("bin", at)
    ahead = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = steps.groupBy("bin").agg(F.sum("n").alias("in_bin")).select("bin", F.coalesce(F.sum("in_bin").over(ahead), F.lit(0)).alias("before"))
    below = F.sum("n").over(Window.partitionBy("bin").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    ranked = steps.withColumn("below", F.coalesce(below, F.lit(0))).join(F.broadcast(bins), "bin")
    ranked = ranked.withColumn("rank", F.col("before") + F.col("below") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("k")).alias("r"), F.sum("k").alias("pos"), F.sum(F.col("n") - F.col("k")).alias("neg"))
    return sums.select(F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg")).alias("auc"), "pos", "neg")


def score_repetitions(predictions: DataFrame) -> DataFrame:
    """Scores by (seed, view, fold): views pooled, valid and train over all folds, pooled also for each fold."""
    views = F.array(F.struct(F.lit("pooled").alias("view"), F.lit(-1).alias("at")), F.struct(F.lit("pooled").alias("view"), F.col("fold").alias("at")), F.struct(F.when(F.col("is_valid"), "valid").otherwise("train").alias("view"), F.lit(-1).alias("at")))
    rows = predictions.withColumn("v", F.explode(views)).select("seed", "v.view", F.col("v.at").alias("fold"), "truth", "prediction")
    by = ("seed", "view", "fold")
    return macro_f1(rows, by).join(accuracy(rows, by), list(by))


def _cells(columns: DataFrame, names: list[str]) -> DataFrame:
    """Distinct combinations of the columns with their counts and the range of places they take in order."""
    cells = columns.groupBy(*names).agg(F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy(*names)
    return cells.withColumn("stop", F.sum("n").over(order)).withColumn("start", F.col("stop") - F.col("n"))


def resampled(predictions: DataFrame, names: list[str], samples: int, seed: int) -> DataFrame:
    """sample, names, weight: how often each combination of the columns is drawn, with replacement, as many
    draws for each sample as there are rows. A client is drawn as the combination that it shows, of which
    there are at most 8 to the power of their number."""
    cells = F.broadcast(_cells(predictions, names))
    total = predictions.agg(F.count("*").alias("total"))
    spark = predictions.sparkSession
    draws = spark.range(samples).withColumnRenamed("id", "sample").crossJoin(F.broadcast(total)).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)))
    u = uniform(seed, F.concat_ws(":", F.col("sample").cast("string"), F.col("draw").cast("string")), "boot")
    drawn = draws.select("sample", F.floor(u * F.col("total")).alias("place"))
    met = drawn.join(cells, (F.col("place") >= F.col("start")) & (F.col("place") < F.col("stop")))
    return met.groupBy("sample", *names).agg(F.count("*").alias("weight"))


def bootstrap(predictions: DataFrame, repetitions: list[str], samples: int = C.BOOTSTRAP_SAMPLES, seed: int = C.BOOTSTRAP_SEED) -> DataFrame:
    """sample, macro_f1: the mean over the repetitions' columns of predictions against truth."""
    weights = resampled(predictions, ["truth", *repetitions], samples, seed)
    listed = F.explode(F.array(*(F.struct(F.lit(i).alias("repetition"), F.col(r).alias("prediction")) for i, r in enumerate(repetitions))))
    pairs = weights.select("sample", "truth", "weight", listed.alias("r")).select("sample", "truth", "weight", "r.*")
    each = macro_f1(pairs, ("sample", "repetition"), F.col("weight"))
    return each.groupBy("sample").agg(F.avg("macro_f1").alias("macro_f1"))


def interval(values: DataFrame, column: str = "macro_f1", confidence: float = 0.95) -> DataFrame:
    tail = (1 - confidence) / 2
    return values.agg(F.percentile(column, F.lit(tail)).alias("lower"), F.percentile(column, F.lit(1 - tail)).alias("upper"), F.count("*").alias("samples"))


def class_intervals(predictions: DataFrame, column: str, samples: int = C.BOOTSTRAP_SAMPLES, seed: int = C.BOOTSTRAP_SEED, confidence: float = 0.95) -> DataFrame:
    """label, lower, upper: intervals of each class' F1 over resamples of the clients."""
    weights = resampled(predictions, ["truth", column], samples, seed)
    scores = class_f1(weights.select("sample", "truth", F.col(column).alias("prediction"), "weight"), ("sample",), F.col("weight"))
    tail = (1 - confidence) / 2
    return scores.groupBy("label").agg(F.percentile("f1", F.lit(tail)).alias("lower"), F.percentile("f1", F.lit(1 - tail)).alias("upper"))


def summary(pairs: DataFrame, samples: int = C.BOOTSTRAP_SAMPLES) -> DataFrame:
    """One row of macro_f1, accuracy, n, the interval of macro_f1 and f1_<class> for each class."""
    per_class = class_f1(pairs).agg(*(F.max(F.when(F.col("label") == c, F.col("f1"))).alias(f"f1_{c}") for c in C.CLASSES))
    whole = macro_f1(pairs).crossJoin(F.broadcast(accuracy(pairs)))
    spread = interval(bootstrap(pairs.withColumnRenamed("prediction", "guess"), ["guess"], samples)).select("lower", "upper")
    return whole.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(per_class))


def ablation(candidate: DataFrame, baseline: DataFrame, labels: DataFrame, stressed: tuple[str, ...], least: float = 0.01) -> DataFrame:
    """seed, candidate_valid, baseline_valid, candidate_test_noise, baseline_test_noise, valid_gain, test_noise_gain,
    kept: macro-F1 of either side's chances (view, seed, client_id, classes) on the view `valid` and on the mean of
    the stressed views. kept: both gains are at least so large for every seed."""
    sides = candidate.withColumn("side", F.lit("candidate")).unionByName(baseline.withColumn("side", F.lit("baseline")))
    view = F.when(F.col("view") == "valid", "valid").when(F.col("view").isin(*stressed), "test_noise")
    mean = sides.withColumn("view", view).where(F.col("view").isNotNull()).groupBy("side", "seed", "view", "client_id").agg(*(F.avg(c).alias(c) for c in C.CLASSES))
    pairs = mean.withColumn("prediction", best_class()).join(labels.select("client_id", F.col("label").alias("truth")), "client_id")
    scores = macro_f1(pairs, ("side", "seed", "view"))
    wide = scores.groupBy("seed").agg(*(F.max(F.when((F.col("side") == s) & (F.col("view") == v), F.col("macro_f1"))).alias(f"{s}_{v}") for s in ("candidate", "baseline") for v in ("valid", "test_noise")))
    gains = wide.withColumns({f"{v}_gain": F.col(f"candidate_{v}") - F.col(f"baseline_{v}") for v in ("valid", "test_noise")})
    every = Window.partitionBy(F.lit(0))  # a row for each seed
    return gains.withColumn("kept", F.min((F.col("valid_gain") >= least) & (F.col("test_noise_gain") >= least)).over(every))


def paired_difference(predictions: DataFrame, first: str, second: str, samples: int = C.BOOTSTRAP_SAMPLES, seed: int = 2028) -> DataFrame:
    """sample, difference: macro-F1 of second less that of first on the same resample."""
    weights = resampled(predictions, ["truth", first, second], samples, seed)
    score = lambda c, name: macro_f1(weights.select("sample", "truth", F.col(c).alias("prediction"), "weight"), ("sample",), F.col("weight")).select("sample", F.col("macro_f1").alias(name))
    both = score(first, "a").join(score(second, "b"), "sample")
    return both.select("sample", (F.col("b") - F.col("a")).alias("difference"))


def rules(features: DataFrame, people: DataFrame) -> DataFrame:
    """client_id, earliest_next, most_payments, most_recent, refunded_none: predictions without learning."""
    on = (F.col("p_active") == 1) & (F.col("p_prob") >= 0.4)
    lone = (F.col("s_prob") >= 0.5) & (F.col("s_last") >= -45)
    pick = lambda *order: F.min_by(F.when(on, F.col("family")), F.when(on, F.struct(*(o.alias(f"o{i}") for i, o in enumerate((*order, F.col("family_id")))))))
    best = features.groupBy("client_id").agg(
        pick(F.col("p_next")).alias("earliest"),
        pick(-F.col("p_n"), F.col("p_next")).alias("most"),
        pick(-F.col("p_last"), F.col("p_next")).alias("recent"),
        F.min_by(F.when(lone, F.col("family")), F.when(lone, F.struct((-F.col("s_last")).alias("a"), F.col("family_id").alias("b")))).alias("single"),
        F.first(F.col("c_n_active_ref") + F.col("c_n_ended_ref"), ignorenulls=True).alias("refunded"),
    )
    picked = people.select("client_id").join(best, "client_id", "left")
    final = lambda c: F.coalesce(F.col(c), F.col("single"), F.lit(C.NONE))
    return picked.select(
        "client_id",
        final("earliest").alias("earliest_next"),
        final("most").alias("most_payments"),
        final("recent").alias("most_recent"),
        F.when(F.coalesce("refunded", F.lit(0)) >= 2, F.lit(C.NONE)).otherwise(final("earliest")).alias("refunded_none"),
    )


def submission(chances: DataFrame, sample: DataFrame) -> DataFrame:
    """pos, client_id, predicted_next_recurring_merchant for the sample's clients, numbered in its order."""
    return sample.select("pos", "client_id").join(argmax_labels(chances), "client_id", "left").select("pos", "client_id", F.col("prediction").alias("predicted_next_recurring_merchant"))
