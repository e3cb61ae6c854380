"""Whole runs: calibrate, evaluate, train, predict, all, ensemble. Each takes DataFrames or a data folder and
writes its results; feature views are lazy and built once where they are used more than once."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.functions.hashing import fold_of
from tidemark.operators import augment, calibration, features, grammar, kernel, keyword, metrics, models, prior, splits, streams, validate
from tidemark.operators.boosting import Model
from tidemark.sources import readers, writers
from tidemark.sources.storage import stored

#: Named views: split, noise, level, seed. Fixed values.
VIEWS = {
    "train": ("train", None, None, 0),
    "valid": ("valid", None, None, 0),
    "test": ("test", None, None, 0),
    "trainT": ("train", "redraw", C.TEST_LEVEL, 0),
    "trainV": ("train", "redraw", C.VALID_LEVEL, 2),
    "trainT1": ("train", "redraw", C.TEST_LEVEL, 1),
    "trainT2": ("train", "redraw", C.TEST_LEVEL, 2),
    "trainV3": ("train", "redraw", C.VALID_LEVEL, 3),
    "trainV4": ("train", "redraw", C.VALID_LEVEL, 4),
    "validT0": ("valid", "add", C.VALID_TO_TEST, 0),
    "validT1": ("valid", "add", C.VALID_TO_TEST, 1),
    "validT2": ("valid", "add", C.VALID_TO_TEST, 2),
}


#: Views of the labelled clients that models are trained on, and those that they are evaluated on. Fixed values.
TRAINING = ("trainT", "trainV", "valid", "validT1")
EVALUATED = {"valid": "valid", "validT_seed0": "validT0", "validT_seed2": "validT2"}


@dataclass
class Recipe:
    """Settings of an ensemble run."""

    weights: dict[str, float] = field(default_factory=lambda: {"parser_softmax": 1.0})
    seeds: tuple[int, ...] = (0, 1, 2)
    bag: tuple[int, ...] = (0, 1, 2)
    folds: int = C.FOLDS
    rounds: int | None = None  # None: each model's own
    drop: tuple[str, ...] = features.EXPERIMENTAL
    bootstrap: int = C.BOOTSTRAP_SAMPLES


@dataclass
class Data:
    """Transactions of each split, labels of train and valid, and the sample of clients that are asked for."""

    transactions: dict[str, DataFrame]
    labels: dict[str, DataFrame]
    sample: DataFrame | None = None
    paths: list[str] = field(default_factory=list)

    def check(self) -> None:
        """Splits share no client, labels are of their split's clients, the sample is of the test clients."""
        people = None
        for name, df in self.transactions.items():
            part = df.select(F.lit(name).alias("split"), "client_id").distinct()
            people = part if people is None else people.unionByName(part)
        shared = validate.split_overlaps(people).where("n_shared > 0").collect()
        if shared:
            raise validate.InvalidData(f"splits share clients: {shared}")
        pairs = [(f"labels of {s}", self.transactions[s], df) for s, df in self.labels.items()]
        for name, left, right in [*pairs, *([("sample", self.transactions["test"], self.sample)] if self.sample is not None else [])]:
            broken = validate.key_mismatches(left, right).first().asDict()
            if any(broken.values()):
                raise validate.InvalidData(f"{name}: {broken}")


def load(spark: SparkSession, folder: str, cutoff: str = readers.CUTOFF) -> Data:
    """All files of a data folder, checked one by one and against each other."""
    readers.check_folder(spark, folder)
    paths = [f"{folder}/{s}_transactions.jsonl" for s in readers.SPLITS] + [f"{folder}/{s}_labels.csv" for s in ("train", "valid")] + [f"{folder}/sample_submission.csv"]
    data = Data(
        {s: readers.load_transactions(spark, p, cutoff) for s, p in zip(readers.SPLITS, paths, strict=False)},
        {s: readers.load_labels(spark, f"{folder}/{s}_labels.csv", cutoff) for s in ("train", "valid")},
        readers.load_sample(spark, paths[-1]),
        paths,
    )
    data.check()
    return data


class Views:
    """Feature tables by view name, built when they are first asked for and kept."""

    def __init__(self, data: Data):
        self.data, self.tables = data, {}
        self.prior = stored(prior.amount_prior(grammar.described(data.transactions["unlabeled_pretrain"])), "prior")

    def _described(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        described = stored(grammar.described(rows), "described")
        return described, stored(streams.stream_records(described, prior.wide(self.prior)), "records")

    def transactions(self, name: str) -> DataFrame:
        split, kind, level, seed = VIEWS[name]
        rows = self.data.transactions[split]
        if kind is None:
            return rows
        if kind == "add":
            return stored(augment.replaced(rows, augment.add_noise(grammar.described(rows), level, seed)), name)
        return stored(augment.replaced(rows, augment.redraw_noise(*self._described(rows), level, seed)), name)

    def features(self, name: str) -> DataFrame:
        """Written once, as every fold reads it."""
        if name not in self.tables:
            described, records = self._described(self.transactions(name))
            self.tables[name] = stored(features.build_features(described, records, self.prior), "features")
        return self.tables[name]


def _rounds(settings: models.Settings, rounds: int | None) -> models.Settings:
    return replace(settings, rounds=rounds) if rounds else settings


def stacked(views: Views, names: tuple[str, ...], clients: DataFrame, of=lambda rows: rows) -> DataFrame:
    """The rows of the clients in each view, one below the other; client_id is <client>@<view>."""
    out = None
    for n in names:
        part = of(views.features(n)).join(clients.select("client_id"), "client_id", "left_semi").withColumn("client_id", F.concat("client_id", F.lit(f"@{n}")))
        out = part if out is None else out.unionByName(part)
    return out


def keyed_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """client_id of the stacked rows, with the client's label."""
    own = F.substring_index("client_id", "@", 1)
    return rows.select("client_id").distinct().withColumn("own", own).join(labels.select(F.col("client_id").alias("own"), "label"), "own").select("client_id", "label")


class ParserSoftmax:
    """Listwise softmax over the parser stack's candidates, on train and valid at both noise levels."""

    def __init__(self, views: Views, recipe: Recipe):
        self.views, self.bag, self.drop, self.settings = views, recipe.bag, recipe.drop, _rounds(models.SOFTMAX, recipe.rounds)

    def rows(self, names: tuple[str, ...], clients: DataFrame) -> DataFrame:
        return stacked(self.views, names, clients, features.candidate_rows)

    def fit_predict(self, train: DataFrame, targets: DataFrame) -> DataFrame:
        rows = self.rows(TRAINING, train)
        fitted = models.fit_listwise(rows, keyed_labels(rows, train), self.drop, self.bag, self.settings)
        asked = self.rows(("train", "valid", "test"), targets)
        return stored(models.predict_listwise(fitted, asked).withColumn("client_id", F.substring_index("client_id", "@", 1)), "chances")


class KeywordStreams:
    """Two-stage model of the keyword stack, on the plain views."""

    def __init__(self, views: Views, recipe: Recipe):
        self.settings = _rounds(models.KEYWORD, recipe.rounds)
        rows = None
        for n in ("train", "valid", "test"):
            part = views.transactions(n)
            rows = part if rows is None else rows.unionByName(part)
        prepared = keyword.prepare(rows)
        assigned = keyword.assign_family(prepared)
        lines = keyword.timeline(assigned, prepared.where("type = 'refund'"))
        long = keyword.families_long(prepared.select("client_id").distinct(), lines)
        self.long = stored(long.join(keyword.client_summary(prepared, assigned), "client_id"), "keyword")

    def fit_predict(self, train: DataFrame, targets: DataFrame) -> DataFrame:
        own = lambda df, ids: df.join(ids.select("client_id"), "client_id", "left_semi")
        fitted = models.fit_keyword(own(self.long, train), train.select("client_id", "label"), settings=self.settings)
        return models.predict_keyword(fitted, own(self.long, targets))


class ListwiseCandidates:
    """Listwise softmax over the amount-kernel profile, with ranks and deltas against the client's other families."""

    def __init__(self, views: Views, recipe: Recipe):
        self.settings = _rounds(models.LISTWISE, recipe.rounds)
        rows = None
        for n in ("train", "valid", "test"):
            part = views.transactions(n)
            rows = part if rows is None else rows.unionByName(part)
        if not rows.where("dayf >= 0").isEmpty():
            raise validate.InvalidData("transactions at or after the cutoff")
        assigned = kernel.assign_families(rows)
        profile = kernel.family_profile(assigned)
        matrix = kernel.candidate_matrix(profile, kernel.client_context(assigned, profile))
        matrix = stored(matrix, "matrix")
        width = matrix.select(F.size("features").alias("n")).first()
        name = F.element_at(F.array(*map(F.lit, C.CLASSES)), F.col("candidate") + 1)
        self.rows = matrix.select("client_id", name.alias("family"), F.col("candidate").alias("family_id"), *(F.col("features")[i].alias(f"x{i}") for i in range(width["n"] if width else 0)))

    def fit_predict(self, train: DataFrame, targets: DataFrame) -> DataFrame:
        own = lambda ids: self.rows.join(validate.check_known(ids, self.rows).select("client_id"), "client_id", "left_semi")
        fitted = models.fit_listwise(own(train), train.select("client_id", "label"), (), (0,), self.settings)
        return metrics.adjust_none(models.predict_listwise(fitted, own(targets)))


COMPONENTS = {"parser_softmax": ParserSoftmax, "keyword_streams": KeywordStreams, "listwise_candidates": ListwiseCandidates}


def calibrate(data: Data, out: str | None = None) -> DataFrame:
    """Noise statistics of the splits and of their noisy views."""
    views = Views(data)
    frames = {s: data.transactions[s] for s in data.transactions}
    for name in ("trainT", "trainV", "validT0", "validT2"):
        frames[name] = views.transactions(name)
    found = stored(calibration.report(frames), "calibration")
    if out:
        rates = {f"generic rate, {n}": calibration.generic_rate_by_label(grammar.described(views.transactions(n)), data.labels["train"]) for n in ("train", "trainT")}
        writers.write_report(out, "Noise calibration", {"noise": found, **rates})
    return found


def people(data: Data) -> DataFrame:
    train, valid = (data.labels[s].select("client_id", "label", F.lit(s).alias("split")) for s in ("train", "valid"))
    return train.unionByName(valid)


def ensemble(data: Data, recipe: Recipe, out: str | None = None) -> dict[str, DataFrame]:
    """Repeated hash folds on the development clients, lockbox, and the submission of the blend."""
    views = Views(data)
    parts = {n: COMPONENTS[n](views, recipe) for n, w in recipe.weights.items() if w > 0}
    everyone = stored(splits.development(people(data)), "people")
    dev, locked = everyone.where("part = 'development'"), everyone.where("part = 'lockbox'")
    runs, unseen = None, {}
    for seed in recipe.seeds:
        fold = fold_of(seed, F.col("client_id"))
        for k in range(recipe.folds):
            train, held = dev.where(fold != k), dev.where(fold == k)
            chances = metrics.blend({n: p.fit_predict(train, held) for n, p in parts.items()}, recipe.weights)
            unseen.setdefault(seed, []).append(chances.withColumn("fold", F.lit(k)))
            run = held.join(metrics.argmax_labels(chances), "client_id").select("client_id", F.lit(seed).alias("seed"), F.lit(k).alias("fold"), "is_valid", F.col("label").alias("truth"), "prediction")
            runs = run if runs is None else runs.unionByName(run)
    runs = stored(runs, "runs")
    results = {"scores": metrics.score_repetitions(runs)}
    results |= seed_intervals(runs, recipe.seeds, recipe.bootstrap)
    asked = locked.select("client_id")
    if data.sample is not None:
        asked = asked.unionByName(data.sample.select("client_id"))
    final = metrics.blend({n: p.fit_predict(dev, asked) for n, p in parts.items()}, recipe.weights)
    final = stored(final, "chances")
    pairs = locked.join(metrics.argmax_labels(final), "client_id").select(F.col("label").alias("truth"), "prediction")
    results["lockbox"] = metrics.summary(pairs, recipe.bootstrap)
    if out:
        if data.sample is not None:
            writers.write_submission(final.join(data.sample.select("client_id"), "client_id", "left_semi"), data.sample, out)
        for seed, parts_of in unseen.items():
            writers.write_probabilities(reduce(DataFrame.unionByName, parts_of), f"{out}/oof_seed{seed}.csv")
        writers.write_probabilities(final.join(locked, "client_id", "left_semi"), f"{out}/lockbox.csv")
        writers.write_report(out, "Ensemble", results)
        spark = runs.sparkSession
        writers.write_manifest(out, readers.file_hashes(spark, data.paths), {"recipe": asdict(recipe)})
    return results | {"runs": runs, "chances": final}


def cross_validated(views: Views, data: Data, seeds: tuple[int, ...], drop: tuple[str, ...], settings: models.Settings, k_folds: int = C.FOLDS) -> DataFrame:
    """view, seed, fold, client_id, classes: chances of every valid client in each of the EVALUATED views, by the
    ranker and gate of the folds that it is not in, trained on the TRAINING views."""
    labels, train, out = data.labels["valid"], data.labels["train"], None
    for seed in seeds:
        folds = stored(splits.stratified(labels, seed, k_folds), "folds")
        for k in range(k_folds):
            known = train.unionByName(folds.where(F.col("fold") != k).select("client_id", "label"))
            rows = stacked(views, TRAINING, known)
            bundle = models.fit_ranker(rows, keyed_labels(rows, known), drop, (0,), settings)
            held = folds.where(F.col("fold") == k).select("client_id")
            for view, name in EVALUATED.items():
                part = models.predict_ranker(bundle, views.features(name).join(held, "client_id", "left_semi"))
                part = part.select(F.lit(view).alias("view"), F.lit(seed).alias("seed"), F.lit(k).alias("fold"), "client_id", *C.CLASSES)
                out = part if out is None else out.unionByName(part)
    return stored(out, "unseen")


def evaluate(data: Data, seeds: tuple[int, ...] = (0, 17), settings: models.Settings = models.RANKER, out: str | None = None, samples: int = C.BOOTSTRAP_SAMPLES, guard: bool = True, k_folds: int = C.FOLDS) -> dict[str, DataFrame]:
    """Rules, the train-only leak contrast with its guard, cross-validation of the ranker and none gate on three
    noise views with intervals, paired differences between the views, and the trial of the experimental features."""
    views = Views(data)
    labels = data.labels["valid"]
    truth = labels.select("client_id", F.col("label").alias("truth"))
    found = metrics.rules(views.features("valid"), labels).join(truth, "client_id")
    results = {}
    for rule in ("earliest_next", "most_payments", "most_recent", "refunded_none"):
        results[f"rule {rule}"] = metrics.macro_f1(found.select("truth", F.col(rule).alias("prediction")))
    pairs = lambda chances: truth.join(metrics.argmax_labels(chances), "client_id").select("truth", "prediction")
    contrast = {}
    for name, drop in (("leaky", ()), ("safe", features.NOISE_LEVEL)):
        bundle = models.fit_ranker(views.features("train"), data.labels["train"], drop, (0,), settings)
        results[f"train only, {name}"] = stored(metrics.macro_f1(pairs(models.predict_ranker(bundle, views.features("valid")))), "contrast")
        contrast[name] = results[f"train only, {name}"].first()["macro_f1"]
    if guard:
        validate.check_leak_contrast(contrast["leaky"], contrast["safe"])
    unseen = cross_validated(views, data, seeds, features.EXPERIMENTAL, settings, k_folds)
    trial = cross_validated(views, data, seeds, (), settings, k_folds)
    averaged = {v: unseen.where(F.col("view") == v).groupBy("client_id").agg(*(F.avg(c).alias(c) for c in C.CLASSES)) for v in EVALUATED}
    for view, chances in averaged.items():
        results[f"cross-validation, {view}"] = metrics.summary(pairs(chances), samples)
        results[f"intervals by class, {view}"] = metrics.class_intervals(pairs(chances), "prediction", samples)
        none = chances.join(truth, "client_id").select(F.col(C.NONE).alias("p"), (F.col("truth") == C.NONE).cast("int").alias("y"))
        results[f"none AUC, {view}"] = metrics.auc(none)
    for view in list(EVALUATED)[1:]:
        both = truth.join(metrics.argmax_labels(averaged["valid"]).withColumnRenamed("prediction", "raw"), "client_id").join(metrics.argmax_labels(averaged[view]).withColumnRenamed("prediction", "noisy"), "client_id")
        results[f"{view} less valid"] = metrics.interval(metrics.paired_difference(both, "raw", "noisy", samples), "difference")
    results["trial of the experimental features"] = metrics.ablation(trial, unseen, labels, tuple(EVALUATED)[1:])
    if out:
        writers.write_oof(labels, averaged, out)
        writers.write_report(out, "Evaluation", results)
        print(writers.metric_line("cross-validation, valid", **writers.line_of(results["cross-validation, valid"].first())))
        writers.write_manifest(out, readers.file_hashes(views.prior.sparkSession, data.paths), {"seeds": list(seeds), "settings": asdict(settings)})
    return results


def train(data: Data, out: str, settings: models.Settings = models.RANKER) -> models.Bundle:
    """Final ranker and gate on the TRAINING views of all labelled clients, saved with the prior that they were built on."""
    views = Views(data)
    known = people(data).select("client_id", "label")
    rows = stacked(views, TRAINING, known)
    bundle = models.fit_ranker(rows, keyed_labels(rows, known), settings=settings)
    os.makedirs(out, exist_ok=True)
    for kind, listed in (("ranker", bundle.rankers), ("gate", bundle.gates)):
        for i, m in enumerate(listed):
            m.save(f"{out}/{kind}_{i}.json")
    with open(f"{out}/bundle.json", "w") as f:
        json.dump({"n": len(bundle.rankers), "drop": list(bundle.drop), "prior": [r.asDict() for r in views.prior.collect()]}, f, sort_keys=True)
    return bundle


def load_bundle(spark: SparkSession, path: str) -> tuple[models.Bundle, DataFrame]:
    with open(f"{path}/bundle.json") as f:
        d = json.load(f)
    if not d.get("prior"):
        raise validate.InvalidData(f"{path} holds no prior")
    listed = {k: [Model.load(f"{path}/{k}_{i}.json") for i in range(d["n"])] for k in ("ranker", "gate")}
    return models.Bundle(listed["ranker"], listed["gate"], tuple(d["drop"])), spark.createDataFrame(d["prior"], "family string, bin int, n long, logp double")


def predict(data: Data, model: str, out: str) -> DataFrame:
    """Chances and submission of the test clients from a saved model."""
    spark = data.transactions["test"].sparkSession
    bundle, learned = load_bundle(spark, model)
    described = grammar.described(data.transactions["test"])
    rows = stored(features.build_features(described, streams.stream_records(described, prior.wide(learned)), learned), "features")
    chances = stored(models.predict_ranker(bundle, rows), "chances")
    writers.write_submission(chances, data.sample, out)
    gain = models.gain_importance(bundle.rankers, spark)
    writers.write_interpretability(out, gain, models.local_explanations(bundle.rankers[0], rows, chances))
    writers.write_report(out, "Importance", {"gain": gain})
    return chances


def score_directory(data: Data, folder: str, seeds: tuple[int, ...] = (0, 1, 2), samples: int = C.BOOTSTRAP_SAMPLES) -> dict[str, DataFrame]:
    """Scores of a folder of chance tables: oof_seed<seed> of the development clients, whose fold column, if there is
    one, has to be the protocol's, and lockbox, if it is there."""
    spark = data.labels["train"].sparkSession
    everyone = splits.development(people(data))
    dev, locked = everyone.where("part = 'development'"), everyone.where("part = 'lockbox'")
    runs = None
    for seed in seeds:
        path = f"{folder}/oof_seed{seed}.csv"
        chances = readers.read_probabilities(spark, path)
        _covers(path, dev, chances)
        given = readers.read_folds(spark, path)
        if given is not None and splits.fold_violations(given, people(data), seed).first()["n_wrong"]:
            raise validate.InvalidData(f"{path}: folds are not those of the protocol")
        run = dev.join(metrics.argmax_labels(chances), "client_id").select("client_id", F.lit(seed).alias("seed"), fold_of(seed, F.col("client_id")).alias("fold"), "is_valid", F.col("label").alias("truth"), "prediction")
        runs = run if runs is None else runs.unionByName(run)
    runs = stored(runs, "runs")
    results = {"scores": metrics.score_repetitions(runs)} | seed_intervals(runs, seeds, samples)
    if readers.exists(spark, f"{folder}/lockbox.csv"):
        chances = readers.read_probabilities(spark, f"{folder}/lockbox.csv")
        _covers(f"{folder}/lockbox.csv", locked, chances)
        results["lockbox"] = metrics.summary(locked.join(metrics.argmax_labels(chances), "client_id").select(F.col("label").alias("truth"), "prediction"), samples)
    return results


def _covers(path: str, clients: DataFrame, chances: DataFrame) -> None:
    broken = validate.key_mismatches(clients, chances).first().asDict()
    if any(broken.values()):
        raise validate.InvalidData(f"{path} does not cover exactly the clients: {broken}")


def seed_intervals(runs: DataFrame, seeds: tuple[int, ...], samples: int) -> dict[str, DataFrame]:
    """Intervals of the mean macro-F1 over the seeds, on all clients and on valid ones; a resample serves all seeds."""
    out = {}
    for name, rows in (("pooled interval", runs), ("valid interval", runs.where("is_valid"))):
        wide = rows.groupBy("client_id", "truth").agg(*(F.max(F.when(F.col("seed") == s, F.col("prediction"))).alias(f"seed_{s}") for s in seeds))
        out[name] = metrics.interval(metrics.bootstrap(wide, [f"seed_{s}" for s in seeds], samples))
    return out


def compare(data: Data, folders: dict[str, str], out: str, seeds: tuple[int, ...] = (0, 1, 2), samples: int = C.BOOTSTRAP_SAMPLES) -> str:
    """comparison.md in out: solutions side by side, by the scores of their folders."""
    return writers.write_comparison(out, {name: score_directory(data, folder, seeds, samples) for name, folder in folders.items()}, seeds)
