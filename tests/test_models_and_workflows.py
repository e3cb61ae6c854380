from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark import cli, workflows
from tidemark.functions import constants as C
from tidemark.operators import boosting, features, kernel, keyword, logistic, metrics, models, splits, validate
from tidemark.sources import adapters, readers, writers
from tidemark.streaming.activity import activity

SF = f"{DATA}/sf0.001"


def rows(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        label = i % 4
        for c in range(4):
            out.append((f"C{i:03d}", c, float(rng.normal(2.0 if c == label else 0.0)), float("nan") if c == 3 else float(rng.normal()), int(c == label)))
    return spark.createDataFrame(out, "client_id string, family_id int, a double, b double, target int").withColumn("b", F.when(~F.isnan("b"), F.col("b")))


def test_boosting_learns_and_repeats(spark, tmp_path):
    df = rows(spark)
    made = [boosting.fit(df, ["a", "b"], "target", boosting.Settings(rounds=6, depth=2, least_hessian=0.1)) for _ in range(2)]
    assert made[0].trees == made[1].trees and made[0].importance()["a"] > made[0].importance()["b"]
    scores = boosting.predict(df, made[0])
    best = scores.groupBy("client_id").agg(F.max_by("family_id", "score").alias("c")).join(df.where("target = 1"), "client_id")
    assert best.agg(F.avg((F.col("c") == F.col("family_id")).cast("double"))).first()[0] > 0.7
    parts = boosting.explain(df, made[0]).groupBy("client_id", "family_id").agg(F.sum("contribution").alias("s")).join(scores, ["client_id", "family_id"])
    assert parts.agg(F.max(F.abs(F.col("s") - F.col("score")))).first()[0] < 1e-9
    made[0].save(f"{tmp_path}/m.json")
    assert boosting.Model.load(f"{tmp_path}/m.json").trees == made[0].trees
    with open(f"{tmp_path}/bad.json", "w") as f:
        json.dump({"features": []}, f)
    with pytest.raises(TypeError):
        boosting.Model.load(f"{tmp_path}/bad.json")


def test_candidate_rows(spark):
    listed = [(f"C{i}", f, j, float(j), 0.5, float(i + j), 1.0, 1.0, 7) for i in range(5) for j, f in enumerate(C.FAMILIES)]
    df = spark.createDataFrame(listed, "client_id string, family string, family_id int, p_next double, p_prob double, p_n double, n_streams double, n_active double, c_rows long")
    found = features.candidate_rows(df).orderBy("client_id", "family_id").collect()
    assert [r["family_id"] for r in found] == list(range(8)) * 5
    for r in found:
        assert r["x_max_n"] == int(r["client_id"][1:]) + 6 and r["c_rows"] == 7
        assert (r["p_next"] is None) == (r["family"] == "none")


def test_listwise_chances_sum_to_one(spark):
    listed = [(f"C{i}", f, j, float((i * j) % 5), 0.5, float(i + j), 1.0, 1.0, 7) for i in range(16) for j, f in enumerate(C.FAMILIES)]
    df = features.candidate_rows(spark.createDataFrame(listed, "client_id string, family string, family_id int, p_next double, p_prob double, p_n double, n_streams double, n_active double, c_rows long"))
    labels = spark.createDataFrame([(f"C{i}", C.CLASSES[i % 8]) for i in range(16)], "client_id string, label string")
    fitted = models.fit_listwise(df, labels, (), (0,), boosting.Settings("softmax", rounds=2, depth=2, least_hessian=0.1))
    assert all(sum(r[c] for c in C.CLASSES) == pytest.approx(1.0) for r in models.predict_listwise(fitted, df).collect())


def test_keyword_order_and_tokens(spark):
    df = spark.createDataFrame([("fit club",), ("fitness pass",), ("outfit",), ("my service plan x",), ("service bill",), ("stream prod",)], "d string")
    assert [r[0] for r in df.select(keyword.keyword_family(F.col("d"))).collect()] == ["gym", "gym", None, "cloud", "mobile", "software"]


def test_candidate_matrix_width(spark):
    assigned = kernel.assign_families(adapters.long_transactions(spark, SF))
    profile = kernel.family_profile(assigned)
    context = kernel.client_context(assigned, profile)
    names = len(profile.columns) - 2
    found = kernel.candidate_matrix(profile, context).select("client_id", F.size("features").alias("n")).collect()
    assert {r["n"] for r in found} == {3 * names + 10 + 4 * names + 4 * len(C.JOINT) + 8}
    assert len(found) == 8 * assigned.select("client_id").distinct().count()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data folder in the file formats, of the adapter's transactions."""
    out = tmp_path_factory.mktemp("data")
    rows = adapters.transactions(spark, SF).select(*readers.TRANSACTIONS.names, "client_id").toPandas()
    rows = rows.loc[:, ~rows.columns.duplicated()]
    people = sorted(rows.client_id.unique())
    own = {s: people[i::4] for i, s in enumerate(readers.SPLITS)}
    for split, ids in own.items():
        part = rows[rows.client_id.isin(ids)].copy()
        part["timestamp"] = part.timestamp.dt.strftime("%Y-%m-%dT%H:%M:%SZ")
        part.to_json(f"{out}/{split}_transactions.jsonl", orient="records", lines=True)
        if split in ("train", "valid"):
            with open(f"{out}/{split}_labels.csv", "w") as f:
                f.write("client_id,cutoff_date,target_next_recurring_merchant\n" + "".join(f"{c},2024-02-01,{C.CLASSES[i % 8]}\n" for i, c in enumerate(ids)))
    with open(f"{out}/sample_submission.csv", "w") as f:
        f.write("client_id,predicted_next_recurring_merchant\n" + "".join(f"{c},none\n" for c in reversed(own["test"])))
    return str(out)


def test_load_and_calibrate(spark, folder, tmp_path):
    data = workflows.load(spark, folder, "2024-02-01")
    assert data.transactions["train"].count() > 0
    found = {r["frame"]: r for r in workflows.calibrate(data, str(tmp_path)).collect()}
    assert found["trainT"]["everyday_mask"] >= found["train"]["everyday_mask"] and (tmp_path / "report.md").exists()
    with pytest.raises(readers.InvalidData):
        workflows.load(spark, folder, "2024-01-15")


def test_ensemble(spark, folder, tmp_path):
    data = workflows.load(spark, folder, "2024-02-01")
    recipe = workflows.Recipe({"parser_softmax": 1.0, "keyword_streams": 0.0}, (0,), (0,), folds=2, rounds=1, bootstrap=20)
    found = workflows.ensemble(data, recipe, str(tmp_path))
    text = "".join(p.read_text() for p in sorted((tmp_path / "submission").glob("part-*.csv")))
    assert text.count("\n") == data.sample.count() + 1
    assert json.loads((tmp_path / "metadata.json").read_text())["classes"] == list(C.CLASSES)
    assert found["scores"].where("view = 'pooled' and fold = -1").first()["n"] == found["runs"].count()
    assert list((tmp_path / "oof_seed0.csv").glob("part-*.csv")) and found["lockbox"].first()["n"] > 0


def test_score_and_compare_directories(spark, folder, tmp_path):
    data = workflows.load(spark, folder, "2024-02-01")
    everyone = splits.development(workflows.people(data))
    dev, locked = everyone.where("part = 'development'"), everyone.where("part = 'lockbox'")
    chances = adapters.scores(dev, 0).withColumn("fold", splits.fold_of(0, F.col("client_id")))
    for name in ("one", "two", "bad"):
        fold = F.lit(0) if name == "bad" else F.col("fold")
        writers.write_probabilities(chances.withColumn("fold", fold), str(tmp_path / name / "oof_seed0.csv"))
    writers.write_probabilities(adapters.scores(locked, 0), str(tmp_path / "one" / "lockbox.csv"))
    scored = workflows.score_directory(data, str(tmp_path / "one"), (0,), 20)
    pairs = dev.join(metrics.argmax_labels(chances), "client_id").select(F.col("label").alias("truth"), "prediction")
    macro = metrics.macro_f1(pairs).first()["macro_f1"]
    assert scored["scores"].where("view = 'pooled' and fold = -1").first()["macro_f1"] == pytest.approx(macro)
    assert scored["lockbox"].first()["n"] == locked.count()
    text = workflows.compare(data, {"one": str(tmp_path / "one"), "two": str(tmp_path / "two")}, str(tmp_path), (0,), 20)
    assert text.count("| one |") == 4 and text.count("| two |") == 4 and f"{macro:.3f}" in text
    with pytest.raises(readers.InvalidData, match="folds"):
        workflows.score_directory(data, str(tmp_path / "bad"), (0,), 20)
    with pytest.raises(readers.InvalidData, match="cover"):
        writers.write_probabilities(chances.limit(3), str(tmp_path / "few" / "oof_seed0.csv"))
        workflows.score_directory(data, str(tmp_path / "few"), (0,), 20)


SMALL = boosting.Settings("binary", rounds=1, depth=1)


def test_training_stacks_the_views_and_leaves_the_trial_features_out(spark, folder, tmp_path, monkeypatch):
    data = workflows.load(spark, folder, "2024-02-01")
    seen = {}
    fit = models.fit_ranker

    def spy(rows, labels, *rest, **more):
        seen["rows"] = rows.groupBy(F.substring_index("client_id", "@", -1).alias("view")).agg(F.countDistinct("client_id").alias("n")).collect()
        return fit(rows, labels, *rest, **more)

    monkeypatch.setattr(models, "fit_ranker", spy)
    bundle = workflows.train(data, str(tmp_path), SMALL)
    n = {s: data.labels[s].count() for s in ("train", "valid")}
    assert {r["view"]: r["n"] for r in seen["rows"]} == {"trainT": n["train"], "trainV": n["train"], "valid": n["valid"], "validT1": n["valid"]}
    used = {f for m in (*bundle.rankers, *bundle.gates) for f in m.features}
    assert not {f.split("__")[-1] for f in used} & set(features.EXPERIMENTAL) and set(features.NOISE_LEVEL) <= used
    chances = workflows.predict(data, str(tmp_path), str(tmp_path / "out"))
    assert chances.count() == data.sample.count()
    for name in ("feature_importance", "group_importance", "local_explanations", "submission"):
        assert list((tmp_path / "out" / name).glob("part-*.csv"))


def test_evaluation_scores_three_views(spark, folder, tmp_path):
    data = workflows.load(spark, folder, "2024-02-01")
    found = workflows.evaluate(data, (0,), SMALL, str(tmp_path), 20, guard=False, k_folds=2)
    for view in workflows.EVALUATED:
        assert found[f"cross-validation, {view}"].first()["n"] == data.labels["valid"].count()
        assert found[f"intervals by class, {view}"].count() == len(C.CLASSES)
        assert list((tmp_path / f"oof_{view}").glob("part-*.csv"))
    row = found["trial of the experimental features"].first()
    assert row["valid_gain"] == pytest.approx(row["candidate_valid"] - row["baseline_valid"]) and row["kept"] in (True, False)
    assert (tmp_path / "report.md").exists() and (tmp_path / "metadata.json").exists()


def test_checks_of_folders_candidates_and_ids(spark, tmp_path):
    with pytest.raises(readers.InvalidData, match="sample_submission"):
        readers.check_folder(spark, str(tmp_path))
    rows = spark.createDataFrame([(k, c) for k in ("K1", "K2") for c in C.CLASSES], "client_id string, family string")
    assert validate.check_candidates(rows) is rows
    for bad in (rows.where("client_id <> 'K2' or family <> 'gym'"), rows.withColumn("family", F.when(F.col("family") == "gym", "shoes").otherwise(F.col("family")))):
        with pytest.raises(readers.InvalidData):
            validate.check_candidates(bad)
    with pytest.raises(readers.InvalidData, match="K3"):
        validate.check_known(spark.createDataFrame([("K3",)], "client_id string"), rows)


def test_logistic_stage_against_its_gradient(spark):
    """At the optimum the gradient of half the squared weights plus the summed loss is zero."""
    rng = np.random.default_rng(3)
    x, classes = rng.normal(size=(120, 3)), ("a", "b", "c")
    y = [classes[int(v)] for v in np.clip(np.rint(x[:, 0] + rng.normal(size=120)) + 1, 0, 2)]
    rows = spark.createDataFrame([(f"K{i}", *map(float, v), y[i]) for i, v in enumerate(x)], "client_id string, p double, q double, r double, label string")
    model = logistic.fit(rows, ["p", "q", "r"], "label", classes)
    w, b = np.array(model.weights), np.array(model.offsets)
    out = np.exp(x @ w.T + b)
    chance = out / out.sum(1, keepdims=True)
    miss = chance - np.array([[c == v for c in classes] for v in y])
    assert np.abs(miss.T @ x + w).max() < 0.02 and np.abs(miss.sum(0)).max() < 0.02
    got = {r["client_id"]: [r[c] for c in classes] for r in logistic.predict(rows, model).collect()}
    assert np.allclose([got[f"K{i}"] for i in range(120)], chance)


def test_keyword_model_has_a_logistic_second_stage(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(64):
        label = C.CLASSES[i % 8]
        labels.append((f"K{i}", label))
        rows += [(f"K{i}", f, j, float(rng.normal(3.0 if f == label else 0.0))) for j, f in enumerate(C.FAMILIES)]
    long = spark.createDataFrame(rows, "client_id string, fam string, fam_id int, a double")
    known = spark.createDataFrame(labels, "client_id string, label string")
    fitted = models.fit_keyword(long, known, settings=boosting.Settings("binary", rounds=12, depth=2, rate=0.3, least_hessian=0.1, column_share=1.0), folds=2)
    chances = models.predict_keyword(fitted, long)
    right = metrics.argmax_labels(chances).join(known, "client_id").agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.7


def test_boosting_beyond_the_kept_trees(spark, monkeypatch):
    df = rows(spark)
    settings = boosting.Settings(rounds=7, depth=2, least_hessian=0.1)
    whole = boosting.fit(df, ["a", "b"], "target", settings)
    monkeypatch.setattr(boosting, "KEEP", 2)
    parts = boosting.fit(df, ["a", "b"], "target", settings)
    assert [[n[:5] for n in t] for t in whole.trees] == [[n[:5] for n in t] for t in parts.trees]
    assert np.allclose([n[5] for t in whole.trees for n in t], [n[5] for t in parts.trees for n in t])


def test_cli_arguments():
    assert cli.parser().parse_args(["ensemble", "--data", "d", "--out", "o", "--seeds", "1,2"]).seeds == (1, 2)
    for bad in (["ensemble", "--data", "d", "--out", "o", "--seeds", ","], ["evaluate", "--data", "d", "--out", "o", "--bootstrap", "0"], []):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)


def test_streamed_activity_equals_the_batch(spark, tmp_path):
    rows = adapters.transactions(spark, SF).select("client_id", "timestamp", "type", "amount")
    rows.write.parquet(f"{tmp_path}/in")
    stream = activity(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "7 days", "7 days", "40 days")
    query = stream.writeStream.format("memory").queryName("activity").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    own = activity(rows, "7 days", "7 days")
    assert spark.table("activity").select("client_id", "start", "n").exceptAll(own.select("client_id", "start", "n")).isEmpty() and own.count() == spark.table("activity").count()
