"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from tests.llm.conftest import CLASHING
from tidemark.llm import decontamination, language, licences, mixing, neighbours, quality, scoring, secret_scan, simhash, toxicity


def ops(docs, labels, benchmark):
    return {
        "op2": secret_scan.op2_secrets(docs),
        "op3": quality.op3_quality(docs, labels),
        "op4": scoring.op4_scoring(docs),
        "op5": mixing.op5_mixing(docs),
        "op6": simhash.op6_simhash(docs),
        "op7": licences.op7_licences(docs),
        "op8": decontamination.op8_decontamination(docs, benchmark),
        "op9": toxicity.op9_toxicity(docs, labels),
        "op10": language.op10_language(docs),
    }


def test_one_row_for_each_row(odd_docs, odd_labels, odd_benchmark):
    n = odd_docs.count()
    for name, found in ops(odd_docs, odd_labels, odd_benchmark).items():
        rows = found.collect()
        assert len(rows) == n, name
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd_docs.select("doc_id").collect()), name


def test_empty_tables(odd_docs, odd_labels, odd_benchmark):
    for name, found in ops(odd_docs.limit(0), odd_labels.limit(0), odd_benchmark.limit(0)).items():
        assert found.collect() == [], name
    assert len(decontamination.op8_decontamination(odd_docs, odd_benchmark.limit(0)).where("contaminated").collect()) == 0
    for found in (quality.op3_quality(odd_docs, odd_labels.limit(0)), toxicity.op9_toxicity(odd_docs, odd_labels.limit(0))):
        assert {r["score"] for r in found.collect()} == {0.5}


def test_texts_without_words(odd_docs, odd_labels, odd_benchmark):
    nothing = hashlib.sha256(b"").hexdigest()
    found = {k: {r["doc_id"]: r for r in v.collect()} for k, v in ops(odd_docs.where("doc_id in (1, 2, 3)"), odd_labels, odd_benchmark).items()}
    for i in (1, 2, 3):
        assert found["op2"][i]["base_sha256"] == nothing and found["op2"][i]["spans"] == ""
        assert found["op4"][i]["n_tokens"] == 1
        assert found["op5"][i]["size"] == 0 and found["op5"][i]["taken"] == 0
        assert found["op6"][i]["fingerprint"] == "0" * 16 and found["op6"][i]["component_id"] == 1
        assert found["op8"][i]["n_words"] == 0 and not found["op8"][i]["contaminated"]
        assert found["op10"][i]["lang_pred"] == "und" and found["op10"][i]["score"] == 0
    assert len({found["op3"][i]["score"] for i in (1, 2, 3)}) <= 2
    assert len({found["op9"][i]["score"] for i in (1, 2, 3)}) == 1


def test_copies_and_ids(odd_docs, odd_benchmark):
    groups = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.op6_simhash(odd_docs).collect()}
    assert {v for (i, f), v in groups.items() if i == 8} == {7}
    found = decontamination.op8_decontamination(odd_docs, odd_benchmark).where("doc_id in (7, 8, 9)").collect()
    assert all(r["contaminated"] for r in found)
    ids = {(r["doc_id"], r["n_words"]): r["items_sha256"] for r in found}
    assert ids[(8, 40)] == hashlib.sha256(b"1,2").hexdigest() and ids[(9, 2)] == hashlib.sha256(b"5").hexdigest()
    assert ids[(7, 50)] == hashlib.sha256(b"").hexdigest()  # hit by an item without an id


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, []), (9, [1.0, 2.0, 3.0]), (2, [1.0, 0.1]), (200, [0.0, 0.0]), (300, None), (100, [1.0, 0.0])]
    more = ("point", "first", "code", "block", "curve", "ids", "asks", *CLASHING)
    df = spark.createDataFrame([(*r, *("x" for _ in more)) for r in rows], "vec_id long, embedding array<float>, " + ", ".join(f"`{c}` string" for c in more))
    found = neighbours.op1_neighbours(df).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [(100, 1, 1), (100, 2, 2)]
    assert found[0]["score"] == 0.0
    assert neighbours.op1_neighbours(df.limit(0)).collect() == []
    assert neighbours.exact(df, df["vec_id"] % 100 == 0).orderBy("rank").collect() == found


def test_ids_with_several_vectors(spark):
    rows = [(1, [0.0, 1.0]), (1, [5.0, 5.0]), (100, [5.0, 5.0]), (2, [0.0, 1.5]), (3, [5.0, 6.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for found in (neighbours.op1_neighbours(df), neighbours.exact(df, df["vec_id"] % 100 == 0)):
        got = [(r["vec_id"], round(r["score"], 2)) for r in found.orderBy("rank").collect()]
        assert got == [(1, 0.0), (3, 1.0), (2, 6.1)]


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [float(j == i % 40) for j in range(40)]) for i in range(400)]
    df = spark.createDataFrame([(7 * i % 400, v) for i, (_, v) in enumerate(rows)], "vec_id long, embedding array<float>")
    own = {7 * i % 400: i % 40 for i in range(400)}
    for found in (neighbours.op1_neighbours(df), neighbours.exact(df, df["vec_id"] % 100 == 0)):
        for q in (0, 100, 200, 300):
            want = sorted((0 if own[v] == own[q] else 1, v) for v in own if v != q)[:10]
            assert [r["vec_id"] for r in found.where(f"query_id = {q}").orderBy("rank").collect()] == [v for _, v in want]


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, odd_docs, odd_benchmark, tmp_path, empty):
    odd_benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_docs.limit(0) if empty else odd_docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{i}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{i}.parquet")
        assert (docs.count() == 0) == empty, name
    assert "copy" in docs.columns


def test_each_stage_alone(spark, odd_docs, odd_benchmark, tmp_path):
    odd_benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {name: stage(spark, odd_docs, str(tmp_path)).collect() for name, stage in corpus_pipeline.STAGES}
    assert not {r["doc_id"] for r in kept["language"]} & {1, 2, 3, 4}
    ids = [r["doc_id"] for r in kept["near-duplicates"]]
    assert ids.count(7) <= 2 and 8 not in ids
    assert not {7, 8, 9} & {r["doc_id"] for r in kept["benchmark passages"]}
    assert len(kept["secrets"]) == odd_docs.count()
