"""The whole pipeline against a plain recomputation of its stages, one document at a time."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import language, mixing, secret_scan
from tidemark.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOUNDS = {"en": ["tha", "ing", "wor", "ell", "ght", "oo", "sh"], "de": ["sch", "ung", "ein", "zur", "keit", "ü", "pf"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda lang: "".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    items = [(i, text("en", 14)) for i in range(3)]
    rows = [(i, text(("en", "de")[i % 2], 60 + i), ("en", "de")[i % 2], ("web", "books", None)[i % 3]) for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[i][2], "copies") for i in range(6)]
    rows += [(200 + i, rows[20 + i][1] + " last words", rows[20 + i][2], "near") for i in range(6)]
    rows += [(300 + i, text("en", 30) + " " + items[i][1] + " " + text("en", 30), "en", "leaks") for i in range(3)]
    rows += [(400 + i, text("de", 40) + " token = abcdefgh" + str(i) * 3 + " " + text("de", 9), "de", "secrets") for i in range(4)]
    rows += [(500, None, "en", "web"), (501, "", "en", "web"), (502, "12 34", None, "web")]
    out = str(tmp_path_factory.mktemp("pipeline"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows, items


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 5, 0) + 1)} if words else set()


def plain(spark, out, rows, items):
    model = language.fit(table(spark, out, "documents"))
    kept = [r for r in rows if not model.predict(r[1])[2]]
    root = {r[0]: r[0] for r in kept}
    sets = {r[0]: shingles(r[1]) for r in kept}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    kept = [r for r in kept if top(r[0]) == r[0]]
    windows = set()
    for _, t in items:
        words = WORD.findall(t.lower())
        windows |= {tuple(words[i : i + 10]) for i in range(len(words) - 9)}
    leaks = lambda t: any(tuple(w[i : i + 10]) in windows for w in [WORD.findall((t or "").lower())] for i in range(len(w) - 9))
    kept = [r for r in kept if not leaks(r[1])]
    clean = []
    for i, t, lang, source in kept:
        spans = secret_scan.find(t, secret_scan.default_vocabulary())
        for _, start, end in sorted(spans, key=lambda s: -s[1]):
            t = t[:start] + "[SECRET]" + t[end:]
        clean.append((i, t, lang, source))
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", clean)
    taken = {i: n // size if size else 0 for i, size, n in con.sql(f"select doc_id, size, taken from ({mixing.ORACLE_SQL})").fetchall()}
    return {(i, t): taken[i] for i, t, _, _ in clean if taken[i]}


def test_pipeline_by_plain_recomputation(spark, folder):
    out, rows, items = folder
    found = corpus_pipeline.run(spark, out).collect()
    want = plain(spark, out, rows, items)
    assert Counter((r["doc_id"], r["text"]) for r in found) == want
    assert {r["copy"] for r in found} <= {1, 2, 3} and all(r["n_chars"] == len(r["text"]) for r in found)
    ids = {i for i, _ in want}
    assert not ids & {100, 101, 102, 200, 201, 300, 301, 302, 500, 501, 502}
    assert any("[SECRET]" in t for _, t in want)
