from __future__ import annotations

import pytest

WORDS = "the of and that river mountain garden window letter morning people water stone bridge field"

#: Columns whose names operators use inside, as further columns of the documents.
CLASHING = ("spans", "licences", "lang_pred", "mix_size", "mix_copies", "copy", "fraction", "row", "rank", "score", "target", "key", "value", "hit_id", "kept_id", "mark", "root", "n", "token", "source_size")


def text(seed: int, n: int) -> str:
    words = WORDS.split()
    return " ".join(words[(seed * 7 + i * i + i * seed) % len(words)] for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing columns."""
    rows = [
        (None, text(1, 30), "en", "a"),
        (None, None, None, None),
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, "  \n\t ", None, "b"),
        (4, "12345 !!! ###", "en", "b"),
        (5, "x" * 300_000, "en", "a"),
        (6, text(3, 60_000), "en", "a"),
        (7, text(4, 40), "de", "c"),
        (7, text(4, 40), "de", "c"),
        (7, text(5, 50), "en", "c"),
        (8, text(4, 40), "de", "c"),
        (9, "one two", "en", "c"),
        (10, "\U0001f600 éÉ 日本語 İ ſ ñandú", "es", "d"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1]), *("x" for _ in CLASHING)) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, None), (7, 1, 1), (7, 0, 0), (None, 1, 1), (99, 1, 0), (8, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_benchmark(spark):
    rows = [(1, text(4, 12)), (1, text(4, 12)), (2, text(4, 12)), (None, text(5, 15)), (3, None), (4, ""), (5, "one two"), (6, "nothing like it at all anywhere in here or there ever")]
    return spark.createDataFrame(rows, "item_id long, text string")
