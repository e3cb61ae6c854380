"""How many random strings the token-efficiency test finds, and how many compounds of words it takes for one."""

from __future__ import annotations

import random
import string

import pytest

from tidemark.llm import secret_scan

COMMON = (
    "time year people way day man thing woman life child world school state family student group country problem hand part "
    "place case week company system program question work government number night point home water room mother area money story fact"
).split()


def found(texts):
    path = secret_scan.default_vocabulary()
    return sum(any(kind == "random" for kind, _, _ in secret_scan.find(f"see {t} there", path)) for t in texts) / len(texts)


@pytest.mark.parametrize(("alphabet", "length", "least"), [(string.ascii_letters + string.digits, 24, 0.97), (string.ascii_letters, 24, 0.97), (string.ascii_lowercase, 28, 0.75)])
def test_random_strings(alphabet, length, least):
    rng = random.Random(8)
    assert found(["".join(rng.choice(alphabet) for _ in range(length)) for _ in range(500)]) >= least


def test_compounds_of_words():
    rng = random.Random(9)
    join = (lambda ws: "_".join(ws), lambda ws: "-".join(ws), lambda ws: "/".join(ws), lambda ws: ws[0] + "".join(w.title() for w in ws[1:]))
    assert found([join[i % 4]([rng.choice(COMMON) for _ in range(5)]) for i in range(500)]) == 0.0
