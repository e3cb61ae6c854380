"""Secrets in texts: three fixed patterns, and random strings found by their token efficiency.

A language's words need few tokens of a byte-pair vocabulary, random characters need many: a long
run of key characters with few characters for each token is taken for a secret, unless it is a
digest or identifier of a known form. Runs that a fixed pattern has already marked are not reported
twice.

Defined results: a null text is scanned as the empty text; rows are kept as often as they come, with
all their columns (an own `spans` column is replaced); an empty table gives an empty result; texts
are scanned whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Kinds in the order in which spans of equal start are listed. Fixed values.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that are looked at for randomness, and the characters for each token below which they count as random.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
RATIO = 2.1
#: Digests by their length in hex digits, and identifiers of a known form: UUIDs, numbers, dates. Fixed values.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|sha(?:1|256|384|512)-[A-Za-z0-9+/]+=*)")
IDENTIFIER = re.compile(r"(?:\{?[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\}?|[0-9_=+/-]+|[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9A-Za-z+-]+)")
#: Characters of a run that go through the tokenizer at once.
BLOCK = 256


@cache
def _encoder(path: str):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.tiktoken")


def is_random(run: str, vocabulary: str, ratio: float = RATIO) -> bool:
    if DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
        return False
    encode = _encoder(vocabulary).encode_ordinary
    tokens = sum(len(encode(run[at : at + BLOCK])) for at in range(0, len(run), BLOCK))
    return len(run) < ratio * tokens


def find(text: str | None, vocabulary: str, ratio: float = RATIO) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    taken = sorted((start, end) for _, start, end in found)
    at = 0
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if not any(start < m.end() and end > m.start() for start, end in _until(taken, at, m.end())) and is_random(m.group(), vocabulary, ratio):
            found.append(("random", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _until(spans: list[tuple[int, int]], at: int, end: int) -> Iterator[tuple[int, int]]:
    while at < len(spans) and spans[at][0] < end:
        yield spans[at]
        at += 1


def scan(docs: DataFrame, vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """docs with spans: array of (kind, start, end), by start and kind."""
    path = vocabulary or default_vocabulary()
    own = docs.drop("spans")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t.as_py(), path, ratio)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "spans"])

    added = StructType.fromDDL("spans array<struct<kind:string,start:bigint,end:bigint>>")
    return own.mapInArrow(run, StructType([*own.schema.fields, *added.fields]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(docs: DataFrame) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", *map(count, KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans")
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", vocabulary: str | None = None) -> DataFrame:
    """docs with every span of a text replaced by mask, overlapping ones by one; n_chars follows where it is there."""
    path = vocabulary or default_vocabulary()

    def clean(text: str) -> str:
        parts, at = [], 0
        for _, start, end in find(text, path):
            if start >= at:
                parts += [text[at:start], mask]
            at = max(at, end)
        return "".join([*parts, text[at:]]) if parts else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := v.as_py()) is None else clean(t) for v in batch.column("text")]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    cleaned = docs.mapInArrow(run, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else cleaned
