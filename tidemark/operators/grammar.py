"""Description grammar: noisy payment descriptions to vocabulary names, kinds and family weights.

Descriptions are parsed once for each distinct one, inside one projection: candidates (prefix and suffix
tokens stripped) are an array, the best is its least element, and names are looked up in literal maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.functions.expressions import let, literal_map


def tokens(description: Column) -> Column:
    return F.filter(F.split(description, r"\s+"), lambda t: t != "")


def _expanded(token: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(C.ABBREVIATIONS), token), token)


def _all_in(part: Column, members) -> Column:
    return F.forall(part, lambda t: t.isin(*members))


def parse(descriptions: DataFrame) -> DataFrame:
    """description -> bases (sorted array), stripped, exact. One row for each row given."""
    known, short = literal_map({b: 1 for b in C.BASES}), literal_map(C.TRUNCATIONS)
    edges = sorted({*C.PREFIXES, *C.SUFFIXES})

    def candidate(t: Column, n: Column, p: Column, q: Column) -> Column:
        def named(core: Column, name: Column) -> Column:
            cut = F.when(F.size(core) == 1, F.try_element_at(short, name))
            whole = F.try_element_at(known, name).isNotNull()
            return F.when(whole, F.struct(F.lit(0).alias("kind"), F.array(name).alias("bases"))).when(cut.isNotNull(), F.struct(F.lit(1).alias("kind"), cut.alias("bases")))

        allowed = _all_in(F.slice(t, F.lit(1), p), C.PREFIXES) & _all_in(F.slice(t, n - q + 1, q), C.SUFFIXES)
        core = F.transform(F.slice(t, p + 1, n - p - q), _expanded)
        found = F.when(allowed, let(core, lambda c: let(F.array_join(c, " "), lambda name: named(c, name))))
        return let(found, lambda x: F.when(x.isNotNull(), F.struct(x["kind"].alias("kind"), (p + q).alias("stripped"), p.alias("p"), q.alias("q"), x["bases"].alias("bases"))))

    def best(t: Column, n: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.least(F.lit(2), n - 1)), lambda p: F.transform(F.sequence(F.lit(0), F.least(F.lit(2), n - p - 1)), lambda q: candidate(t, n, p, q)))
        loose = F.filter(F.transform(t, _expanded), lambda x: ~x.isin(*edges))
        fallback = F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(loose, lambda x: F.try_element_at(short, x)), lambda b: b.isNotNull()))))
        none = F.struct(F.lit(2).alias("kind"), F.lit(99).alias("stripped"), F.lit(0).alias("p"), F.lit(0).alias("q"), fallback.alias("bases"))
        return F.coalesce(F.when(n > 0, F.array_min(F.filter(F.flatten(pairs), lambda c: c.isNotNull()))), none)

    found = descriptions.withColumn("best", let(tokens(F.col("description")), lambda t: best(t, F.size(t))))
    return found.select(*descriptions.columns, F.col("best.bases").alias("bases"), F.col("best.stripped").alias("stripped"), (F.col("best.kind") == 0).alias("exact"))


def _shares() -> dict[str, list[float]]:
    """For each name what it gives to each family, then to each kind."""
    return {
        b: [1.0 / len(C.BASE_FAMILIES[b]) if f in C.BASE_FAMILIES[b] else 0.0 for f in C.FAMILIES] + [float(b in C.KIND_MEMBERS[k]) for k in C.KINDS]
        for b in C.BASES
    }


def evidence(parsed: DataFrame) -> DataFrame:
    """Adds kind and d_<family>: the family weights of the names, normalised to 1 (0 without families)."""
    shares = literal_map(_shares())
    families, kinds = len(C.FAMILIES), len(C.KINDS)

    def summed(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(families + kinds)), lambda i: F.aggregate(rows, F.lit(0.0), lambda s, v: s + F.element_at(v, i)) / F.size(rows))

    def judged(raw: Column) -> Column:
        ranked = F.transform(F.slice(raw, families + 1, kinds), lambda w, i: F.when(w > 0, F.struct(F.round(w, 9).alias("w"), i.alias("i"))))
        kind = F.element_at(F.array(*map(F.lit, C.KINDS)), F.array_max(F.filter(ranked, lambda x: x.isNotNull()))["i"] + 1)
        weights = let(F.aggregate(F.slice(raw, 1, families), F.lit(0.0), lambda s, w: s + w), lambda total: F.transform(F.slice(raw, 1, families), lambda w: F.when(total > 0, w / total).otherwise(0.0)))
        return F.struct(kind.alias("kind"), weights.alias("weights"))

    nothing = F.struct(F.lit("unknown").alias("kind"), F.array(*[F.lit(0.0)] * families).alias("weights"))
    found = let(F.transform("bases", lambda b: F.element_at(shares, b)), lambda rows: F.when(F.size(rows) > 0, let(summed(rows), judged)).otherwise(nothing))
    df = parsed.withColumn("found", found)
    return df.select(*parsed.columns, F.col("found.kind").alias("kind"), *(F.col("found.weights")[i].alias(f"d_{f}") for i, f in enumerate(C.FAMILIES)))


def described(transactions: DataFrame) -> DataFrame:
    """transactions with kind and d_<family>; each distinct description is parsed once."""
    found = evidence(parse(transactions.select("description").distinct())).drop("bases", "stripped", "exact")
    return transactions.join(found, "description", "left")
