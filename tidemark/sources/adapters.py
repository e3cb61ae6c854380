"""Transaction tables made from the driver's tables, as the private data is not at hand.

`transactions` reads card-like activity from `events` (30 days of history), `long_transactions` several
years of it from `lineitem` and `orders`. Both give row_id, client_id, timestamp, date, day (whole days
to the cutoff, negative), dayf (fractional days), amount, currency, direction, type, mcc, description, fee.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.functions.hashing import digit_sum, uniform

CUTOFF = "2024-02-01"
LONG_CUTOFF = "2002-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return _at(F.array(*map(F.lit, values)), index)


def _at(values: Column, index: Column) -> Column:
    """The value at index, from 0; null for null, where element_at of Spark's generated code gives the last value."""
    return F.when(index.isNotNull(), F.element_at(values, (index + 1).cast("int")))


def _described(df: DataFrame, number: str, k: str) -> DataFrame:
    """Adds mcc, description and fee from amount, type, a row number and k."""
    family = F.pmod(F.floor(F.ln("amount") * 8), F.lit(7))
    names = F.array(*(F.array(*map(F.lit, C.FAMILY_NAMES[f][:4])) for f in C.FAMILIES))
    n, k = F.col(number), F.col(k)
    df = df.withColumn("fam", family.cast("int"))
    df = df.withColumn("base", _at(_at(names, F.col("fam")), n % 4))
    last = n % 10
    description = (
        F.when(F.col("type") == "refund", F.col("base"))
        .when(last == 4, F.concat(F.lit("pay "), "base", F.lit(" online")))
        .when(last == 5, F.concat(F.lit("member "), "base"))
        .when(last == 6, F.element_at(F.split("base", " "), 1))
        .when(last == 7, _pick(C.GENERIC_SUBSCRIPTION, k % 4))
        .when(last == 8, _pick(C.EVERYDAY, k % 10))
        .when((last == 9) & (k % 2 == 0), _pick(C.GENERIC_EVERYDAY, k % 4))
        .when(last == 9, F.concat(F.lit("alien vendor "), k.cast("string")))
        .otherwise(F.col("base"))
    )
    mcc = F.when(k % 10 == 0, _pick(C.CARD_MCCS, last)).otherwise(_pick([C.FAMILY_MCC[f] for f in C.FAMILIES], F.col("fam")))
    return df.withColumns({"description": description, "mcc": mcc, "fee": F.when(k % 20 == 0, 0.5).otherwise(0.0)})


def _dated(df: DataFrame, cutoff: str) -> DataFrame:
    at = F.lit(cutoff).cast("timestamp")
    return df.withColumns(
        {
            "date": F.to_date("timestamp"),
            "day": F.datediff(F.to_date("timestamp"), F.lit(cutoff).cast("date")),
            "dayf": (F.unix_micros("timestamp") - F.unix_micros(at)) / F.lit(86_400_000_000.0),
        }
    )


COLUMNS = ("row_id", "client_id", "timestamp", "date", "day", "dayf", "amount", "currency", "direction", "type", "mcc", "description", "fee")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of events in the shape of transactions, amounts of 0 too."""
    events = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"\d+", 0).cast("int")
    df = events.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("C"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("client_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("amount"),
        k.alias("k"),
        F.when(F.col("event_type") == "error", "refund")
        .when(F.col("event_type") == "signup", _pick(("topup", "p2p_transfer", "transfer", "atm", "fee"), F.col("event_id") % 5))
        .otherwise("card_payment")
        .alias("type"),
    )
    df = df.withColumn("currency", F.when(F.col("k") % 10 < 7, "chf").when(F.col("k") % 10 < 9, "eur").otherwise("usd"))
    df = df.withColumn("direction", F.when(F.col("type").isin("refund", "topup"), "in").otherwise("out"))
    return _dated(_described(df, "row_id", "k"), CUTOFF).select(*COLUMNS)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_transactions(spark, sf_dir).where("amount > 0")


ROWS_IN_A_PART = 200_000


def long_transactions(spark: SparkSession, sf_dir: str, by_client: bool = False) -> DataFrame:
    """lineitem with its order's customer as client; row_id is a hash of the whole row, as no key is unique.

    Lines meet their orders, and with by_client are dealt by client, as narrow rows: what follows from them is
    computed afterwards."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    text = F.concat_ws("|", *(F.col(c).cast("bigint").cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    narrow = lines.where("l_extendedprice > 0").select(
        "l_orderkey",
        F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").alias("row_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_extendedprice").alias("amount"),
        (F.col("l_partkey") % 100).cast("int").alias("k"),
        (F.lower("l_linestatus") == "o").alias("open"),
        (F.col("l_returnflag") == "R").alias("returned"),
    )
    client = F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("client_id")
    df = narrow.join(orders, narrow["l_orderkey"] == orders["o_orderkey"]).select("row_id", client, "timestamp", "amount", "k", "open", "returned")
    if by_client:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // ROWS_IN_A_PART + 1)
        df = df.repartition(parts, "client_id")
    df = df.select(
        "row_id", "client_id", "timestamp", "amount", "k", F.when(F.col("open"), "chf").otherwise("eur").alias("currency"), F.when(F.col("returned"), "refund").otherwise("card_payment").alias("type")
    )
    df = df.withColumn("direction", F.when(F.col("type") == "refund", "in").otherwise("out"))
    return _dated(_described(df, "row_id", "k"), LONG_CUTOFF).select(*COLUMNS)


def clients(transactions: DataFrame) -> DataFrame:
    """client_id, split and label of each client, by hash."""
    split = _pick(("train", "valid", "test", "unlabeled"), digit_sum(F.concat(F.lit("split:"), "client_id")) % 4)
    label = _pick(C.CLASSES, digit_sum(F.col("client_id")) % len(C.CLASSES))
    return transactions.select("client_id").distinct().select("client_id", split.alias("split"), label.alias("label"))


def scores(people: DataFrame, seed: int) -> DataFrame:
    """client_id and, for each class, a chance by hash; a stand-in for a model's output."""
    raw = {c: uniform(seed, F.concat(F.col("client_id"), F.lit(f":{c}")), "p") for c in C.CLASSES}
    df = people.select("client_id", "label", *(u.alias(c) for c, u in raw.items()))
    df = df.withColumns({c: F.col(c) + F.when(F.col("label") == c, 0.5).otherwise(0.0) for c in C.CLASSES})
    total = sum((F.col(c) for c in C.CLASSES[1:]), F.col(C.CLASSES[0]))
    return df.select("client_id", *((F.col(c) / total).alias(c) for c in C.CLASSES))
