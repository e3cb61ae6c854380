"""Client activity over a stream of transactions: counters by window, with late rows dropped behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(transactions: DataFrame, window: str = "30 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """client_id, start, stop, n, n_refunds, amount for each sliding window; for streams and tables alike."""
    rows = transactions.withWatermark("timestamp", late) if transactions.isStreaming else transactions
    counted = rows.groupBy(F.window("timestamp", window, slide).alias("w"), "client_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("type") == "refund").alias("n_refunds"), F.sum("amount").alias("amount")
    )
    return counted.select("client_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "n_refunds", "amount")
