"""Keyword stack: families by keyword, amount anchor and merchant code; timelines by family; ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as C
from tidemark.functions.expressions import let, literal_map
from tidemark.operators.streams import main_currency

GROUPS = (*C.FAMILIES, "amb5812", "unknown")


def keyword_family(description: Column) -> Column:
    """First family of which a keyword occurs: words as whole tokens, phrases anywhere."""
    def search(words: Column) -> Column:
        found = F.lit(None).cast("string")
        for family, keywords in reversed(C.KEYWORDS.items()):
            hits = [F.contains(description, F.lit(k)) if " " in k else F.array_contains(words, k) for k in keywords]
            found = F.when(F.array_contains(F.array(*hits), True), family).otherwise(found)
        return found

    return let(F.split(description, r"\s+"), search)


def prepare(transactions: DataFrame) -> DataFrame:
    """Adds kwfam, mccfam, mcc as a number, isnoise, isnonrec and cand."""
    df = transactions.withColumns({"mcc": F.col("mcc").cast("int"), "kwfam": keyword_family(F.col("description")), "isnoise": F.col("description").isin(*C.GENERIC_EVERYDAY), "isnonrec": F.col("description").isin(*C.NON_RECURRING)})
    df = df.withColumn("mccfam", F.try_element_at(literal_map(C.KEYWORD_MCC), F.col("mcc")))
    return df.withColumn("cand", (F.col("direction") == "out") & (F.col("type") == "card_payment") & ~F.col("isnoise") & ~F.col("isnonrec"))


def anchors(named: DataFrame, tolerance: float = 0.04) -> DataFrame:
    """client_id, kwfam, cluster, anchor (median ln amount), support: islands of named payments by family."""
    order = Window.partitionBy("client_id", "kwfam").orderBy("amount", "row_id")
    la = F.ln("amount")
    rows = named.withColumn("la", la).withColumn("step", la - F.lag(la).over(order))
    rows = rows.withColumn("cluster", F.sum(F.when(F.col("step") > tolerance, 1).otherwise(0)).over(order))
    return rows.groupBy("client_id", "kwfam", "cluster").agg(F.median("la").alias("anchor"), F.count("*").alias("support"))


def assign_family(prepared: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """Candidate payments with fam: by keyword, else the best anchor, else merchant code, amb5812 or unknown.

    The best anchor has the least distance over the root of its support among all of the client's; where
    that one is not within the tolerance, it is the nearest that is. Ties go to the first by family and amount.
    A payment meets its client's anchors, not its payments: anchors of a family are over 4 % apart, so their
    number is bounded by the range of amounts, however many payments a client has.
    """
    rows = prepared.where("cand")
    points = anchors(rows.where(F.col("kwfam").isNotNull())).withColumnRenamed("kwfam", "anchor_family")
    loose = rows.where(F.col("kwfam").isNull()).select("client_id", "row_id", F.ln("amount").alias("la"))
    met = loose.join(points, "client_id").withColumn("d", F.abs(F.col("anchor") - F.col("la")))
    place = (F.col("anchor_family").alias("f"), F.col("cluster").alias("c"))
    best = met.groupBy("client_id", "row_id").agg(
        F.min(F.struct((F.col("d") / F.sqrt("support")).alias("s"), *place, F.col("d").alias("d"))).alias("scaled"),
        F.min(F.when(F.col("d") < tolerance, F.struct(F.col("d").alias("d"), *place))).alias("near"),
    )
    linked = best.select("client_id", "row_id", F.when(F.col("near").isNull(), F.lit(None)).when(F.col("scaled.d") < tolerance, F.col("scaled.f")).otherwise(F.col("near.f")).alias("anchored"))
    fam = F.coalesce("kwfam", "anchored", "mccfam", F.when(F.col("mcc") == 5812, "amb5812"), F.lit("unknown"))
    return rows.join(linked, ["client_id", "row_id"], "left").withColumn("fam", fam).drop("anchored")


def timeline(assigned: DataFrame, refunds: DataFrame) -> DataFrame:
    """One row for each client and fam that has payments, with the statistics of its timeline.

    Two passes: medians by window over the family's rows, then one aggregation.
    """
    whole = Window.partitionBy("client_id", "fam")
    order, back = whole.orderBy("dayf", "row_id"), whole.orderBy(F.desc("dayf"), F.desc("row_id"))
    rows = assigned.repartition("client_id").withColumns({"la": F.ln("amount"), "gap": F.col("dayf") - F.lag("dayf").over(order), "back": F.row_number().over(back), "cur_n": F.count("*").over(Window.partitionBy("client_id", "fam", "currency"))})
    rows = rows.withColumns({"med": F.median("la").over(whole), "medgap": F.median("gap").over(whole), "mode_cur": F.min(F.struct(-F.col("cur_n"), "currency")).over(whole)["currency"]})
    main = F.try_element_at(literal_map({f: int(m) for f, m in C.FAMILY_MCC.items()}), F.col("fam"))
    real = F.col("fam").isin(*C.FAMILIES)
    number = lambda c: c.cast("double")
    unnamed, noisy, generic = F.col("kwfam").isNull(), ~F.col("description").isin(*C.CLEAN), F.col("description").isin(*C.GENERIC_SUBSCRIPTION)
    swapped, fee, dev, gap, medgap, day = F.col("mcc") != main, F.col("fee") > 0, F.abs(F.col("la") - F.col("med")), F.col("gap"), F.col("medgap"), F.col("dayf")
    recent = lambda k, c: F.sum(F.when(F.col("back") <= k, number(c)))
    agg = rows.groupBy("client_id", "fam").agg(
        F.count("*").alias("n"), F.min("dayf").alias("first"), F.max("dayf").alias("last"), F.count("kwfam").alias("n_named"),
        F.avg(number(unnamed)).alias("frac_generic"), recent(3, unnamed).alias("generic_last3"), recent(1, unnamed).alias("generic_last1"),
        F.avg(number(noisy)).alias("frac_noisy"), recent(3, noisy).alias("noisy_last3"), F.count_if(noisy).alias("n_noisy"), F.avg(number(generic)).alias("frac_gen_exact"),
        F.avg(number(swapped)).alias("swap_frac"), recent(1, swapped).alias("swap_last1"), recent(3, swapped).alias("swap_last3"), F.sum(F.when(real, swapped.cast("int"))).alias("n_swap"),
        F.sum(F.when(real, (~swapped & ~noisy & ~generic).cast("int"))).alias("n_clean"),
        F.countDistinct("mcc").alias("n_mcc"), F.countDistinct("description").alias("n_desc"), F.countDistinct("currency").alias("n_cur"),
        F.avg(number(fee)).alias("fee_frac"), recent(1, fee).alias("fee_last"), recent(1, F.col("currency") != F.col("mode_cur")).alias("cur_last_diff"),
        F.first("med").alias("logamt"), F.stddev_pop("la").alias("amt_cv"), (F.max("la") - F.min("la")).alias("amt_range"), F.max(F.when(F.col("back") == 1, F.col("la") - F.col("med"))).alias("last_amt_dev"),
        F.max(dev).alias("max_absdev"), F.count_if(dev > 0.03).alias("n_outlier"), F.regr_slope("la", "dayf").alias("slope"),
        *(F.count_if(day > -w).alias(f"n{w}") for w in (30, 45, 60, 90, 180)),
        F.first("medgap").alias("medgap"), F.avg(gap).alias("meangap"), F.stddev_pop(gap).alias("gap_std"), F.min(gap).alias("min_gap"), F.max(gap).alias("max_gap"), F.max(F.when(F.col("back") == 1, gap)).alias("last_gap"),
        F.count_if(gap < 5).alias("dup"), F.count_if(gap > 1.6 * medgap).alias("missed"), F.avg(F.when(gap.isNotNull(), F.coalesce(F.abs(F.try_divide(gap, medgap) - 1) < 0.2, F.lit(False)).cast("double"))).alias("reg"),
        F.stddev_pop(F.dayofmonth("timestamp").cast("double")).alias("dom"),
    )
    many, mg = F.col("n") >= 2, F.when(F.col("medgap") > 0, F.col("medgap"))
    base = agg.withColumns(
        {
            "span": F.col("last") - F.col("first"), "last_amt_absdev": F.abs("last_amt_dev"), "amt_slope": F.when(F.col("n") >= 3, F.col("slope") * 30),
            "noise_score": F.col("swap_frac") + F.col("frac_noisy") + F.col("frac_gen_exact") + F.col("fee_frac"),
            "last_gap_ratio": F.col("last_gap") / mg, "due": F.col("last") + F.col("medgap"), "overdue": -F.col("last") / mg, "due_mean": F.col("last") + F.col("meangap"),
            "n_dup": F.when(many, F.col("dup")), "n_missed": F.when(many, F.col("missed")), "cov90": F.col("n90") * F.col("medgap") / 90.0, "dom_std": F.when(many, F.col("dom")),
        }
    ).drop("slope", "dup", "missed", "dom")
    r = refunds.select("client_id", F.col("amount").alias("r_amount"), F.col("dayf").alias("r_day"), F.col("kwfam").alias("r_fam"))
    near = (F.abs(F.ln(F.col("r_amount") / F.exp("logamt"))) < 0.1) | F.coalesce(F.col("r_fam") == F.col("fam"), F.lit(False))
    hits = base.select("client_id", "fam", "logamt", "last").join(r, "client_id").where(near).groupBy("client_id", "fam").agg(
        F.count("*").alias("nref"), F.max("r_day").alias("ref_last"), F.max((F.col("r_day") > F.col("last")).cast("double")).alias("ref_after_last"), F.count_if(F.col("r_day") > -60).alias("nref60")
    )
    df = base.join(hits, ["client_id", "fam"], "left")
    df = df.withColumns({"nref": F.coalesce("nref", F.lit(0)), "ref_last": F.coalesce("ref_last", F.lit(-999.0)), "ref_after_last": F.coalesce("ref_after_last", F.lit(0.0)), "nref60": F.coalesce("nref60", F.lit(0))})
    return df.withColumn("nref_frac", F.col("nref") / F.col("n"))


def client_summary(prepared: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row for each client: counts, sums and what its candidates were assigned to."""
    refund, day = F.col("type") == "refund", F.col("dayf")
    own = prepared.groupBy("client_id").agg(
        F.count("*").alias("n_txn"), F.min("dayf").alias("first_txn"), F.max("dayf").alias("last_txn"),
        *(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in C.TYPES),
        F.count_if(F.col("direction") == "in").alias("n_in"), F.countDistinct("currency").alias("n_cur"), F.count_if("isnoise").alias("n_noise"), F.count_if("isnonrec").alias("n_nonrec"),
        F.sum("fee").alias("fee_sum"), F.count_if(F.col("fee") > 0).alias("n_feepos"), F.sum(F.when(F.col("description") == "salary", F.col("amount")).otherwise(0.0)).alias("salary_sum"),
        F.sum(F.when(F.col("direction") == "out", F.col("amount")).otherwise(0.0)).alias("out_sum"),
        *(F.count_if(refund & (day > -w)).alias(f"n_ref{w}") for w in (30, 60, 90, 180)), *(F.count_if(day > -w).alias(f"n_txn{w}") for w in (30, 60, 90, 180)),
        F.count_if(refund & F.col("kwfam").isNotNull()).alias("ref_rec_named"), F.count_if(refund & F.col("description").isin(*C.GENERIC_SUBSCRIPTION)).alias("ref_generic"), F.count_if(refund & F.col("isnonrec")).alias("ref_nonrec"),
    )
    real = F.col("fam").isin(*C.FAMILIES)
    found = assigned.groupBy("client_id").agg(F.count("*").alias("n_cand"), F.count_if(F.col("fam") == "amb5812").alias("n_amb"), F.count_if(F.col("fam") == "unknown").alias("n_unknown"), F.countDistinct(F.when(real, F.col("fam"))).alias("n_fam_present"))
    place = F.array_position(F.array(*map(F.lit, C.CURRENCIES)), F.col("main_currency")).cast("int") - 1
    df = own.join(main_currency(prepared), "client_id").withColumn("main_cur", place).drop("main_currency").join(found, "client_id", "left")
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_cand", "n_amb", "n_unknown", "n_fam_present")})


def families_long(people: DataFrame, lines: DataFrame) -> DataFrame:
    """One row for each client and real family: f_* of its timeline, its ranks among active families, and oth_* of the others."""
    spine = people.select("client_id").crossJoin(F.broadcast(people.sparkSession.range(len(C.FAMILIES)).select(F.element_at(F.array(*map(F.lit, C.FAMILIES)), F.col("id").cast("int") + 1).alias("fam"), F.col("id").cast("int").alias("fam_id"))))
    own = [c for c in lines.columns if c not in ("client_id", "fam")]
    df = spine.join(lines, ["client_id", "fam"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    df = df.withColumn("act", (F.col("n") >= 2) & (F.col("last") > -75) & F.col("due").isNotNull()).withColumn("act", F.coalesce("act", F.lit(False)))
    client = Window.partitionBy("client_id")
    rank = lambda *o: F.when(F.col("act"), F.row_number().over(client.orderBy(F.desc("act"), *o, "fam_id")) - 1).when(F.max("act").over(client), -1)
    df = df.withColumns({"due_rank": rank("due"), "n_rank": rank(F.desc("n")), "last_rank": rank(F.desc("last")), "n_active": F.count_if("act").over(client), "min_due": F.min(F.when(F.col("act"), F.col("due"))).over(client)})
    df = df.withColumn("due_minus_min", F.when(F.col("n") >= 2, F.col("due") - F.col("min_due")))
    listed = F.collect_list(F.struct("fam_id", "n", "n90", "last", "due")).over(client)
    others = F.filter("listed", lambda x: x["fam_id"] != F.col("fam_id"))
    df = df.withColumn("listed", listed).withColumn("others", others)
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    df = df.withColumns(
        {
            "oth_max_n": F.array_max(F.transform("others", lambda x: zero(x["n"]))),
            "oth_sum_n": F.aggregate("others", F.lit(0).cast("long"), lambda s, x: s + zero(x["n"])),
            "oth_n_active": F.size(F.filter("others", lambda x: x["last"] > -60)),
            "oth_min_due": F.array_min(F.transform(F.filter("others", lambda x: x["last"] > -75), lambda x: x["due"])),
            "oth_max_n90": F.array_max(F.transform("others", lambda x: zero(x["n90"]))),
        }
    ).withColumn("due_minus_oth_min", F.col("due") - F.col("oth_min_due"))
    ranks = ("due_rank", "n_rank", "last_rank", "due_minus_min")
    return df.select("client_id", "fam", "fam_id", *(F.col(c).alias(f"f_{c}") for c in (*own, *ranks)), "n_active", "min_due", "oth_max_n", "oth_sum_n", "oth_n_active", "oth_min_due", "due_minus_oth_min", "oth_max_n90")


def stage_two_inputs(scores: DataFrame) -> DataFrame:
    """client_id, logit_<family>, top1, top2, margin of clipped family scores."""
    clipped = {f: F.least(F.greatest(F.col(f), F.lit(1e-4)), F.lit(1 - 1e-4)) for f in C.FAMILIES}
    df = scores.select("client_id", *(F.ln(p / (1 - p)).alias(f"logit_{f}") for f, p in clipped.items()))
    df = df.withColumn("sorted", F.sort_array(F.array(*(f"logit_{f}" for f in C.FAMILIES)), asc=False))
    return df.withColumns({"top1": F.col("sorted")[0], "top2": F.col("sorted")[1], "margin": F.col("sorted")[0] - F.col("sorted")[1]}).drop("sorted")
