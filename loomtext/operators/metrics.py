"""Classification, explanation and running metrics, and significance tests, from counts that Spark aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import labels as L
from loomtext.functions import text as X


#: Discordant pairs up to which McNemar's test is exact.
EXACT_PAIRS = 100_000


def confusion(df: DataFrame, true: Column, pred: Column, by: list[str] | None = None) -> DataFrame:
    """(by, y, p, n): counts of true and predicted label; rows with a null in either are dropped."""
    return df.select(*(by or []), true.alias("y"), pred.alias("p")).where("y IS NOT NULL AND p IS NOT NULL").groupBy(*(by or []), "y", "p").agg(F.count("*").alias("n"))


def class_report(conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, label, precision, recall, f1, support, tp, predicted); the labels are those of either side, 0 for 0 / 0."""
    by = by or []
    rows = conf.select(*by, F.explode(F.array(F.struct(F.col("y").alias("label"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("q")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("q")))).alias("r"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    per = rows.groupBy(*by, F.col("r.label").alias("label")).agg(F.sum("r.s").alias("support"), F.sum("r.q").alias("predicted"), (F.sum("hit") / 2).cast("bigint").alias("tp"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = zero(F.col("tp"), F.col("predicted")), zero(F.col("tp"), F.col("support"))
    return per.select(*by, "label", p.alias("precision"), r.alias("recall"), zero(2 * p * r, p + r).alias("f1"), "support", "tp", "predicted")


def summary(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, accuracy, macro and weighted precision, recall and F1, balanced_accuracy, kappa)."""
    w = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    po = F.sum("tp") / F.sum("support")
    pe = F.sum(F.col("support") * F.col("predicted")) / (F.sum("support") * F.sum("support"))
    return report.groupBy(*(by or [])).agg(
        F.sum("support").alias("n"),
        F.round(po, 6).alias("accuracy"),
        *(F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")),
        *(F.round(w(c), 6).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")),
        F.round(F.avg(F.when(F.col("support") > 0, F.col("recall"))), 6).alias("balanced_accuracy"),
        F.round(F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(0.0)), 6).alias("kappa"),
    )


def mcnemar(df: DataFrame, true: Column, a: Column, b: Column) -> DataFrame:
    """(both, only_a, only_b, neither, p): exact two-sided test on the discordant pairs; 1 where there are none.

    Up to EXACT_PAIRS discordant pairs the binomial tail is summed exactly; beyond, it is that of the normal distribution
    with continuity correction, whose error is then below a thousandth of p.
    """
    right_a, right_b = F.coalesce(a == true, F.lit(False)), F.coalesce(b == true, F.lit(False))
    counts = df.where(true.isNotNull()).agg(F.count_if(right_a & right_b).alias("both"), F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(~right_a & right_b).alias("only_b"), F.count_if(~right_a & ~right_b).alias("neither"))
    n, m = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    exact = n <= EXACT_PAIRS
    # log C(n, k) grows by log((n - k + 1) / k): a running sum over k
    steps = F.when(exact & (m > 0), F.sequence(F.lit(1).cast("bigint"), m)).otherwise(F.expr("cast(array() as array<bigint>)"))
    first = F.struct((-n * F.log(F.lit(2.0))).alias("l"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    tail = F.aggregate(steps, first, lambda acc, k: F.struct((acc["l"] + F.log((n - k + 1) / k)).alias("l"), (acc["s"] + F.exp(acc["l"] + F.log((n - k + 1) / k))).alias("s")))
    far = F.greatest(F.lit(0.0), F.abs(F.col("only_a") - F.col("only_b")) - 1.0) / F.sqrt(n.cast("double"))
    p = F.when(n == 0, 1.0).when(exact, F.least(F.lit(1.0), 2 * tail["s"])).otherwise(F.least(F.lit(1.0), two_sided(far)))
    return counts.withColumn("p", F.round(p, 6)).withColumn("significant", F.col("p") < 0.05)


def two_sided(z: Column) -> Column:
    """Both tails of the normal distribution, by a rational approximation of erfc with an error below 1.2e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def replicate_weight(key: Column, replicate: Column) -> Column:
    """How often a row is drawn in a bootstrap replicate: Poisson(1) by inverse transform of an MD5 number.

    Rows are weighted where they stand; no row is sent or sorted for a replicate.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("/", key.cast("string"), replicate.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]
    out = F.lit(len(cuts))
    for k in range(len(cuts) - 1, -1, -1):
        out = F.when(u < cuts[k], k).otherwise(out)
    return out


def bootstrap(df: DataFrame, key: Column, value: Column, replicates: int = 200) -> DataFrame:
    """(n, mean, lower, upper, std) of the mean of value: 95 % percentile interval and population deviation.

    Each row meets each replicate where it is read, and only sums by replicate are shuffled.
    """
    base = df.select(key.alias("k"), value.cast("double").alias("v")).where("v IS NOT NULL")
    each = base.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", replicate_weight(F.col("k"), F.col("r")))
    means = each.groupBy("r").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m")).where("m IS NOT NULL")
    spread = means.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.expr("percentile(m, 0.025)"), 6).alias("lower"), F.round(F.expr("percentile(m, 0.975)"), 6).alias("upper"), F.round(F.stddev_pop("m"), 6).alias("std"))
    return base.agg(F.count("*").alias("n")).join(F.broadcast(spread))  # one row each


def paired_bootstrap(df: DataFrame, key: Column, a: Column, b: Column, replicates: int = 200) -> DataFrame:
    """(n, delta, p): the mean of a - b and the share of replicates in which it is not above 0."""
    base = df.select(key.alias("k"), (a.cast("double") - b.cast("double")).alias("v")).where("v IS NOT NULL")
    each = base.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", replicate_weight(F.col("k"), F.col("r")))
    means = each.groupBy("r").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    p = means.agg(F.round(F.avg(F.when(F.col("m") <= 0, 1.0).otherwise(0.0)), 6).alias("p"))
    return base.agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("delta")).join(F.broadcast(p))  # one row each


def wilcoxon(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n, w_plus, w_minus, z, p): signed ranks with ties averaged, normal approximation with tie correction.

    Equal differences are counted first; ranks come from running counts over the distinct values, cut into ranges whose
    totals are summed before, so no task sorts all rows.
    """
    diffs = df.select((a - b).alias("d")).where("d IS NOT NULL AND d <> 0").withColumn("m", F.round(F.abs("d"), 9))
    ties = diffs.groupBy("m").agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("plus"))
    cut = F.floor(F.log2(F.col("m") + 1e-12) * 8)
    ranges = ties.withColumn("cut", cut)
    before = ranges.groupBy("cut").agg(F.sum("t").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("cut")) - F.col("c")).select("cut", "before")  # hundreds of ranges
    ranked = ranges.join(F.broadcast(before), "cut").withColumn("rank", F.col("before") + F.sum("t").over(Window.partitionBy("cut").orderBy("m")) - (F.col("t") - 1) / 2.0)
    sums = ranked.agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("plus"))).alias("w_minus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)
    return sums.select("n", F.round("w_plus", 3).alias("w_plus"), F.round("w_minus", 3).alias("w_minus"), F.round(z, 6).alias("z"), F.round(two_sided(z), 6).alias("p"))


def krippendorff_ordinal(df: DataFrame, item: str, rating: str) -> DataFrame:
    """(items, alpha): ordinal agreement of the ratings of items with two ratings or more; 1 without any.

    Ratings are whole numbers of a short scale; the coincidence matrix has the square of its length.
    """
    counts = df.where(F.col(rating).isNotNull()).groupBy(item, rating).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(item).agg(F.sum("c").alias("m")).where("m > 1")
    per = counts.join(sizes, item)
    left, right = per.select(item, F.col(rating).alias("x"), F.col("c").alias("cx"), "m"), per.select(item, F.col(rating).alias("y"), F.col("c").alias("cy"))
    o = left.join(right, item).groupBy("x", "y").agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("cx") * (F.col("cx") - 1)).otherwise(F.col("cx") * F.col("cy")) / (F.col("m") - 1)).alias("o"))
    n = o.groupBy(F.col("x").alias("v")).agg(F.sum("o").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("v")))  # one row for each point of the scale
    a, b = n.select(F.col("v").alias("x"), F.col("n").alias("nx"), F.col("upto").alias("ux")), n.select(F.col("v").alias("y"), F.col("n").alias("ny"), F.col("upto").alias("uy"))
    grid = a.join(b, F.col("x") < F.col("y")).withColumn("d", F.pow(F.col("uy") - F.col("ux") - F.col("ny") + F.col("nx") + F.col("ny") - (F.col("nx") + F.col("ny")) / 2, F.lit(2)))  # points of the scale
    both = grid.join(o, ["x", "y"], "left")
    total = n.agg(F.sum("n").alias("all"))
    out = both.agg(F.sum(F.coalesce("o", F.lit(0.0)) * F.col("d")).alias("do"), F.sum(F.col("nx") * F.col("ny") * F.col("d")).alias("de"))
    items = sizes.agg(F.count("*").alias("items"))
    return items.join(F.broadcast(total)).join(F.broadcast(out)).select("items", F.round(F.coalesce(1 - (F.col("all") - 1) * F.col("do") / F.nullif("de", F.lit(0.0)), F.lit(1.0)), 6).alias("alpha"))  # one row each


def relevance_f1(df: DataFrame, pred: str, gold: str) -> Column:
    """Token-set F1 of two texts; 1 where both have no tokens."""
    p, g = F.array_distinct(X.tokens(pred)), F.array_distinct(X.tokens(gold))
    both = F.size(F.array_intersect(p, g))
    precision, recall = F.try_divide(both, F.size(p)), F.try_divide(both, F.size(g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).otherwise(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))


def without_quotes(text: str, quotes: Column) -> Column:
    """The text with each quote removed and white space squeezed."""
    return X.squeeze(F.aggregate(quotes, F.col(text), lambda t, q: F.replace(t, q, F.lit(" "))))


def running(df: DataFrame, group: str, order: list[str], error: Column, latency: Column) -> DataFrame:
    """df with n, errors, error_rate and slowest so far, in arrival order within each group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({"n": F.count("*").over(w), "errors": F.sum(error.cast("bigint")).over(w), "slowest": F.max(latency).over(w)}).withColumn("error_rate", F.round(F.col("errors") / F.col("n"), 6))


def early_stopping(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """df with `best` so far (least value) and `waited`, the number of rows since it last improved."""
    w = Window.partitionBy(group).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumns({"best": F.min(value).over(upto), "_n": F.row_number().over(w), "_up": before.isNull() | (F.col(value) < before)})
    return marked.withColumn("waited", (F.col("_n") - F.max(F.when(F.col("_up"), F.col("_n"))).over(upto)).cast("bigint")).drop("_n", "_up")


def flattened(summaries: DataFrame, by: str, names: list[str]) -> DataFrame:
    """(key, value): each metric of each part as <part>_<metric>."""
    return summaries.unpivot(by, names, "metric", "value").select(F.concat_ws("_", by, "metric").alias("key"), "value")


def trait_report(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """class_report by trait of strings O:HIGH,C:LOW,...; traits that only one of the strings names are left out."""
    both = df.select(F.explode(L.parse_trait_string(gold)).alias("trait", "y"), L.parse_trait_string(predicted).alias("p"))
    each = both.select("trait", "y", F.element_at("p", F.col("trait")).alias("p"))
    return class_report(confusion(each, F.col("y"), F.col("p"), ["trait"]), ["trait"])


def micro(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, micro_precision, micro_recall, micro_f1), from the sums over the classes."""
    zero = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, s, q = F.sum("tp"), F.sum("support"), F.sum("predicted")
    return report.groupBy(*(by or [])).agg(zero(tp, q).alias("micro_precision"), zero(tp, s).alias("micro_recall"), zero(2 * tp, s + q).alias("micro_f1"))


def best(summaries: DataFrame, by: str, method: str, score: str) -> DataFrame:
    """(by, method, score): the method with the greatest score; of equal ones the last in order."""
    top = F.max_by(F.struct(method, score), F.struct(score, method))
    return summaries.groupBy(by).agg(top.alias("t")).select(by, f"t.{method}", f"t.{score}")


def log_loss(df: DataFrame, probability: str, by: list[str]) -> DataFrame:
    """(by, n, log_loss): the mean of -ln of the probability given to the true class, of at least 1e-15."""
    return df.where(F.col(probability).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(-F.log(F.greatest(F.col(probability), F.lit(1e-15)))), 6).alias("log_loss"))


def by_position(first: DataFrame, second: DataFrame, by: str, order: str, buckets: int = 64) -> DataFrame:
    """Rows (by, place, order, other) of two tables that have the same place in the order of their group.

    Places are found from counts per bucket of the order's range, so no group is sorted in one task.
    """

    def placed(df: DataFrame) -> DataFrame:
        ends = df.groupBy(by).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
        cut = F.least(F.lit(buckets - 1), F.floor((F.col(order) - F.col("_lo")) * buckets / (F.col("_hi") - F.col("_lo") + 1)))
        cells = df.join(ends, by).withColumn("_cell", cut).drop("_lo", "_hi")
        counts = cells.groupBy(by, "_cell").agg(F.count("*").alias("_n"))
        before = counts.select(by, "_cell", (F.sum("_n").over(Window.partitionBy(by).orderBy("_cell")) - F.col("_n")).alias("_before"))  # at most `buckets` rows a group
        return cells.join(before, [by, "_cell"]).withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy(by, "_cell").orderBy(order))).select(by, "place", order)

    return placed(first).join(placed(second).withColumnRenamed(order, "other"), [by, "place"])
