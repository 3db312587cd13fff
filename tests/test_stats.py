"""Order statistics and paired tests against published numbers and brute force."""

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runscore.functions.distributions import t_quantile, t_two_sided
from runscore.operators.models import auc, classification_metrics
from runscore.operators import ordered
from runscore.operators.ordered import exact_percentiles, order_statistics, running_totals
from runscore.operators.prep import impute, iqr_clip, stratified_split
from runscore.operators.profile import describe_numeric, quality_report
from runscore.operators.stats import paired_stats, wilcoxon
from runscore.operators.summary import delta_boxplot, extreme_tasks, overall_metrics
from runscore.operators.workload import residual_anomaly, response_curve, target_top_share

# published (baseline, feedback) values of the twenty tasks that have them
DQS = [
    (70.25, 71.0), (72.0, 72.25), (67.0, 70.0), (54.75, 66.25), (68.0, 71.75), (47.0, 48.75),
    (64.25, 70.25), (64.0, 67.5), (62.25, 62.25), (65.25, 69.75), (59.25, 66.25), (62.0, 60.25),
    (59.0, 65.5), (58.25, 58.5), (66.75, 66.0), (62.5, 61.75), (70.0, 70.75), (64.25, 67.0),
    (73.25, 74.25), (70.5, 72.5),
]
ORS = [
    (37.8, 38.12), (53.73, 70.62), (69.9, 70.33), (71.45, 80.35), (69.18, 63.33), (58.07, 58.92),
    (49.18, 68.55), (33.22, 34.92), (47.95, 71.05), (62.97, 64.03), (29.27, 62.67), (62.15, 61.3),
    (61.47, 63.1), (60.23, 60.45), (67.02, 74.8), (61.58, 61.27), (64.08, 72.5), (62.6, 62.82),
    (69.48, 70.02), (70.02, 70.58),
]
ESR = [(1.0, 1.0)] * 26 + [(0.0, 1.0)] * 4 + [(0.0, 0.0)] * 2
FIS = [(0.0, 0.0)] * 27 + [(0.0, 0.54)] * 4 + [(0.0, -0.44)]
RR = [(0.0, 0.0)] * 32
PUBLISHED = {
    # t, p, W, p, interval, d
    "DQS": (3.5756, 0.0020, 17.5, 0.0018, 1.1166, 4.0834, 0.8203),
    "ORS": (2.6732, 0.0150, 24.5, 0.0027, 1.4020, 10.4360, 0.6133),
    "ESR": (2.1044, 0.0435, 0.0, 0.0455, 0.0058, 0.2442, 0.3780),
    "FIS": (1.5037, 0.1428, 1.0, 0.0660, -0.0180, 0.1255, 0.2701),
}


@pytest.fixture(scope="module")
def published(spark):
    rows = []
    for metric, values in (("DQS", DQS), ("ORS", ORS), ("ESR", ESR), ("FIS", FIS), ("RR", RR)):
        rows += [
            (metric, f"task_{i:03d}", b, f, round(f - b, 4), f > b)
            for i, (b, f) in enumerate(values)
        ]
        rows.append((metric, "task_999", None, 1.0, None, None))
    return spark.createDataFrame(
        rows, "metric string, task_id string, baseline double, feedback double, delta double, "
        "improved boolean",
    )


def test_published_paired_statistics(published):
    found = {r["metric"]: r for r in paired_stats(published).collect()}
    for metric, expected in PUBLISHED.items():
        r = found[metric]
        got = (r["t"], r["t_p"], r["w"], r["w_p"], r["ci_low"], r["ci_high"], r["cohen_d"])
        assert got == pytest.approx(expected, abs=1e-4), metric
    zero = found["RR"]
    assert zero["n"] == 32 and zero["w"] == 0.0 and zero["cohen_d"] == 0.0
    assert all(math.isnan(zero[c]) for c in ("t", "t_p", "w_p", "ci_low", "ci_high"))


def test_published_overall_metrics(published):
    complete = published.where("baseline is not null")
    found = {r["metric"]: r for r in overall_metrics(complete).collect()}
    r = found["DQS"]
    assert (r["baseline_mean"], r["feedback_mean"], r["mean_delta"]) == (64.025, 66.625, 2.6)
    assert (r["median_delta"], r["std_dev"], r["improvement_pct"]) == (1.875, 3.1696, 4.06)
    assert found["FIS"]["improvement_pct"] == 0.0
    assert found["ORS"]["improvement_pct"] == pytest.approx(10.19)


def test_t_distribution():
    assert t_two_sided(2.0930240544, 19) == pytest.approx(0.05, abs=1e-9)
    assert t_quantile(0.95, 19) == pytest.approx(2.0930240544, abs=1e-8)


def skewed(seed=3, n=3000):
    """A third of all rows share one group and one value."""
    dice = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append(("hot", 5.0, i))
        else:
            group = dice.choice(["hot", "a", "b", None])
            value = dice.choice([0.0, -1.5, None, dice.gauss(0, 10), dice.random() * 1e-9, 1e12])
            rows.append((group, value, i))
    return rows


def quantile(values, fraction):
    values = sorted(values)
    at = (len(values) - 1) * fraction
    low = math.floor(at)
    high = math.ceil(at)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_percentiles_match_brute_force(spark):
    rows = skewed()
    table = spark.createDataFrame(rows, "g string, v double, k long").repartition(7)
    found = {
        r["g"]: r
        for r in exact_percentiles(
            table, "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}, ["g"]
        ).collect()
    }
    for group in {r[0] for r in rows}:
        values = [v for g, v, _ in rows if g == group and v is not None]
        assert found[group]["total"] == len(values)
        for name, fraction in (("a", 0.0), ("b", 0.1), ("c", 0.5), ("d", 0.77), ("e", 1.0)):
            assert found[group][name] == pytest.approx(quantile(values, fraction))
    alone = exact_percentiles(table, "v", {"m": 0.5}).first()["m"]
    assert alone == pytest.approx(statistics.median(v for _, v, _ in rows if v is not None))


def test_many_groups(spark):
    groups = 12_000
    table = spark.range(groups).select(
        F.col("id").alias("g"),
        F.explode(F.array(F.col("id").cast("double"), F.col("id") + 1.0)).alias("v"),
    )
    found = exact_percentiles(table, "v", {"m": 0.5}, ["g"])
    wrong = found.where(F.abs(F.col("m") - F.col("g") - 0.5) > 1e-9)
    assert found.count() == groups and wrong.count() == 0


def jobs_of(spark, build):
    """Number of jobs that building a frame starts."""
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    build()
    return len(set(tracker.getJobIdsForGroup(None)) - before)


def test_building_a_plan_starts_no_job(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    pairs = spark.createDataFrame(
        [("a", "t", 1.0, 2.0, 1.0, True)],
        "metric string, task_id string, baseline double, feedback double, delta double, improved boolean",
    )
    assert jobs_of(spark, lambda: describe_numeric(lines)) == 0
    assert jobs_of(spark, lambda: quality_report(lines)) == 0
    assert jobs_of(spark, lambda: impute(lines, "l_tax", by=["l_returnflag"])) == 0
    assert jobs_of(spark, lambda: iqr_clip(lines, "l_tax")) == 0
    assert jobs_of(spark, lambda: stratified_split(lines, "l_returnflag", "l_orderkey")) == 0
    assert jobs_of(spark, lambda: target_top_share(lines, "l_tax", F.col("l_tax") > 0, "l_orderkey")) == 0
    assert jobs_of(spark, lambda: residual_anomaly(lines, "l_tax", "l_returnflag")) == 0
    assert jobs_of(spark, lambda: delta_boxplot(pairs)) == 0
    assert jobs_of(spark, lambda: extreme_tasks(pairs)) == 0


def test_counts_precede_the_shuffle(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    found = exact_percentiles(lines, "l_quantity", {"m": 0.5}, ["l_returnflag"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    # what is shuffled was counted per distinct value first
    assert plan.index("partial_count") < plan.index("FileScan")


def narrow(spark, rows=1_000_000):
    """A million values within 1000 of each other, a third of the rows at one of them."""
    i = F.col("id")
    offset = F.when(i % 3 == 0, F.lit(500.0)).otherwise(F.pmod(i * 7919, F.lit(rows)) / (rows / 1000.0))
    return spark.range(0, rows, 1, 8).select(F.lit("g").alias("g"), (F.lit(1.7e9) + offset).alias("v"))


def test_narrow_ranges_and_hot_values_are_split(spark):
    table = narrow(spark)
    counted = table.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    cuts = counted.groupBy("g").agg(ordered._splitters("v").alias("cuts"))
    number = ordered._range_of(F.col("v"), F.col("cuts")).alias("range")
    sizes = [r["count"] for r in ordered.attach(counted, cuts, ["g"]).select(number).groupBy("range").count().collect()]
    assert len(sizes) >= 128 and max(sizes) <= 0.02 * sum(sizes)


def test_narrow_ranges_match_plain_percentiles(spark):
    table = narrow(spark, 200_000)
    found = exact_percentiles(table, "v", {"a": 0.25, "b": 0.5, "c": 0.999}, ["g"]).first()
    wanted = table.agg(F.percentile("v", [0.25, 0.5, 0.999]).alias("p")).first()["p"]
    assert [found[c] for c in "abc"] == pytest.approx(wanted, abs=1e-6)
    counted = table.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    totals = running_totals(counted, "v", ["n"], ["g"])
    plain = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    checked = totals.withColumn("want", F.coalesce(F.sum("n").over(plain), F.lit(0)))
    assert checked.where("n_before <> want").count() == 0


def test_whole_numbers_are_not_rounded(spark):
    base = 2**62
    table = spark.createDataFrame([(base + i,) for i in range(9)], "v long")
    row = order_statistics(table, "v", {"first": F.lit(0), "fourth": F.lit(3)}).first()
    assert (row["first"], row["fourth"], row["total"]) == (base, base + 3, 9)


def test_nan_is_missing(spark):
    nan = float("nan")
    table = spark.createDataFrame([(1.0, "a"), (nan, "a"), (3.0, "a"), (None, "a")], "v double, g string")
    row = describe_numeric(table, ["v"]).first()
    assert (row["count"], row["mean"], row["min"], row["p50"], row["max"]) == (2, 2.0, 1.0, 2.0, 3.0)
    for by in ([], ["g"]):
        filled = impute(table, "v", by=by).collect()
        assert sorted(r["v"] for r in filled) == [1.0, 2.0, 2.0, 3.0]


def signed(spark, differences):
    rows = [("m", 0.0, float(d)) for d in differences]
    return spark.createDataFrame(rows, "metric string, baseline double, feedback double")


def brute_p(differences):
    """Two-sided p over all signs of the ranks."""
    m = len(differences)
    order = sorted(differences, key=abs)
    up = sum(i + 1 for i, d in enumerate(order) if d > 0)
    w = min(up, m * (m + 1) // 2 - up)
    sums = [sum(r for r, s in zip(range(1, m + 1), signs) if s) for signs in itertools.product([0, 1], repeat=m)]
    return min(1.0, 2 * sum(s <= w for s in sums) / 2**m)


@pytest.mark.parametrize("differences", [range(1, 9), [1, -2, 3, -4, 5], [-1], [3, -1, 2, -7, 6, 9, -10, 11, 4, 12]])
def test_exact_signed_rank_p(spark, differences):
    for method in ("exact", "auto"):
        got = wilcoxon(signed(spark, differences), ["metric"], method=method).first()["w_p"]
        assert got == pytest.approx(brute_p(list(differences)))
    if list(differences) == list(range(1, 9)):
        assert got == pytest.approx(0.0078125)


def test_exact_p_needs_untied_differences(spark):
    for differences in ([1, 1, 2], [0, 1, 2], [1, -1, 2]):
        table = signed(spark, differences)
        exact, normal = (wilcoxon(table, ["metric"], method=m).first()["w_p"] for m in ("exact", "approx"))
        assert exact == normal
    many = signed(spark, range(1, 61))
    auto, normal, exact = (wilcoxon(many, ["metric"], method=m).first()["w_p"] for m in ("auto", "approx", "exact"))
    assert auto == normal and exact == pytest.approx(2.0**-59)


def test_equal_differences_have_an_infinite_t(spark):
    row = paired_stats(signed(spark, [2, 2, 2])).first()
    assert row["t"] == math.inf and row["t_p"] == 0.0
    assert paired_stats(signed(spark, [-2, -2])).first()["t"] == -math.inf
    assert math.isnan(paired_stats(signed(spark, [0, 0])).first()["t"])
    assert math.isnan(paired_stats(signed(spark, [2])).first()["t"])


def test_order_statistics_outside_group_is_null(spark):
    table = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    row = order_statistics(table, "v", {"first": F.lit(0), "third": F.lit(2)}).first()
    assert (row["first"], row["third"]) == (1.0, None)


def test_running_totals_match_brute_force(spark):
    rows = [(g, v) for g, v, _ in skewed() if v is not None]
    table = spark.createDataFrame(rows, "g string, v double")
    counted = table.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for r in running_totals(counted, "v", ["n"], ["g"]).collect():
        assert r["n_before"] == sum(1 for g, v in rows if g == r["g"] and v < r["v"])


def test_auc_matches_brute_force(spark):
    dice = random.Random(5)
    rows = [(round(dice.random(), 1), dice.random() < 0.4) for _ in range(300)]
    got = auc(spark.createDataFrame(rows, "s double, p boolean"), "s", F.col("p")).first()["auc"]
    wins = [
        1.0 if a > b else 0.5 if a == b else 0.0
        for a, p in rows if p for b, q in rows if not q
    ]
    assert got == pytest.approx(sum(wins) / len(wins))


def test_macro_f1_counts_unpredicted_classes(spark):
    rows = [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (2.0, 2.0)]
    got = classification_metrics(spark.createDataFrame(rows, "label double, prediction double"))
    assert got.first()["f1_macro"] == pytest.approx((0.8 + 0.0 + 1.0) / 3)


def test_split_is_exact_and_keeps_copies_together(spark):
    rows = [("x" if i % 4 else "y", i) for i in range(1000)] + [("x", 7)] * 400
    split = stratified_split(spark.createDataFrame(rows, "c string, k long"), "c", "k")
    y = split.where("c = 'y'").groupBy("is_train").count().collect()
    assert {r["is_train"]: r["count"] for r in y} == {True: 200, False: 50}
    mixed = split.groupBy("k").agg(F.count_distinct("is_train").alias("n")).where("n > 1")
    assert mixed.count() == 0


def test_ranks_do_not_gather_a_group_in_one_task(spark):
    table = spark.createDataFrame([("a", 1.0, 2.0)], "metric string, baseline double, feedback double")
    plan = paired_stats(table)._jdf.queryExecution().executedPlan().toString()
    # every window over values is also split by range or runs over range totals
    for line in plan.split("\n"):
        if "Window [" in line and "metric" in line:
            assert "__range" in line


def test_split_of_wide_keys_and_infinite_values(spark):
    rows = [("x", k) for i in range(5) for k in (i, 2**31 + i)]
    split = stratified_split(spark.createDataFrame(rows, "c string, k long"), "c", "k", 0.5)
    assert split.where("is_train").count() == 5
    table = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),)], "v double")
    found = exact_percentiles(table, "v", {"m": 0.5, "top": 1.0}).first()
    assert (found["m"], found["top"]) == (2.0, float("inf"))


def test_response_curve_over_many_counts(spark):
    contacts = F.col("id") % 20_000
    rows = spark.range(60_000).select(F.when(F.col("id") > 9, contacts).alias("c"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("y"))
    found = response_curve(rows, "c", F.col("y"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):  # the only window without a key runs over the borders of the ranges
        if "Window [" in line and "rate" in line:
            assert "__range" in line
    got = {r["c"]: (r["rate"], r["marginal"], r["first_without_gain"]) for r in found.collect()}
    seen = {}
    for r in rows.collect():
        n, k = seen.get(r["c"], (0, 0))
        seen[r["c"]] = (n + 1, k + r["y"])
    rates = {c: k / n for c, (n, k) in seen.items()}
    known = sorted(c for c in rates if c is not None)
    gains = {c: rates[c] - rates[p] for p, c in zip(known, known[1:])}
    first = min(c for c, gain in gains.items() if gain <= 0)
    assert set(got) == set(rates)
    for c in known:
        assert got[c] == pytest.approx((rates[c], gains.get(c), first)) if c in gains else got[c][1] is None


def test_a_few_classes_are_not_shuffled_by(spark):
    from runscore.operators import ordered, prep

    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("class"))
    split = prep.with_class_weights(prep.stratified_split(rows, "class", "id", few=True), "class", few=True)
    plan = split._jdf.queryExecution().executedPlan().toString()
    # neither a join by class nor an aggregate that sorts rows with their splitters
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
    shares = split.groupBy("class").agg(F.count_if("is_train").alias("in"), F.count(F.lit(1)).alias("n"), F.max("weight"))
    found = {r[0]: (r[1], r[2]) for r in shares.collect()}
    assert found == {k: (int(0.8 * n), n) for k, (_, n) in found.items()} and set(found) == {None, 0, 1}
    assert ordered.few_groups(rows, ["class"]) and not ordered.few_groups(rows, ["id"])
    many = prep.stratified_split(rows.withColumn("class", F.col("id") % 5_000), "class", "id")
    assert many.where("is_train").count() == 15_000
