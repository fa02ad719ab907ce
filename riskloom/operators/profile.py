"""Profiles and column analysis. Every operator is one conditional aggregation, never a chain of joins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import bool_double, day_no, prefix
from riskloom.operators.skew import join_unique, null_safe_join
from riskloom.schema import ACTIVITY_EDGES


def _count_true(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole, F.lit(0))


# --- per-key profiles -------------------------------------------------------------------------

def spend_profile(df: DataFrame, key: str, amount: str, ts: str, months: float) -> DataFrame:
    """Spend per key: totals, spread, active days and months, and averages per month of the span.

    Rows are combined to (key, day) first, so distinct days are counted on days; the spread is put together from those of the days.
    """
    value = F.col(amount)
    days = df.groupBy(key, F.to_date(ts).alias("_day")).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"), F.avg(value).alias("_m"), (F.var_pop(value) * F.count(value)).alias("_v"))
    count, total = F.sum("_n"), F.sum("_s")
    apart = F.sum(F.col("_n") * F.col("_m") * F.col("_m")) - F.pow(F.sum(F.col("_n") * F.col("_m")), 2) / count
    spread = F.when(count > 1, F.sqrt(F.greatest(F.lit(0.0), F.sum("_v") + apart) / (count - 1)))
    return days.groupBy(key).agg(
        total.alias("amount_sum"), F.try_divide(total.cast("double"), count).alias("amount_avg"), spread.alias("amount_std"),
        count.alias("txn_cnt"), F.count("_day").alias("active_days"), F.count_distinct(F.trunc("_day", "month")).alias("active_months"),
        (total / months).alias("amount_per_month"), (count / F.lit(float(months))).alias("cnt_per_month"),
    )


def mean_by(df: DataFrame, key: str, amount: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(amount).alias("amount_avg"))


def qr_profile(df: DataFrame, key: str, flag: str, amount: str, day: str, mcc: str) -> DataFrame:
    """QR use per key, for keys that use it at all. Rows are combined to (key, day, category) before anything distinct is counted."""
    on = F.col(flag) == 1.0
    use = df.groupBy(key, F.col(day).alias("_day"), F.col(mcc).alias("_mcc")).agg(
        _count_true(on).alias("_on"), F.count(flag).alias("_all"), F.sum(F.when(on, F.col(amount))).alias("_s"),
        F.count(F.when(on, F.col(amount))).alias("_n"))
    used = F.col("_on") > 0
    return use.groupBy(key).agg(
        F.sum("_on").alias("QR_cnt"), _ratio(F.sum("_on"), F.sum("_all")).alias("QR_cnt_ratio"),
        F.try_divide(F.sum("_s").cast("double"), F.sum("_n")).alias("QR_avg_RMB"),
        F.count_distinct(F.when(used, F.col("_day"))).alias("QR_date_cnt"),
        F.count_distinct(F.when(used, F.col("_mcc"))).alias("QR_mcc_tps"),
    ).where(F.col("QR_cnt") > 0)


def count_where(df: DataFrame, key: str, conditions: Mapping[str, Column]) -> DataFrame:
    """``<name>_cnt`` per key for each condition."""
    return df.groupBy(key).agg(*[_count_true(c).alias(f"{n}_cnt") for n, c in conditions.items()])


def group_counts(df: DataFrame, key: str, col: str, groups: Mapping[str, Iterable]) -> DataFrame:
    """``<group>_cnt`` per key: rows whose value is in the group."""
    return count_where(df, key, {name: F.col(col).isin(*values) for name, values in groups.items()})


def code_counts(df: DataFrame, key: str, col: str, codes: Iterable) -> DataFrame:
    """The same for single codes."""
    return group_counts(df, key, col, {str(c): [c] for c in codes})


def listed_counts(df: DataFrame, key: str, col: str, lists: DataFrame, list_col: str = "list_name") -> DataFrame:
    """Counts per (key, list) when the lists are a table of (value, list name) too long for literals.

    Rows are combined to (key, value) before they meet the table.
    """
    members = lists.select(F.col(col), F.col(list_col)).distinct()
    per_value = df.where(F.col(col).isNotNull()).groupBy(key, col).agg(F.count(F.lit(1)).alias("_n"))
    return null_safe_join(per_value, members, [col], "inner").groupBy(key, list_col).agg(F.sum("_n").alias("list_cnt"))


def flag_counts(df: DataFrame, key: str, flags: Iterable[str]) -> DataFrame:
    """Sum of each 1.0/0.0 flag per key."""
    return df.groupBy(key).agg(*[F.sum(f).alias(f"{f}_cnt") for f in flags])


def flag_ratios(df: DataFrame, key: str, flags: Iterable[str]) -> DataFrame:
    """Sum of each flag and its share of the rows where the flag is known."""
    out = []
    for f in flags:
        out += [F.sum(f).alias(f"{f}_cnt"), _ratio(F.sum(f), F.count(f)).alias(f"{f}_ratio")]
    return df.groupBy(key).agg(*out)


def card_kind_profile(df: DataFrame, key: str, card: str, is_deposit: Column) -> DataFrame:
    """Deposit and credit cards and transactions per person, with the credit shares. Rows are combined to (person, card) first."""
    deposit = F.coalesce(is_deposit, F.lit(False))
    cards = df.groupBy(key, F.col(card).alias("_card")).agg(_count_true(deposit).alias("_d"), _count_true(~deposit).alias("_c"))
    named = F.col("_card").isNotNull()
    return cards.groupBy(key).agg(
        F.count_if(named & (F.col("_d") > 0)).alias("deposit_cards_cnt"), F.count_if(named & (F.col("_c") > 0)).alias("credit_cards_cnt"),
        F.sum("_d").alias("deposit_trans_cnt"), F.sum("_c").alias("credit_trans_cnt"),
    ).withColumns({
        "credit_cards_ratio": _ratio(F.col("credit_cards_cnt"), F.col("credit_cards_cnt") + F.col("deposit_cards_cnt")),
        "credit_trans_ratio": _ratio(F.col("credit_trans_cnt"), F.col("credit_trans_cnt") + F.col("deposit_trans_cnt")),
    })


def amount_bucket_counts(df: DataFrame, key: str, amount: str, edges: Iterable[float]) -> DataFrame:
    """``amount_<i>_cnt`` per key: rows with edge i <= amount < edge i+1."""
    edges = list(edges)
    value = F.col(amount)
    return count_where(df, key, {
        f"amount_{i}": (value >= low) & (value < high) if high != float("inf") else value >= low
        for i, (low, high) in enumerate(zip(edges, edges[1:]))
    })


# --- places -----------------------------------------------------------------------------------

def distinct_places(df: DataFrame, key: str, place: str, ts: str | None = None, province_chars: int = 2) -> DataFrame:
    """Distinct places and provinces per key, or per (key, day) when ``ts`` is given."""
    keys = [key] + ([] if ts is None else ["day"])
    rows = df if ts is None else df.withColumn("day", F.to_date(ts))
    seen = rows.select(*keys, place).distinct()
    return seen.groupBy(*keys).agg(
        F.count_distinct(F.col(place)).alias("places_cnt"),
        F.count_distinct(prefix(F.col(place).cast("string"), province_chars)).alias("provinces_cnt"),
    )


def with_place_counts(df: DataFrame, key: str, place: str, ts: str, province_chars: int = 2) -> DataFrame:
    """Rows with the day's and the overall number of places and provinces of their key."""
    rows = df.withColumn("day", F.to_date(ts))
    per_day = distinct_places(df, key, place, ts, province_chars).withColumnsRenamed(
        {"places_cnt": "cur_tot_locs", "provinces_cnt": "cur_tot_provs"})
    overall = distinct_places(df, key, place, None, province_chars).withColumnsRenamed(
        {"places_cnt": "tot_locs", "provinces_cnt": "tot_provs"})
    out = join_unique(rows, per_day, [key, "day"])
    return join_unique(out, overall, [key]).drop("day")


def place_profile(df: DataFrame, key: str, place: str, ts: str, province_chars: int = 2,
                  days: Iterable[int] = (3, 7, 30)) -> tuple[DataFrame, DataFrame]:
    """(per key and ``_day``, per key): all place features from one combined table of visits.

    Per day: places and provinces. Per key: places, provinces, the most frequent place with its count, and the
    places visited again within n days. The rows are read and shuffled once, combined to (key, day, place).
    """
    visits = df.select(key, place, day_no(F.col(ts)).alias("_day")).groupBy(key, place, "_day").agg(F.count(F.lit(1)).alias("_n"))
    province = prefix(F.col(place).cast("string"), province_chars)
    per_day = visits.groupBy(key, "_day").agg(
        F.count(place).alias("cur_tot_locs"), F.count_distinct(province).alias("cur_tot_provs"))
    gap = F.col("_day") - F.lag("_day").over(Window.partitionBy(key, place).orderBy("_day"))
    per_place = visits.withColumn("_gap", gap).groupBy(key, place).agg(F.sum("_n").alias("_n"), F.min("_gap").alias("_gap"))
    per_key = per_place.groupBy(key).agg(
        F.count(place).alias("tot_locs"), F.count_distinct(province).alias("tot_provs"),
        F.max_by(place, F.struct("_n", place)).alias(f"mode_{place}"), F.max("_n").alias(f"mode_{place}_cnt"),
        *[F.count_if((F.col("_gap") <= n) & F.col(place).isNotNull()).alias(f"places_day{n}_cnt") for n in days])
    return per_day, per_key


def mode_by(df: DataFrame, key: str, col: str) -> DataFrame:
    """Most frequent value per key and its count; of equally frequent values the larger one."""
    counted = df.groupBy(key, col).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(key).agg(
        F.max_by(col, F.struct("_n", col)).alias(f"mode_{col}"), F.max("_n").alias(f"mode_{col}_cnt"))


def with_mode_flags(df: DataFrame, key: str, col: str, risky: Iterable | None = None) -> DataFrame:
    """Is the row at its key's most frequent value, and is that value on a risk list."""
    out = join_unique(df, mode_by(df, key, col), [key])
    mode = F.col(f"mode_{col}")
    out = out.withColumn(f"is_frequent_{col}", bool_double(F.col(col).eqNullSafe(mode)))
    if risky is not None:
        out = out.withColumn(f"is_mode_{col}_risky", bool_double(F.coalesce(mode.isin(*risky), F.lit(False))))
    return out


def with_group_stat(df: DataFrame, keys: Iterable[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Rows with aggregates of their group."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return join_unique(df, stats, keys)


def with_day_totals(df: DataFrame, key: str, ts: str, amount: str) -> DataFrame:
    """Rows with the amount and number of transactions of their key on their day."""
    rows = df.withColumn("_day", day_no(F.col(ts)))
    return with_group_stat(rows, [key, "_day"], {
        "day_tot_amt": F.sum(amount), "day_tot_cnt": F.count(amount),
    }).drop("_day")


# --- learned risk lists -----------------------------------------------------------------------

def learn_risk_values(df: DataFrame, col: str, label: str, bad: float = 0, good: float = 1) -> DataFrame:
    """Values seen with the bad label; ``risk_only`` marks those never seen with the good one."""
    seen = df.where(F.col(col).isNotNull()).groupBy(col).agg(
        F.max(F.col(label) == bad).alias("_bad"), F.max(F.col(label) == good).alias("_good"))
    return seen.where("_bad").select(
        col, F.lit(1).alias("bad_seen"), (~F.coalesce("_good", F.lit(False))).cast("int").alias("risk_only"))


def risk_exposure(df: DataFrame, key: str, col: str, values: DataFrame) -> DataFrame:
    """Per key: rows at bad and at risk-only values, whether there are any, and their share."""
    per_value = df.groupBy(key, col).agg(F.count(F.lit(1)).alias("_n"))
    marked = join_unique(per_value, values, [col])
    n = F.col("_n")
    return marked.groupBy(key).agg(
        F.coalesce(F.sum(n * F.col("bad_seen")), F.lit(0)).alias("bad_cnt"),
        F.coalesce(F.sum(n * F.col("risk_only")), F.lit(0)).alias("risk_cnt"),
        F.sum(n).alias("txn_cnt"),
    ).select(
        "*", bool_double(F.col("bad_cnt") > 0).alias("has_bad"), bool_double(F.col("risk_cnt") > 0).alias("has_risk"),
        _ratio(F.col("bad_cnt"), F.col("txn_cnt")).alias("bad_ratio"),
        _ratio(F.col("risk_cnt"), F.col("txn_cnt")).alias("risk_ratio"),
    )


def flag_listed(df: DataFrame, col: str, listed: DataFrame, out: str) -> DataFrame:
    """1.0 where the value is in a one-column table, by a join in place of a driver-side list."""
    marks = listed.select(F.col(listed.columns[0]).alias(col)).distinct().withColumn(out, F.lit(1.0))
    return join_unique(df, marks, [col]).fillna(0.0, subset=[out])


# --- column analysis --------------------------------------------------------------------------

def melt(df: DataFrame, cols: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Long form: one row per (kept columns, column name ``col``, text ``value``)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.col", "_p.value")


def crosstab_ratio(df: DataFrame, cols: Iterable[str], label: str) -> DataFrame:
    """Per column and value: rows with label 0 and 1 and the quotient n1/n0."""
    long = melt(df, cols, [label])
    counted = long.groupBy("col", "value").agg(
        _count_true(F.col(label) == 0).alias("n0"), _count_true(F.col(label) == 1).alias("n1"),
        _count_true(F.col(label) == -1).alias("n_unknown"))
    return counted.withColumn("ratio", _ratio(F.col("n1"), F.col("n0")))


def risk_values(df: DataFrame, cols: Iterable[str], label: str, min0: int = 10, minx: int | None = 10,
                max_ratio: float = 1.0) -> DataFrame:
    """Values frequent among label 0 (and among unknown labels) where label 1 is rarer than label 0."""
    table = crosstab_ratio(df, cols, label).where((F.col("n0") > min0) & (F.col("ratio") < max_ratio))
    return table if minx is None else table.where(F.col("n_unknown") > minx)


def crosstab(df: DataFrame, a: str, b: str, b_values: Iterable | None = None) -> DataFrame:
    """Contingency table, one column per value of ``b``."""
    grouped = df.groupBy(a)
    return (grouped.pivot(b, list(b_values)) if b_values is not None else grouped.pivot(b)).count().na.fill(0)


def describe(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Count, mean, sample deviation, min and max of each column, one row per column, in one pass."""
    cols = list(cols)
    stats = {"cnt": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[fn(F.col(c).cast("double")).alias(f"{c}__{s}") for c in cols for s, fn in stats.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("col"), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in cols])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def label_corr(df: DataFrame, cols: Iterable[str], label: str) -> DataFrame:
    """Pearson correlation of each column with the label, one row per column."""
    cols = list(cols)
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("corr")) for c in cols])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def freq_items(df: DataFrame, cols: Iterable[str], support: float = 0.1) -> DataFrame:
    """Values that make up more than ``support`` of a column's rows, exactly."""
    # A column's counts add up to the rows of the table; one row per column, and the counts' exchange is reused.
    counted = value_counts(df, cols)
    joined = counted.join(F.broadcast(counted.groupBy("col").agg(F.sum("cnt").alias("_rows"))), "col")
    return joined.where(F.col("cnt") > F.col("_rows") * support).select("col", "value", "cnt")


def quantiles(df: DataFrame, col: str, probabilities: Iterable[float], exact: bool = False,
              accuracy: int = 10_000) -> DataFrame:
    """One row per probability: from a bounded sketch, or exactly (interpolated) with ``exact``."""
    ps = [float(p) for p in probabilities]
    if exact:
        return df.sparkSession.createDataFrame(_exact_quantiles(df, col, ps), "probability double, value double")
    agg = [F.percentile_approx(col, p, accuracy).cast("double").alias(f"p{i}") for i, p in enumerate(ps)]
    rows = F.array(*[F.struct(F.lit(p).alias("probability"), F.col(f"p{i}").alias("value")) for i, p in enumerate(ps)])
    return df.agg(*agg).select(F.explode(rows).alias("_r")).select("_r.*")


def _exact_quantiles(df: DataFrame, col: str, ps: list[float], bins: int = 4096) -> list[tuple[float, float | None]]:
    """Values at the wanted ranks, found by narrowing intervals with histograms.

    A pass cuts the interval around every wanted rank into bins and keeps the bin that holds the rank. Only
    bin counts reach the driver, no task ever holds the values, and a pass narrows each interval thousands of times.
    Nulls and NaN are left out; infinities keep their place at the ends of the order.
    """
    known = df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).persist()
    try:
        return _narrowed(known, ps, bins)
    finally:
        known.unpersist()


def _narrowed(known: DataFrame, ps: list[float], bins: int) -> list[tuple[float, float | None]]:
    infinity = float("inf")
    n, under, over = known.agg(F.count("_v"), F.count_if(F.col("_v") == -infinity), F.count_if(F.col("_v") == infinity)).first()
    if not n:
        return [(p, None) for p in ps]
    values = known.where(F.abs("_v") < infinity)
    low, high = values.agg(F.min("_v"), F.max("_v")).first()
    ranks = {int(p * (n - 1)) for p in ps} | {min(int(p * (n - 1)) + 1, n - 1) for p in ps}
    found = {r: -infinity for r in ranks if r < under} | {r: infinity for r in ranks if r >= n - over}
    open_ = {r: (low, high, under) for r in ranks - found.keys()}  # rank -> (low, high, rows below low)
    while True:
        for r in [r for r, (lo, hi, _) in open_.items() if lo == hi]:
            found[r] = open_.pop(r)[0]
        if not open_:
            break
        spans = sorted(set(open_.values()))
        which, bin_ = F.lit(None).cast("int"), F.lit(None).cast("bigint")
        for i, (lo, hi, _) in enumerate(spans):
            inside = F.col("_v").between(lo, hi)
            # Halves, so that the width of the widest interval does not overflow.
            share = (F.col("_v") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
            which = F.when(inside, F.lit(i)).otherwise(which)
            bin_ = F.when(inside, F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(bin_)
        counts = values.groupBy(which.alias("i"), bin_.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where("i IS NOT NULL").collect()
        for r, span in list(open_.items()):
            below = span[2]
            for c in sorted((c for c in counts if c.i == spans.index(span)), key=lambda c: c.b):
                if r < below + c.n:
                    open_[r] = (c.lo, c.hi, below)
                    break
                below += c.n
    out = []
    for p in ps:
        at = p * (n - 1)
        a, b = found[int(at)], found[min(int(at) + 1, n - 1)]
        part = at - int(at)
        out.append((p, a if a == b or not part or abs(a) == infinity else a + (b - a) * part))
    return out


def activity_histogram(df: DataFrame, key: str, edges: Iterable[int] = ACTIVITY_EDGES) -> DataFrame:
    """Keys by number of rows, in (low, high] buckets; the last one is open."""
    edges = list(edges)
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    bucket = F.when(F.col("_n") <= edges[0], F.lit(None).cast("int"))
    for i, high in enumerate(edges[1:]):
        bucket = bucket.when(F.col("_n") <= high, F.lit(i))
    bucket = bucket.otherwise(F.lit(len(edges) - 1))
    return per_key.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("key_cnt")).select(
        "bucket", F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bucket") + 1).alias("above"), "key_cnt")


def activity_moments(df: DataFrame, key: str) -> DataFrame:
    """Mean and population variance of rows per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.avg("_n").alias("avg_cnt"), F.var_pop("_n").alias("var_cnt"))


def value_counts(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """How often each value of each column occurs."""
    return melt(df, cols).groupBy("col", "value").agg(F.count(F.lit(1)).alias("cnt"))


def distinct_counts(df: DataFrame, cols: Iterable[str], by: str | None = None) -> DataFrame:
    """Number of values per column, optionally per group, in long form.

    The long form is reduced to distinct values first, so no column costs its own pass.
    """
    keep = [by] if by else []
    return melt(df, cols, keep).where(F.col("value").isNotNull()).distinct().groupBy(*keep, "col").agg(
        F.count(F.lit(1)).alias("distinct_cnt"))


def daily_total(df: DataFrame, ts: str, amount: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("cnt"))


def class_balance(df: DataFrame, label: str, target: float | None = None) -> DataFrame:
    """Frauds, normals, their ratio and the fraud rate that would reach ``target`` normals per fraud."""
    row = df.agg(_count_true(F.col(label) == 1).alias("fraud_cnt"), _count_true(F.col(label) == 0).alias("normal_cnt"))
    out = row.withColumn("normal_per_fraud", _ratio(F.col("normal_cnt"), F.col("fraud_cnt")))
    if target is None:
        return out
    return out.withColumn("fraud_rate", _ratio(F.col("normal_cnt") / F.lit(float(target)), F.col("fraud_cnt")))


def count_by(df: DataFrame, col: str | Column, name: str = "value") -> DataFrame:
    return df.groupBy((F.col(col) if isinstance(col, str) else col).alias(name)).agg(F.count(F.lit(1)).alias("cnt"))


def population_report(detail: DataFrame, valuable: DataFrame, card: str, amount: str, flag: str) -> DataFrame:
    """One row: cards, valuable cards, and transactions and amounts of both, flagged rows apart."""
    per_card = detail.groupBy(card).agg(
        F.count(F.lit(1)).alias("_n"), _count_true(F.col(flag) == 1.0).alias("_qr"),
        F.sum(amount).alias("_amt"), F.sum(F.when(F.col(flag) == 1.0, F.col(amount))).alias("_qr_amt"))
    marks = valuable.select(card).distinct().withColumn("_v", F.lit(True))
    joined = null_safe_join(per_card, marks, [card], "left").withColumn("_v", F.coalesce("_v", F.lit(False)))
    v = F.col("_v")
    return joined.agg(
        F.count(F.lit(1)).alias("card_cnt"), F.count_if(v).alias("valuable_card_cnt"),
        F.sum("_n").alias("txn_cnt"), F.sum(F.when(v, F.col("_n")).otherwise(0)).alias("valuable_txn_cnt"),
        F.sum("_qr").alias("qr_txn_cnt"), F.sum(F.when(v, F.col("_qr")).otherwise(0)).alias("valuable_qr_txn_cnt"),
        (F.sum("_amt") / 100).alias("amount"), (F.sum(F.when(v, F.col("_amt"))) / 100).alias("valuable_amount"),
        (F.sum(F.when(v, F.col("_qr_amt"))) / 100).alias("valuable_qr_amount"),
    )


def merchant_reach(df: DataFrame, merchant: str, person: str) -> DataFrame:
    """Distinct persons and rows per merchant, largest reach first."""
    return df.groupBy(merchant).agg(
        F.count_distinct(person).alias("person_cnt"), F.count(F.lit(1)).alias("txn_cnt"),
    ).orderBy(F.desc("person_cnt"), F.desc("txn_cnt"), merchant)


def class_value_counts(df: DataFrame, col: str, label: str) -> DataFrame:
    """Rows per value in each class."""
    return df.groupBy(col).agg(
        _count_true(F.col(label) == 1).alias("fraud_cnt"), _count_true(F.col(label) == 0).alias("normal_cnt"))
