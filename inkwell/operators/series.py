"""Series: momentum, daily index, smoothing, feed health, coverage histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import half_life_alpha, saturating
from .windows import ordered_fold

# Evaluated momentum parameters, in seconds.
MOMENTUM = {"bucket": 300, "short": 1800, "long": 10800, "signal": 1800, "window": 3600, "reports": 3, "origins": 2}

# Weights of event types, in the order that breaks ties.
TYPE_WEIGHTS = {"armedConflict": 10.0, "terrorism": 8.0, "civilUnrest": 4.0, "coercion": 4.0, "disaster": 6.0, "healthEmergency": 4.0, "cyberAttack": 3.0}
# Multipliers of the magnitudes none, units, tens, hundreds, thousands.
DEATHS = (1.0, 1.2, 1.5, 2.0, 2.5)
AFFECTED = (1.0, 1.1, 1.25, 1.5, 2.0)
ESCALATION = {"noSignal": 1.0, "escalating": 1.3, "deescalating": 0.7, "mixed": 1.0}


def independent_reports(reports: DataFrame, through: Column | None = None) -> DataFrame:
    """(event, wire, at, origin): the earliest report of each wire; wires without an origin stay out.

    Rows published or fetched after ``through`` stay out. A wire with several origins is an error:
    it is marked by ``n_origins`` over 1 for the caller to reject.
    """
    if through is not None:
        reports = reports.where((F.col("published") <= through) & (F.col("fetched") <= through))
    known = reports.where("wire IS NOT NULL AND origin IS NOT NULL AND published IS NOT NULL")
    return known.groupBy("event", "wire").agg(F.min("published").alias("at"), F.min_by("origin", F.struct("published", "origin")).alias("origin"), F.count_distinct("origin").alias("n_origins"))


def macd(reports: DataFrame, horizon: int, through: int, params: dict = MOMENTUM) -> DataFrame:
    """(event, macd, signal, histogram, reports, origins, state) at ``through``, from (event, at, origin).

    Arrivals are counted in buckets first (partial aggregation), so the ordered fold of each event sees
    bucket counts, at most horizon / bucket of them, and not reports.
    """
    width, start = params["bucket"], through - horizon
    n_buckets = -(-horizon // width)
    inside = reports.where((F.col("at") >= start) & (F.col("at") <= through))
    bucket = F.least(F.expr(f"(at - {start}L) div {width}"), F.lit(n_buckets - 1))
    counts = inside.groupBy("event", bucket.alias("b")).agg(F.count("*").alias("n"))
    per = counts.groupBy("event").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("arrived"))
    last = horizon - (n_buckets - 1) * width
    alphas = {k: (float(1 - 2 ** (-width / params[k])), float(1 - 2 ** (-last / params[k]))) for k in ("short", "long", "signal")}

    def step(s, b):
        final = b == n_buckets - 1
        a = {k: F.when(final, F.lit(v[1])).otherwise(F.lit(v[0])) for k, v in alphas.items()}
        rate = F.coalesce(F.element_at(F.col("arrived"), b), F.lit(0)) * F.when(final, F.lit(width / last)).otherwise(F.lit(1.0))
        short = s["short"] + a["short"] * (rate - s["short"])
        long = s["long"] + a["long"] * (rate - s["long"])
        signal = s["signal"] + a["signal"] * (short - long - s["signal"])
        return F.struct(short.alias("short"), long.alias("long"), signal.alias("signal"), s["hist"].alias("prev"), (short - long - signal).alias("hist"))

    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("short", "long", "signal", "prev", "hist")))
    folded = per.select("event", F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(n_buckets - 1).cast("long")), zero, step).alias("s"))
    recent = inside.where(F.col("at") > through - params["window"]).groupBy("event").agg(F.count("*").alias("reports"), F.count_distinct("origin").alias("origins"))
    joined = folded.join(recent, "event", "left").withColumns({"reports": F.coalesce("reports", F.lit(0)), "origins": F.coalesce("origins", F.lit(0))})
    met = (F.col("reports") >= params["reports"]) & (F.col("origins") >= params["origins"])
    state = F.when((F.col("s.prev") > 0) & (F.col("s.hist") < 0), "decelerating").when((F.col("s.hist") > 0) & met, "accelerating").otherwise("quiet")
    return joined.select("event", (F.col("s.short") - F.col("s.long")).alias("macd"), F.col("s.signal").alias("signal"), F.col("s.hist").alias("histogram"), "reports", "origins", state.alias("state"))


def magnitude(count: Column) -> Column:
    """0 none, 1 units, 2 tens, 3 hundreds, 4 thousands."""
    return F.when(count < 1, 0).when(count < 10, 1).when(count < 100, 2).when(count < 1000, 3).otherwise(4)


def event_score(kind: Column, deaths: Column, affected: Column, escalation: Column, regions: Column) -> Column:
    """Type weight x the larger magnitude multiplier x escalation x breadth; 0 for a type that isn't counted."""
    table = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i + 1)
    breadth = F.when(regions <= 1, 0.85).when(regions == 2, 1.0).when(regions == 3, 1.15).otherwise(1.30)
    size = F.greatest(pick(DEATHS, magnitude(deaths)), pick(AFFECTED, magnitude(affected)))
    return F.coalesce(F.element_at(table(TYPE_WEIGHTS), kind), F.lit(0.0)) * size * F.element_at(table(ESCALATION), escalation) * breadth


def coverage_status(feeds: Column, regions: Column, least_feeds: int = 7, least_regions: int = 4) -> Column:
    return F.when(feeds == 0, "noData").when((feeds >= least_feeds) & (regions >= least_regions), "sufficient").otherwise("insufficient")


def day_index(raw: Column, status: Column) -> Column:
    """0 to 100, null for a day without enough coverage: a gap is never a zero."""
    return F.when(status == "sufficient", saturating(raw))


def smoothed(df: DataFrame, keys: list[str], day: str, value: str, alpha: float = 0.25) -> DataFrame:
    """(keys, day, value, smoothed): exponential mean over days; a gap has none and the last value is carried across it.

    A fold over each key's rows in order; only the last mean is held.
    """

    def step(last, row):
        v = row[1]
        if v is None:
            return last, (None,)
        now = v if last is None else last + alpha * (v - last)
        return now, (now,)

    rows = df.select(*keys, day, F.col(value).cast("double").alias(value))
    return ordered_fold(rows, keys, [day], [day, value], step, None, "smoothed double")


def displayed(df: DataFrame, keys: list[str], day: str, score: str, alpha: float = 0.25, days: int = 7, step: int = 3, cap: int = 9) -> DataFrame:
    """(keys, day, score, shown): the score shown for each day that has one.

    An exponential mean, seeded by the first, over the days within ``days`` calendar days, rounded, plus
    ``step`` for each rise in a row up to the day, ``cap`` at most. A rise counts between neighbouring
    calendar days only and inside the same window, so a gap ends a run of rises. Frames hold ``days`` rows at most.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy(*keys).orderBy("_n").rangeBetween(-(days - 1), 0)
    rows = df.where(F.col(score).isNotNull()).withColumn("_n", number)
    rows = rows.withColumn("_w", F.sort_array(F.collect_list(F.struct(F.col("_n").alias("n"), F.col(score).cast("double").alias("v"))).over(frame)))
    mean = F.aggregate("_w", F.lit(None).cast("double"), lambda m, x: F.when(m.isNull(), x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * m))
    before = lambda i: F.get(F.col("_w"), i - 1)
    up = F.transform("_w", lambda x, i: (i > 0) & (x["n"] - before(i)["n"] <= 1) & (x["v"] > before(i)["v"]))
    run = F.aggregate(up, F.lit(0), lambda n, u: F.when(F.coalesce(u, F.lit(False)), n + 1).otherwise(0))
    shown = F.floor(mean + 0.5) + F.least(F.lit(cap), step * run)
    return rows.select(*keys, day, score, F.least(F.lit(100), F.greatest(F.lit(0), shown)).cast("long").alias("shown"))


def halved_counters(df: DataFrame, keys: list[str], order: str, success: str, latency: str, at: int = 200) -> DataFrame:
    """(keys, attempts, successes, latency): counters that are halved whenever attempts reach ``at``, folded in order.

    Each row is given the counters after it, and the last row's are kept: one row of state a key.
    """

    def step(now, row):
        attempts, successes, spent = now
        keep = 0.5 if attempts >= at else 1.0
        now = (attempts * keep + 1, successes * keep + row[0], spent * keep + row[0] * row[1])
        return now, now

    rows = df.select(*keys, order, F.col(success).cast("double").alias("_ok"), F.col(latency).cast("double").alias("_l"))
    return ordered_fold(rows, keys, [order], ["_ok", "_l"], step, (0.0, 0.0, 0.0), "attempts double, successes double, latency double", last=True)


def gap_filled(df: DataFrame, keys: list[str], day: str, first: Column, last: Column, value: str) -> DataFrame:
    """A row for every key and day of the range; days without a row count 0."""
    days = df.select(*keys).distinct().withColumn(day, F.explode(F.sequence(first, last)))
    return days.join(df, [*keys, day], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def health(df: DataFrame) -> DataFrame:
    """(feed, success_rate, latency, class): rates of a feed and the plurality of its classes, of three samples at least.

    Ties go to full, teaser, blocked, paywall in that order. Columns: feed, ok, latency, class.
    """
    order = ("full", "teaser", "blocked", "paywall")
    counts = [F.struct(F.count_if(F.col("class") == c).alias("n"), F.lit(-i).alias("place"), F.lit(c).alias("class")) for i, c in enumerate(order)]
    g = df.groupBy("feed").agg(F.avg(F.col("ok").cast("double")).alias("success_rate"), F.avg(F.when(F.col("ok"), F.col("latency"))).alias("latency"), F.count("class").alias("assessed"), F.array_max(F.array(*counts)).alias("best"))
    return g.select("feed", "success_rate", "latency", F.when(F.col("assessed") >= 3, F.col("best.class")).alias("class"))
