"""Spatial statistics over an edge list of neighbouring places, and a space-time scan; weights are row-standardised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weights(edges: DataFrame) -> DataFrame:
    """(a, b, w) of an undirected edge list (a, b): both directions, each row summing to 1; loops and repeats are dropped."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    degree = both.groupBy("a").agg((1 / F.count(F.lit(1))).alias("w"))
    return both.join(degree, "a")


def _centred(panel: DataFrame, group: list[str], value: str) -> DataFrame:
    stats = panel.groupBy(*group).agg(F.avg(value).alias("_mean"), F.sum(F.pow(F.col(value), 2)).alias("_sq"), F.count(value).alias("_n"))
    joined = panel.join(stats, group) if group else panel.join(stats, F.lit(True))
    return joined.withColumn("z", F.col(value) - F.col("_mean")).withColumn("ss", F.col("_sq") - F.col("_n") * F.col("_mean") * F.col("_mean"))


def local_lag(panel: DataFrame, group: list[str], place: str, value: str, w: DataFrame) -> DataFrame:
    """Each place's value, deviation, and weighted mean deviation of its neighbours that have a value in the same group."""
    z = _centred(panel.where(F.col(value).isNotNull()), group, value)
    near = z.select(*group, F.col(place).alias("b"), F.col("z").alias("z_b"))
    lag = z.select(*group, F.col(place).alias("a"), "z", "ss", F.col("_n").alias("n"), F.col(value).alias("value")).join(w, "a").join(near, [*group, "b"])
    return lag.groupBy(*group, "a", "z", "ss", "n", "value").agg(F.sum(F.col("w") * F.col("z_b")).alias("lag"), F.sum("w").alias("w_sum"), F.sum(F.col("w") * F.pow(F.col("z") - F.col("z_b"), 2)).alias("difference"))


def global_autocorrelation(panel: DataFrame, group: list[str], place: str, value: str, w: DataFrame) -> DataFrame:
    """Moran's I and Geary's C of each group, with the expectation of I; null where all values are equal."""
    lag = local_lag(panel, group, place, value, w)
    out = lag.groupBy(*group).agg(F.sum(F.col("z") * F.col("lag")).alias("zz"), F.sum("w_sum").alias("s0"), F.max("ss").alias("ss"), F.max("n").alias("n"), F.sum("difference").alias("d"))
    ok = (F.col("ss") > 1e-12) & (F.col("s0") > 0)
    return out.select(
        *group, F.col("n").alias("places"), F.when(ok, F.col("n") / F.col("s0") * F.col("zz") / F.col("ss")).alias("moran_i"), F.try_divide(F.lit(-1.0), (F.col("n") - 1).cast("double")).alias("expected_i"),
        F.when(ok, (F.col("n") - 1) * F.col("d") / (2 * F.col("s0") * F.col("ss"))).alias("geary_c"),
    )


def local_moran(panel: DataFrame, group: list[str], place: str, value: str, w: DataFrame) -> DataFrame:
    """Local Moran's I and quadrant (high/low place among high/low neighbours) of each place."""
    lag = local_lag(panel, group, place, value, w)
    quadrant = F.concat(F.when(F.col("z") > 0, "high").otherwise("low"), F.lit("-"), F.when(F.col("lag") > 0, "high").otherwise("low"))
    return lag.where("ss > 1e-12").select(*group, F.col("a").alias(place), (F.col("z") * F.col("lag") * (F.col("n") - 1) / F.col("ss")).alias("local_i"), quadrant.alias("quadrant"))


def hot_spots(panel: DataFrame, group: list[str], place: str, value: str, edges: DataFrame) -> DataFrame:
    """Getis-Ord Gi* z-score of each place, neighbours and itself with weight 1, in closed form."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    have = panel.where(F.col(value).isNotNull())
    own = have.select(F.col(place).alias("a")).distinct()
    star = both.unionByName(own.select("a", F.col("a").alias("b")))
    stats = have.groupBy(*group).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(value).alias("n"))
    near = have.select(*group, F.col(place).alias("b"), F.col(value).cast("double").alias("x"))
    sums = have.select(*group, F.col(place).alias("a")).join(star, "a").join(near, [*group, "b"]).groupBy(*group, "a").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("k"))
    below = F.col("s") * F.sqrt(F.try_divide((F.col("n") * F.col("k") - F.col("k") * F.col("k")).cast("double"), (F.col("n") - 1).cast("double")))
    joined = sums.join(stats, group) if group else sums.join(stats, F.lit(True))
    return joined.select(*group, F.col("a").alias(place), F.when(below > 0, (F.col("x") - F.col("m") * F.col("k")) / below).alias("gi_star"))


def semivariogram(points: DataFrame, group: list[str], place: str, value: str, x: Column, y: Column, bins: int = 10) -> DataFrame:
    """Mean half squared difference by distance class (equal widths up to the largest distance of the group).

    Pairs of places within a group: for reference lists of places, at most MOST_PLACES; a longer list is refused.
    """
    _few(points, place)
    p = points.where(F.col(value).isNotNull()).select(*group, F.col(place).alias("p"), F.col(value).alias("v"), x.alias("x"), y.alias("y"))
    a, b = (p.select(*group, *[F.col(c).alias(f"{c}_{s}") for c in ("p", "v", "x", "y")]) for s in "ab")
    pairs = a.join(b, group).where("p_a < p_b").select(*group, F.sqrt(F.pow(F.col("x_a") - F.col("x_b"), 2) + F.pow(F.col("y_a") - F.col("y_b"), 2)).alias("h"), (F.pow(F.col("v_a") - F.col("v_b"), 2) / 2).alias("g"))
    longest = pairs.groupBy(*group).agg(F.max("h").alias("top"))
    k = F.least(F.floor(F.col("h") / F.col("top") * bins).cast("int"), F.lit(bins - 1))
    return pairs.join(longest, group).where("top > 0").groupBy(*group, k.alias("bin")).agg(F.count(F.lit(1)).alias("pairs"), F.avg("h").alias("distance"), F.avg("g").alias("semivariance"))


def variogram_range(classes: DataFrame, group: list[str], share: float = 0.95) -> DataFrame:
    """(group, sill, range): the largest semivariance, and the mean distance of the nearest class that reaches ``share`` of it."""
    top = classes.groupBy(*group).agg(F.max("semivariance").alias("sill"))
    reached = classes.join(top, group).where(F.col("semivariance") >= share * F.col("sill"))
    return reached.groupBy(*group).agg(F.max("sill").alias("sill"), F.min(F.struct("bin", "distance"))["distance"].alias("range"))


#: Places up to which all their pairs are compared; a longer list is refused, not cut.
MOST_PLACES = 5_000


def _few(df: DataFrame, place: str) -> None:
    many = df.agg(F.count_distinct(place)).first()[0]
    if many > MOST_PLACES:
        raise ValueError(f"{many} places have more pairs than are compared at once (at most {MOST_PLACES} places)")


def hotspot_classes(scores: DataFrame, place: str, score: str, cut: float = 1.96) -> DataFrame:
    """Trajectory of each place over its periods: persistent, new, consecutive, intensifying, diminishing, sporadic, coldspot or no_pattern.

    Intensifying and diminishing places are hot half of the time with a trend in their scores: Kendall's rank statistic over all pairs of
    periods beyond 1.96 of its deviations (corrected for ties), from four periods on. The scores of a place are one array, as long as the calendar.
    """
    order = Window.partitionBy(place).orderBy(F.desc("period_start"))
    marked = scores.withColumn("hot", F.col(score) > cut).withColumn("cold", F.col(score) < -cut).withColumn("back", F.row_number().over(order))
    g = marked.groupBy(place).agg(
        F.avg(F.col("hot").cast("double")).alias("hot_share"), F.avg(F.col("cold").cast("double")).alias("cold_share"), F.max(F.when(F.col("back") == 1, F.col("hot"))).alias("last_hot"),
        F.count_if(F.col("hot") & (F.col("back") > 1)).alias("hot_before"), F.count_if(F.col("hot") & (F.col("back") <= 3)).alias("hot_last"), F.least(F.count(F.lit(1)), F.lit(3)).alias("recent"),
        F.array_sort(F.collect_list(F.when(F.col(score).isNotNull(), F.struct("period_start", F.col(score).alias("z"))))).alias("s"),
    )
    rise = F.expr("""aggregate(transform(s, (x, i) -> aggregate(slice(s, i + 2, size(s)), 0, (a, y) -> a + int(sign(y.z - x.z)))), 0, (a, v) -> a + v)""")
    ties = F.expr("aggregate(transform(array_distinct(transform(s, x -> x.z)), v -> size(filter(s, x -> x.z = v))), 0D, (a, t) -> a + t * (t - 1) * (2 * t + 5))")
    n = F.size("s")
    g = g.withColumn("trend", F.when(n >= 4, F.try_divide(rise, F.sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18))))
    kind = (
        F.when(F.col("hot_share") >= 0.9, "persistent").when(F.col("last_hot") & (F.col("hot_before") == 0), "new").when(F.col("hot_last") == F.col("recent"), "consecutive")
        .when((F.col("hot_share") >= 0.5) & (F.col("trend") > 1.959963984540054), "intensifying").when((F.col("hot_share") >= 0.5) & (F.col("trend") < -1.959963984540054), "diminishing")
        .when(F.col("hot_share") > 0, "sporadic").when(F.col("cold_share") >= 0.5, "coldspot").otherwise("no_pattern")
    )
    return g.select(place, "hot_share", "cold_share", kind.alias("trajectory"))


def rank_correlation(panel: DataFrame, place: str, value: str) -> DataFrame:
    """Spearman correlation of each pair of places over the periods both have (ranks within each place, averaged on ties); null where one of them does not vary.

    Pairs of a reference list of places, at most MOST_PLACES (a longer list is refused); each pair meets by period.
    """
    _few(panel, place)
    order = Window.partitionBy(place).orderBy(value)
    rank = F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(place, value)) - 1) / 2
    r = panel.where(F.col(value).isNotNull()).select(place, "period_start", rank.alias("r"))
    a, b = r.select(F.col(place).alias("place_a"), "period_start", F.col("r").alias("r_a")), r.select(F.col(place).alias("place_b"), "period_start", F.col("r").alias("r_b"))
    return a.join(b, "period_start").where("place_a < place_b").groupBy("place_a", "place_b").agg(F.count(F.lit(1)).alias("periods"), F.try_divide(F.covar_pop("r_a", "r_b"), F.stddev_pop("r_a") * F.stddev_pop("r_b")).alias("spearman"))
