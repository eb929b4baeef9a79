"""Queries for the library's operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.sampling import rank_hash, rank_prefix, rank_sql
from .operators import exact, grid, kd, outliers, running
from .sources import prepare
from .spec import Points, Rect

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), epoch("o_orderdate").alias("t"), F.col("o_totalprice").alias("p"), F.col("o_custkey").cast("double").alias("c"))


def events(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), epoch("ts").alias("t"), F.col("user_id").cast("double").alias("u"), F.col("value").alias("v"))


def items(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("returned"))


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


ORDERS = "(SELECT o_orderkey AS row_id, epoch_us(o_orderdate) / 1e6 AS t, o_totalprice AS p, o_custkey::DOUBLE AS c FROM orders)"
EVENTS = "(SELECT event_id AS row_id, epoch_us(ts) / 1e6 AS t, user_id::DOUBLE AS u, value AS v FROM events)"
ITEMS = "(SELECT l_quantity AS q, l_discount AS d, l_extendedprice AS price, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS returned FROM lineitem)"


def aggregate_sql(measures, digits=2) -> str:
    return ", ".join(f"round(coalesce(sum({m}), 0.0), {digits}) AS sum_{m}, count({m}) AS count_{m}, round(avg({m}), {digits}) AS avg_{m}" for m in measures) + ", count(*) AS count_star"


def exact_sql(table: str, measures, where: str) -> str:
    return f"SELECT {aggregate_sql(measures)} FROM {table} WHERE {where}"


@query(exact_sql(ORDERS, ["p"], "c >= 10 AND c < 1000 AND p >= 1000 AND p < 250000"))
def exact_rect_orders(spark, sf_dir):
    return rounded(exact.exact_scan(orders(spark, sf_dir), Points(("c", "p"), ("p",)), Rect((10, 1000), (1000, 250000))))


@query(exact_sql(ITEMS, ["price", "returned"], "q >= 5 AND q < 30 AND d >= 0.02 AND d < 0.07"))
def exact_rect_null_measure(spark, sf_dir):
    return rounded(exact.exact_scan(items(spark, sf_dir), Points(("q", "d"), ("price", "returned")), Rect((5, 0.02), (30, 0.07))))


@query(exact_sql(ORDERS, ["p"], "c >= -10 AND c < -5"))
def exact_rect_empty(spark, sf_dir):
    return rounded(exact.exact_scan(orders(spark, sf_dir), Points(("c",), ("p",)), Rect((-10,), (-5,))))


@query(exact_sql(ORDERS, ["p"], "t >= 820454400 AND t < 852076800 AND p >= 0 AND p < 300000"))
def exact_rect_time(spark, sf_dir):
    return rounded(exact.exact_scan(orders(spark, sf_dir), Points(("t", "p"), ("p",)), Rect((820454400, 0), (852076800, 300000))))


@query(f"SELECT count(*) AS count_star FROM {EVENTS} WHERE u >= 5 AND u < 60")
def count_star_rect(spark, sf_dir):
    return events(spark, sf_dir).where(Rect((5,), (60,)).predicate(["u"])).agg(F.count("*").alias("count_star"))


RECTS = [(i, [i * 5.0, 0.01 * (i % 4)], [i * 5.0 + 12, 0.01 * (i % 4) + 0.05]) for i in range(12)]
RECTS_SQL = "(VALUES " + ", ".join(f"({i}::BIGINT, {lo[0]}, {lo[1]!r}::DOUBLE, {hi[0]}, {hi[1]!r}::DOUBLE)" for i, lo, hi in RECTS) + ") r(query_ordinal, x0, y0, x1, y1)"
BATCH_SQL = f"SELECT query_ordinal, round(coalesce(sum(price), 0.0), 2) AS sum_price, count(price) AS count_price, round(avg(price), 2) AS avg_price, count(price) AS count_star FROM {RECTS_SQL} LEFT JOIN {ITEMS} i ON q >= x0 AND q < x1 AND d >= y0 AND d < y1 GROUP BY 1"


@query(BATCH_SQL)
def batch_rects_exact(spark, sf_dir):
    rects = spark.createDataFrame(RECTS, "query_ordinal long, lower array<double>, upper array<double>")
    return rounded(exact.batch_scan(items(spark, sf_dir), Points(("q", "d"), ("price",)), rects, (10.0, 0.05)))


@query(BATCH_SQL)
def batch_rects_grid_join(spark, sf_dir):
    rects = spark.createDataFrame(RECTS, "query_ordinal long, lower array<double>, upper array<double>")
    return rounded(exact.batch_scan(items(spark, sf_dir), Points(("q", "d"), ("price",)), rects, (10.0, 0.05), most=0))


@query("SELECT count(*) AS kept, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE NOT coalesce(l_tax > 0.06, false) AND l_quantity BETWEEN 3 AND 40")
def drop_if_bounds(spark, sf_dir):
    spec = prepare.Dataset({"l_quantity": (3, 40)}, ["l_extendedprice"], [("l_tax", ">", 0.06)])
    return prepare.prepare(read(spark, sf_dir, "lineitem"), spec).agg(F.count("*").alias("kept"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(" UNION ALL ".join(f"SELECT '{m}' AS measure, count({m}) AS non_nan_count, count(*) - count({m}) AS nan_count, round(coalesce(sum({m}), 0.0), 2) AS sum, round(coalesce(sum({m} * {m}), 0.0), 0) AS sum_sq, coalesce(min({m}), 0.0) AS min, coalesce(max({m}), 0.0) AS max FROM {ITEMS}" for m in ("price", "returned")))
def global_measure_stats(spark, sf_dir):
    return prepare.describe(items(spark, sf_dir), ["price", "returned"]).withColumn("sum", F.round("sum", 2)).withColumn("sum_sq", F.round("sum_sq", 0))


@query(f"SELECT min(t) AS t_low, max(t) AS t_high, min(u) AS u_low, max(u) AS u_high FROM {EVENTS}")
def dim_extent(spark, sf_dir):
    return events(spark, sf_dir).agg(F.min("t").alias("t_low"), F.max("t").alias("t_high"), F.min("u").alias("u_low"), F.max("u").alias("u_high"))


@query("SELECT round(sum(epoch_us(o_orderdate) / 1e6), 0) AS t, count(try_cast(o_orderpriority AS DOUBLE)) AS n_text, round(sum((o_totalprice > 1000)::INT), 0) AS n_true, sum(o_custkey::DOUBLE) AS c FROM orders")
def cast_matrix(spark, sf_dir):
    df = read(spark, sf_dir, "orders").withColumn("big", F.col("o_totalprice") > 1000)
    c = lambda n: prepare.as_double(df, n)
    return df.select(c("o_orderdate").alias("t"), c("o_orderpriority").alias("s"), c("big").alias("b"), c("o_custkey").alias("c")).agg(F.round(F.sum("t"), 0).alias("t"), F.count("s").alias("n_text"), F.round(F.sum("b"), 0).alias("n_true"), F.sum("c").alias("c"))


@query(f"SELECT count(*) AS n, min(row_id) AS first, max(row_id) AS last FROM (SELECT row_id FROM {ORDERS} WHERE p > 2000 ORDER BY row_id LIMIT 500)")
def max_rows_prefix(spark, sf_dir):
    spec = prepare.Dataset({"c": (float("-inf"), float("inf"))}, ["p"], [("p", "<=", 2000)], max_rows=500)
    return prepare.prepare(orders(spark, sf_dir), spec).agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


@query(f"SELECT count(*) AS n, round(sum(v), 2) AS total FROM {EVENTS} WHERE row_id % 7 = 0")
def modulo_sample(spark, sf_dir):
    return events(spark, sf_dir).where(F.pmod("row_id", F.lit(7)) == 0).agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


GRID = grid.Grid(Rect((0.0, 0.0), (64.0, 0.125)), 8)
ITEM_POINTS = Points(("q", "d"), ("price", "returned"))
TILE_SQL = f"SELECT (floor(q / 8) * 8 + floor(d / 0.015625))::BIGINT AS part_id, * FROM {ITEMS}"
MOMENT_SQL = ", ".join(f"count({m}) AS n_{m}, round(coalesce(sum({m}), 0.0), 2) AS S_{m}, round(coalesce(sum({m} * {m}), 0.0), 0) AS Q_{m}" for m in ("price", "returned"))


def moments(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 2 if c[0] == "S" else 0).alias(c) if c[0] in "SQ" else F.col(c) for c in df.columns])


@query(f"SELECT part_id, count(*) AS population, {MOMENT_SQL} FROM ({TILE_SQL}) GROUP BY 1")
def grid_tile_moments(spark, sf_dir):
    return moments(grid.tile_moments(items(spark, sf_dir), ITEM_POINTS, GRID))


@query(f"SELECT (part_id // 8)::BIGINT AS parent_id, count(*) AS population, round(sum(price), 2) AS S_price FROM ({TILE_SQL}) GROUP BY 1")
def grid_rollup(spark, sf_dir):
    tiles = grid.tile_moments(items(spark, sf_dir), ITEM_POINTS, GRID)
    return tiles.groupBy(F.floor(F.col("part_id") / 8).alias("parent_id")).agg(F.sum("population").alias("population"), F.round(F.sum("S_price"), 2).alias("S_price"))


@query(f"SELECT part_id, n, (sum(n) OVER (ORDER BY part_id) - n)::BIGINT AS first FROM (SELECT part_id, count(*) AS n FROM ({TILE_SQL}) GROUP BY 1)")
def grid_offsets(spark, sf_dir):
    counts = items(spark, sf_dir).groupBy(GRID.tile(("q", "d")).alias("part_id")).agg(F.count("*").alias("n"))  # a row a tile
    return counts.withColumn("first", F.sum("n").over(Window.orderBy("part_id")) - F.col("n"))


@query(exact_sql(ITEMS, ["price", "returned"], "q >= 5 AND q < 40 AND d >= 0.01 AND d < 0.06"))
def summary_answer_rect(spark, sf_dir):
    """Tiles inside come from summaries, the rest from a scan of the boundary tiles."""
    points, rect = items(spark, sf_dir).withColumn("part_id", GRID.tile(("q", "d"))), Rect((5, 0.01), (40, 0.06))
    inside = [t for t in GRID.covering(rect) if rect.contains(GRID.box(t))]
    edge = [t for t in GRID.covering(rect) if t not in inside]
    known = grid.tile_moments(points, ITEM_POINTS, GRID).where(F.col("part_id").isin(inside))
    rest = grid.tile_moments(points.where(F.col("part_id").isin(edge) & rect.predicate(["q", "d"])), ITEM_POINTS, GRID)
    both = known.union(rest)
    out = []
    for m in ITEM_POINTS.measures:
        out += [F.round(F.coalesce(F.sum(f"S_{m}"), F.lit(0.0)), 2).alias(f"sum_{m}"), F.sum(f"n_{m}").alias(f"count_{m}"), F.round(F.sum(f"S_{m}") / F.sum(f"n_{m}"), 2).alias(f"avg_{m}")]
    return both.agg(*out, F.sum("population").alias("count_star"))


@query(f"SELECT 0::BIGINT AS part_id, t AS pivot FROM (SELECT t, row_number() OVER (ORDER BY t) AS n, count(*) OVER () AS a FROM {ORDERS}) WHERE n = a // 2 + 1")
def kd_median_split(spark, sf_dir):
    return kd.medians(orders(spark, sf_dir).withColumn("part_id", F.lit(0).cast("long")), "t")


@query(f"SELECT count(*) FILTER (WHERE q < 10) AS below_low, count(*) FILTER (WHERE q >= 10 AND q < 30) AS within, count(*) FILTER (WHERE q >= 30) AS above FROM {ITEMS}")
def crack_counts(spark, sf_dir):
    tree = kd.root(items(spark, sf_dir), ["q"], 100)
    tree.crack(Rect((10,), (30,)))
    by = {tree.nodes[i].box.lower[0]: tree.nodes[i].population for i in tree.leaves()}
    low = sorted(by)
    return spark.createDataFrame([tuple(by[k] for k in low)], "below_low long, within long, above long")


PILOT_SQL = f"SELECT u, row_number() OVER (PARTITION BY u ORDER BY {rank_sql('row_id')}, row_id) AS k, v FROM {EVENTS}"


@query(f"SELECT u, count(*) AS m, round(sum(v), 2) AS S, round(sum(v * v), 1) AS Q FROM ({PILOT_SQL}) WHERE k <= 32 GROUP BY 1")
def pilot_sample_stats(spark, sf_dir):
    return rank_prefix(events(spark, sf_dir), "u", F.lit(32)).groupBy("u").agg(F.count("*").alias("m"), F.round(F.sum("v"), 2).alias("S"), F.round(F.sum(F.col("v") * F.col("v")), 1).alias("Q"))


@query(f"SELECT row_id, t, u FROM {EVENTS} ORDER BY {rank_sql('row_id')}, row_id LIMIT 1000")
def reservoir_sample(spark, sf_dir):
    return events(spark, sf_dir).orderBy(rank_hash(F.col("row_id")), "row_id").limit(1000).select("row_id", "t", "u")


@query(f"WITH s AS (SELECT avg(value) AS a, floor(0.01 * count(*) + 0.5) AS b FROM events), r AS (SELECT row_id, power((v - a) / a, 2) AS score, b FROM {EVENTS}, s) SELECT row_id, round(score, 6) AS score FROM r QUALIFY row_number() OVER (ORDER BY score DESC, row_id) <= b")
def outlier_topk(spark, sf_dir):
    return outliers.outliers(events(spark, sf_dir), ["v"], 0.01).select("row_id", F.round("score", 6).alias("score"))


@query(f"SELECT round(avg((u >= 10 AND u < 50)::INT), 6) AS fraction FROM {EVENTS}")
def selectivity_fraction(spark, sf_dir):
    return events(spark, sf_dir).agg(F.round(F.avg(Rect((10,), (50,)).predicate(["u"]).cast("int")), 6).alias("fraction"))


@query(f"SELECT i.place, e.row_id, e.v FROM (SELECT (n * 37) % 1000 AS row_id, n AS place FROM range(50) t(n)) i JOIN {EVENTS} e USING (row_id)")
def gather_by_id(spark, sf_dir):
    ids = spark.range(50).select(((F.col("id") * 37) % 1000).alias("row_id"), F.col("id").alias("place"))
    return prepare.gather(events(spark, sf_dir), ids, ["v"])


COST = "(SELECT event_type AS method, event_id AS query_ordinal, value AS latency FROM events)"


def costs(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.col("event_id").alias("query_ordinal"), F.col("value").alias("latency"))


@query(f"SELECT method, round(sum(latency), 2) AS total, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, round(quantile_cont(latency, 0.99), 6) AS p99, round(avg((latency > 50)::INT), 6) AS slow FROM {COST} GROUP BY 1")
def cost_summary_percentiles(spark, sf_dir):
    c = costs(spark, sf_dir)
    sums = c.groupBy("method").agg(F.round(F.sum("latency"), 2).alias("total"), F.round(F.avg((F.col("latency") > 50).cast("int")), 6).alias("slow"))
    return sums.join(rounded(running.quantiles(c, "method", "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), 6), "method").select("method", "total", "p50", "p95", "p99", "slow")


@query(f"SELECT method, query_ordinal, round(sum(latency) OVER (PARTITION BY method ORDER BY query_ordinal), 2) AS cumulative FROM {COST}")
def cumulative_latency(spark, sf_dir):
    return running.running_sum(costs(spark, sf_dir), "method", "query_ordinal", "latency", "cumulative").select("method", "query_ordinal", F.round("cumulative", 2).alias("cumulative"))


@query(f"SELECT method, count(*) FILTER (WHERE latency > before) AS rises FROM (SELECT method, latency, lag(latency) OVER (PARTITION BY method ORDER BY query_ordinal) AS before FROM {COST}) GROUP BY 1")
def monotone_lag_check(spark, sf_dir):
    return running.lagged(costs(spark, sf_dir), "method", "query_ordinal", "latency").groupBy("method").agg(F.count_if(F.col("latency") > F.col("before")).alias("rises"))


@query("SELECT l_returnflag, round(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 2) AS F, round(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY 1")
def pivot_threshold(spark, sf_dir):
    out = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_extendedprice"))
    return rounded(out)


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def plan_diff_anti(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) GROUP BY 1")
def facet_semi_join(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer").where("c_acctbal > 0"), read(spark, sf_dir, "orders")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


MEANS = "(SELECT l_returnflag AS f, l_linestatus AS l, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1, 2)"


def means(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("l")).agg(F.avg("l_extendedprice").alias("mean"))


@query(f"SELECT f, l, round(mean / min(mean) OVER (PARTITION BY f), 6) AS relative FROM {MEANS}")
def row_min_normalised(spark, sf_dir):
    return means(spark, sf_dir).select("f", "l", F.round(F.col("mean") / F.min("mean").over(Window.partitionBy("f")), 6).alias("relative"))


@query(f"SELECT f, round(max(mean) - min(mean), 4) AS span, round(max(mean) / min(mean), 6) AS ratio FROM {MEANS} GROUP BY 1")
def flatness_span(spark, sf_dir):
    return means(spark, sf_dir).groupBy("f").agg(F.round(F.max("mean") - F.min("mean"), 4).alias("span"), F.round(F.max("mean") / F.min("mean"), 6).alias("ratio"))


@query(f"SELECT f, l FROM {MEANS} WHERE f IN (SELECT f FROM {MEANS} GROUP BY f HAVING count(DISTINCT l) > 1)")
def varying_axis_groups(spark, sf_dir):
    """Groups whose other axis takes more than one value."""
    m = means(spark, sf_dir)
    varied = m.groupBy("f").agg(F.count_distinct("l").alias("n")).where("n > 1").select("f")
    return m.join(varied, "f", "left_semi").select("f", "l")


@query(f"SELECT method, round(quantile_cont(e, 0.5), 6) AS p50, round(quantile_cont(e, 0.95), 6) AS p95, round(max(e), 6) AS worst FROM (SELECT method, abs(latency - 50) / 50 AS e FROM {COST}) GROUP BY 1")
def error_quantiles(spark, sf_dir):
    e = costs(spark, sf_dir).withColumn("e", F.abs(F.col("latency") - 50) / 50)
    worst = e.groupBy("method").agg(F.round(F.max("e"), 6).alias("worst"))
    return rounded(running.quantiles(e, "method", "e", {"p50": 0.5, "p95": 0.95}), 6).join(worst, "method")


@query(f"WITH m AS (SELECT method, max(query_ordinal) AS last FROM {COST} GROUP BY 1) SELECT method, count(*) AS n, round(sum(latency), 2) AS total FROM {COST} WHERE query_ordinal <= (SELECT min(last) FROM m) GROUP BY 1")
def shared_prefix_totals(spark, sf_dir):
    """Only the ordinals that every method has reached."""
    c = costs(spark, sf_dir)
    least = c.groupBy("method").agg(F.max("query_ordinal").alias("last")).agg(F.min("last").alias("least"))
    return c.join(F.broadcast(least), F.col("query_ordinal") <= F.col("least")).groupBy("method").agg(F.count("*").alias("n"), F.round(F.sum("latency"), 2).alias("total"))  # one row


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^199[5-7]') AND o_totalprice BETWEEN 1000 AND 200000")
def regex_bbox_filter(spark, sf_dir):
    # the years that the pattern allows, as a range too: the scan skips by it
    years = (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    kept = read(spark, sf_dir, "orders").where(years & F.date_format("o_orderdate", "yyyy-MM-dd").rlike("^199[5-7]") & F.col("o_totalprice").between(1000, 200000))
    return kept.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"SELECT ({rank_sql('row_id')} % 16)::BIGINT AS bucket, count(*) AS n, round(sum(v), 2) AS total FROM {EVENTS} GROUP BY 1")
def hashed_buckets(spark, sf_dir):
    return events(spark, sf_dir).groupBy((rank_hash(F.col("row_id")) % 16).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


PLAN_SQL = """
WITH w AS (SELECT * FROM (VALUES ('small', 2, 100), ('wide', 4, 50)) w(workload, there, queries)),
m AS (SELECT * FROM (VALUES ('scan', 'scan', false), ('grid_agg', 'grid', false), ('akd_agg_approx', 'akd', true)) m(method, substrate, near))
SELECT workload, method, substrate, measures::INT AS measures, threshold::INT AS threshold, true AS resident, replicate::INT AS replicate, error_bound::DOUBLE AS error_bound,
  outlier_budget::DOUBLE AS outlier_budget, (CASE WHEN substrate LIKE 'grid%' THEN 8 ELSE 1 END)::INT AS tiles, least(queries, 80)::INT AS queries
FROM w, m, (VALUES (2), (4)) n(measures), (VALUES (512), (1024)) t(threshold), (VALUES (0), (1)) r(replicate), (VALUES (0.0), (0.01), (0.05)) e(error_bound), (VALUES (0.0), (0.01)) o(outlier_budget)
WHERE measures <= there AND (substrate <> 'scan' OR threshold = 512) AND (near OR replicate = 0) AND (error_bound > 0) = near AND outlier_budget = CASE WHEN near AND workload = 'wide' THEN 0.01 ELSE 0.0 END
"""


@query(PLAN_SQL)
def legal_plan_cells(spark, sf_dir):
    """Axes of a plan multiplied out, without what makes no sense."""
    from .plans import experiment

    plan = experiment.Plan({"small": (2, 100), "wide": (4, 50)}, ["scan", "grid_agg", "akd_agg_approx"], [2, 4], [0.01, 0.05], [512, 1024], replicates=2, budgets={"wide": [0.01]}, tiles=8, max_queries=80)
    return experiment.as_table(spark, plan)


@query("SELECT c_nationkey AS nation, c_mktsegment AS segment FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT DISTINCT c_mktsegment FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000")
def missing_cells(spark, sf_dir):
    """Cells that a plan expects and results lack."""
    from .sources.results import missing

    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    there = c.where("c_acctbal > 9000").select("nation", "segment")
    axis = [r[0] for r in c.select("segment").distinct().collect()]  # one axis of a plan
    expected = c.select("nation").distinct().select("nation", F.explode(F.array(*[F.lit(x) for x in axis])).alias("segment"))
    return missing(expected, there, ["nation", "segment"])


@query(f"SELECT u, count(*) AS n FROM {EVENTS} GROUP BY u HAVING max((v > 150)::INT) = 0")
def never_covered(spark, sf_dir):
    """Positions that no replicate covers."""
    return events(spark, sf_dir).groupBy("u").agg(F.count("*").alias("n"), F.bool_or(F.col("v") > 150).alias("any")).where(~F.col("any")).select("u", "n")


def approximate(spark, sf_dir, target: float = 0.05):
    """The engine over tiles of time and user, a rectangle, and its result to a relative error."""
    from .plans.engine import Engine
    from .spec import Target, lifted

    points = events(spark, sf_dir)
    t0, t1, u0, u1 = points.agg(F.min("t"), F.max("t"), F.min("u"), F.max("u")).first()
    box = Rect((t0, u0), (lifted(t1), lifted(u1)))
    engine = Engine(points, Points(("t", "u"), ("v",)), grid.Grid(box, 4))
    rect = Rect((t0, u0 + (u1 - u0) * 0.1), (lifted(t1), u0 + (u1 - u0) * 0.8))
    return engine, rect, engine.execute(rect, Target(target))


@query(None)
def approx_rect_ci(spark, sf_dir):
    """SUM, COUNT and AVG to 5 % at 95 % confidence, by tiles of time and user."""
    _, _, got = approximate(spark, sf_dir)
    rows = [(e.aggregate, e.measure, float(e.estimate), float(e.ci_low), float(e.ci_high), e.exact, got.status, got.rows_read) for e in got.estimates]
    return spark.createDataFrame(rows, "aggregate string, measure string, estimate double, ci_low double, ci_high double, exact boolean, status string, rows_read long")


@query(f"WITH b AS (SELECT min(u) AS u0, max(u) AS u1 FROM {EVENTS}) SELECT a AS aggregate, true AS covered, true AS within, true AS reads_less, (SELECT count(*) FROM {EVENTS}, b WHERE u >= u0 + (u1 - u0) * 0.1 AND u < u0 + (u1 - u0) * 0.8) AS count_star FROM (VALUES ('SUM'), ('COUNT'), ('AVG')) t(a)")
def approx_rect_properties(spark, sf_dir):
    """Of each estimate whether its interval, a little widened, holds the truth and its half-width the bound, of rows read whether they are fewer than a scan's; and COUNT(*), which is exact."""
    engine, rect, got = approximate(spark, sf_dir)
    truth = exact.exact_scan(engine.points, engine.spec, rect).first()
    rows = []
    for e in got.estimates[:3]:
        t, half = truth[f"{e.aggregate.lower()}_v"], e.ci_high - e.estimate
        rows.append((e.aggregate, bool(abs(e.estimate - t) <= 2 * half + 1e-6 * abs(t)), e.exact or e.relative_half_width <= 0.05, got.rows_read <= truth["count_star"], int(got.estimates[-1].estimate)))
    return spark.createDataFrame(rows, "aggregate string, covered boolean, within boolean, reads_less boolean, count_star long")


SAMPLE_BOUND = 1 << 30  # a quarter of all ranks
STRATA_GRID = grid.Grid(Rect((0.0, 0.0), (64.0, 0.125)), 4)
LINES = "(SELECT l_orderkey * 8 + l_linenumber AS row_id, l_quantity AS q, l_discount AS d, l_extendedprice AS price, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS returned FROM lineitem)"
STRATA_SQL = f"""
ranked AS (SELECT floor(q / 16) * 4 + floor(d / 0.03125) AS part, returned AS x, {rank_sql('row_id')} < {SAMPLE_BOUND} AS taken FROM {LINES} WHERE q >= 5 AND q < 45),
strata AS (SELECT part, count(*)::DOUBLE AS size, count(*) FILTER (taken)::DOUBLE AS m, count(x) FILTER (taken)::DOUBLE AS c, coalesce(sum(x) FILTER (taken), 0.0) AS sx, coalesce(sum(x * x) FILTER (taken), 0.0) AS sxx FROM ranked GROUP BY 1)"""


def line_strata(spark, sf_dir):
    """A Stratum for each tile, from a rank sample."""
    from .operators.estimate import Stratum

    points = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("x"))
    taken = lambda c: F.when(rank_hash(F.col("row_id")) < SAMPLE_BOUND, c)
    x = F.col("x")
    rows = points.where(Rect((5,), (45,)).predicate(["q"])).groupBy(STRATA_GRID.tile(("q", "d")).alias("part")).agg(F.count("*").alias("N"), F.count(taken(F.lit(1))).alias("m"), F.count(taken(x)).alias("n"), F.coalesce(F.sum(taken(x)), F.lit(0.0)).alias("S"), F.coalesce(F.sum(taken(x * x)), F.lit(0.0)).alias("Q"))
    return {r["part"]: Stratum(r["N"], r["m"], r["n"], r["S"], r["Q"]) for r in rows.collect()}  # a row a tile


@query(f"""
WITH {STRATA_SQL},
single AS (SELECT *, 1 - m / size AS rest, greatest(0.0, (sxx - sx * sx / m) / (m - 1)) AS spread, CASE WHEN c > 0 AND c < m THEN c / m ELSE (c + 3.841458820694124 / 2) / (m + 3.841458820694124) END AS p FROM strata),
total AS (SELECT sum(size * sx / m) AS all_x, sum(size * c / m) AS all_c FROM strata),
parts AS (SELECT *, size * size * spread / m * rest AS vs, size * size * p * (1 - p) / (m - 1) * rest AS vc, size * size * sx * (m - c) / (m * m * (m - 1)) * rest AS cov FROM single, total),
ratio AS (SELECT *, greatest(0.0, (vs - 2 * all_x / all_c * cov + power(all_x / all_c, 2) * vc) / (all_c * all_c)) AS va FROM parts),
found AS (SELECT 'SUM' AS aggregate, max(all_x) AS e, sum(vs) AS v, sum(vs * vs / (m - 1)) AS w FROM ratio UNION ALL
  SELECT 'COUNT', max(all_c), sum(vc), sum(vc * vc / (m - 1)) FROM ratio UNION ALL
  SELECT 'AVG', max(all_x / all_c), sum(va), sum(va * va / (m - 1)) FROM ratio)
SELECT aggregate, round(e, 2) AS estimate, round(sqrt(v), 2) AS std_error, round(v * v / w, 2) AS effective_df FROM found
""")
def stratified_estimate(spark, sf_dir):
    """Estimates from a stratified rank sample, their standard errors and degrees of freedom."""
    from .functions.quantiles import t_quantile
    from .operators.estimate import estimate

    strata = line_strata(spark, sf_dir)
    found = estimate({"returned": list(strata.values())}, sum(h.N for h in strata.values()), {}, 1.0, 0.95)[:3]
    rows = [(e.aggregate, round(e.estimate, 2), round((e.ci_high - e.estimate) / t_quantile(0.975, e.effective_df), 2), round(e.effective_df, 2)) for e in found]
    return spark.createDataFrame(rows, "aggregate string, estimate double, std_error double, effective_df double")


@query(f"""
WITH {STRATA_SQL},
spreads AS (SELECT part, size, sqrt(greatest(0.0, (sxx - sx * sx / m) / (m - 1))) AS dev, sum(size * sx / m) OVER () AS total FROM strata),
sums AS (SELECT *, sum(size * dev) OVER () AS a, sum(size * dev * dev) OVER () AS b FROM spreads)
SELECT part::BIGINT AS part_id, least(size, ceil(a * a / (power(0.05 * total / 1.959963984540054, 2) + b) * size * dev / a))::BIGINT AS rows FROM sums
""")
def neyman_allocation(spark, sf_dir):
    """Rows of each stratum for a SUM to 5 %, by size and spread."""
    import math

    from .operators.estimate import neyman

    strata = line_strata(spark, sf_dir)
    spreads = [math.sqrt(max(0.0, (h.Q - h.S**2 / h.m) / (h.m - 1))) for h in strata.values()]
    budget = (0.05 * sum(h.N * h.S / h.m for h in strata.values()) / 1.959963984540054) ** 2
    return spark.createDataFrame(list(zip(strata, neyman([h.N for h in strata.values()], spreads, budget), strict=True)), "part_id long, rows long")


TREE_SQL = f"SELECT round(sum(p), 2) AS sum_p, count(p) AS count_p, round(avg(p), 2) AS avg_p, count(*) AS count_star FROM {ORDERS} WHERE c >= 100 AND c < 900 AND t >= 820454400 AND t < 852076800"


TREE_RECT = Rect((100.0, 820454400.0), (900.0, 852076800.0))


def tree_engine(spark, sf_dir, index: str, held_share: float = 0.0, approximate: bool = False, threshold: int = 4096):
    from .plans.runner import Method, engine

    return engine(orders(spark, sf_dir), Points(("c", "t"), ("p",)), Rect((0.0, 694224000.0), (1e5, 915148800.0)), Method(index, index, True, approximate), threshold=threshold, held_share=held_share)


def answers(spark, result) -> DataFrame:
    found = {e.aggregate: e.estimate for e in result.estimates}
    row = (round(found["SUM"], 2), int(found["COUNT"]), round(found["AVG"], 2), int(found["COUNT_STAR"]))
    return spark.createDataFrame([row], "sum_p double, count_p long, avg_p double, count_star long")


def by_engine(spark, sf_dir, index: str, held_share: float = 0.0) -> DataFrame:
    """The second of two equal rectangles, which summaries answer where they can."""
    parts = tree_engine(spark, sf_dir, index, held_share)
    parts.execute(TREE_RECT)
    return answers(spark, parts.execute(TREE_RECT))


@query(TREE_SQL)
def cracked_tree_rect(spark, sf_dir):
    return by_engine(spark, sf_dir, "akd")


@query(TREE_SQL)
def median_tree_rect(spark, sf_dir):
    """All leaves are read at once, before any query, and added up into their parents."""
    return by_engine(spark, sf_dir, "kd")


@query(TREE_SQL)
def cracked_tiles_rect(spark, sf_dir):
    """Equal-width tiles, cut inside along the query."""
    return by_engine(spark, sf_dir, "grid_akd")


@query(TREE_SQL)
def held_out_rect(spark, sf_dir):
    return by_engine(spark, sf_dir, "grid", 0.01)


@query(f"SELECT count(*) AS rows, round(sum(p), 2) AS sum_p, count(p) AS count_p FROM {ORDERS}")
def rolled_up_root(spark, sf_dir):
    """The root's summary: its leaves', added up through all their parents without reading again."""
    parts = tree_engine(spark, sf_dir, "kd")
    root = parts.known[0]
    return spark.createDataFrame([(root.N, round(root.strata["p"].S, 2), root.strata["p"].n)], "rows long, sum_p double, count_p long")


@query("SELECT true AS sampled_first, 0::BIGINT AS rows_read_again, true AS same_estimates, 0::BIGINT AS outliers_read_again")
def kept_samples(spark, sf_dir):
    """Samples and outliers of strata inside a rectangle stay known: asked again, nothing is read."""
    from .spec import Target

    parts = tree_engine(spark, sf_dir, "grid", 0.01, approximate=True)
    whole = Rect((-1.0, 694224000.0), (1e6, 915148800.0))
    first, again = (parts.execute(whole, Target(0.2)) for _ in range(2))
    same = [e.estimate for e in first.estimates] == [e.estimate for e in again.estimates]
    return spark.createDataFrame([(first.rows_read > 0, again.rows_read, same, again.outlier_rows)], "sampled_first boolean, rows_read_again long, same_estimates boolean, outliers_read_again long")


@query(f"SELECT count(*) AS rows, count(*) AS in_one_leaf, 0::BIGINT AS in_others FROM {ORDERS} WHERE c >= 100 AND c < 900 AND t >= 820454400 AND t < 852076800")
def disjoint_cover(spark, sf_dir):
    """Each row of a rectangle lies in the box of the one stratum of the cover that its place is told to be in, and in no other."""
    parts = tree_engine(spark, sf_dir, "grid_akd", threshold=64)
    parts.execute(TREE_RECT)
    cover, dims = parts.grid.covering(TREE_RECT), ["c", "t"]
    boxes = F.broadcast(spark.createDataFrame([(i, *map(float, parts.grid.box(i).lower), *map(float, parts.grid.box(i).upper)) for i in cover], "node long, c0 double, t0 double, c1 double, t1 double"))  # a row a stratum
    rows = parts.points.where(TREE_RECT.predicate(dims)).withColumn("own", parts.grid.tile(dims, TREE_RECT))
    inside = rows.join(boxes, (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1")) & (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1")), "left")
    return inside.agg(F.count_distinct("row_id").alias("rows"), F.count_if(F.col("own") == F.col("node")).alias("in_one_leaf"), F.count_if(F.coalesce(F.col("own") != F.col("node"), F.lit(True))).alias("in_others"))


@query("SELECT 'akd_agg' AS method, true AS ok, true AS inert UNION ALL SELECT 'grid_akd_agg_approx', true, true UNION ALL SELECT 'scan', true, true")
def run_identities(spark, sf_dir):
    """Of each method whether reads and frontiers add up for every query, and no outliers are read where none are held out."""
    from .operators import validation
    from .plans import runner
    from .spec import Target

    methods = [m for m in runner.METHODS if m.name in ("scan", "akd_agg", "grid_akd_agg_approx")]
    points, spec = orders(spark, sf_dir), Points(("c", "t"), ("p",))
    got = runner.run(points, spec, Rect((0.0, 694224000.0), (1e5, 915148800.0)), [TREE_RECT, TREE_RECT], methods, Target(0.1), k=4, threshold=4096)
    ok = validation.status_ok(got, 1).groupBy("method").agg(F.bool_and("ok").alias("ok"))
    return ok.join(validation.inert(got).withColumnRenamed("ok", "inert"), "method").select("method", "ok", "inert")
