"""Rectangles, trees, quantiles, estimates and the catalog against DuckDB."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import sampling
from tessera.functions.quantiles import chi_squared_quantile, t_quantile
from tessera.operators import figures, kd, running, validation
from tessera.operators.estimate import Stratum, estimate, neyman, pilot
from tessera.plans import experiment, runner, workload
from tessera.plans.engine import Engine, clustered
from tessera.operators.grid import Grid
from tessera.sources import prepare, results, synthetic
from tessera.spec import Points, Rect, Target

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_catalog(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name not in catalog.SQL:
        assert df.count()
        return
    with duckdb.connect() as c:
        for f in os.listdir(SF):
            c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
        want = c.sql(catalog.SQL[name])
        cols = sorted(want.columns)
        assert sorted(df.columns) == cols
        put = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
        theirs = sorted((tuple(map(put, r)) for r in want.select(*cols).fetchall()), key=str)
    ours = sorted((tuple(map(put, r)) for r in df.select(*cols).collect()), key=str)
    assert ours == theirs


def test_geometry():
    a, b = Rect((0, 0), (2, 2)), Rect((2, 0), (3, 2))
    assert not a.intersects(b) and a.intersects(Rect((1, 1), (3, 3))) and Rect((0, 0), (4, 4)).contains(a)


def test_quantiles():
    for nu, want in ((1, 12.7062), (5, 2.57058), (30, 2.04227)):
        assert t_quantile(0.975, nu) == pytest.approx(want, rel=1e-5)
    assert chi_squared_quantile(0.05, 10) == pytest.approx(3.940, abs=0.02)


def test_estimate():
    found = {e.aggregate: e for e in estimate({"m": [Stratum(100, 10, 10, 55.0, 385.0)]}, 100, {}, 5.5, 0.95)}
    assert found["SUM"].estimate == 550 and found["AVG"].estimate == 5.5 and found["SUM"].effective_df == pytest.approx(9)
    assert found["SUM"].ci_high - 550 == pytest.approx(t_quantile(0.975, 9) * math.sqrt(8250))
    assert estimate({"m": [Stratum(5, 1, 1, 2.0, 4.0)]}, 5, {}, 1, 0.95)[0].ci_high == math.inf
    assert pilot(64) == 64 and pilot(65) == 32 and neyman([10, 10], [1.0, 0.0], 1e-9) == [10, 0]


def test_tree(spark):
    df = spark.createDataFrame([(float(i % 20), float(i // 20)) for i in range(400)], "x double, y double")
    tree = kd.root(df, ["x", "y"], 16)
    assert tree.crack(Rect((3, 3), (9, 9))) and sum(tree.nodes[i].population for i in tree.leaves()) == 400
    sizes = [r["count"] for r in kd.static_split(df, ["x", "y"], 50).groupBy("part_id").count().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 50


def test_engine(spark):
    df = spark.range(4000).selectExpr("id AS row_id", "cast(id % 100 AS double) AS x", "cast(id % 7 AS double) AS y", "cast(50 + (id * 37) % 31 AS double) AS m")
    engine = Engine(df, Points(("x", "y"), ("m",)), Grid(Rect((0, 0), (100, 7)), 4))
    rect, truth = Rect((0, 0), (50, 7)), df.where("x < 50").selectExpr("sum(m)", "count(*)").first()
    close = engine.execute(rect, Target(0.05))
    assert close.estimates[0].ci_low <= close.estimates[0].estimate <= close.estimates[0].ci_high and close.rows_read < 2000
    assert close.estimates[0].estimate == pytest.approx(truth[0], rel=0.05) and close.estimates[-1].estimate == truth[1]
    assert engine.execute(rect, Target(0.05)).rows_read == 0  # samples of strata inside are kept
    exact = engine.execute(rect)
    assert exact.estimates[0].estimate == pytest.approx(truth[0]) and exact.estimates[0].exact and exact.rows_read == 2000 - close.rows_read
    assert engine.execute(rect).rows_read == 0
    hard = Engine(df, Points(("x", "y"), ("m",)), Grid(Rect((0, 0), (100, 7)), 4), rounds=2).execute(rect, Target(1e-5))
    assert (hard.status, hard.exactify_cause) == ("exactified", "gave_up") and hard.pre_exactification_error_bound > 1e-5 and hard.estimates[0].exact
    far = spark.range(100).selectExpr("id + 4294967296 * (id % 3) AS row_id")
    assert far.select(sampling.rank_hash(F.col("row_id"))).distinct().count() == 100


def test_clustered_points(spark, tmp_path):
    """Stored tiles and ranks give the same answers, and scans are asked for few rows only."""
    df = spark.range(20000).selectExpr("id AS row_id", "cast((id * 7919) % 1000 AS double) AS x", "cast((id * 31) % 77 AS double) AS y", "cast(50 + (id * 37) % 31 AS double) AS m")
    spec, parts = Points(("x", "y"), ("m",)), Grid(Rect((0.0, 0.0), (1000.0, 77.0)), 4)
    clustered(df, spec, parts, str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "c"))
    for rect in (Rect((0.0, 0.0), (500.0, 77.0)), Rect((100.0, 5.0), (700.0, 60.0))):
        plain, stored = (Engine(p, spec, parts, stored=s).execute(rect, Target(0.02)) for p, s in ((df, None), (rows, ("tile", "rank"))))
        assert [str(e) for e in plain.estimates] == [str(e) for e in stored.estimates] or plain.estimates[0].estimate == pytest.approx(stored.estimates[0].estimate)
        assert plain.rows_read == stored.rows_read < 5000
    with pytest.raises(ValueError):
        Engine(rows, spec, parts, run_id=1, stored=("tile", "rank"))


def test_walked_tree(spark):
    """A large tree tells nodes as a small one does."""
    df = spark.range(3000).selectExpr("id AS row_id", "cast((id * 7919) % 1000 AS double) AS x", "cast((id * 104729) % 997 AS double) AS y")
    tree = kd.root(df, ["x", "y"], 16).build()
    assert len(tree.nodes) > 2 * kd.COMPARED
    steps = tree.steps(None, (), 0)
    told = df.select("x", "y", tree.walked(["x", "y"], steps, 0).alias("node")).collect()
    sizes = {}
    for r in told:
        box = tree.nodes[r["node"]].box
        assert tree.nodes[r["node"]].children is None and box.contains(Rect((r["x"], r["y"]), (r["x"], r["y"])))
        sizes[r["node"]] = sizes.get(r["node"], 0) + 1
    assert sizes == {i: tree.nodes[i].population for i in tree.leaves()}
    rect = Rect((100.0, 200.0), (500.0, 800.0))
    cut = kd.Forest(df, ["x", "y"], 16, Grid(Rect((0.0, 0.0), (1000.0, 1000.0)), 4))
    assert cut.crack(rect) and sum(cut.nodes[i].population for i in cut.leaves()) == 3000
    found = {r["n"]: r["count"] for r in df.groupBy(cut.tile(["x", "y"]).alias("n")).count().collect()}
    assert found == {i: cut.nodes[i].population for i in cut.leaves()}


def test_order_statistics(spark):
    rng = random.Random(3)
    groups = {"a": [rng.gauss(0, 1e6) for _ in range(900)], "b": [1.0] * 500 + [2.0], "c": [rng.choice([0.0, 1e-9, 1e9]) for _ in range(700)], "d": [5.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, v double")
    for few in (10, 10**6):  # brackets are narrowed, or sorted at once
        got = {r["k"]: r["pivot"] for r in kd.medians(df, "v", "k", few).collect()}
        assert got == {k: sorted(vs)[len(vs) // 2] for k, vs in groups.items()}
        got = {r["k"]: r["p"] for r in running.quantiles(df, "k", "v", {"p": 0.95}, few).collect()}
        want = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("v", 0.95).alias("p")).collect()}
        assert got == pytest.approx(want)
    rows = spark.createDataFrame([("a" if i % 3 else "b", i, float(i % 7)) for i in range(300)], "k string, o long, v double")
    w = Window.partitionBy("k").orderBy("o")
    want = rows.select("k", "o", F.sum("v").over(w).alias("s"), F.lag("v").over(w).alias("l"))
    got = running.running_sum(rows, "k", "o", "v", "s", width=16).join(running.lagged(rows, "k", "o", "v", "l", width=16).select("k", "o", "l"), ["k", "o"]).select("k", "o", "s", "l")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_plan_cells():
    plan = experiment.Plan({"w": (2, 10)}, ["scan", "grid", "akd_approx"], measures=[1, 2, 4], thresholds=[64, 128], replicates=3, error_bounds=[0.01, 0.1])
    cells = experiment.cells(plan)
    assert len(cells) == 2 * 1 + 2 * 2 + 2 * 2 * 3 * 2 and len(set(cells)) == len(cells)
    with pytest.raises(ValueError, match="no such methods"):
        experiment.cells(experiment.Plan({"w": (2, 10)}, ["none"]))


def test_prepare(spark, tmp_path):
    rows = [(10.0, "5"), (50.0, "X"), (10.0, "-3"), (200.0, "7"), (-5.0, "2"), (30.0, "8"), (None, "1"), (float("nan"), "1")]
    spec = prepare.Dataset({"x": (0, 100)}, ["m"], [("m", "<", 0)])
    out = prepare.prepare(spark.createDataFrame(rows, "x double, m string"), spec)
    stats = prepare.describe(out, ["m"]).first()
    assert (stats["non_nan_count"], stats["nan_count"], stats["sum"]) == (2, 1, 13)
    with pytest.raises(ValueError, match="no columns"):
        prepare.prepare(out, prepare.Dataset({"z": (0, 1)}, []))
    (tmp_path / "a.csv").write_text("10,1.5\n20,2.5\n")
    assert prepare.read_csv(spark, str(tmp_path / "a.csv"), header=False).dtypes == [("col0", "int"), ("col1", "double")]
    (tmp_path / "b.csv").write_text("a,b\nNA,x\n,NA\n3,\n")
    assert [tuple(r) for r in prepare.read_csv(spark, str(tmp_path / "b.csv"), null="NA").collect()] == [(None, "x"), (None, None), (3, None)]
    assert out.columns == ["row_id", "x", "m"] and out.select("row_id").distinct().count() == out.count()
    numbered = spark.createDataFrame([(i, float(i)) for i in range(9, -1, -1)], "row_id long, x double")
    assert [r["row_id"] for r in prepare.prepare(numbered, prepare.Dataset({"x": (2, 99)}, [], max_rows=3)).collect()] == [2, 3, 4]
    with pytest.raises(ValueError, match="max_rows"):
        prepare.prepare(numbered.select("x"), prepare.Dataset({"x": (2, 99)}, [], max_rows=3))
    asked = spark.createDataFrame([(0, 5), (1, 2), (2, 5)], "place long, row_id long")
    for most in (0, 10):
        assert [(r["row_id"], r["x"]) for r in prepare.gather(numbered, asked, ["x"], most=most).orderBy("place").collect()] == [(5, 5.0), (2, 2.0), (5, 5.0)]
    with pytest.raises(IndexError):
        prepare.gather(numbered, spark.createDataFrame([(0, 50)], "place long, row_id long"), ["x"])


def test_data_sets(spark, tmp_path):
    spec = prepare.Dataset({"col0": (0, 10)}, ["col1"])
    source = prepare.Source(spec, rows=500, columns=[synthetic.Spread("uniform", 0, 12), synthetic.Spread("normal", 5, 1)])
    path = str(tmp_path / "d")
    assert prepare.ensure(spark, source, path) and not prepare.ensure(spark, source, path)
    told = prepare.read_manifest(spark, f"{path}/manifest")
    assert 300 < told["row_count"] < 500 and [m["measure"] for m in told["measures"]] == ["col1"]
    assert prepare.ensure(spark, prepare.Source(spec, rows=400, columns=source.columns), path)
    files = prepare.Source(prepare.Dataset({"col0": (0, 5)}, ["col1"]), parquet=f"{path}/points")
    assert prepare.ensure(spark, files, str(tmp_path / "e")) and not prepare.ensure(spark, files, str(tmp_path / "e"))
    for bad in ({"row_count": 1}, told | {"row_count": 1}, told | {"dimensions": [{"name": "col0", "low": 2, "high": 1}]}, told | {"dimensions": [{"name": "col1", "low": 0, "high": 1}]}):
        with pytest.raises(ValueError):
            prepare.validate(bad)


def test_workload(spark):
    df = spark.range(10000).selectExpr("id AS row_id", "cast(id % 100 AS double) AS x", "cast(id div 100 AS double) AS y")
    dims, domain = Points(("x", "y"), ()), Rect((0.0, 0.0), (100.0, 100.0))
    for spec in (workload.Workload(20, 0.1), workload.Workload(20, 0.25, "clustered", (50.0, 50.0), seed=3)):
        rects = workload.generate(df, dims, domain, spec)
        inside = [(lambda r: df.where(r.predicate(["x", "y"])).count() / 10000)(r) for r in rects[:4]]
        assert all(abs(s - spec.selectivity) <= 0.2 * spec.selectivity for s in inside) and all(domain.contains(r) for r in rects)
        assert rects == workload.generate(df, dims, domain, spec)
    plain = workload.generate(df, dims, domain, workload.Workload(5, 0.04, calibrated=False))
    assert all(r.upper[0] - r.lower[0] == pytest.approx(20) for r in plain)
    assert workload.fingerprint(spec, domain) != workload.fingerprint(workload.Workload(20, 0.1), domain)
    assert workload.as_table(spark, rects).count() == 20


def test_methods(spark):
    """Every method agrees with the scan, or covers it, on a table with missing and extreme values."""
    df = spark.range(3000).selectExpr("id AS row_id", "cast(id % 60 AS double) AS x", "cast(id div 60 AS double) AS y", "cast(10 + (id * 37) % 31 + if(id % 500 = 0, 1e5, 0) AS double) AS m", "cast(if(id % 3 = 0, id % 11, null) AS double) AS k").coalesce(2).cache()
    spec, domain = Points(("x", "y"), ("m", "k")), Rect((0.0, 0.0), (60.0, 50.0))
    rects = [Rect((5, 5), (41, 33)), Rect((5, 5), (41, 33)), Rect((200, 200), (300, 300))]
    methods = [m for m in runner.METHODS if m.name in ("scan", "kd", "grid_agg", "kd_agg", "akd_agg", "akd_agg_approx", "grid_akd_agg", "grid_akd_agg_approx")]
    got = runner.run(df, spec, domain, rects, methods, Target(0.1), k=4, threshold=200, held_share=0.002).cache()
    rows = validation.judged(got, got.where("method = 'scan'")).cache()
    assert rows.where("NOT exact_ok OR NOT brackets OR NOT same_query").count() == 0
    assert rows.where("exact AND NOT covered").count() == 0 and rows.where("NOT covered").count() <= 2
    assert validation.status_ok(got, 2).where("NOT ok").count() == 0 and validation.complete(got).first()["ok"]
    reads = {(r["method"], r["query_ordinal"]): r["rows_read"] for r in got.collect()}
    assert reads["akd_agg", 0] > 1000 and reads["akd_agg", 1] < 20 and reads["grid_akd_agg", 0] > 1000 and reads["grid_akd_agg", 1] < reads["grid_akd_agg", 0] and reads["scan", 2] == 0  # tiles below the threshold are never cut
    assert reads["grid_agg", 0] == reads["grid_agg", 1] < reads["scan", 0] and reads["kd_agg", 0] < reads["scan", 0] == reads["kd", 0]  # read whole before the first query
    by = {d["check"]: d["status"] for d in validation.diagnostics(got)}
    assert by["no method reads more than scan"] == by["exact methods without summaries read the same"] == by["kd_agg measure_reads kd"] == "PASS"
    assert not validation.inert(got).where("method = 'scan'").first()["ok"] and validation.shared(got, "confidence") == 0.95 and validation.several(got, "method")
    with pytest.raises(ValueError, match="differ in method"):
        validation.shared(got, "method")
    resident = runner.run(df, spec, domain, rects, methods[:1], Target(0.1), resident=True)
    assert [str(r["estimate"]) for r in resident.collect()] == [str(r["estimate"]) for r in got.where("method = 'scan'").collect()]
    assert {r["verdict"] for r in validation.coverage(rows)} <= {"insufficient"}
    assert validation.costs(got).where("method = 'scan'").first()["speedup"] == 1 and validation.reads_fall(got).where("NOT ok").count() == 0


def test_workload_files(spark, tmp_path):
    rects = [Rect((0.1, -2.0), (1 / 3, 5.0)), Rect((0.0, 0.0), (1e-9, 1e300))]
    workload.save(spark, rects, 12345678901234567890, str(tmp_path / "w"))
    assert workload.load(spark, str(tmp_path / "w")) == (12345678901234567890, rects)
    spark.createDataFrame([("fingerprint=1\nlower_0,upper_0\n1,2,3",)], "value string").coalesce(1).write.text(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        workload.load(spark, str(tmp_path / "bad"))


def test_result_files(spark, tmp_path):
    cells = [("SUM", "m", 1 / 3, 0.1, 0.5, 0.6, 9.5, False), ("COUNT_STAR", "", 7.0, 7.0, 7.0, 0.0, 0.0, True)]
    tail = (40, 0, 0, 3, 1, 1, 1, 0, 1, "none", None)
    rows = [("grid_akd_approx", 0, q, [0.0], [9.0], 0.7, 0.95, m, a, *x, "ok", 2, 40, 40, 1.0, 2.5, *tail) for q in range(3) for a, m, *x in cells]
    long = spark.createDataFrame(rows, runner.SCHEMA)
    wide = results.per_query(long, "points", "random")
    assert tuple(wide.columns) == results.COLUMNS and len(results.COLUMNS) == 29 and wide.count() == 3
    assert {(r["target_satisfied"], r["sampled_rows"], r["exactified_rows"], r["substrate"]) for r in wide.collect()} == {(True, 40, 0, "grid_akd")}
    assert wide.where("frontier_partitions <> 3 OR query_local_strata <> 1 OR round_paths <> '[]' OR exactify_cause <> 'none'").count() == 0
    results.write(wide, str(tmp_path / "r"))
    back = results.read(spark, str(tmp_path / "r"))
    same = ["method", "replicate", "query_ordinal", "lower", "upper", *results.PARTS, "status", "measure_reads"]
    settings = {"method": "grid_approx", "error_bound": 0.05, "workload_fingerprint": 1 << 63, "cold": False}
    results.write_settings(spark, settings, str(tmp_path / "meta"))
    assert results.read_settings(spark, str(tmp_path / "meta")) == settings
    key = lambda r: (r["query_ordinal"], r["aggregate"])
    got, want = (sorted(x.select(*same).collect(), key=key) for x in (back, long))
    assert [(r["aggregate"], r["estimate"], r["lower"], r["exact"]) for r in got] == [(r["aggregate"], r["estimate"], r["lower"], r["exact"]) for r in want]
    for rep in (0, 1):
        results.write(wide.where("query_ordinal < 2"), results.run_path(str(tmp_path / "all"), "points", "random", "grid_akd_approx", "eb=0.05", rep))
    everything = results.discover(spark, str(tmp_path / "all"))
    assert everything.count() == 8 and {(r["dataset"], r["setting"], r["replicate"]) for r in everything.collect()} == {("points", "eb=0.05", 0), ("points", "eb=0.05", 1)}
    with pytest.raises(ValueError):
        wide.drop("status").write.option("header", True).csv(str(tmp_path / "bad"))
        results.read(spark, str(tmp_path / "bad"))


def test_synthetic(spark, tmp_path):
    columns = [synthetic.Spread("uniform", 10, 20), synthetic.Spread("normal", 50, 15), synthetic.Spread("lognormal", 2, 0.5)]
    df = synthetic.generate(spark, 20000, columns, seed=3)
    again = synthetic.generate(spark, 20000, columns, seed=3).repartition(3)
    assert df.exceptAll(again).isEmpty()
    got = df.agg(F.min("col0"), F.max("col0"), F.avg("col1"), F.stddev("col1"), F.avg(F.log("col2")), F.corr("col0", "col1")).first()
    assert 10 <= got[0] and got[1] < 20 and abs(got[2] - 50) < 0.5 and abs(got[3] - 15) < 0.5 and abs(got[4] - 2) < 0.02 and abs(got[5]) < 0.03
    synthetic.scatter(df, 4, str(tmp_path / "s"))
    counts = {r["bucket"]: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("bucket").count().collect()}
    assert sum(counts.values()) == 20000 and all(abs(n - 5000) < 300 for n in counts.values())
    told = prepare.describe(df, ["col1"])
    assert synthetic.verify(df, told, ["col1"]).isEmpty()
    assert [r["statistic"] for r in synthetic.verify(df, told.withColumn("max", F.col("max") + 1), ["col1"]).collect()] == ["max"]


def test_figures(spark):
    head = lambda m, rep, q, eb: (m, rep, q, [0.0], [1.0], eb, 0.95, "m", "SUM")
    tail = (0, 50, 0, 1, 0, 0, 0, 0, 1, "none", None)
    rows = [(*head("scan", 0, q, 0.0), 100.0, 100.0, 100.0, 0.0, 0.0, True, "ok", 1, 50, 50, 10.0, 20.0, *tail) for q in range(4)]
    rows += [(*head("grid_approx", rep, q, 0.05), 100.0 + q + rep, 90.0, 110.0, 0.1, 5.0, False, "ok", 1, 5, 5, 4.0, 2.0 + rep, *tail) for q in range(4) for rep in range(3)]
    long = spark.createDataFrame(rows, runner.SCHEMA)
    grown = {(r["method"], r["query_ordinal"]): r["cumulative_ms"] for r in figures.cumulative_time(long).collect()}
    assert grown["scan", 3] == 90 and [grown["grid_approx", q] for q in range(4)] == [7, 10, 13, 16]
    assert {r["method"]: (r["p50"], r["worst"]) for r in figures.latency_tail(long).collect()} == {"scan": (20, 20), "grid_approx": (3, 3)}
    (e,) = figures.achieved_error(long).collect()
    assert (round(e["worst"], 9), e["within"]) == (0.05, 1.0) and round(e["p50"], 9) == 0.025
    (s,) = figures.speedup_and_error(long).collect()
    assert s["speedup"] == 90 / 16 and s["worst"] == e["worst"]
    assert {r["relative"] for r in figures.sweep(long, "error_bound").collect()} == {1.0}
