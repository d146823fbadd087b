"""Structural invariants of the jobs and a brute-force check."""

from pyspark.sql import functions as F

from paths import SF_SMALL
from rightsize.operators import cost as C
from rightsize.operators import packing as N
from rightsize.operators import waves as W
from rightsize.sources.fixtures import fixture


def test_rejects_plus_valid_is_input(spark):
    wl = fixture(spark, SF_SMALL, "workloads")
    assert W.wave_plan(wl).count() + W.wave_rejects(wl).count() == wl.count()


def test_total_cores_is_executors_times_cores(spark):
    plans = W.wave_plan(fixture(spark, SF_SMALL, "workloads"))
    assert plans.where(F.col("total_cores") != F.col("executors") * F.col("cores_per_executor")).count() == 0


def test_search_best_meets_target_and_one_less_does_not(spark):
    cands = C.candidates(spark, fixture(spark, SF_SMALL, "cost_workloads"))
    best = C.sla_search(C.search_base(spark, fixture(spark, SF_SMALL, "cost_workloads"))).where("status = 'met'").select("workload_id", "best_executors")
    j = cands.join(best, "workload_id")
    at_best = j.where(F.col("n") == F.col("best_executors"))
    assert at_best.where(F.col("runtime_min") > F.col("target_runtime_min")).count() == 0
    below = j.where(F.col("in_search") & (F.col("n") < F.col("best_executors"))
                    & (F.col("runtime_min") <= F.col("target_runtime_min")))
    assert below.count() == 0


def test_runtime_never_rises_with_executors(spark):
    cands = C.candidates(spark, fixture(spark, SF_SMALL, "cost_workloads"), with_prev=True)
    rises = cands.where(F.col("in_curve") & (F.col("n") > F.col("curve_from"))
                        & (F.col("runtime_min") > F.col("prev_runtime_min")))
    assert rises.count() == 0


def test_pick_shape_against_brute_force(spark):
    wl = fixture(spark, SF_SMALL, "node_workloads")
    shapes = fixture(spark, SF_SMALL, "cluster_shapes")
    got = {r.workload_id: r.best_cluster_id for r in N.pick_shape(spark, wl, shapes).collect()}
    sized = [r for r in N.shape_sizing(shapes).collect() if r.status == "ok"]
    inflation = {"Parquet / ORC": 4, "Compressed CSV / JSON": 8, "Plain text": 3}
    for w in wl.collect():
        need = w.data_size_gb * inflation[w.data_format]
        fits = [s for s in sized if need <= s.cluster_unified_mem_gb]
        want = min(fits, key=lambda s: (s.cluster_cores, s.cluster_ram_gb, s.cluster_id)).cluster_id if fits else None
        assert got[w.workload_id] == want, w.workload_id
    assert any(v is not None for v in got.values())


def test_cheapest_two_pass_equals_one_pass(spark):
    wl = fixture(spark, SF_SMALL, "cost_workloads")
    one = {tuple(r) for r in C.cheapest(C.candidates(spark, wl)).collect()}
    two = {tuple(r) for r in C.cheapest_two_pass(spark, wl)
           .select("workload_id", "cheapest_executors", "cheapest_core_hours", "cheapest_runtime_min").collect()}
    assert one == two and len(one) > 0


def test_cheapest_meets_target(spark):
    ch = C.cheapest_two_pass(spark, fixture(spark, SF_SMALL, "cost_workloads"))
    search = C.sla_search(C.search_base(spark, fixture(spark, SF_SMALL, "cost_workloads")))
    j = ch.join(search, "workload_id")
    assert j.where(F.col("cheapest_runtime_min") > F.col("target_runtime_min")).count() == 0
    assert j.where(F.col("cheapest_executors") < F.col("best_executors")).count() == 0
    assert ch.count() == search.where("status = 'met'").count()


def test_approximate_median_is_close(spark):
    from rightsize.operators import calibrate as K
    tm = fixture(spark, SF_SMALL, "task_metrics")
    exact = {(r.app_id, r.stage_id): r.median_ms for r in K.stage_summary(tm, exact=True).collect()}
    approx = {(r.app_id, r.stage_id): r.median_ms for r in K.stage_summary(tm, exact=False).collect()}
    assert exact.keys() == approx.keys()
    # a sketch returns an observed value next to the exact median among the counted tasks
    values = {}
    for r in K.last_attempts(tm).where("good > 0").collect():
        values.setdefault((r.app_id, r.stage_id), []).append(r.duration_ms)
    for k, v in values.items():
        v.sort()
        lo, hi = v[(len(v) - 1) // 2], v[len(v) // 2]
        assert lo <= approx[k] <= hi or abs(approx[k] - exact[k]) <= 0.01 * exact[k] + 1


def test_a_large_shape_catalogue(spark):
    many = spark.range(120_000).selectExpr(
        "id AS cluster_id", "CAST(id AS STRING) AS cluster", "CAST(8 + id % 40 AS INT) AS node_cores",
        "CAST(32 + id % 500 AS INT) AS node_ram_gb", "CAST(2 + id % 30 AS INT) AS num_nodes")
    work = spark.createDataFrame([(1, 900.0, "Plain text"), (2, 1e9, "Plain text")],
                                 "workload_id int, data_size_gb double, data_format string")
    got = {r.workload_id: r.best_cluster_id for r in N.pick_shape(spark, work, many).collect()}
    ok = N.shape_sizing(many).where("status = 'ok' AND cluster_unified_mem_gb >= 2700")
    best = ok.orderBy("cluster_cores", "cluster_ram_gb", "cluster_id").first()
    assert got == {1: best.cluster_id, 2: None}


def test_packer_rejects_what_it_cannot_size(spark):
    shape = spark.createDataFrame([(1, "c")], "cluster_id int, cluster string")
    work = spark.createDataFrame([(1, 1, 1000.0, "Avro"), (2, 1, -5.0, "Plain text"), (3, 1, None, "Plain text"),
                                  (4, 9, 5.0, "Plain text")],
                                 "workload_id int, cluster_id int, data_size_gb double, data_format string")
    packed = {r.workload_id: r for r in N.node_pack(spark, work, shape).collect()}
    assert [packed[i].status for i in (1, 2, 3, 4)] == ["unknown_format", "data_size_not_positive", "ok", "unknown_cluster"]
    for i in (1, 2, 4):
        assert packed[i].alerts is None and packed[i].shuffle_partitions is None and packed[i].spark_submit is None
    need = {r.workload_id: r.need_gb for r in N.pick_shape(spark, work, shape).collect()}
    assert need == {1: None, 2: None, 3: 3000.0, 4: 15.0}


def test_typed_coefficients_outlive_a_missing_measurement(spark):
    work = spark.createDataFrame([("w", "a", 11.0, 4.5, 1.1, 1.2)],
                                 "workload_id string, app_id string, t_base_sec double, e_mem_rate double, k_comp double, k_skew double")
    cal = spark.createDataFrame([("a", None, None, None, 1.9)],
                                "app_id string, t_base_sec double, k_comp double, k_skew double, e_mem_rate double")
    from rightsize.operators.waves import with_calibration
    row = with_calibration(work, cal).first()
    assert (row.t_base_sec, row.e_mem_rate, row.k_comp, row.k_skew) == (11.0, 1.9, 1.1, 1.2)
