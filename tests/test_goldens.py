"""Golden rows: the published worked example (G1) and the form-default cases."""

import pytest
from pyspark.sql import functions as F

from rightsize.operators import cost as C
from rightsize.operators import packing as N
from rightsize.operators import profiles as P
from rightsize.operators import waves as W


def _wave(spark, gb, sla, kc, ks, mode="off"):
    df = spark.createDataFrame([(1, "t", gb, sla, kc, ks, mode)],
                               "workload_id long, team string, data_size_gb double, sla_seconds int, "
                               "k_comp double, k_skew double, skew_memory_mode string")
    return W.wave_plan(df).first()


def test_g1_worked_example(spark):
    r = _wave(spark, 100.0, 600, 1.5, 1.2)
    assert (r.tasks, r.t_eff_sec, r.waves, r.total_cores_needed) == (800, 45.0, 13, 62)
    assert (r.executors, r.total_cores, r.executor_heap_mb, r.executor_overhead_mb) == (13, 65, 5100, 510)
    assert r.container_memory_mb == 5610
    assert r.total_cluster_memory_gb == 71.22 and r.total_cluster_memory_gb_legacy == 71.24
    assert r.spark_submit == ("spark-submit --num-executors 13 --executor-cores 5 --executor-memory 5100m "
                              "--conf spark.executor.memoryOverhead=510m")


def test_g2_example_call(spark):
    r = _wave(spark, 500.0, 1200, 1.2, 1.3)
    assert (r.tasks, r.waves, r.executors, r.total_cores) == (4000, 30, 27, 135)
    assert (r.executor_heap_mb, r.executor_overhead_mb, r.container_memory_mb) == (4140, 414, 4554)
    assert r.total_cluster_memory_gb == 120.08 and r.total_cluster_memory_gb_legacy == 120.15
    assert r.t_eff_sec == pytest.approx(39.0)


def test_wave_rejects_first_rule(spark):
    df = spark.createDataFrame([(1, 0.0, 600, 1.0, 0.0), (2, 10.0, 10, 1.0, 1.0), (3, 10.0, 600, 1.0, 1.0)],
                               "workload_id long, data_size_gb double, sla_seconds int, k_comp double, k_skew double")
    rej = {r.workload_id: r.reject_reason for r in W.wave_rejects(df).collect()}
    assert rej == {1: "data_size_not_positive", 2: "sla_too_tight"}


def _cost_one(spark, **overrides):
    cols = {"workload_id": 1, "team": "t", "join_strategy": "Sort-merge join"}
    cols.update(overrides)
    return spark.createDataFrame([tuple(cols.values())], list(cols.keys()))


def test_g3_cost_defaults(spark):
    wl = _cost_one(spark)
    est = C.cost_estimate(spark, wl).first()
    assert est.estimated_runtime_min == pytest.approx(138.5736422547323, rel=1e-12)
    # 2.674375 is the GC multiplier (heap pressure 1205/480); spill is (830-144)/144*0.65+1
    assert est.gc_multiplier == pytest.approx(2.674375, rel=1e-12)
    assert est.spill_multiplier == pytest.approx(1 + (830 - 144) / 144 * 0.65, rel=1e-12)
    assert est.cpu_seconds == pytest.approx(464.59, abs=0.01)
    curve = {r.executors: r.runtime_min for r in C.runtime_curve(C.candidates(spark, wl)).collect()}
    assert len(curve) == 117
    assert curve[4] == pytest.approx(114026.4, abs=0.1)
    assert curve[120] == pytest.approx(5.5446, abs=1e-4)
    s = C.sla_search(C.search_base(spark, wl)).first()
    assert (s.best_executors, s.status) == (41, "met")
    assert s.runtime_at_best_min == pytest.approx(59.2375, abs=1e-4)


def test_cost_status_and_unknown_join(spark):
    wl = _cost_one(spark, join_strategy="nonsense", target_runtime_min=0.0)
    assert C.sla_search(C.search_base(spark, wl)).first().status == "disabled"
    est = C.cost_estimate(spark, wl).first()
    ref = C.cost_estimate(spark, _cost_one(spark, join_strategy="Sort-merge join")).first()
    assert est.shuffled_gb == ref.shuffled_gb   # unknown kind falls back to 1.0
    wl = _cost_one(spark, target_runtime_min=1.0, max_executors=6)
    assert C.sla_search(C.search_base(spark, wl)).first().status == "unreachable"


def _profile(spark, profile, gb, fmt, complexity, sla, cache):
    df = spark.createDataFrame(
        [(1, "t", gb, "GB", fmt, complexity, sla, cache, profile, False, "Standard", False, 0, 1)],
        "workload_id long, team string, data_volume double, volume_unit string, data_format string, "
        "complexity string, sla_minutes int, use_cache boolean, profile string, manual_override boolean, "
        "shuffle_intensity string, skew_risk boolean, safety_buffer_pct int, max_executors_cap int")
    return P.profile_plan(spark, df).first()


def test_g4_profiles(spark):
    want = {"Conservative": (192000, 1500, 94, 24, 4, 5632, 564, 152800),
            "Balanced": (135168, 1056, 66, 14, 5, 5120, 512, 82944),
            "Aggressive": (129024, 1008, 63, 13, 5, 5120, 512, 77312)}
    for prof, exp in want.items():
        r = _profile(spark, prof, 100.0, "Parquet", "Medium", 60, False)
        got = (r.effective_data_mb, r.total_partitions, r.required_parallel_tasks, r.executors,
               r.executor_cores, r.executor_memory_mb, r.executor_overhead_mb, r.total_cluster_ram_mb)
        assert got == exp, prof


def test_g4b_cap(spark):
    r = _profile(spark, "Balanced", 102400.0, "CSV", "High", 60, True)
    assert (r.raw_executors, r.executors, r.cap_hit) == (84105, 250, True)
    assert (r.executor_memory_mb, r.driver_memory_mb, r.shuffle_partitions) == (9728, 8192, 3364182)


def _shape(spark, node_cores):
    shapes = spark.createDataFrame([(1, "c", node_cores, 64, 6, 5, 1, 1, 128, 0.6)],
                                   "cluster_id int, cluster string, node_cores int, node_ram_gb int, num_nodes int, "
                                   "target_exec_cores int, os_cores int, os_ram_gb int, partition_size_mb int, "
                                   "memory_fraction double")
    wl = spark.createDataFrame([(1, 1, 1000, "Parquet / ORC")],
                               "workload_id long, cluster_id int, data_size_gb long, data_format string")
    return N.node_pack(spark, wl, shapes).first()


def test_g5_node_defaults(spark):
    r = _shape(spark, 16)
    assert (r.executors_per_node, r.total_executors, r.total_compute_cores) == (3, 17, 85)
    assert r.raw_mem_per_exec_gb == pytest.approx(21.0) and r.heap_gb == pytest.approx(18.9)
    assert (r.base_partitions, r.shuffle_partitions) == (32000, 32045)
    assert r.cluster_unified_mem_gb == pytest.approx(189.72)
    assert r.alerts == ["spill_risk"]
    assert "--conf spark.executor.memory=18g" in r.spark_submit
    assert "spark.executor.memoryOverhead=2151m" in r.spark_submit
    assert r.g1_advised is True


def test_g5b_infeasible(spark):
    r = _shape(spark, 4)
    assert r.executors_per_node == 0 and r.status == "no_executor_fits" and r.alerts is None


def test_wave_report_nesting(spark):
    df = spark.createDataFrame([(1, "t", 100.0, 600, 1.5, 1.2, "off")],
                               "workload_id long, team string, data_size_gb double, sla_seconds int, "
                               "k_comp double, k_skew double, skew_memory_mode string")
    r = W.wave_report(W.wave_plan(df)).first()
    assert r.execution.t_eff == 45.0 and r.cluster.executors == 13
    assert r.memory.m_task_mb == 576.0 and r.memory.m_unified_mb == 2880.0
    assert r.spark_submit.executor_memory == "5100m" and r.spark_submit.memory_overhead == "510m"
