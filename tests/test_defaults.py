"""S3: missing fields take the form defaults; present fields keep their type."""

from rightsize.operators import packing as N
from rightsize.operators import profiles as P
from rightsize.operators import waves as W
from rightsize.sources.defaults import COST_DEFAULTS, with_defaults


def test_with_defaults_fills_and_keeps_types(spark):
    df = spark.createDataFrame([(1, None), (2, 7)], "workload_id long, executors int")
    out = with_defaults(df, COST_DEFAULTS)
    types = dict(out.dtypes)
    assert types["executors"] == "int" and types["input_data_gb"] == "double"
    rows = {r.workload_id: r for r in out.collect()}
    assert rows[1].executors == 30 and rows[2].executors == 7
    assert rows[1].join_strategy == "Sort-merge join"


def test_wave_form_defaults(spark):
    # only an id: the form's 500 GB, 20 min, 1.2, 1.3 (the printed example, G2)
    r = W.wave_plan(spark.createDataFrame([(1,)], "workload_id long")).first()
    assert (r.tasks, r.waves, r.executors, r.executor_heap_mb) == (4000, 30, 27, 4140)


def test_profile_form_defaults(spark):
    r = P.profile_plan(spark, spark.createDataFrame([(1,)], "workload_id long")).first()
    assert (r.executors, r.executor_cores, r.executor_memory_mb, r.total_cluster_ram_mb) == (14, 5, 5120, 82944)


def test_node_form_defaults(spark):
    shapes = spark.createDataFrame([(1, "c")], "cluster_id int, cluster string")
    wl = spark.createDataFrame([(1, 1)], "workload_id long, cluster_id int")
    r = N.node_pack(spark, wl, shapes).first()
    assert (r.total_executors, r.shuffle_partitions, r.alerts) == (17, 32045, ["spill_risk"])
