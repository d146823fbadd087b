"""DuckDB SQL for every registered job (the correctness oracle).

Written independently of the DataFrame code, from the formulas. Each query
starts from the same fixture blocks (``rightsize.sources.fixtures``) as CTEs.
DuckDB typing notes: ``ceil``/``floor`` return DOUBLE (cast to BIGINT),
``sum(BIGINT)`` is HUGEINT (cast to BIGINT), ``round_even`` is Python's round.
"""

from __future__ import annotations

from rightsize.sources.fixtures import fixture_cte


def _with(*names: str, extra: str = "") -> str:
    parts = [f"{n} AS (\n{fixture_cte(n)}\n)" for n in names]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"


# ---- calibration (K) -------------------------------------------------------

_STAGES = """
held AS (
  SELECT * FROM task_metrics WHERE NOT failed AND NOT killed
  QUALIFY row_number() OVER (PARTITION BY app_id, stage_id, task_index ORDER BY task_id DESC) = 1
),
stages AS (
  SELECT app_id, stage_id, stage_attempt, tasks, median_ms, max_ms, mem_spill_bytes, disk_spill_bytes,
    input_bytes, shuffle_bytes, run_ms, duration_ms, retried_tasks, first_launch_ms, last_finish_ms
  FROM (
    SELECT app_id, stage_id, count(*) FILTER (WHERE failed AND NOT speculative) AS retried_tasks,
      min(launch_ms) AS first_launch_ms, max(launch_ms + duration_ms) AS last_finish_ms
    FROM task_metrics GROUP BY app_id, stage_id)
  LEFT JOIN (
    SELECT app_id, stage_id, max(stage_attempt) AS stage_attempt, count(*) AS counted,
      CAST(median(duration_ms) AS DOUBLE) AS median_ms, max(duration_ms) AS max_ms,
      CAST(sum(mem_spill_bytes) AS BIGINT) AS mem_spill_bytes, CAST(sum(disk_spill_bytes) AS BIGINT) AS disk_spill_bytes,
      CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(shuffle_bytes) AS BIGINT) AS shuffle_bytes,
      CAST(sum(run_ms) AS BIGINT) AS run_ms, CAST(sum(duration_ms) AS BIGINT) AS duration_ms
    FROM held GROUP BY app_id, stage_id) USING (app_id, stage_id),
  LATERAL (SELECT coalesce(counted, 0) AS tasks)
)"""

_CALIBRATION = _STAGES + """,
baselines AS (
  SELECT app_id, run_ms AS baseline_run_ms, CAST(median(duration_ms) AS DOUBLE) AS base_median_ms
  FROM baseline_tasks GROUP BY app_id, run_ms
),
started AS (SELECT app_id, min(first_launch_ms) AS started_ms FROM stages GROUP BY app_id),
base AS (
  SELECT s.app_id, b.baseline_run_ms, b.base_median_ms, b.base_median_ms / 1000e0 AS t_base_sec
  FROM started s ASOF LEFT JOIN baselines b ON s.app_id = b.app_id AND s.started_ms >= b.baseline_run_ms
),
heavy AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY median_ms DESC NULLS LAST, stage_id ASC) AS rn
    FROM stages) WHERE rn = 1
),
calibration AS (
  SELECT h.app_id, b.baseline_run_ms, b.t_base_sec,
    h.stage_id AS heavy_stage_id, h.tasks AS heavy_tasks,
    h.median_ms / nullif(b.base_median_ms, 0) AS k_comp,
    h.max_ms / nullif(h.median_ms, 0) AS k_skew,
    CAST(h.mem_spill_bytes AS DOUBLE) / nullif(h.disk_spill_bytes, 0) AS e_mem_rate,
    h.max_ms / nullif(h.median_ms, 0) > 2.0e0 AS skew_join_advised
  FROM heavy h LEFT JOIN base b ON h.app_id = b.app_id
)"""

_PROFILE = """,
profile AS (
  SELECT app_id, count(*) AS stages_count, CAST(sum(tasks) AS BIGINT) AS tasks,
    max(CASE WHEN shuffle_bytes = 0 THEN tasks END) AS input_partitions,
    CAST(sum(retried_tasks) AS DOUBLE) / nullif(sum(tasks), 0) AS expected_retry_fraction,
    CAST(sum(shuffle_bytes) AS DOUBLE) / nullif(sum(input_bytes), 0) AS shuffle_ratio,
    (sum(input_bytes) / 1048576e0) / nullif(sum(run_ms) / 1000e0, 0) AS cpu_throughput_mb_s_per_core,
    sum(input_bytes) / 1073741824e0 AS input_data_gb,
    CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
    (max(last_finish_ms) - min(first_launch_ms)) / 1000e0 AS observed_sec,
    greatest(CAST(1 AS BIGINT), CAST(ceil(CAST(sum(duration_ms) AS DOUBLE)
      / nullif(max(last_finish_ms) - min(first_launch_ms), 0)) AS BIGINT)) AS slots
  FROM stages GROUP BY app_id
)"""

_PARALLEL = """,
steps AS (
  SELECT app_id, at_ms, CAST(sum(step) AS BIGINT) AS step FROM (
    SELECT app_id, launch_ms AS at_ms, 1 AS step FROM task_metrics WHERE duration_ms > 0
    UNION ALL SELECT app_id, launch_ms + duration_ms, -1 FROM task_metrics WHERE duration_ms > 0)
  GROUP BY app_id, at_ms
),
parallel AS (
  SELECT app_id, CAST(max(running) AS BIGINT) AS peak_tasks,
    CAST(sum(until_ms - at_ms) FILTER (WHERE running > 0) AS BIGINT) AS busy_ms,
    CAST(sum((until_ms - at_ms) * running) FILTER (WHERE running > 0) AS BIGINT) AS task_ms
  FROM (SELECT app_id, at_ms, lead(at_ms) OVER w AS until_ms, sum(step) OVER w AS running
    FROM steps WINDOW w AS (PARTITION BY app_id ORDER BY at_ms))
  GROUP BY app_id
)"""

_BACKTEST = _PARALLEL + """,
errors AS (
  SELECT app_id, observed_sec, slots, tasks, waves, predicted_sec,
    abs(predicted_sec - observed_sec) AS abs_error_sec,
    abs(predicted_sec - observed_sec) / nullif(observed_sec, 0) AS rel_error
  FROM (
    SELECT p.app_id, p.observed_sec, s.slots,
      CAST(ceil(p.input_data_gb * 1024e0 / 128e0) AS BIGINT) AS tasks,
      CAST(ceil(ceil(p.input_data_gb * 1024e0 / 128e0) / s.slots) AS BIGINT) AS waves,
      ceil(ceil(p.input_data_gb * 1024e0 / 128e0) / s.slots) * (c.t_base_sec * c.k_comp * c.k_skew) AS predicted_sec
    FROM profile p JOIN calibration c ON p.app_id = c.app_id
    JOIN (SELECT profile.app_id, greatest(coalesce(peak_tasks, slots), 1) AS slots
      FROM profile LEFT JOIN parallel USING (app_id)) s ON s.app_id = p.app_id)
)"""

SQL: dict[str, str] = {}

SQL["stage_summary"] = _with("task_metrics", extra=_STAGES) + """
SELECT *, max_ms / nullif(median_ms, 0) AS stage_skew FROM stages"""

SQL["parallelism"] = _with("task_metrics", extra=_PARALLEL.lstrip(",")) + """
SELECT *, CAST(task_ms AS DOUBLE) / nullif(busy_ms, 0) AS mean_tasks FROM parallel"""

_FIT = """
sums AS (
  SELECT app_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(a) AS DOUBLE) AS sa, CAST(sum(b) AS DOUBLE) AS sb,
    CAST(sum(c) AS DOUBLE) AS sc, CAST(sum(a * a) AS DOUBLE) AS saa, CAST(sum(a * b) AS DOUBLE) AS sab, CAST(sum(a * c) AS DOUBLE) AS sac,
    CAST(sum(b * b) AS DOUBLE) AS sbb, CAST(sum(b * c) AS DOUBLE) AS sbc, CAST(sum(c * c) AS DOUBLE) AS scc,
    CAST(sum(a * y) AS DOUBLE) AS say, CAST(sum(b * y) AS DOUBLE) AS sby, CAST(sum(c * y) AS DOUBLE) AS scy
  FROM (SELECT app_id, duration_ms AS y, (input_bytes + 524288) // 1048576 AS a, (disk_spill_bytes + 524288) // 1048576 AS b,
      (shuffle_bytes + 524288) // 1048576 AS c FROM task_metrics WHERE NOT failed AND NOT killed)
  GROUP BY app_id
),
cov AS (
  SELECT *, saa - sa * sa / n AS caa, sab - sa * sb / n AS cab, sac - sa * sc / n AS cac, sbb - sb * sb / n AS cbb,
    sbc - sb * sc / n AS cbc, scc - sc * sc / n AS ccc, say - sa * sy / n AS ga, sby - sb * sy / n AS gb, scy - sc * sy / n AS gc
  FROM sums
),
e1 AS (SELECT *, CASE WHEN caa > 1e-9 * greatest(saa, 1e0) THEN 1e0 / caa ELSE 0e0 END AS ia FROM cov),
e2 AS (SELECT *, cbb - cab * ia * cab AS db, cbc - cab * ia * cac AS ebc, gb - cab * ia * ga AS hb, ccc - cac * ia * cac AS fc,
    gc - cac * ia * ga AS qc FROM e1),
e3 AS (SELECT *, CASE WHEN db > 1e-9 * greatest(cbb, 1e0) THEN 1e0 / db ELSE 0e0 END AS ib FROM e2),
e4 AS (SELECT *, fc - ebc * ib * ebc AS dc, qc - ebc * ib * hb AS hc FROM e3),
e5 AS (SELECT *, hc * CASE WHEN dc > 1e-9 * greatest(ccc, 1e0) THEN 1e0 / dc ELSE 0e0 END AS bc FROM e4),
e6 AS (SELECT *, (hb - ebc * bc) * ib AS bb FROM e5),
e7 AS (SELECT *, (ga - cab * bb - cac * bc) * ia AS ba FROM e6),
rates AS (
  SELECT *, CASE WHEN input_ms_mb > 0 THEN 1000e0 / input_ms_mb END AS cpu_throughput_mb_s_per_core,
    CASE WHEN spill_ms_mb > 0 THEN 1000e0 / spill_ms_mb END AS disk_throughput_mb_s_per_executor,
    CASE WHEN shuffle_ms_mb > 0 THEN 1000e0 / shuffle_ms_mb END AS network_throughput_mb_s_per_executor,
    CASE WHEN overhead_ms > 0 THEN overhead_ms / 1000e0 END AS task_overhead_s
  FROM (SELECT app_id, CAST(n AS BIGINT) AS tasks, round((sy - ba * sa - bb * sb - bc * sc) / n, 6) AS overhead_ms,
      round(ba, 6) AS input_ms_mb, round(bb, 6) AS spill_ms_mb, round(bc, 6) AS shuffle_ms_mb FROM e7)
)"""

SQL["fitted_rates"] = _with("task_metrics", extra=_FIT) + "SELECT * FROM rates"

# the merged sketches' medians differ from run to run; that they lie within the bound does not
SQL["median_rank_error"] = _with("task_metrics") + """
SELECT stage_id, count(*) AS tasks, true AS within_bound FROM task_metrics GROUP BY stage_id"""

SQL["calibrate"] = _with("task_metrics", "baseline_tasks", extra=_CALIBRATION) + "SELECT * FROM calibration"

SQL["skew_advice"] = _with("task_metrics", "baseline_tasks", extra=_CALIBRATION) + """
SELECT app_id, heavy_stage_id, k_skew, 'spark.sql.adaptive.skewJoin.enabled=true' AS advice
FROM calibration WHERE skew_join_advised"""

SQL["coefficient_check"] = _with("task_metrics", "baseline_tasks", extra=_CALIBRATION) + """
SELECT k_comp_class, e_mem_check, count(*) AS apps,
  CAST(sum(CAST(skew_join_advised AS INTEGER)) AS BIGINT) AS skewed_apps
FROM (
  SELECT skew_join_advised,
    CASE WHEN k_comp IS NULL THEN 'unknown' WHEN k_comp < 1.25e0 THEN 'simple'
      WHEN k_comp < 2.0e0 THEN 'aggregate' WHEN k_comp <= 3.0e0 THEN 'heavy' ELSE 'beyond_range' END AS k_comp_class,
    CASE WHEN e_mem_rate IS NULL THEN 'no_spill' WHEN e_mem_rate >= 2.0e0 AND e_mem_rate <= 5.0e0 THEN 'plausible'
      WHEN e_mem_rate < 2.0e0 THEN 'below_range' ELSE 'above_range' END AS e_mem_check
  FROM calibration)
GROUP BY k_comp_class, e_mem_check"""

SQL["measured_profile"] = _with("task_metrics", extra=_STAGES + _PROFILE) + "SELECT * FROM profile"

SQL["backtest"] = _with("task_metrics", "baseline_tasks", extra=_CALIBRATION + _PROFILE + _BACKTEST) + "SELECT * FROM errors"

SQL["backtest_by_team"] = _with("task_metrics", "baseline_tasks", "workloads", extra=_CALIBRATION + _PROFILE + _BACKTEST) + """
SELECT t.team, count(*) AS apps, max(e.rel_error) AS max_rel_error,
  CAST(sum(CASE WHEN e.rel_error <= 0.25e0 THEN 1 ELSE 0 END) AS BIGINT) AS apps_within_25pct,
  round(avg(e.rel_error), 9) AS mean_rel_error
FROM (SELECT DISTINCT team, app_id FROM workloads) t JOIN errors e ON t.app_id = e.app_id
GROUP BY t.team"""


# ---- wave planner (W) ------------------------------------------------------

def _wave_steps(src: str) -> str:
    """Formula steps over ``src`` (needs data_size_gb, sla_seconds, k_comp,
    k_skew, skew_memory_mode, t_base_sec, e_mem_rate); adds reject_reason."""
    return f"""
SELECT *,
  CASE WHEN data_size_gb <= 0 THEN 'data_size_not_positive'
       WHEN sla_seconds <= 0 THEN 'sla_not_positive'
       WHEN k_comp <= 0 THEN 'k_comp_not_positive'
       WHEN k_skew <= 0 THEN 'k_skew_not_positive'
       WHEN t_base_sec <= 0 OR e_mem_rate <= 0 THEN 'system_param_not_positive'
       WHEN coalesce(waves, 0) < 1 THEN 'sla_too_tight' END AS reject_reason,
  container_memory_mb * executors AS total_memory_mb_raw,
  round_even(container_memory_mb / 1024e0, 2) AS container_memory_gb,
  round_even(container_memory_mb * executors / 1024e0, 2) AS total_cluster_memory_gb,
  round_even(round_even(container_memory_mb / 1024e0, 2) * executors, 2) AS total_cluster_memory_gb_legacy,
  'spark-submit --num-executors ' || CAST(executors AS VARCHAR) || ' --executor-cores ' || CAST(cores_per_executor AS VARCHAR)
    || ' --executor-memory ' || CAST(executor_heap_mb AS VARCHAR) || 'm --conf spark.executor.memoryOverhead='
    || CAST(executor_overhead_mb AS VARCHAR) || 'm' AS spark_submit
FROM (
  SELECT *, executor_heap_mb + executor_overhead_mb AS container_memory_mb FROM (
    SELECT *, CAST(ceil(greatest(384e0, executor_heap_mb * 0.1e0)) AS BIGINT) AS executor_overhead_mb FROM (
      SELECT *, CAST(ceil(m_unified_mb / 0.6e0 + 300e0) AS BIGINT) AS executor_heap_mb FROM (
        SELECT *, m_task_mb * CAST(cores_per_executor AS DOUBLE) AS m_unified_mb FROM (
          SELECT *, 128e0 * e_mem_rate * k_comp * memory_skew_factor AS m_task_mb,
            executors * cores_per_executor AS total_cores FROM (
            SELECT *, CAST(ceil(total_cores_needed / CAST(cores_per_executor AS DOUBLE)) AS BIGINT) AS executors FROM (
              SELECT *, CAST(ceil(tasks / CAST(CASE WHEN waves >= 1 THEN waves END AS DOUBLE)) AS BIGINT) AS total_cores_needed FROM (
                SELECT *, CAST(floor(sla_seconds / nullif(t_eff_sec, 0)) AS BIGINT) AS waves FROM (
                  SELECT *, CAST(ceil(data_size_gb * 1024e0 / 128e0) AS BIGINT) AS tasks,
                    t_base_sec * k_comp * k_skew AS t_eff_sec,
                    CAST(5 AS BIGINT) AS cores_per_executor,
                    CASE WHEN skew_memory_mode = 'linear' THEN k_skew
                         WHEN skew_memory_mode = 'sqrt' THEN sqrt(k_skew) ELSE 1e0 END AS memory_skew_factor
                  FROM {src})))))))))"""


_WAVE_OUT = """tasks, t_eff_sec, waves, total_cores_needed, executors, total_cores, cores_per_executor,
  memory_skew_factor, m_task_mb, m_unified_mb, executor_heap_mb, executor_overhead_mb, container_memory_mb,
  container_memory_gb, total_cluster_memory_gb, total_cluster_memory_gb_legacy, spark_submit"""
_WAVE_KEYS = "workload_id, team, app_id, data_size_gb, sla_seconds, k_comp, k_skew, skew_memory_mode, t_base_sec, e_mem_rate"

_TYPED_WL = "typed_wl AS (SELECT *, 25e0 AS t_base_sec, 3e0 AS e_mem_rate FROM workloads)"

_CAL_WL = """cal_wl AS (
  SELECT w.workload_id, w.team, w.app_id, w.data_size_gb, w.sla_seconds, w.skew_memory_mode,
    coalesce(c.k_comp, w.k_comp) AS k_comp, coalesce(c.k_skew, w.k_skew) AS k_skew,
    coalesce(c.t_base_sec, 25e0) AS t_base_sec, coalesce(c.e_mem_rate, 3e0) AS e_mem_rate,
    CASE WHEN c.t_base_sec IS NOT NULL THEN 'measured' ELSE 'constant' END AS t_base_source,
    CASE WHEN c.e_mem_rate IS NOT NULL THEN 'measured' ELSE 'constant' END AS e_mem_source,
    CASE WHEN c.k_comp IS NOT NULL THEN 'measured' WHEN w.k_comp IS NOT NULL THEN 'typed' ELSE 'constant' END AS k_comp_source,
    CASE WHEN c.k_skew IS NOT NULL THEN 'measured' WHEN w.k_skew IS NOT NULL THEN 'typed' ELSE 'constant' END AS k_skew_source
  FROM workloads w LEFT JOIN calibration c ON w.app_id = c.app_id
)"""

SQL["wave_plan"] = _with("task_metrics", "baseline_tasks", "workloads", extra=_CALIBRATION + ",\n" + _CAL_WL) + f"""
SELECT {_WAVE_KEYS}, t_base_source, e_mem_source, k_comp_source, k_skew_source, {_WAVE_OUT}
FROM ({_wave_steps('cal_wl')}) WHERE reject_reason IS NULL"""

SQL["wave_plan_typed"] = _with("workloads", extra=_TYPED_WL) + f"""
SELECT {_WAVE_KEYS}, {_WAVE_OUT}
FROM ({_wave_steps('typed_wl')}) WHERE reject_reason IS NULL"""

SQL["wave_rejects"] = _with("workloads", extra=_TYPED_WL) + f"""
SELECT workload_id, reject_reason,
  list_filter([CASE WHEN data_size_gb <= 0 THEN 'data_size_not_positive' END,
               CASE WHEN sla_seconds <= 0 THEN 'sla_not_positive' END,
               CASE WHEN k_comp <= 0 THEN 'k_comp_not_positive' END,
               CASE WHEN k_skew <= 0 THEN 'k_skew_not_positive' END,
               CASE WHEN t_base_sec <= 0 OR e_mem_rate <= 0 THEN 'system_param_not_positive' END,
               CASE WHEN coalesce(waves, 0) < 1 THEN 'sla_too_tight' END], lambda x: x IS NOT NULL) AS reject_reasons
FROM ({_wave_steps('typed_wl')}) WHERE reject_reason IS NOT NULL"""

SQL["wave_fleet"] = _with("workloads", extra=_TYPED_WL) + f"""
SELECT team, sla_seconds, count(*) AS workloads,
  CAST(sum(CASE WHEN reject_reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS plans,
  CAST(sum(CASE WHEN reject_reason IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS rejected,
  CAST(sum(CASE WHEN reject_reason IS NULL THEN executors END) AS BIGINT) AS executors,
  CAST(sum(CASE WHEN reject_reason IS NULL THEN total_cores END) AS BIGINT) AS total_cores,
  CAST(sum(CASE WHEN reject_reason IS NULL THEN total_memory_mb_raw END) AS BIGINT) AS total_memory_mb,
  max(CASE WHEN reject_reason IS NULL THEN executors END) AS max_executors,
  CAST(sum(CASE WHEN reject_reason IS NULL THEN 0 ELSE 1 END) AS DOUBLE) / count(*) AS rejected_share
FROM ({_wave_steps('typed_wl')})
GROUP BY ROLLUP (team, sla_seconds)"""

SQL["wave_sensitivity"] = _with("workloads", extra="""grid AS (
  SELECT workload_id, data_size_gb, sla_seconds, k_comp, k_skew, m AS skew_memory_mode,
    25e0 AS t_base_sec, 3e0 AS e_mem_rate
  FROM workloads, (SELECT unnest(['off', 'sqrt', 'linear']) AS m))""") + f"""
SELECT skew_memory_mode,
  CAST(sum(CASE WHEN reject_reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS plans,
  CAST(sum(CASE WHEN reject_reason IS NULL THEN executors END) AS BIGINT) AS executors,
  CAST(sum(CASE WHEN reject_reason IS NULL THEN total_memory_mb_raw END) AS BIGINT) AS total_memory_mb,
  max(CASE WHEN reject_reason IS NULL THEN container_memory_mb END) AS max_container_memory_mb
FROM ({_wave_steps('grid')})
GROUP BY skew_memory_mode"""


# ---- cost model (C) --------------------------------------------------------

_COST_SRC = """cw AS (
  SELECT w.*, 3e0 AS compression_expand_factor, 1.25e0 AS format_overhead_factor,
    1e0 AS transform_amplification_factor, 1e0 AS udf_complexity_factor, 18 AS stages_count,
    1200 AS input_partitions, 2000 AS shuffle_partitions, 4 AS cores_per_executor,
    16e0 AS executor_memory_gb, 12e0 AS executor_memory_overhead_pct, 0.75e0 AS cluster_cpu_utilization,
    90e0 AS cpu_tp, 320e0 AS disk_tp, 220e0 AS net_tp, 0.6e0 AS mem_frac, 0.5e0 AS storage_frac,
    0.2e0 AS ws_frac, 0.2e0 AS cache_frac, 5e0 AS broadcast_tables_gb, 0.25e0 AS concurrent_frac,
    8e0 AS stage_overhead, 0.65e0 AS spill_penalty, 0.9e0 AS gc_sens, 0.03e0 AS retry_frac,
    0.35e0 AS retry_cost, 0.05e0 AS spec_gain,
    CASE join_strategy WHEN 'Broadcast hash join' THEN 0.35e0 WHEN 'Sort-merge join' THEN 1.0e0
      WHEN 'Shuffle hash join' THEN 0.85e0 WHEN 'Mostly aggregations (few joins)' THEN 0.6e0 ELSE 1.0e0 END AS join_multiplier
  FROM cost_workloads w
)"""


def _cost_exprs(ex: str) -> dict[str, str]:
    """The cost formulas as SQL text for executor count ``ex``."""
    e = {}
    e["input_logical_gb"] = "(input_data_gb * compression_expand_factor * format_overhead_factor)"
    e["post_transform_gb"] = f"({e['input_logical_gb']} * transform_amplification_factor)"
    e["shuffled_gb"] = f"({e['post_transform_gb']} * shuffle_ratio * skew_factor * join_multiplier)"
    e["total_processed_gb"] = f"({e['post_transform_gb']} + {e['shuffled_gb']})"
    e["total_cores"] = f"(CAST({ex} AS BIGINT) * CAST(cores_per_executor AS BIGINT))"
    e["effective_cores"] = f"({e['total_cores']} * greatest(0.2e0, least(1.0e0, cluster_cpu_utilization)))"
    tp = "(cpu_tp / greatest(0.2e0, least(10.0e0, udf_complexity_factor)))"
    e["cpu_seconds"] = f"(({e['total_processed_gb']} * 1024e0) / greatest(1e0, {tp} * greatest({e['effective_cores']}, 1e0)))"
    ex1 = f"greatest(CAST({ex} AS BIGINT), 1)"
    e["disk_seconds"] = f"(({e['input_logical_gb']} * 1024e0) / greatest(1e0, disk_tp * {ex1}))"
    e["network_seconds"] = f"(({e['shuffled_gb']} * 1024e0) / greatest(1e0, net_tp * {ex1}))"
    tasks = f"greatest(CAST(input_partitions AS BIGINT), CAST(shuffle_partitions AS BIGINT), {e['total_cores']})"
    e["waves"] = f"(CAST({tasks} AS DOUBLE) / greatest({e['total_cores']}, 1))"
    e["wave_penalty"] = f"(1e0 + greatest(0e0, {e['waves']} - 1e0) * 0.025e0)"
    base = f"greatest({e['cpu_seconds']}, {e['disk_seconds']}, {e['network_seconds']})"
    e["scheduling_overhead_seconds"] = "(stages_count * stage_overhead)"
    heap = f"(CAST({ex} AS BIGINT) * executor_memory_gb)"
    e["execution_memory_gb"] = f"({heap} * mem_frac * (1e0 - storage_frac))"
    e["storage_memory_gb"] = f"({heap} * mem_frac * storage_frac)"
    e["working_set_gb"] = f"({e['post_transform_gb']} * ws_frac)"
    e["cache_need_gb"] = f"({e['post_transform_gb']} * cache_frac)"
    e["shuffle_in_flight_gb"] = f"({e['shuffled_gb']} * concurrent_frac)"
    e["peak_execution_need_gb"] = f"({e['working_set_gb']} + {e['shuffle_in_flight_gb']} + broadcast_tables_gb)"
    e["spill_ratio"] = f"(greatest(0e0, {e['peak_execution_need_gb']} - {e['execution_memory_gb']}) / greatest({e['execution_memory_gb']}, 0.001e0))"
    e["spill_multiplier"] = f"(1e0 + {e['spill_ratio']} * spill_penalty)"
    e["heap_pressure"] = f"(({e['peak_execution_need_gb']} + {e['cache_need_gb']}) / greatest({heap}, 0.001e0))"
    e["gc_multiplier"] = f"(1e0 + greatest(0e0, {e['heap_pressure']} - 0.65e0) * gc_sens)"
    e["retry_multiplier"] = "(1e0 + retry_frac * retry_cost)"
    spec = "(1e0 - greatest(0e0, least(0.35e0, spec_gain)))"
    runtime_s = (f"(({base} * {e['wave_penalty']} + {e['scheduling_overhead_seconds']}) * {e['spill_multiplier']}"
                 f" * {e['gc_multiplier']} * {e['retry_multiplier']} * {spec})")
    e["estimated_runtime_min"] = f"({runtime_s} / 60e0)"
    e["cpu_core_hours"] = f"(({runtime_s} / 3600e0) * {e['total_cores']})"
    e["total_memory_gb_with_overhead"] = f"(CAST({ex} AS BIGINT) * (executor_memory_gb + executor_memory_gb * executor_memory_overhead_pct / 100e0))"
    req = f"(greatest({e['peak_execution_need_gb']}, 0.001e0) / greatest(mem_frac * (1e0 - storage_frac), 0.001e0))"
    e["recommended_executor_memory_gb"] = f"({req} / {ex1})"
    e["storage_pressure_ratio"] = f"({e['cache_need_gb']} / greatest({e['storage_memory_gb']}, 0.001e0))"
    return e


SQL["backtest_models"] = _with("task_metrics", "baseline_tasks", extra=_CALIBRATION + _PROFILE + _BACKTEST + "," + _FIT) + f""",
widest AS (SELECT app_id, max(tasks) AS shuffle_partitions FROM stages GROUP BY app_id),
app AS (
  SELECT e.app_id, e.observed_sec, e.slots, e.predicted_sec AS wave_sec, p.input_data_gb, coalesce(p.shuffle_ratio, 0e0) AS shuffle_ratio,
    p.stages_count, coalesce(p.input_partitions, 1) AS input_partitions, w.shuffle_partitions, coalesce(p.expected_retry_fraction, 0e0) AS retry_frac,
    coalesce(r.cpu_throughput_mb_s_per_core, 90e0) AS cpu_tp, coalesce(r.disk_throughput_mb_s_per_executor, 320e0) AS disk_tp,
    coalesce(r.network_throughput_mb_s_per_executor, 220e0) AS net_tp,
    coalesce(r.task_overhead_s, 0e0) * (CAST(p.tasks AS DOUBLE) / (p.stages_count * e.slots)) AS stage_overhead,
    1e0 AS compression_expand_factor, 1e0 AS format_overhead_factor, 1e0 AS transform_amplification_factor, 1e0 AS skew_factor,
    1e0 AS join_multiplier, 1e0 AS udf_complexity_factor, 1e0 AS cluster_cpu_utilization, 0e0 AS spill_penalty, 0e0 AS gc_sens,
    0e0 AS spec_gain, 0.35e0 AS retry_cost, 1 AS cores_per_executor, 16e0 AS executor_memory_gb, 0.6e0 AS mem_frac, 0.5e0 AS storage_frac,
    0.2e0 AS ws_frac, 0.2e0 AS cache_frac, 5e0 AS broadcast_tables_gb, 0.25e0 AS concurrent_frac
  FROM errors e JOIN profile p USING (app_id) JOIN widest w USING (app_id) LEFT JOIN rates r USING (app_id)
),
both_models AS (SELECT app_id, observed_sec, slots, wave_sec, {_cost_exprs('slots')['estimated_runtime_min']} * 60e0 AS cost_sec FROM app)
SELECT *, CASE WHEN wave_rel_error < cost_rel_error THEN 'wave' WHEN cost_rel_error IS NOT NULL THEN 'cost' END AS closer
FROM (SELECT *, abs(wave_sec - observed_sec) / nullif(observed_sec, 0) AS wave_rel_error,
  abs(cost_sec - observed_sec) / nullif(observed_sec, 0) AS cost_rel_error FROM both_models)"""


def _estimate_sql() -> str:
    e = _cost_exprs("executors")
    cols = ",\n  ".join(f"{v} AS {k}" for k, v in e.items())
    return f"""estimates AS (
  SELECT workload_id, team, join_strategy, executors, shuffle_partitions, broadcast_tables_gb, target_runtime_min,
  {cols},
  CAST(greatest(64, ceil({e['total_cores']} * 2.5e0)) AS BIGINT) AS recommended_shuffle_partitions
  FROM cw
)"""


def _cands_sql() -> str:
    e = _cost_exprs("n")
    p = _cost_exprs("(n - 1)")
    return f"""ranges AS (
  SELECT *, greatest(1, least(min_executors, max_executors)) AS curve_from,
    greatest(greatest(1, least(min_executors, max_executors)), max_executors) AS curve_to,
    greatest(1, min_executors) AS search_from,
    greatest(greatest(1, min_executors), max_executors) AS search_to
  FROM cw
),
cands AS (
  SELECT workload_id, team, target_runtime_min, n, curve_from, curve_to,
    n BETWEEN curve_from AND curve_to AS in_curve,
    n BETWEEN search_from AND search_to AS in_search,
    {e['estimated_runtime_min']} AS runtime_min,
    {e['cpu_core_hours']} AS cpu_core_hours,
    {p['estimated_runtime_min']} AS prev_runtime_min
  FROM ranges, LATERAL (SELECT unnest(range(least(curve_from, search_from), greatest(curve_to, search_to) + 1)) AS n)
)"""


_EST_COLS = ["workload_id", "team", "join_strategy", "executors", "shuffle_partitions", "broadcast_tables_gb",
             "target_runtime_min", *_cost_exprs("executors").keys(), "recommended_shuffle_partitions"]

SQL["cost_estimate"] = _with("cost_workloads", extra=_COST_SRC + ",\n" + _estimate_sql()) + \
    "SELECT " + ", ".join(_EST_COLS) + " FROM estimates"

SQL["runtime_curve"] = _with("cost_workloads", extra=_COST_SRC + ",\n" + _cands_sql()) + """
SELECT workload_id, CAST(n AS BIGINT) AS executors, runtime_min, cpu_core_hours FROM cands WHERE in_curve"""

SQL["sla_search"] = _with("cost_workloads", extra=_COST_SRC + ",\n" + _cands_sql()) + """
SELECT workload_id, target_runtime_min, best_executors, runtime_at_best_min,
  CASE WHEN target_runtime_min <= 0 THEN 'disabled' WHEN best_executors IS NOT NULL THEN 'met'
    ELSE 'unreachable' END AS status
FROM (
  SELECT workload_id, target_runtime_min,
    CAST(min(CASE WHEN in_search AND target_runtime_min > 0 AND runtime_min <= target_runtime_min THEN n END) AS BIGINT) AS best_executors,
    arg_min(CASE WHEN in_search AND target_runtime_min > 0 AND runtime_min <= target_runtime_min THEN runtime_min END,
            CASE WHEN in_search AND target_runtime_min > 0 AND runtime_min <= target_runtime_min THEN n END) AS runtime_at_best_min
  FROM cands GROUP BY workload_id, target_runtime_min)"""

SQL["curve_gain"] = _with("cost_workloads", extra=_COST_SRC + ",\n" + _cands_sql()) + """
SELECT w.workload_id, k.knee_executors, k.knee_runtime_min, k.knee_gain
FROM (SELECT DISTINCT workload_id FROM cands) w LEFT JOIN (
  SELECT workload_id, CAST(n AS BIGINT) AS knee_executors, runtime_min AS knee_runtime_min, gain AS knee_gain FROM (
    SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY n) AS rn FROM (
      SELECT workload_id, n, runtime_min, (prev_runtime_min - runtime_min) / nullif(prev_runtime_min, 0) AS gain,
        in_curve, curve_from FROM cands)
    WHERE in_curve AND n > curve_from AND gain < 0.01e0)
  WHERE rn = 1) k ON w.workload_id = k.workload_id"""

SQL["cheapest"] = _with("cost_workloads", extra=_COST_SRC + ",\n" + _cands_sql()) + """
SELECT workload_id, CAST(n AS BIGINT) AS cheapest_executors, cpu_core_hours AS cheapest_core_hours,
  runtime_min AS cheapest_runtime_min
FROM (
  SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY cpu_core_hours, n) AS rn
  FROM cands WHERE in_search AND target_runtime_min > 0 AND runtime_min <= target_runtime_min)
WHERE rn = 1"""

_EST = _with("cost_workloads", extra=_COST_SRC + ",\n" + _estimate_sql())

SQL["time_breakdown"] = _EST + """
SELECT workload_id, 'cpu' AS component, cpu_seconds AS seconds FROM estimates
UNION ALL SELECT workload_id, 'disk_io', disk_seconds FROM estimates
UNION ALL SELECT workload_id, 'network_shuffle', network_seconds FROM estimates
UNION ALL SELECT workload_id, 'scheduler_overhead', scheduling_overhead_seconds FROM estimates"""

SQL["memory_breakdown"] = _EST + """
SELECT workload_id, 'execution_available' AS component, execution_memory_gb AS gb FROM estimates
UNION ALL SELECT workload_id, 'storage_available', storage_memory_gb FROM estimates
UNION ALL SELECT workload_id, 'working_set', working_set_gb FROM estimates
UNION ALL SELECT workload_id, 'shuffle_in_flight', shuffle_in_flight_gb FROM estimates
UNION ALL SELECT workload_id, 'cache_need', cache_need_gb FROM estimates
UNION ALL SELECT workload_id, 'broadcast', broadcast_tables_gb FROM estimates"""

SQL["cost_risks"] = _EST + """
SELECT workload_id, spill_ratio, heap_pressure, 'high_spill' AS risk FROM estimates WHERE spill_ratio > 0.25e0
UNION ALL
SELECT workload_id, spill_ratio, heap_pressure, 'high_heap_pressure' FROM estimates WHERE heap_pressure > 0.85e0"""

SQL["recommendations"] = _EST + """
SELECT workload_id, 'recommended_executor_memory_gb' AS parameter, recommended_executor_memory_gb AS value FROM estimates
UNION ALL SELECT workload_id, 'recommended_shuffle_partitions', CAST(recommended_shuffle_partitions AS DOUBLE) FROM estimates
UNION ALL SELECT workload_id, 'current_shuffle_partitions', CAST(shuffle_partitions AS DOUBLE) FROM estimates
UNION ALL SELECT workload_id, 'storage_pressure_pct', storage_pressure_ratio * 100e0 FROM estimates
UNION ALL SELECT workload_id, 'wave_factor', waves FROM estimates"""

SQL["bottleneck_mix"] = _EST + """
SELECT team, bottleneck, count(*) AS workloads, round(sum(cpu_core_hours), 4) AS cpu_core_hours
FROM (
  SELECT team, cpu_core_hours,
    CASE WHEN cpu_seconds >= disk_seconds AND cpu_seconds >= network_seconds THEN 'cpu'
      WHEN disk_seconds >= network_seconds THEN 'disk' ELSE 'network' END AS bottleneck
  FROM estimates)
GROUP BY team, bottleneck"""


# ---- profile planner (P) ---------------------------------------------------

_PROFILE_DIMS = """pdims AS (
  SELECT * FROM (VALUES ('Conservative', 'Heavy', true, 25, 180), ('Balanced', 'Standard', false, 10, 250),
    ('Aggressive', 'Standard', false, 5, 400)) t(p_name, p_shuffle, p_skew, p_safety, p_cap)
),
fdims AS (SELECT * FROM (VALUES ('Parquet', 1.20e0), ('Iceberg', 1.15e0), ('ORC', 1.25e0), ('CSV', 2.80e0)) t(f_name, format_factor)),
cdims AS (SELECT * FROM (VALUES ('Low', 384, 75.0e0, 24), ('Medium', 768, 45.0e0, 16), ('High', 1536, 24.0e0, 10))
  t(c_name, task_memory_mb, throughput_mbps, partitions_per_core)),
sdims AS (SELECT * FROM (VALUES ('Standard', 1.00e0), ('Heavy', 1.25e0), ('Extreme', 1.45e0)) t(s_name, shuffle_factor))"""


def _profile_resolved(src: str) -> str:
    return f"""
SELECT r.*, f.format_factor, c.task_memory_mb, c.throughput_mbps, c.partitions_per_core, s.shuffle_factor,
  CASE WHEN NOT profile_known THEN 'unknown_profile' WHEN f.format_factor IS NULL THEN 'unknown_data_format'
    WHEN c.task_memory_mb IS NULL THEN 'unknown_complexity' WHEN s.shuffle_factor IS NULL THEN 'unknown_shuffle_intensity'
    WHEN sla_minutes <= 0 THEN 'sla_not_positive' END AS reject_reason
FROM (
  SELECT w.workload_id, w.team, w.profile, w.data_format, w.complexity, w.sla_minutes, w.use_cache,
    w.data_volume, w.volume_unit, w.manual_override, p.p_cap IS NOT NULL AS profile_known,
    CASE WHEN coalesce(w.manual_override, false) THEN w.shuffle_intensity ELSE p.p_shuffle END AS shuffle_intensity,
    CASE WHEN coalesce(w.manual_override, false) THEN w.skew_risk ELSE p.p_skew END AS skew_risk,
    CAST(CASE WHEN coalesce(w.manual_override, false) THEN w.safety_buffer_pct ELSE p.p_safety END AS INTEGER) AS safety_buffer_pct,
    CAST(CASE WHEN coalesce(w.manual_override, false) THEN w.max_executors_cap ELSE p.p_cap END AS INTEGER) AS max_executors_cap,
    CAST(CASE WHEN w.volume_unit = 'TB' THEN w.data_volume * 1024e0 ELSE w.data_volume END AS DOUBLE) AS data_volume_gb
  FROM {src} w LEFT JOIN pdims p ON w.profile = p.p_name) r
LEFT JOIN fdims f ON r.data_format = f.f_name
LEFT JOIN cdims c ON r.complexity = c.c_name
LEFT JOIN sdims s ON r.shuffle_intensity = s.s_name"""


def _profile_plan_sql(src: str) -> str:
    return f"""
SELECT *, executors * (executor_memory_mb + executor_overhead_mb) + driver_memory_mb AS total_cluster_ram_mb,
  greatest(total_partitions, total_cluster_cores * 2) AS shuffle_partitions,
  '--num-executors ' || CAST(executors AS VARCHAR) || ' --executor-cores ' || CAST(executor_cores AS VARCHAR)
   || ' --executor-memory ' || CAST(greatest(1, CAST(ceil(executor_memory_mb / 1024) AS BIGINT)) AS VARCHAR)
   || 'g --driver-cores ' || CAST(driver_cores AS VARCHAR)
   || ' --driver-memory ' || CAST(greatest(1, CAST(ceil(driver_memory_mb / 1024) AS BIGINT)) AS VARCHAR)
   || 'g --conf spark.executor.memoryOverhead=' || CAST(executor_overhead_mb AS VARCHAR)
   || ' --conf spark.serializer=org.apache.spark.serializer.KryoSerializer --conf spark.sql.adaptive.enabled=true'
   || ' --conf spark.sql.adaptive.coalescePartitions.enabled=true --conf spark.sql.adaptive.advisoryPartitionSizeInBytes='
   || CAST(advisory_partition_bytes AS VARCHAR)
   || ' --conf spark.sql.shuffle.partitions=' || CAST(greatest(total_partitions, total_cluster_cores * 2) AS VARCHAR)
   || ' --conf spark.default.parallelism=' || CAST(greatest(total_partitions, total_cluster_cores * 2) AS VARCHAR) AS spark_submit
FROM (
  SELECT *, executors * executor_cores AS total_cluster_cores,
    greatest(CAST(384 AS BIGINT), CAST(ceil(executor_memory_mb * 0.10e0) AS BIGINT)) AS executor_overhead_mb
  FROM (
    SELECT *, least(raw_executors, CAST(max_executors_cap AS BIGINT)) AS executors,
      raw_executors > least(raw_executors, CAST(max_executors_cap AS BIGINT)) AS cap_hit,
      CAST(ceil(greatest(CAST(4096 AS BIGINT), CAST(ceil((executor_cores * task_memory_mb)
        * ((CASE WHEN use_cache THEN 1.30e0 ELSE 1.0e0 END) * shuffle_factor * (CASE WHEN skew_risk THEN 1.15e0 ELSE 1.0e0 END))
        + CASE WHEN complexity = 'High' THEN 1536 ELSE 1024 END) AS BIGINT)) / 512e0) AS BIGINT) * 512 AS executor_memory_mb,
      CASE WHEN complexity = 'High' THEN 8192 + CASE WHEN skew_risk THEN 2048 ELSE 0 END
        WHEN complexity = 'Medium' THEN CASE WHEN use_cache THEN 6144 ELSE 4096 END ELSE 3072 END AS driver_memory_mb,
      CASE WHEN complexity = 'High' THEN 2 ELSE 1 END AS driver_cores
    FROM (
      SELECT *, greatest(CAST(1 AS BIGINT), CAST(ceil(required_parallel_tasks / CAST(executor_cores AS DOUBLE)) AS BIGINT)) AS raw_executors
      FROM (
        SELECT *, greatest(
            greatest(CAST(1 AS BIGINT), CAST(ceil((effective_data_mb / CAST(sla_minutes * 60 AS DOUBLE)) / throughput_mbps) AS BIGINT)),
            greatest(CAST(1 AS BIGINT), CAST(ceil(total_partitions / CAST(partitions_per_core AS DOUBLE)) AS BIGINT))) AS required_parallel_tasks,
          CASE WHEN complexity = 'High' OR shuffle_intensity <> 'Standard' THEN 4 ELSE 5 END AS executor_cores
        FROM (
          SELECT *, greatest(CAST(1 AS BIGINT), CAST(ceil(effective_data_mb / CAST(aqe_partition_mb AS DOUBLE)) AS BIGINT)) AS total_partitions,
            CAST(aqe_partition_mb AS BIGINT) * 1048576 AS advisory_partition_bytes,
            effective_data_mb / 1024e0 AS effective_data_gb
          FROM (
            SELECT *, CAST(ceil(data_volume_gb * 1024 * format_factor * shuffle_factor * (1e0 + safety_buffer_pct / 100)) AS BIGINT) AS effective_data_mb,
              CASE WHEN complexity = 'High' OR shuffle_intensity = 'Extreme' THEN 96 ELSE 128 END AS aqe_partition_mb
            FROM ({_profile_resolved(src)}) WHERE reject_reason IS NULL))))))"""


_P_KEYS = ("workload_id, team, profile, data_format, complexity, shuffle_intensity, sla_minutes, use_cache, "
           "skew_risk, safety_buffer_pct, max_executors_cap, data_volume_gb")
_P_OUT = ("executors, executor_cores, executor_memory_mb, executor_overhead_mb, driver_memory_mb, driver_cores, "
          "total_cluster_cores, total_cluster_ram_mb, effective_data_mb, aqe_partition_mb, total_partitions, "
          "required_parallel_tasks, shuffle_partitions, advisory_partition_bytes, raw_executors, cap_hit, "
          "effective_data_gb, spark_submit")

SQL["profile_plan"] = _with("profile_workloads", extra=_PROFILE_DIMS) + \
    f"SELECT {_P_KEYS}, {_P_OUT} FROM ({_profile_plan_sql('profile_workloads')})"

SQL["enum_rejects"] = _with("profile_workloads", extra=_PROFILE_DIMS) + f"""
SELECT workload_id, profile, data_format, complexity, shuffle_intensity, reject_reason
FROM ({_profile_resolved('profile_workloads')}) WHERE reject_reason IS NOT NULL"""

SQL["profile_fleet"] = _with("profile_workloads", extra=_PROFILE_DIMS) + f"""
SELECT profile, data_format, complexity, count(*) AS workloads, CAST(sum(executors) AS BIGINT) AS executors,
  CAST(sum(total_cluster_cores) AS BIGINT) AS total_cluster_cores, CAST(sum(total_cluster_ram_mb) AS BIGINT) AS total_cluster_ram_mb,
  CAST(sum(CAST(cap_hit AS INTEGER)) AS BIGINT) AS capped_workloads
FROM ({_profile_plan_sql('profile_workloads')})
GROUP BY CUBE (profile, data_format, complexity)"""

SQL["profile_compare"] = _with("profile_workloads", extra=_PROFILE_DIMS + """,
grid AS (
  SELECT w.* REPLACE (g.p AS profile, false AS manual_override)
  FROM profile_workloads w, (SELECT unnest(['Conservative', 'Balanced', 'Aggressive']) AS p) g
)""") + f"""
SELECT workload_id,
  max(CASE WHEN profile = 'Conservative' THEN executors END) AS Conservative_executors,
  max(CASE WHEN profile = 'Conservative' THEN total_cluster_cores END) AS Conservative_cores,
  max(CASE WHEN profile = 'Conservative' THEN total_cluster_ram_mb END) AS Conservative_ram_mb,
  max(CASE WHEN profile = 'Balanced' THEN executors END) AS Balanced_executors,
  max(CASE WHEN profile = 'Balanced' THEN total_cluster_cores END) AS Balanced_cores,
  max(CASE WHEN profile = 'Balanced' THEN total_cluster_ram_mb END) AS Balanced_ram_mb,
  max(CASE WHEN profile = 'Aggressive' THEN executors END) AS Aggressive_executors,
  max(CASE WHEN profile = 'Aggressive' THEN total_cluster_cores END) AS Aggressive_cores,
  max(CASE WHEN profile = 'Aggressive' THEN total_cluster_ram_mb END) AS Aggressive_ram_mb,
  max(CASE WHEN profile = 'Conservative' THEN total_cluster_ram_mb END)
    - max(CASE WHEN profile = 'Balanced' THEN total_cluster_ram_mb END) AS Conservative_ram_mb_vs_Balanced,
  max(CASE WHEN profile = 'Conservative' THEN total_cluster_cores END)
    - max(CASE WHEN profile = 'Balanced' THEN total_cluster_cores END) AS Conservative_cores_vs_Balanced,
  max(CASE WHEN profile = 'Aggressive' THEN total_cluster_ram_mb END)
    - max(CASE WHEN profile = 'Balanced' THEN total_cluster_ram_mb END) AS Aggressive_ram_mb_vs_Balanced,
  max(CASE WHEN profile = 'Aggressive' THEN total_cluster_cores END)
    - max(CASE WHEN profile = 'Balanced' THEN total_cluster_cores END) AS Aggressive_cores_vs_Balanced
FROM ({_profile_plan_sql('grid')})
GROUP BY workload_id"""


# ---- node packer (N) -------------------------------------------------------

_SHAPES = """sized AS (
  SELECT *,
    CASE WHEN epn IS NULL OR epn < 1 THEN 'no_executor_fits' WHEN epn * num_nodes - 1 < 1 THEN 'cluster_too_small' ELSE 'ok' END AS status,
    CAST(node_cores * num_nodes AS BIGINT) AS cluster_cores, CAST(node_ram_gb * num_nodes AS BIGINT) AS cluster_ram_gb
  FROM (SELECT *, CAST(floor((node_cores - os_cores) / nullif(CAST(target_exec_cores AS DOUBLE), 0)) AS BIGINT) AS epn FROM cluster_shapes)
),
shapes AS (
  SELECT *, CASE WHEN status = 'ok' THEN (heap - 0.3e0) * memory_fraction * (epn * num_nodes - 1) END AS cluster_unified_mem_gb
  FROM (
    SELECT *, CASE WHEN status = 'ok' THEN raw - greatest(0.384e0, raw * 0.10e0) END AS heap,
      CASE WHEN status = 'ok' THEN greatest(0.384e0, raw * 0.10e0) END AS overhead_gb,
      CASE WHEN status = 'ok' THEN epn * num_nodes - 1 END AS total_executors,
      CASE WHEN status = 'ok' THEN (epn * num_nodes - 1) * target_exec_cores END AS total_compute_cores
    FROM (SELECT *, CASE WHEN status = 'ok' THEN (node_ram_gb - os_ram_gb) / CAST(epn AS DOUBLE) END AS raw FROM sized))
),
infl AS (SELECT * FROM (VALUES ('Parquet / ORC', 4), ('Compressed CSV / JSON', 8), ('Plain text', 3)) t(fmt, inflation_factor))"""

_PACK = """pack AS (
  SELECT w.workload_id, w.cluster_id, s.cluster, w.data_size_gb, w.data_format, i.inflation_factor,
    coalesce(s.status, 'unknown_cluster') AS status, s.epn AS executors_per_node, s.total_executors,
    s.target_exec_cores, s.total_compute_cores, s.raw AS raw_mem_per_exec_gb, s.overhead_gb, s.heap AS heap_gb,
    s.cluster_unified_mem_gb, s.memory_fraction,
    w.data_size_gb * i.inflation_factor * 1024 AS mb, w.data_size_gb * i.inflation_factor AS inflated,
    s.partition_size_mb, CASE WHEN s.status = 'ok' THEN s.heap > 8 END AS g1_advised
  FROM node_workloads w LEFT JOIN infl i ON w.data_format = i.fmt LEFT JOIN shapes s ON w.cluster_id = s.cluster_id
),
packed AS (
  SELECT workload_id, cluster_id, cluster, data_size_gb, data_format, inflation_factor, status, executors_per_node,
    total_executors, target_exec_cores, total_compute_cores, raw_mem_per_exec_gb, overhead_gb, heap_gb,
    cluster_unified_mem_gb,
    CASE WHEN status = 'ok' THEN mb END AS data_in_memory_mb,
    CASE WHEN status = 'ok' THEN base END AS base_partitions,
    CASE WHEN status = 'ok' THEN sp END AS shuffle_partitions,
    CASE WHEN status = 'ok' THEN CASE WHEN len(a) = 0 THEN ['ok'] ELSE a END END AS alerts,
    g1_advised,
    CASE WHEN status = 'ok' THEN '--conf spark.executor.instances=' || CAST(total_executors AS VARCHAR)
      || ' --conf spark.executor.cores=' || CAST(target_exec_cores AS VARCHAR)
      || ' --conf spark.executor.memory=' || CAST(CAST(floor(heap_gb) AS BIGINT) AS VARCHAR) || 'g'
      || ' --conf spark.executor.memoryOverhead=' || CAST(CAST(ceil(overhead_gb * 1024) AS BIGINT) AS VARCHAR) || 'm'
      || ' --conf spark.sql.shuffle.partitions=' || CAST(sp AS VARCHAR)
      || ' --conf spark.default.parallelism=' || CAST(sp AS VARCHAR)
      || ' --conf spark.memory.fraction=' || CAST(memory_fraction AS VARCHAR)
      || ' --conf spark.sql.adaptive.enabled=true' END AS spark_submit
  FROM (
    SELECT *, greatest(CAST(200 AS BIGINT), CAST(ceil(base / CAST(total_compute_cores AS DOUBLE)) AS BIGINT) * total_compute_cores) AS sp,
      list_filter([CASE WHEN heap_gb > 32 THEN 'compressed_oops_lost' END,
                   CASE WHEN target_exec_cores > 5 THEN 'fat_executor' END,
                   CASE WHEN target_exec_cores = 1 THEN 'tiny_executor' END,
                   CASE WHEN inflated > cluster_unified_mem_gb THEN 'spill_risk'
                        WHEN inflated > cluster_unified_mem_gb * 0.7e0 THEN 'high_memory_use' END], lambda x: x IS NOT NULL) AS a
    FROM (SELECT *, CAST(ceil(mb / CAST(partition_size_mb AS DOUBLE)) AS BIGINT) AS base FROM pack))
)"""

SQL["node_pack"] = _with("node_workloads", "cluster_shapes", extra=_SHAPES + ",\n" + _PACK) + "SELECT * FROM packed"

SQL["alert_counts"] = _with("node_workloads", "cluster_shapes", extra=_SHAPES + ",\n" + _PACK) + """
SELECT cluster, code, count(*) AS workloads,
  CASE code WHEN 'compressed_oops_lost' THEN 'warning' WHEN 'fat_executor' THEN 'warning' WHEN 'tiny_executor' THEN 'warning'
    WHEN 'spill_risk' THEN 'error' WHEN 'high_memory_use' THEN 'info' WHEN 'ok' THEN 'success' END AS severity
FROM (SELECT cluster, unnest(alerts) AS code FROM packed)
GROUP BY cluster, code"""

SQL["pick_shape"] = _with("node_workloads", "cluster_shapes", extra=_SHAPES) + """
SELECT w.workload_id, CAST(w.data_size_gb * i.inflation_factor AS DOUBLE) AS need_gb,
  b.cluster_id AS best_cluster_id, b.cluster AS best_cluster, b.cluster_cores AS best_cluster_cores,
  b.cluster_ram_gb AS best_cluster_ram_gb, b.cluster_unified_mem_gb AS best_cluster_unified_mem_gb
FROM node_workloads w LEFT JOIN infl i ON w.data_format = i.fmt
LEFT JOIN (
  SELECT * FROM (
    SELECT w2.workload_id, s.cluster_id, s.cluster, s.cluster_cores, s.cluster_ram_gb, s.cluster_unified_mem_gb,
      row_number() OVER (PARTITION BY w2.workload_id ORDER BY s.cluster_cores, s.cluster_ram_gb, s.cluster_id) AS rn
    FROM node_workloads w2 JOIN infl i2 ON w2.data_format = i2.fmt
    JOIN shapes s ON s.status = 'ok' AND w2.data_size_gb * i2.inflation_factor <= s.cluster_unified_mem_gb)
  WHERE rn = 1) b ON w.workload_id = b.workload_id"""


# ---- domain rules (V3) -----------------------------------------------------

# Declared ranges as the conditions that break them, by table and form.
_WAVE_BREAKS = {
    "data_size_below_min": "data_size_gb < 1", "sla_below_one_minute": "sla_seconds < 60",
    "k_comp_out_of_range": "k_comp NOT BETWEEN 1 AND 3", "k_skew_out_of_range": "k_skew NOT BETWEEN 1 AND 3",
    "skew_mode_not_offered": "skew_memory_mode NOT IN ('off', 'sqrt', 'linear')",
}
_COST_BREAKS = {
    "input_below_min": "input_data_gb < 0.1e0", "shuffle_ratio_out_of_range": "shuffle_ratio NOT BETWEEN 0 AND 2",
    "skew_factor_out_of_range": "skew_factor NOT BETWEEN 1 AND 4", "executors_below_min": "executors < 1",
    "target_negative": "target_runtime_min < 0", "min_executors_below_min": "min_executors < 1",
    "max_executors_below_min": "max_executors < 1",
}
_BREAKS = {
    ("workloads", "workloads"): _WAVE_BREAKS,
    ("workloads", "wave_forms"): _WAVE_BREAKS | {
        "block_size_not_offered": "block_size_mb NOT IN (64, 96, 128, 192, 256)",
        "t_base_below_min": "t_base_sec < 1", "e_mem_out_of_range": "e_mem_rate NOT BETWEEN 1 AND 6",
        "cores_per_exec_not_offered": "cores_per_exec NOT IN (2, 3, 4, 5, 6, 8)",
    },
    ("cost_workloads", "cost_workloads"): _COST_BREAKS,
    ("cost_workloads", "cost_forms"): _COST_BREAKS | {
        "compression_out_of_range": "compression_expand_factor NOT BETWEEN 1 AND 8",
        "format_overhead_out_of_range": "format_overhead_factor NOT BETWEEN 1 AND 2.5e0",
        "amplification_out_of_range": "transform_amplification_factor NOT BETWEEN 0.5e0 AND 3",
        "udf_complexity_out_of_range": "udf_complexity_factor NOT BETWEEN 0.5e0 AND 4",
        "stages_below_min": "stages_count < 1", "input_partitions_below_min": "input_partitions < 1",
        "shuffle_partitions_below_min": "shuffle_partitions < 1", "cores_below_min": "cores_per_executor < 1",
        "executor_memory_below_min": "executor_memory_gb < 1",
        "memory_overhead_out_of_range": "executor_memory_overhead_pct NOT BETWEEN 5 AND 50",
        "cpu_utilization_out_of_range": "cluster_cpu_utilization NOT BETWEEN 0.2e0 AND 1",
        "cpu_throughput_below_min": "cpu_throughput_mb_s_per_core < 1",
        "disk_throughput_below_min": "disk_throughput_mb_s_per_executor < 10",
        "network_throughput_below_min": "network_throughput_mb_s_per_executor < 10",
        "memory_fraction_out_of_range": "spark_memory_fraction NOT BETWEEN 0.2e0 AND 0.9e0",
        "storage_fraction_out_of_range": "spark_storage_fraction NOT BETWEEN 0.1e0 AND 0.9e0",
        "working_set_out_of_range": "active_working_set_fraction NOT BETWEEN 0.05e0 AND 0.7e0",
        "cache_fraction_out_of_range": "cache_fraction_of_data NOT BETWEEN 0 AND 1",
        "broadcast_negative": "broadcast_tables_gb < 0",
        "in_flight_shuffle_out_of_range": "concurrent_shuffle_fraction NOT BETWEEN 0.05e0 AND 0.8e0",
        "stage_overhead_negative": "stage_scheduler_overhead_s < 0",
        "spill_penalty_out_of_range": "spill_penalty_per_100pct NOT BETWEEN 0 AND 2",
        "gc_sensitivity_out_of_range": "gc_penalty_sensitivity NOT BETWEEN 0 AND 2",
        "retry_fraction_out_of_range": "expected_retry_fraction NOT BETWEEN 0 AND 0.5e0",
        "retry_cost_out_of_range": "retry_cost_fraction NOT BETWEEN 0 AND 1",
        "speculation_gain_out_of_range": "speculative_execution_gain NOT BETWEEN 0 AND 0.35e0",
    },
    ("profile_workloads", "profile_workloads"): {
        "data_volume_below_min": "data_volume < 1", "sla_out_of_range": "sla_minutes NOT BETWEEN 5 AND 720",
        "safety_buffer_out_of_range": "safety_buffer_pct NOT BETWEEN 0 AND 40",
        "executor_cap_below_min": "max_executors_cap < 1",
    },
    ("cluster_shapes", "cluster_shapes"): {
        "node_cores_below_min": "node_cores < 2", "node_ram_below_min": "node_ram_gb < 4",
        "num_nodes_below_min": "num_nodes < 2",
        "target_cores_out_of_range": "target_exec_cores NOT BETWEEN 1 AND node_cores",
        "os_cores_negative": "os_cores < 0", "os_ram_negative": "os_ram_gb < 0",
        "partition_size_below_min": "partition_size_mb < 10",
        "memory_fraction_out_of_range": "memory_fraction NOT BETWEEN 0.1e0 AND 0.9e0",
    },
    ("node_workloads", "node_workloads"): {"data_size_below_min": "data_size_gb < 1"},
}


def _violations_sql() -> str:
    rows = [f"SELECT '{form}' AS table_name, CAST({'cluster_id' if form == 'cluster_shapes' else 'workload_id'} AS BIGINT)"
            f" AS row_key, '{code}' AS rule FROM {table} WHERE {broken}"
            for (form, table), rules in _BREAKS.items() for code, broken in rules.items()]
    return (_with(*[table for _, table in _BREAKS], extra="violated AS (\n" + "\nUNION ALL ".join(rows) + "\n)"))


SQL["domain_violations"] = _violations_sql() + """
SELECT table_name, rule, count(*) AS violations FROM violated GROUP BY table_name, rule"""

SQL["violation_rows"] = _violations_sql() + "SELECT * FROM violated"


# ---- cross-model (X), sources and sinks (S) --------------------------------

_COMPARED = (_with("workloads", "cost_workloads", "profile_workloads", "node_workloads", "cluster_shapes",
                   extra=_TYPED_WL + ",\n" + _COST_SRC + ",\n" + _cands_sql() + ",\n" + _PROFILE_DIMS + ",\n"
                   + _SHAPES + ",\n" + _PACK) + f""",
search AS (
  SELECT workload_id, target_runtime_min, CAST(min(CASE WHEN in_search AND target_runtime_min > 0 AND runtime_min <= target_runtime_min THEN n END) AS BIGINT) AS best
  FROM cands GROUP BY workload_id, target_runtime_min
),
compared AS (
  SELECT workload_id, 'wave' AS model, CASE WHEN reject_reason IS NULL THEN executors END AS executors,
    CASE WHEN reject_reason IS NULL THEN total_cores END AS total_cores,
    CASE WHEN reject_reason IS NULL THEN container_memory_mb * executors END AS total_ram_mb, coalesce(reject_reason, 'ok') AS status
  FROM ({_wave_steps('typed_wl')})
  UNION ALL
  SELECT s.workload_id, 'cost', s.best, CAST(s.best * c.cores_per_executor AS BIGINT),
    CAST(ceil(s.best * (c.executor_memory_gb + c.executor_memory_gb * c.executor_memory_overhead_pct / 100e0) * 1024e0) AS BIGINT),
    CASE WHEN s.target_runtime_min <= 0 THEN 'disabled' WHEN s.best IS NULL THEN 'unreachable' ELSE 'ok' END
  FROM search s JOIN cw c ON s.workload_id = c.workload_id
  UNION ALL
  SELECT workload_id, 'profile', executors, total_cluster_cores, total_cluster_ram_mb, 'ok'
  FROM ({_profile_plan_sql('profile_workloads')})
  UNION ALL
  SELECT workload_id, 'profile', NULL, NULL, NULL, reject_reason
  FROM ({_profile_resolved('profile_workloads')}) WHERE reject_reason IS NOT NULL
  UNION ALL
  SELECT workload_id, 'node', total_executors, total_compute_cores, CAST(ceil(total_executors * raw_mem_per_exec_gb * 1024e0) AS BIGINT), status
  FROM packed
)""")

SQL["compare_models"] = _COMPARED + "\nSELECT * FROM compared"

SQL["model_spread"] = _COMPARED + """
SELECT workload_id, count(executors) AS models, min(executors) AS min_executors, max(executors) AS max_executors,
  arg_min(model, (executors, model)) AS min_model, arg_min(model, (-executors, model)) AS max_model,
  max(executors) / nullif(CAST(min(executors) AS DOUBLE), 0) AS spread_ratio
FROM compared WHERE executors IS NOT NULL GROUP BY workload_id
ORDER BY spread_ratio DESC NULLS LAST, workload_id LIMIT 20"""

SQL["dataset_sizes"] = _with("file_manifest") + """
SELECT dataset, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, sum(bytes) / 1073741824e0 AS data_size_gb
FROM file_manifest GROUP BY dataset"""

SQL["write_plans"] = SQL["wave_plan_typed"]

SQL["duplicate_rejects"] = _with("resubmitted_workloads") + """
SELECT *, 'duplicate_key' AS reject_reason
FROM (SELECT *, count(*) OVER (PARTITION BY workload_id) AS copies FROM resubmitted_workloads) WHERE copies > 1"""

SQL["plan_changes"] = _with("task_metrics", "baseline_tasks", "workloads", extra=_CALIBRATION + ",\n" + _CAL_WL + ",\n" + _TYPED_WL) + f""",
old_plans AS (SELECT workload_id, executors, executor_heap_mb FROM ({_wave_steps('typed_wl')}) WHERE reject_reason IS NULL),
new_plans AS (SELECT workload_id, executors, executor_heap_mb FROM ({_wave_steps('cal_wl')}) WHERE reject_reason IS NULL)
SELECT * FROM (
  SELECT coalesce(o.workload_id, n.workload_id) AS workload_id,
    CASE WHEN o.workload_id IS NULL THEN 'added' WHEN n.workload_id IS NULL THEN 'removed'
      WHEN o.executors <> n.executors OR o.executor_heap_mb <> n.executor_heap_mb THEN 'changed' END AS change,
    o.executors AS old_executors, n.executors AS new_executors, o.executor_heap_mb AS old_executor_heap_mb, n.executor_heap_mb AS new_executor_heap_mb
  FROM old_plans o FULL JOIN new_plans n ON o.workload_id = n.workload_id)
WHERE change IS NOT NULL"""

SQL["wave_skew_sensitivity"] = _with("workloads", extra="""grid AS (
  SELECT workload_id, data_size_gb, sla_seconds, k_comp, k AS k_skew, m AS skew_memory_mode,
    25e0 AS t_base_sec, 3e0 AS e_mem_rate
  FROM workloads, (SELECT unnest(['off', 'sqrt', 'linear']) AS m), (SELECT unnest([1.0e0, 1.5e0, 2.0e0, 2.5e0, 3.0e0]) AS k))""") + f"""
SELECT skew_memory_mode, k_skew,
  CAST(sum(CASE WHEN reject_reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS plans,
  CAST(sum(CASE WHEN reject_reason IS NULL THEN executors END) AS BIGINT) AS executors,
  CAST(sum(CASE WHEN reject_reason IS NULL THEN total_memory_mb_raw END) AS BIGINT) AS total_memory_mb,
  max(CASE WHEN reject_reason IS NULL THEN container_memory_mb END) AS max_container_memory_mb
FROM ({_wave_steps('grid')})
GROUP BY skew_memory_mode, k_skew"""

SQL["wave_plan_stream"] = _with("workloads", extra=_TYPED_WL) + f"""
SELECT {_WAVE_KEYS}, reject_reason,
  {", ".join(f"CASE WHEN reject_reason IS NULL THEN {c.strip()} END AS {c.strip()}" for c in _WAVE_OUT.split(","))}
FROM ({_wave_steps('typed_wl')})"""
