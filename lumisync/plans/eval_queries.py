"""Registered benchmark-table and probe queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators.diff import throughput as per_second
from ..operators.probe import INVERSE_STRENGTH, accuracy, fit_probe, optimality, predict
from ..session import fresh_dir
from .fixtures import table

MEASURES = {"run_1": "l_quantity", "run_2": "l_extendedprice", "run_3": "l_discount", "run_4": "l_tax"}
RUNS = [f"run_{i}" for i in range(1, 8)]


def _wide(spark, sf, size="l_linenumber"):
    lines = table(spark, sf, "lineitem")
    return lines.select(F.col(size).cast("bigint").alias("images"),
                        *[F.col(c).alias(run) for run, c in MEASURES.items()])


def _long(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select(F.col("l_orderkey").alias("images"),
                        F.concat(F.lit("run_"), "l_linenumber").alias("run"), F.col("l_quantity").alias("seconds"))


def bench_csv(spark, sf):
    path = fresh_dir(spark, "csv")
    R.write_csv(_wide(spark, sf, "l_orderkey"), path)
    return R.read_csv(spark, path, list(MEASURES))


def wide_to_long(spark, sf):
    return R.to_long(_wide(spark, sf, "l_orderkey"))


def long_to_wide(spark, sf):
    return R.to_wide(_long(spark, sf), RUNS)


def append_run(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("images"), F.col("o_totalprice").alias("seconds"))
    return R.to_wide(R.append_run(_long(spark, sf), orders), [*RUNS, "run_8"])


def bench_summary(spark, sf):
    summary = R.summarize_runs(R.to_long(_wide(spark, sf)))
    return summary.select("images", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def throughput(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(per_second(F.col("l_quantity"), F.col("l_discount")), 4).alias("per_second"))


def probe_accuracy(spark, sf):
    return table(spark, sf, "labels").agg(
        F.round(accuracy(F.col("toxic"), F.col("quality")), 6).alias("accuracy"))


HELD_OUT = "vec_id % 5 = 0"


def linear_probe(spark, sf):
    """Predicted labels of the held-out fifth, from a probe fitted on the rest."""
    rows = table(spark, sf, "embeddings")
    model = fit_probe(rows.where(f"not {HELD_OUT}"), "embedding", "label")
    return predict(model, rows.where(HELD_OUT), "embedding").select("vec_id", "label", "prediction")


def probe_optimality(spark, sf):
    """How many rows of each label the probe learns from, and whether its weights for the label
    are the optimum: there the gradient of the penalised loss vanishes, and only there."""
    train = table(spark, sf, "embeddings").where(f"not {HELD_OUT}")
    model = fit_probe(train, "embedding", "label")
    return optimality(model, train, "embedding", "label").select(
        F.col("label").cast("int").alias("label"), "n", (F.col("steepest") < 1e-3).alias("optimal"))


QUERIES = {
    "bench_csv": bench_csv,
    "wide_to_long": wide_to_long,
    "long_to_wide": long_to_wide,
    "append_run": append_run,
    "bench_summary": bench_summary,
    "throughput": throughput,
    "probe_accuracy": probe_accuracy,
    "linear_probe": linear_probe,
    "probe_optimality": probe_optimality,
}

_COLUMNS = ", ".join(f"{c} as {run}" for run, c in MEASURES.items())
_LONG = "l as (select l_orderkey as images, 'run_' || l_linenumber as run, l_quantity as seconds from lineitem)"


def _pivot(runs) -> str:
    return ", ".join(f"max(seconds) filter (run = '{r}') as {r}" for r in runs)


def _unpivot(size: str) -> str:
    return " union all ".join(
        f"select cast({size} as bigint) as images, '{run}' as run, {c} as seconds from lineitem"
        for run, c in MEASURES.items())


# The same penalised loss by another way: gradient steps from zero, 1 / (greatest curvature) long. The summed squares
# bound the curvature in the weights, the rows that in the intercepts (column 0, without penalty).
_PROBE_STEPS = 150
_PROBE_SQL = f"""with recursive
x as (select vec_id, label, unnest(range(0, len(embedding) + 1)) as d,
        unnest(list_prepend(1.0, cast(embedding as double[]))) as v
      from embeddings where not {HELD_OUT}),
y as (select distinct vec_id, label from x),
classes as (select unnest(range(0, max(label) + 1)) as k from y),
rate as (select d, case when d = 0 then 2.0 / (select count(*) from y)
           else 1 / (1 / {INVERSE_STRENGTH} + 0.5 * (select max(s) from (select sum(abs(g)) as s from (
               select a.d as i, sum(a.v * b.v) as g from x a join x b using (vec_id) where a.d > 0 and b.d > 0 group by a.d, b.d) group by i)))
           end as rate
         from (select distinct d from x)),
fit as (
  select 0 as step, k, d, cast(0 as double) as w from classes, rate
  union all
  select f.step + 1, f.k, f.d, f.w - r.rate * (g.slope + case when f.d = 0 then 0 else f.w / {INVERSE_STRENGTH} end)
  from fit f join rate r using (d) join (
    select k, d, sum((p - case when x.label = k then 1 else 0 end) * v) as slope
    from (select vec_id, k, exp(z) / sum(exp(z)) over (partition by vec_id) as p
          from (select vec_id, k, sum(w * v) as z from fit join x using (d) group by vec_id, k)) join x using (vec_id)
    group by k, d) g using (k, d)
  where f.step < {_PROBE_STEPS}),
held as (select vec_id, label, unnest(range(0, len(embedding) + 1)) as d,
           unnest(list_prepend(1.0, cast(embedding as double[]))) as v
         from embeddings where {HELD_OUT}),
scores as (select vec_id, label, k, sum(w * v) as z from held join fit using (d) where step = {_PROBE_STEPS} group by vec_id, label, k)
select vec_id, label, cast(arg_max(k, z) as int) as prediction from scores group by vec_id, label"""

ORACLES = {
    "linear_probe": _PROBE_SQL,
    "bench_csv": f"select l_orderkey as images, {_COLUMNS} from lineitem",
    "wide_to_long": _unpivot("l_orderkey"),
    "long_to_wide": f"with {_LONG} select images, {_pivot(RUNS)} from l group by images",
    "append_run": f"""with {_LONG}, m as (select * from l union all
  select o_orderkey, 'run_' || (select count(distinct run) + 1 from l), o_totalprice from orders)
select images, {_pivot([*RUNS, 'run_8'])} from m group by images""",
    "bench_summary": f"""with l as ({_unpivot('l_linenumber')})
select images, round(avg(seconds), 4) as mean, round(stddev_pop(seconds), 4) as std from l group by images""",
    "throughput": """select l_orderkey, l_linenumber,
  case when l_discount <> 0 then round(l_quantity / l_discount, 4) end as per_second from lineitem""",
    "probe_optimality": f"""select label, count(*) as n, true as optimal from embeddings
where not {HELD_OUT} group by label""",
    "probe_accuracy": """select round(avg(case when toxic = quality then 1.0 else 0.0 end) * 100, 6) as accuracy
from labels""",
}
