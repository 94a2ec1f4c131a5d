"""Tree queries whose splits and leaves SQL computes as well."""

from pyspark.sql import functions as F

from wattline.models import series_trees as trees
from wattline.operators import features
from wattline.plans import views
from wattline.plans.catalog import query
from wattline.plans.oracle_views import with_views

PAIR = ("load_t_1", "load_t_24")


def _rows_sql(bins: int, held_out: bool) -> str:
    """Rows with two lags, those that are fitted, their gradients and the bin edges of both lags.

    An edge is the value at a step of the sorted column; the largest value is none."""
    last = "n - least(100, greatest(5, cast(floor(n * 0.1) as bigint)))" if held_out else "n"
    return f"""
    l as (select *, lag(y, 1) over w as a, lag(y, 24) over w as b from load_by_type window w as (partition by series_id order by ts)),
    v as (select series_id, ts, y, a, b, row_number() over (partition by series_id order by ts) - 1 as i, count(*) over (partition by series_id) as n,
                 pow(2, 29 - ceil(log2(max(abs(y)) over (partition by series_id)))) as sc from l where b is not null),
    fitted as (select * from v where i < {last}),
    means as (select series_id, sum(y) / count(*) as base from fitted group by 1),
    wide as (select f.*, base, round_even(base * sc, 0) - y * sc as g from fitted f join means using (series_id)),
    u as (select series_id, ts, y, g, sc, 0 as node, 0 as f, a as x from wide union all select series_id, ts, y, g, sc, 0, 1, b from wide),
    placed as (select series_id, f, x, row_number() over (partition by series_id, f order by x) as rn, count(*) over (partition by series_id, f) as m,
                      max(x) over (partition by series_id, f) as top from u),
    steps as (select unnest(generate_series(1, {bins - 1})) as step),
    edges as (select distinct series_id, f, x as edge from placed join steps on rn = (m * step + {bins - 1}) // {bins} where x < top)"""


def _best_sql(name: str, rows: str, l2: float, least: int, value: str = "g") -> str:
    """The best cut of every node of ``rows`` (series_id, node, f, x, sc and a value)."""
    return f"""
    {name}_sums as (
      select r.series_id, node, e.f, edge, sum(case when x <= edge then {value} else 0 end) / sc as gl, count(*) filter (x <= edge) as hl,
             sum({value}) / sc as g, count(*) as h
      from {rows} r join edges e on e.series_id = r.series_id and e.f = r.f group by r.series_id, node, e.f, edge, sc),
    {name} as (
      select *, gl * gl / (hl + {l2}) + (g - gl) * (g - gl) / (h - hl + {l2}) - g * g / (h + {l2}) as gain from {name}_sums
      where hl >= {least} and h - hl >= {least}
      qualify row_number() over (partition by series_id, node order by gain desc, f, edge) = 1)"""


def _rows(spark, sf_dir):
    return features.add_lags(views.load_by_type(spark, sf_dir), lags=[1, 24], diffs=False).na.drop("any")


def _predicted(model, rows):
    return model.transform(rows).select("series_id", "ts", F.round("prediction", 3).alias("prediction"))


@query("forest_stump", with_views("load_by_type", _rows_sql(64, False).replace("round_even(base * sc, 0) - y * sc as g", "y * sc as g") + "," + _best_sql("cut", "u", 0.0, 1) + """
    select v.series_id, ts, round(case when (case when f = 0 then a else b end) <= edge then gl / hl else (g - gl) / (h - hl) end, 3) as prediction
    from v join cut using (series_id)"""))
def forest_stump(spark, sf_dir):
    """A forest of one tree of depth one on all rows: each owner's own best cut, and the means of both sides."""
    rows = _rows(spark, sf_dir)
    model = trees.fit_series_forest(rows, PAIR, params={"trees": 1, "depth": 1, "min_split": 2, "bootstrap": False}, tune=False)
    return _predicted(model, rows)


@query("second_order_stump", with_views("load_by_type", _rows_sql(256, True) + "," + _best_sql("cut", "u", 1.0, 0) + """
    select v.series_id, ts, round(base - case when (case when f = 0 then a else b end) <= edge then gl / (hl + 1.0) else (g - gl) / (h - hl + 1.0) end, 3) as prediction
    from v join cut using (series_id) join means using (series_id)""").replace("where hl >= 0 and h - hl >= 0", "where hl > 0 and h > hl"))
def second_order_stump(spark, sf_dir):
    """One boosting round of depth one: gain and leaves from sums of gradients and weights with L2, on all but the newest rows."""
    rows = _rows(spark, sf_dir)
    params = {"trees": 1, "depth": 1, "rate": 1.0, "rows": 1.0, "columns": 1.0, "min_leaf": 0}
    return _predicted(trees.fit_series_boosted_a(rows, PAIR, params=params, tune=False), rows)


LEAST = 20


@query("leafwise_tree", with_views("load_by_type", _rows_sql(256, True) + "," + _best_sql("cut", "u", 0.0, LEAST) + f""",
    sides as (select w.series_id, w.ts, case when (case when c.f = 0 then a else b end) <= c.edge then 1 else 2 end as node, a, b, w.g, sc
              from wide w join cut c using (series_id)),
    u2 as (select series_id, node, 0 as f, a as x, g, sc from sides union all select series_id, node, 1, b, g, sc from sides),
    {_best_sql("second", "u2", 0.0, LEAST)},
    chosen as (select * from second qualify row_number() over (partition by series_id order by gain desc, node) = 1),
    routed as (
      select v.series_id, ts, case when (case when c.f = 0 then a else b end) <= c.edge then 1 else 2 end as side, a, b,
             c.gl as lg, c.hl as lh, c.g - c.gl as rg, c.h - c.hl as rh from v join cut c using (series_id))
    select r.series_id, ts, round(base - case
        when k.node = side then case when (case when k.f = 0 then a else b end) <= k.edge then k.gl / k.hl else (k.g - k.gl) / (k.h - k.hl) end
        when side = 1 then lg / lh else rg / rh end, 3) as prediction
    from routed r left join chosen k using (series_id) join means using (series_id)"""))
def leafwise_tree(spark, sf_dir):
    """A tree of three leaves: the side with the larger gain is divided first, and then the leaves are used up."""
    rows = _rows(spark, sf_dir)
    params = {"trees": 1, "leaves": 3, "depth": 6, "rate": 1.0, "min_leaf": LEAST, "rows": 1.0, "columns": 1.0}
    return _predicted(trees.fit_series_boosted_b(rows, PAIR, params=params, tune=False), rows)


@query("owner_forests", with_views("load_by_type", """
    select series_id, count(*) - 24 as n_rows, 0::bigint as changed_by_others from load_by_type group by 1"""))
def owner_forests(spark, sf_dir):
    """Forests fitted to all owners, and again after the readings of all but two owners were changed: rows of these two that are predicted otherwise,
    and rows of the changed ones that are not."""
    rows = _rows(spark, sf_dir)
    params = {"trees": 20, "depth": 5}
    want = trees.fit_series_forest(rows, PAIR, params=params, tune=False).transform(rows).select("series_id", "ts", "prediction")
    names = [r[0] for r in rows.select("series_id").distinct().orderBy("series_id").limit(2).collect()]
    kept = F.col("series_id").isin(names)  # the first two keep their readings
    others = rows.withColumn("y", F.when(kept, F.col("y")).otherwise(F.col("y") * -2 + 1))
    again = trees.fit_series_forest(others, PAIR, params=params, tune=False).transform(rows).select("series_id", "ts", F.col("prediction").alias("again"))
    both = want.join(again, ["series_id", "ts"])
    differs = F.when(kept & (F.col("prediction") != F.col("again")), 1).when(~kept & (F.col("prediction") == F.col("again")), 1).otherwise(0)
    return both.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(differs).cast("long").alias("changed_by_others"))
