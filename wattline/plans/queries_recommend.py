"""Recommendation rules and savings."""

from pyspark.sql import functions as F

from wattline.config import DEFAULTS, replace
from wattline.operators import anomaly, recommend
from wattline.plans import views
from wattline.plans.catalog import query
from wattline.plans.oracle_views import with_views
from wattline.plans.queries_anomaly import FLAG_CTES
from wattline.session import reliable

PUBLIC = ["series_id", "rule_no", "category", "priority", "title", "description", "estimated_saving_pct", "actions"]

# Thresholds low enough for some series of the test tables to meet them and some not.
TUNED = replace(DEFAULTS, load_shift_threshold=1_000.0, high_percentile=0.45)
RATIO, NIGHT_SHARE, CHANGE, GAP_SHARE, ANOMALY_PCT = 1.0, 0.99, 0.0, 1.0, 2.0


def public(recs, *extra: str):
    return recs.select(
        *PUBLIC[:-2], F.round("estimated_saving_pct", 4).alias("estimated_saving_pct"),
        F.array_join("action_items", ";").alias("actions"), *extra,
    )


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, *args: str) -> str:
    """SQL expression for a text template with ``%s`` places."""
    parts = template.replace("%%", "\0").split("%s")
    pieces = [quoted(parts[0].replace("\0", "%"))] if args else [quoted(template)]
    for arg, rest in zip(args, parts[1:]):
        pieces += [arg, quoted(rest.replace("\0", "%"))]
    return " || ".join(p for p in pieces if p != "''") or "''"


def whole(expr: str) -> str:
    return f"format('{{:,}}', cast(round_even({expr}, 0) as bigint))"


def decimals(expr: str, n: int) -> str:
    return f"format('{{:.{n}f}}', {expr})"


def row_sql(rule: str, no: int, priority: str, saving: str, source: str, title=(), description=()) -> str:
    text = recommend.TEXTS[rule]
    return f"""select series_id, cast({no} as integer) as rule_no, {quoted(text['category'])} as category, {priority} as priority,
       {filled(text['title'], *title)} as title, {filled(text['description'], *description)} as description,
       round(cast({saving} as double), 4) as estimated_saving_pct, {quoted(';'.join(text['actions']))} as actions
       from {source}"""


PEAK_CTE = """
    pk as (select series_id, coalesce(avg(case when hour(ts) in (15, 16, 17, 18) then y end), 0) as p,
                  coalesce(avg(case when hour(ts) not in (15, 16, 17, 18) then y end), 0) as o from load_by_type group by series_id),
    pf as (select *, p / o as r from pk where p > 1000 and o > 0 and p / o > 1.0)"""
PEAK = row_sql("peak_shift", 1, "'HIGH'", "least(15.0, (r - 1) * 10)", "pf", description=(whole("p"), decimals("r", 1), whole("o")))
NIGHT_CTE = """
    nt as (select series_id, avg(case when hour(ts) between 0 and 5 then y end) as n, avg(y) as a from load_by_type group by series_id),
    nf as (select * from nt where n < a * cast(0.99 as double))"""
NIGHT = row_sql("offpeak_storage", 2, "'MEDIUM'", "8.0", "nf", description=(whole("n"), decimals("100.0 * (1 - n / a)", 0)))
TREND_CTE = """
    rk as (select *, row_number() over (partition by series_id order by ts desc) as rn from load_by_type),
    wk as (select series_id, count(*) as n, avg(y) as all_mean, avg(case when rn <= 168 then y end) as last_mean,
                  avg(case when rn > 168 and rn <= 336 then y end) as prev_mean from rk group by series_id),
    wp as (select *, case when n >= 336 then prev_mean else all_mean end as prev from wk where n >= 168),
    wf as (select *, (last_mean - prev) / (prev + 1e-8) * 100 as change from wp where (last_mean - prev) / (prev + 1e-8) * 100 > 0.0)"""
TREND = row_sql("week_trend", 3, "'HIGH'", "change * 0.5", "wf", title=(decimals("change", 1),), description=(whole("last_mean"), whole("prev")))
DECILE_CTE = """
    dr as (select *, row_number() over (partition by series_id order by ts desc) as rn from load_by_type),
    dq as (select series_id, count(*) as n, quantile_cont(y, 0.45) as lim, avg(case when rn <= 24 then y end) as recent
           from dr group by series_id),
    df as (select * from dq where n >= 168 and recent > lim)"""
DECILE = row_sql("top_decile", 4, "'HIGH'", "12.0", "df", description=(whole("recent"), "'45.0'", whole("lim")))
GAP_CTE = """
    gp as (select series_id, avg(case when isodow(ts) < 6 then y end) as wd, avg(case when isodow(ts) >= 6 then y end) as we
           from load_by_type group by series_id),
    gf as (select * from gp where wd > 0 and we / wd < 1.0)"""
GAP = row_sql("weekend_gap", 5, "'LOW'", "5.0", "gf", description=(whole("wd"), whole("we")))
SHARE_CTE = FLAG_CTES.format(source="load_by_type", z=3.0) + """,
    sh as (select series_id, sum(is_anomaly) as hits, count(*) as n from v group by series_id),
    sf as (select *, hits * 100 / (n + 1e-8) as pct from sh where hits * 100 / (n + 1e-8) > 2.0)"""
SHARE = row_sql(
    "anomaly_rate", 6, "case when pct > 4.0 then 'HIGH' else 'MEDIUM' end", "least(20.0, pct)", "sf",
    title=("cast(cast(hits as bigint) as varchar)", decimals("pct", 1)),
)
DRIVER_CTE = """
    im as (select series_id, case hour(ts) % 6 when 0 then 'hour_sin' when 1 then 'rolling_mean_7' when 2 then 'load_t_24'
                  when 3 then 'is_weekend' when 4 then 'month' else 'load_t_1' end as feature, avg(y) as mean_abs_shap
           from load_by_type group by 1, 2),
    it as (select * from im qualify row_number() over (partition by series_id order by mean_abs_shap desc, feature) <= 2),
    dg as (select series_id, max(case when contains(feature, 'rolling') then 1 else 0 end) as ro,
                  max(case when contains(feature, 'hour') then 1 else 0 end) as ho,
                  max(case when contains(feature, 'is_weekend') or contains(feature, 'is_holiday') then 1 else 0 end) as ca
           from it group by series_id)"""
DRIVERS = " union all ".join([
    row_sql("driver_rolling", 7, "'LOW'", "0.0", "dg where ro = 1"), row_sql("driver_hour", 8, "'MEDIUM'", "7.0", "dg where ho = 1"),
    row_sql("driver_calendar", 9, "'LOW'", "4.0", "dg where ca = 1"),
])
IDS_CTE = "\n    ids as (select distinct series_id from load_by_type)"
GENERAL = " union all ".join([
    row_sql("general_hvac", 10, "'MEDIUM'", "15.0", "ids"), row_sql("general_renewable", 11, "'MEDIUM'", "10.0", "ids"),
])


def loads(spark, sf_dir):
    return views.load_by_type(spark, sf_dir)


def as_forecast(series):
    return series.withColumnRenamed("y", "forecast")


def importances(series):
    """Mean load by hour class, read as the importance of six features."""
    hour = F.hour("ts") % 6
    name = F.when(hour == 0, "hour_sin").when(hour == 1, "rolling_mean_7").when(hour == 2, "load_t_24")
    name = name.when(hour == 3, "is_weekend").when(hour == 4, "month").otherwise("load_t_1")
    return series.groupBy("series_id", name.alias("feature")).agg(F.avg("y").alias("mean_abs_shap"))


RULES = {
    "peak_shift": lambda s: recommend.peak_shift(recommend.forecast_profile(as_forecast(s)), cfg=TUNED, min_ratio=RATIO),
    "offpeak_storage": lambda s: recommend.offpeak_storage(recommend.forecast_profile(as_forecast(s)), share=NIGHT_SHARE),
    "week_trend": lambda s: recommend.week_trend(recommend.history_profile(s), min_change=CHANGE),
    "top_decile": lambda s: recommend.top_decile(recommend.history_profile(s, cfg=TUNED), cfg=TUNED),
    "weekend_gap": lambda s: recommend.weekend_gap(recommend.history_profile(s), share=GAP_SHARE),
    "anomaly_rate": lambda s: recommend.anomaly_share(
        anomaly.detect(s, methods=("zscore", "iqr")), threshold=ANOMALY_PCT, high=4.0),
    "drivers": lambda s: recommend.driver_rules(importances(s), top=2),
    "general": recommend.general_rules,
}


def _register(name, key, ctes, body):
    @query(name, with_views("load_by_type", ctes + " " + body))
    def run(spark, sf_dir):
        return public(RULES[key](loads(spark, sf_dir)))

    return run


_register("rule_peak_shift", "peak_shift", PEAK_CTE, PEAK)
_register("rule_offpeak_storage", "offpeak_storage", NIGHT_CTE, NIGHT)
_register("rule_week_trend", "week_trend", TREND_CTE, TREND)
_register("rule_top_decile", "top_decile", DECILE_CTE, DECILE)
_register("rule_weekend_gap", "weekend_gap", GAP_CTE, GAP)
_register("rule_anomaly_rate", "anomaly_rate", SHARE_CTE, SHARE)
_register("rule_shap_drivers", "drivers", DRIVER_CTE, DRIVERS)
_register("rule_general", "general", IDS_CTE, GENERAL)

# The combined run uses the default thresholds apart from the two in TUNED.
ALL_CTE = ",".join([
    PEAK_CTE.replace("p / o > 1.0", "p / o > cast(1.15 as double)"), NIGHT_CTE.replace("0.99", "0.75"),
    TREND_CTE.replace("* 100 > 0.0", "* 100 > 10.0"), DECILE_CTE, GAP_CTE.replace("we / wd < 1.0", "we / wd < cast(0.6 as double)"),
    SHARE_CTE.replace("> 2.0", "> 5.0"), DRIVER_CTE.replace("<= 2", "<= 5"), IDS_CTE,
])
ALL_ROWS = f"""
    every as ({' union all '.join([PEAK, NIGHT, TREND, DECILE, GAP, SHARE.replace('pct > 4.0', 'pct > 10.0'), DRIVERS, GENERAL])}),
    uniq as (select * from every qualify row_number() over (partition by series_id, title order by rule_no) = 1),
    final as (select *, cast(row_number() over (partition by series_id order by
                  case priority when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, rule_no) as integer) as position from uniq)"""


def generated(spark, sf_dir):
    """All rules; the loads feed every one of them, so they are written once."""
    base = reliable(loads(spark, sf_dir))
    flagged = anomaly.detect(base, methods=("zscore", "iqr"))
    return recommend.generate(as_forecast(base), base, flagged, importances(base), cfg=TUNED)


@query("recommendations", with_views("load_by_type", ALL_CTE + "," + ALL_ROWS + "\n    select * from final"))
def recommendations(spark, sf_dir):
    return public(generated(spark, sf_dir), "position")


@query("implemented_filter", with_views("load_by_type", ALL_CTE + "," + ALL_ROWS + """
    select series_id, rule_no, title from final where title in (select title from final where rule_no in (8, 10))"""))
def implemented_filter(spark, sf_dir):
    from wattline.operators.reports import implemented_only

    recs = generated(spark, sf_dir)
    done = recs.filter(F.col("rule_no").isin(8, 10)).select("title").distinct()
    return implemented_only(recs, done).select("series_id", "rule_no", "title")


@query("savings_totals", with_views("load_by_type", ALL_CTE + "," + ALL_ROWS + """,
    k as (select *, estimated_saving_pct / 100 * 50000 as kwh, title in (select title from final where rule_no in (8, 10)) as done from final)
    select series_id, count(*) as recommendations, round(avg(estimated_saving_pct), 3) as mean_saving_pct,
           round(sum(kwh * cast(0.4 as double)), 2) as total_co2, round(coalesce(sum(case when done then kwh end), 0), 2) as realised_kwh,
           round(coalesce(sum(case when done then kwh end), 0) * cast(0.4 as double), 2) as realised_co2,
           round(coalesce(sum(case when done then kwh end), 0) * cast(0.12 as double), 2) as realised_money,
           cast(round(count(*) filter (where done) * 100.0 / count(*)) as bigint) as implemented_pct
    from k group by series_id"""))
def savings_totals(spark, sf_dir):
    recs = generated(spark, sf_dir).withColumn("estimated_saving_pct", F.round("estimated_saving_pct", 4))
    done = recs.filter(F.col("rule_no").isin(8, 10)).select("title").distinct()
    out = recommend.savings_totals(recs, done)
    digits = {"mean_saving_pct": 3, "total_co2": 2, "realised_kwh": 2, "realised_co2": 2, "realised_money": 2}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})
