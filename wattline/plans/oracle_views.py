"""The same views as SQL text, used as CTE bodies by the checking queries."""

VIEWS = {
    "load_hourly": """
        select 'all' as series_id, date_trunc('hour', ts) as ts, sum(round(value * 100)) as y
        from events group by 1, 2""",
    "load_by_type": """
        select event_type as series_id, date_trunc('hour', ts) as ts, sum(round(value * 100)) as y
        from events group by 1, 2""",
    "load_exog": """
        select 'all' as series_id, date_trunc('hour', ts) as ts, sum(round(value * 100)) as y,
               sum(case when event_type = 'click' then round(value * 100) else 0.0 end) as click,
               sum(case when event_type = 'view' then round(value * 100) else 0.0 end) as view
        from events group by 1, 2""",
    "load_gappy": """
        select g.series_id, g.ts, l.y from (
            select series_id, unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts
            from load_by_type group by series_id) g
        left join load_by_type l on l.series_id = g.series_id and l.ts = g.ts""",
    "load_dup": """
        select event_type as series_id, date_trunc('hour', ts) as ts, round(value * 100) as y,
               event_id as ingest_order from events""",
    "meter_readings": """
        select cast(user_id as varchar) as series_id, ts, round(value * 100) as y from events""",
    "orders_daily": """
        select 'orders' as series_id, o_orderdate as ts, sum(round(o_totalprice * 100)) as y
        from orders group by 2""",
}
NEEDS = {"load_gappy": ["load_by_type"]}


def with_views(names: str, body: str) -> str:
    """``with`` clause for the named views (and those they need), then ``body``.

    ``body`` either starts with further CTEs (``name as (...), ... select``) or is a plain select."""
    ordered: list[str] = []
    for name in names.split():
        for n in [*NEEDS.get(name, []), name]:
            if n not in ordered:
                ordered.append(n)
    ctes = ",\n".join(f"{n} as materialized ({VIEWS[n]})" for n in ordered)
    text = body.strip()
    glue = "\n" if text.lower().startswith("select") else ",\n"
    return f"with {ctes}{glue}{text}"
