"""Energy and metered time-series analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames keyed by ``series_id`` and ordered
by ``ts``; nothing is evaluated until the caller runs an action, except for the
size checks described in ``wattline.operators.ordering``.
"""
