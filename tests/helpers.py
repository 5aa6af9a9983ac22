import datetime as dt

from souk.sources.schema import SCHEMAS, TABLES
from souk.sources.tables import Market

T0 = dt.datetime(2024, 1, 1)


def bundle(spark, **rows):
    """A Market from dicts of column values; unspecified columns are null."""
    frames = {}
    for t in TABLES:
        cols = SCHEMAS[t].fieldNames()
        data = [tuple(r.get(c) for c in cols) for r in rows.get(t, [])]
        frames[t] = spark.createDataFrame(data, SCHEMAS[t])
    return Market(spark, lambda name: frames[name])


def ts(minutes):
    return T0 + dt.timedelta(minutes=minutes)
