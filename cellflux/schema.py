"""The canonical data set: elapsed seconds, signed milliamperes, volts."""

from __future__ import annotations

from types import MappingProxyType

from pyspark.sql import types as T

TIME, CURRENT, VOLTAGE = "time_s", "current_mA", "voltage_V"
CANONICAL_COLUMNS = (TIME, CURRENT, VOLTAGE)
CANONICAL_UNITS = MappingProxyType({TIME: "s", CURRENT: "mA", VOLTAGE: "V"})
CANONICAL_DTYPES = MappingProxyType({c: "float64" for c in CANONICAL_COLUMNS})
CANONICAL_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in CANONICAL_COLUMNS])
QUANTITY_OF = MappingProxyType({TIME: "time", CURRENT: "current", VOLTAGE: "voltage"})

#: Internal columns: which acquisition a row is of, and its place in it (rising, maybe with gaps).
SOURCE, ROW = "__source", "__row"
