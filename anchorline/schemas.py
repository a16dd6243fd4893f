"""Schemas of the long tables."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DataType, DateType, DoubleType, IntegerType, LongType, StringType, StructType, TimestampType

_TYPES: dict[str, DataType] = {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "date": DateType(), "timestamp": TimestampType(), "boolean": BooleanType()}


def struct(columns: str) -> StructType:
    """A schema from ``name type, ...``; unlike DDL it needs no session."""
    out = StructType()
    for name, kind in (x.split() for x in columns.split(", ")):
        out = out.add(name, _TYPES[kind])
    return out


PANEL = struct("vintage string, model_id string, date date, series string, value double")
WEIGHTS = struct("year int, series string, w double")
PATHS = struct("model_id string, vintage string, run_id string, forecast_name string, draw int, date date, series string, value double, is_future boolean")
PAIRING = struct("stage string, pair_id long, model string, draw int")
TAX_PATH = struct("model_id string, date date, vat double, excise double, scenario_vat double, scenario_excise double, scenario_active boolean")
RUNS = struct("model_id string, vintage string, run_id string, created timestamp, promoted int, path string")
# The columns of the table that readers ask for results.
DISPLAY = struct(
    "display_schema_version string, record_type string, scope string, model_id string, vintage string, run_id string, forecast_name string, basis string, metric string, "
    "series string, label string, unit string, date timestamp, segment string, is_future boolean, value double, q05 double, q16 double, q50 double, q84 double, q95 double, "
    "key string, text_value string, extra_value double"
)
