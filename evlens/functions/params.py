"""Key/value extraction from ``event_params`` / ``user_properties`` arrays."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def param_value(key: str, array_col: str = "event_params") -> Column:
    """The ``value`` struct of the first entry whose key equals ``key`` (NULL if none).

    ``array_position`` over the key array finds the first match (0 when absent, so
    the 0-based lookup at -1 yields NULL); unlike a lambda ``filter`` this stays in
    generated code.
    """
    arr = F.col(array_col)
    idx = F.array_position(arr["key"], F.lit(key)) - 1
    return F.get(arr, idx.cast("int"))["value"]


def param_int(key: str, array_col: str = "event_params") -> Column:
    return param_value(key, array_col)["int_value"]


def param_string(key: str, array_col: str = "event_params") -> Column:
    return param_value(key, array_col)["string_value"]


def param_double(key: str, array_col: str = "event_params") -> Column:
    return param_value(key, array_col)["double_value"]


def param_as_string(key: str, array_col: str = "event_params") -> Column:
    """String value, else the int value as text; float / double values give NULL."""
    v = param_value(key, array_col)
    return F.coalesce(v["string_value"], v["int_value"].cast("string"))


def user_property(key: str) -> Column:
    return param_as_string(key, "user_properties")


def event_param(key: str) -> Column:
    return param_as_string(key, "event_params")
