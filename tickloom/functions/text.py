"""Small text and level rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Logger level -> stored level.
STORED_LEVELS = {
    "trace": "DEBUG",
    "debug": "DEBUG",
    "info": "INFO",
    "warning": "INFO",
    "error": "ERROR",
    "fatal": "PANIC",
    "panic": "PANIC",
}
# Logger levels kept under each threshold; any other threshold keeps errors only.
KEPT_LEVELS = {
    "none": (),
    "debug": ("panic", "fatal", "error", "warning", "info", "debug", "trace"),
    "info": ("panic", "fatal", "error", "warning", "info"),
}
KEPT_BY_DEFAULT = ("panic", "fatal", "error")


def stored_level(level: Column) -> Column:
    result = F.lit("UNKNOWN")
    for name, stored in STORED_LEVELS.items():
        result = F.when(level == name, stored).otherwise(result)
    return result


def level_kept(level: Column, threshold: str) -> Column:
    kept = KEPT_LEVELS.get(threshold, KEPT_BY_DEFAULT)
    return level.isin(*kept) if kept else F.lit(False)


def ident(id_: Column, name: Column) -> Column:
    """'id' or 'id|name' when there is a name."""
    return F.when(F.coalesce(name, F.lit("")) == "", id_.cast("string")).otherwise(
        F.concat_ws("|", id_.cast("string"), name)
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The same frame, or an error if it is empty. Looks at one row only."""
    if df.isEmpty():
        raise ValueError(message)
    return df
