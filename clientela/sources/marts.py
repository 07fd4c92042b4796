"""Reading stored marts: locale CSV files and Parquet views."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Marts that ad-hoc queries may name.
QUERY_MARTS = ("fato_rfm_clientes", "fato_pedidos", "dim_segmentos", "dim_calendario")


def read_locale_csv(
    spark: SparkSession, path: str, types: Mapping[str, str] | None = None
) -> DataFrame:
    """Read ``;``-separated text with decimal commas; ``types`` names the typed columns."""
    raw = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    columns = []
    for name in raw.columns:
        wanted = (types or {}).get(name, "string")
        value = F.col(f"`{name}`")
        if wanted in ("float", "double") or wanted.startswith("decimal"):
            value = F.replace(value, F.lit(","), F.lit("."))
        columns.append(value.try_cast(wanted).alias(name))
    return raw.select(columns)


def register_marts(
    spark: SparkSession, folder: str, names: Iterable[str] = QUERY_MARTS
) -> list[str]:
    """Make Parquet marts queryable by name; a mart that is missing is left out with a warning."""
    registered = []
    for name in names:
        try:
            spark.read.parquet(f"{folder.rstrip('/')}/{name}").createOrReplaceTempView(name)
            registered.append(name)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            warnings.warn(f"mart {name} not found in {folder}", stacklevel=2)
    return registered
