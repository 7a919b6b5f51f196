"""Schemas of the data model, catalog objects, and sessions tested with captured errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared columns of the tables.
SCHEMAS = {
    "raw_gps": "point_id BIGINT, subid SMALLINT, lat DOUBLE, lon DOUBLE, time TIMESTAMP_NTZ, app_source STRING",
    "processed_gps": "processed_id BIGINT, subid SMALLINT, raw_point_id BIGINT, lat DOUBLE, lon DOUBLE, time TIMESTAMP_NTZ, time_local TIMESTAMP_NTZ, movement_state STRING, is_stationary BOOLEAN, cluster_id INT, speed_mph DOUBLE, dist_miles DOUBLE, dwell_time_seconds INT",
    "osm_poi": "osm_id BIGINT, osm_type STRING, class STRING, type STRING, name STRING, housenumber STRING, street STRING, city STRING, postcode STRING, lon DOUBLE, lat DOUBLE, geom STRING",
    "osm_landuse": "osm_id BIGINT, osm_type STRING, class STRING, type STRING, name STRING, city STRING, area_sqkm DOUBLE, geom STRING",
}


def checks(table: str) -> dict[str, Column]:
    """Constraints of a table as rules for :func:`pathloom.operators.relational.violations`."""
    rules = {"raw_gps": {"subid not null": F.col("subid").isNotNull(), "time not null": F.col("time").isNotNull(), "lat in range": F.col("lat").between(-90, 90), "lon in range": F.col("lon").between(-180, 180)}}
    rules["processed_gps"] = rules["raw_gps"] | {"movement state": F.col("movement_state").isin("stationary", "transition")}
    rules["osm_poi"] = {"class not null": F.col("class").isNotNull(), "type not null": F.col("type").isNotNull()}
    return rules[table]


def create_table(spark: SparkSession, schema: str, table: str, columns: str, location: str) -> None:
    """CREATE SCHEMA and TABLE of Parquet files at a shared location, if they aren't there."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{schema}`.`{table}` ({columns}) USING parquet LOCATION '{location}'")


def columns_of(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, data_type) of a table."""
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema, 1)], "ordinal int, column_name string, data_type string")


def tables_of(spark: SparkSession, schema: str) -> DataFrame:
    """(table_name, n_columns, is_temporary) of a schema."""
    rows = [(t.name, len(spark.catalog.listColumns(t.name if t.isTemporary else f"{schema}.{t.name}")), t.isTemporary) for t in spark.catalog.listTables(schema)]
    return spark.createDataFrame(rows, "table_name string, n_columns int, is_temporary boolean")


def analyze(spark: SparkSession, table: str, columns: list[str] = []) -> None:  # noqa: B006
    """Statistics for the optimizer, as ANALYZE gathers them."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else ""))


def safely(f, *args, **kwargs) -> tuple[object | None, str | None]:
    """(result, None), or (None, message) where ``f`` raises."""
    try:
        return f(*args, **kwargs), None
    except Exception as e:  # noqa: BLE001
        return None, str(e).splitlines()[0]


def session_test(spark: SparkSession) -> tuple[bool, str]:
    """Whether a session answers, with its version or what went wrong."""
    got, wrong = safely(lambda: spark.sql("SELECT version()").first()[0])
    return (wrong is None, got.split()[0] if wrong is None else wrong)
