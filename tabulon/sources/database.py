"""Relational tables over JDBC: connection settings, parallel reads, writes, table lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

CATALOG_CLASS = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"
BATCH_ROWS = 1000  # fixed value: rows per INSERT batch
WRITE_MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


@dataclass(frozen=True)
class Database:
    """Connection settings; host, database and user are mandatory."""

    host: str
    database: str
    user: str
    password: str = field(default="", repr=False)
    port: int = 5432
    url: str | None = None
    driver: str = "org.postgresql.Driver"

    def __post_init__(self) -> None:
        if not (self.host and self.database and self.user):
            raise ValueError("host, database and user must be set")

    def options(self) -> dict[str, str]:
        """Options for Spark's JDBC source and catalog (credentials are passed apart from the URL)."""
        url = self.url or f"jdbc:postgresql://{self.host}:{int(self.port)}/{self.database}"
        return {"url": url, "user": self.user, "password": self.password, "driver": self.driver}


def quoted(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def reader(
    spark: SparkSession,
    database: Database,
    table: str,
    max_rows: int | None = None,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 8,
    fetch_rows: int = 10_000,
) -> DataFrameReader:
    """A configured JDBC reader. A positive ``max_rows`` becomes a LIMIT inside the database;
    ``None``, zero and negative values read the whole table, in ``partitions`` ranges of
    ``partition_column`` when one is given."""
    source = spark.read.format("jdbc").options(**database.options()).option("fetchsize", fetch_rows)
    if max_rows and max_rows > 0:
        return source.option("query", f"SELECT * FROM {quoted(table)} LIMIT {int(max_rows)}")
    source = source.option("dbtable", quoted(table))
    if partition_column:
        if not bounds:
            raise ValueError("a parallel read needs the bounds of its partition column")
        source = source.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)
        )
    return source


def read_table(spark: SparkSession, database: Database, table: str, **options) -> DataFrame:
    return reader(spark, database, table, **options).load()


def write_table(df: DataFrame, database: Database, table: str, if_exists: str = "fail") -> None:
    """``fail``, ``replace`` or ``append``; every partition writes over its own connection."""
    if if_exists not in WRITE_MODES:
        raise ValueError(f"if_exists must be one of {sorted(WRITE_MODES)}")
    options = {**database.options(), "dbtable": quoted(table), "batchsize": str(BATCH_ROWS)}
    df.write.format("jdbc").options(**options).mode(WRITE_MODES[if_exists]).save()


def register_catalog(spark: SparkSession, name: str, database: Database) -> None:
    """Make the database a Spark catalog, so its tables can be listed and queried by name."""
    spark.conf.set(f"spark.sql.catalog.{name}", CATALOG_CLASS)
    for key, value in database.options().items():
        spark.conf.set(f"spark.sql.catalog.{name}.{key}", value)


def list_tables(spark: SparkSession, namespace: str | None = None) -> DataFrame:
    """``(table)`` sorted by name: of a catalog namespace (``catalog.schema``) or of the session."""
    listed = spark.sql(f"SHOW TABLES IN {namespace}" if namespace else "SHOW TABLES")
    return listed.selectExpr("tableName AS `table`").orderBy("table")


def check_connection(spark: SparkSession, namespace: str | None = None) -> int:
    """The number of tables that can be seen."""
    return list_tables(spark, namespace).count()
