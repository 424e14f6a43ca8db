"""Database reads and writes through Spark's JDBC source.

The driver jar of the database must be on the session's classpath.
"""

from pyspark.sql import DataFrame, types as T

# Spark type to SQL column type. Anything else is kept as TEXT.
SQL_TYPES = {
    "tinyint": "SMALLINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "float": "REAL",
    "double": "DOUBLE PRECISION",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "string": "TEXT",
}


def sql_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "INTERVAL"
    if isinstance(kind, T.DecimalType):
        return f"NUMERIC({kind.precision},{kind.scale})"
    return SQL_TYPES.get(kind.simpleString(), "TEXT")


# Types Spark's writer can create a column for; anything else goes out as text.
WRITABLE = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
    T.BooleanType, T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BinaryType,
)


def jdbc_column_types(schema: T.StructType) -> str:
    """The ``createTableColumnTypes`` of a table that can hold ``schema``: names in
    backticks with Spark's own types, as its writer parses them."""
    def kind(t):
        return t.simpleString().upper() if isinstance(t, WRITABLE) else "STRING"

    return ", ".join(f"`{f.name.replace('`', '``')}` {kind(f.dataType)}" for f in schema)


def create_table_sql(schema: T.StructType, table: str) -> str:
    """The statement a database takes for a table that can hold ``schema``."""
    columns = ", ".join(f'"{f.name}" {sql_type(f.dataType)}' for f in schema)
    return f"CREATE TABLE IF NOT EXISTS {table} ({columns})"


def jdbc_options(url: str, user=None, password=None, driver=None, **more) -> dict:
    given = {"url": url, "user": user, "password": password, "driver": driver, **more}
    return {k: str(v) for k, v in given.items() if v is not None}


def write_jdbc(df: DataFrame, url: str, table: str, batch_size=10_000, connections=16,
               column_types=None, **options) -> None:
    """Append a frame, creating the table when absent.

    ``connections`` bounds the number of tasks that write at once: the database, not
    the cluster, is the limit.
    """
    more = {"dbtable": table, "batchsize": batch_size, "numPartitions": connections,
            "createTableColumnTypes": column_types}
    df.write.format("jdbc").options(**jdbc_options(url, **more, **options)).mode("append").save()


def read_jdbc(spark, url: str, query: str, fetch_size=10_000, **options) -> DataFrame:
    """The result of a query that the database runs."""
    given = jdbc_options(url, query=query, fetchsize=fetch_size, **options)
    return spark.read.format("jdbc").options(**given).load()


def read_jdbc_table(spark, url: str, table: str, column: str, lower, upper, partitions: int,
                    fetch_size=10_000, **options) -> DataFrame:
    """A whole table, read over several connections by ranges of ``column``. The
    bounds only place the cuts; rows outside them are read too."""
    given = jdbc_options(
        url, dbtable=table, fetchsize=fetch_size, partitionColumn=column,
        lowerBound=lower, upperBound=upper, numPartitions=partitions, **options,
    )
    return spark.read.format("jdbc").options(**given).load()
