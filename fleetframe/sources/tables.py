"""The eight rental tables: schemas, container and readers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from fleetframe.sources.batches import contents, current_rows, edited_part, read_marks

MONEY = T.DecimalType(12, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


TEXT, DATE, MOMENT = T.StringType(), T.DateType(), T.TimestampNTZType()

SCHEMAS: dict[str, T.StructType] = {
    # key: id_card
    "customer": _schema(id_card=TEXT, drivers_license=TEXT, name=TEXT, phone_number=TEXT, address=TEXT),
    # key: staff_id
    "staff": _schema(staff_id=TEXT, name=TEXT, position=TEXT, contact=TEXT),
    # key: cc_id
    "car_class": _schema(cc_id=TEXT, class_name=TEXT),
    # key: car_id
    "car": _schema(car_id=TEXT, car_name=TEXT, car_type=TEXT, car_price=MONEY, car_class_cc_id=TEXT),
    # key: booking_id
    "booking": _schema(
        booking_id=TEXT,
        date_preserved=DATE,
        start_date=DATE,
        end_date=DATE,
        customer_drivers_license=TEXT,
        customer_id_card=TEXT,
        staff_staff_id=TEXT,
    ),
    # key: transaction_id
    "transaction": _schema(
        transaction_id=TEXT,
        payment_method=TEXT,
        amount=MONEY,
        payment_date=MOMENT,
        staff_staff_id=TEXT,
        booking_booking_id=TEXT,
    ),
    # bridge between cars and payments
    "car_transaction": _schema(car_car_id=TEXT, transaction_transaction_id=TEXT),
    # append-only log
    "notification": _schema(
        user_id=TEXT, message=TEXT, type=TEXT, link=TEXT, is_read=T.IntegerType(), created_at=MOMENT
    ),
}


# Key columns of the tables whose rows can be replaced or deleted.
EDITABLE = {
    "customer": "id_card",
    "staff": "staff_id",
    "car": "car_id",
    "booking": "booking_id",
    "transaction": "transaction_id",
}


@dataclass(frozen=True)
class RentalTables:
    """One snapshot of the rental data, as lazily evaluated DataFrames."""

    customer: DataFrame
    staff: DataFrame
    car_class: DataFrame
    car: DataFrame
    booking: DataFrame
    transaction: DataFrame
    car_transaction: DataFrame
    notification: DataFrame

    def with_tables(self, **changed: DataFrame) -> RentalTables:
        """The same snapshot with some tables replaced."""
        return replace(self, **changed)

    @property
    def spark(self) -> SparkSession:
        return self.booking.sparkSession

    def narrowed(self, table: str, runs: list[str]) -> DataFrame:
        """Rows of a table among which are all that hold the given runs of characters, ignoring case.

        Without an index these are all rows.
        """
        return getattr(self, table)

    def create_views(self, prefix: str = "") -> None:
        """Register every table as a temporary view for ``spark.sql``."""
        for name in SCHEMAS:
            getattr(self, name).createOrReplaceTempView(prefix + name)


def _read_all(read: Callable[[str, T.StructType], DataFrame]) -> RentalTables:
    return RentalTables(**{name: read(name, schema) for name, schema in SCHEMAS.items()})


def read_parquet_tables(spark: SparkSession, folder: str, before: int | None = None) -> RentalTables:
    """Read ``folder/<table>`` for every table with the declared schema.

    Of a folder written in batches (``sources.batches``) only whole batches are read, and only those
    with numbers below ``before`` if that is given; the others' files are not opened. Of a key that was edited
    the newest state counts. A table no batch edited is read as it is, without a join; one no batch wrote is empty.
    """
    held = contents(spark, folder, before)
    if held is None:
        return _read_all(
            lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}").select(*schema.names)
        )

    def part(name: str, fields: list[T.StructField]) -> DataFrame:
        full = T.StructType([*fields, T.StructField("batch_id", T.LongType())])
        rows = read_marks(spark, f"{folder}/{name}", full)
        rows = spark.createDataFrame([], full) if rows is None else rows
        return rows.filter(F.col("batch_id").isin(held.batches))

    def read(name: str, schema: T.StructType) -> DataFrame:
        rows = part(name, schema.fields)
        if name in held.edited:
            key = EDITABLE[name]
            rows = current_rows(rows, part(edited_part(name), [schema[key]]), key)
        if name in held.read:
            # Entries of earlier batches were marked as read.
            unread = (F.col("is_read") == 0) & (F.col("batch_id") < held.read[name])
            rows = rows.withColumn("is_read", F.when(unread, F.lit(1)).otherwise(F.col("is_read")).cast("int"))
        return rows.select(*schema.names)

    return _read_all(read)


# The tables' names in the database, where upper and lower case may differ.
DATABASE_NAMES = {
    "customer": "Customer",
    "staff": "Staff",
    "car_class": "Car_Class",
    "car": "Car",
    "booking": "Booking",
    "transaction": "Transaction",
    "car_transaction": "Car_Transaction",
    "notification": "Notification",
}
SPLIT_OPTIONS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def jdbc_options(
    url: str,
    properties: dict[str, str],
    names: dict[str, str] | None = None,
    split_on: dict[str, dict[str, str]] | None = None,
    large: tuple[str, ...] = (),
) -> dict[str, dict[str, str]]:
    """The reader options of every table.

    ``names`` replaces names of ``DATABASE_NAMES``. A table of ``large`` must have all SPLIT_OPTIONS
    in ``split_on``, since without them a single task reads a table.
    """
    options = {}
    for table in SCHEMAS:
        split = (split_on or {}).get(table, {})
        if table in large and set(split) < set(SPLIT_OPTIONS):
            raise ValueError(f"large table {table} needs {', '.join(SPLIT_OPTIONS)}")
        options[table] = {**properties, "url": url, "dbtable": (names or {}).get(table, DATABASE_NAMES[table]), **split}
    return options


def read_jdbc_tables(spark: SparkSession, options: dict[str, dict[str, str]]) -> RentalTables:
    """Read the tables of a relational database with the options of ``jdbc_options``."""

    def read(name: str, schema: T.StructType) -> DataFrame:
        raw = spark.read.format("jdbc").options(**options[name]).load()
        return raw.select([raw[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])

    return _read_all(read)


def empty_tables(spark: SparkSession) -> RentalTables:
    return _read_all(lambda _, schema: spark.createDataFrame([], schema))
