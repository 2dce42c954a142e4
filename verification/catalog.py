"""Named queries over the bundled tables, one or more per operator."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from fleetframe.functions import (
    booking_status,
    inclusive_days,
    or_default,
    rupiah,
    truncate_text,
    usage_status,
)
from fleetframe.operators import (
    availability,
    booking_intake,
    bookings,
    changes,
    customers,
    dashboard,
    distinct_counts,
    fleet,
    intake,
    maintained,
    months,
    notifications,
    payments,
    search,
    top_by_bounds,
)
from fleetframe.plans import lookups
from fleetframe.session import ensure_checkpoint_dir, scratch_folder, scratch_tables
from fleetframe.sources import batches, dump, fixtures, sinks, sql_functions, trigrams
from fleetframe.sources.fixtures import AS_OF, load_tables
from fleetframe.sources.tables import DATABASE_NAMES, MONEY, RentalTables, read_parquet_tables
from fleetframe.streaming import availability as availability_stream
from fleetframe.streaming import micro_batch

Query = Callable[[SparkSession, str], DataFrame]

NOW = dt.datetime.combine(AS_OF, dt.time(9, 30))


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, which is how the checking engine returns them."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def report_runs() -> dict[str, Callable[[RentalTables], DataFrame]]:
    """Queries over the rental tables."""
    return {
        # reports per month
        "monthly_bookings": lambda t: months.monthly_bookings(t, AS_OF),
        "revenue_growth": lambda t: months.revenue_growth(t, AS_OF),
        "monthly_revenue_report": lambda t: months.monthly_revenue_report(t, AS_OF),
        "monthly_revenue_recent": lambda t: months.monthly_revenue_recent(t, AS_OF),
        "seasonal_patterns": lambda t: months.seasonal_patterns(t, AS_OF),
        "monthly_bookings_chart": lambda t: months.monthly_bookings_chart(t, AS_OF),
        "revenue_growth_chart": lambda t: months.revenue_growth_chart(t, AS_OF),
        "monthly_revenue_chart": lambda t: months.monthly_revenue_chart(t, AS_OF),
        # customers and staff
        "top_customers": customers.top_customers,
        "top_customers_by_bounds": _top_by_bounds,
        "customer_history": customers.customer_history,
        "customer_tiers": customers.customer_tiers,
        "staff_list": customers.staff_list,
        "customer_page": lambda t: customers.customer_page(t, page=7),
        "customer_page_past_end": lambda t: customers.customer_page(t, page=10**6),
        "customer_page_meta": lambda t: customers.customer_page_meta(t, page=7),
        "customer_page_past_end_meta": lambda t: customers.customer_page_meta(t, page=10**6),
        "customer_cards": lambda t: customers.customer_cards(t, page=2, limit=9),
        # cars and classes
        "class_utilization": fleet.class_utilization,
        "vehicle_utilization": fleet.vehicle_utilization,
        "popular_classes": fleet.popular_classes,
        "fleet_list": fleet.fleet_list,
        "cars_by_class": fleet.cars_by_class,
        "car_usage": fleet.car_usage,
        "car_usage_all": lambda t: fleet.car_usage(t, k=None),
        "fleet_stats": fleet.fleet_stats,
        "rental_stats": fleet.rental_stats,
        # payments
        "summary_stats": lambda t: payments.summary_stats(t, AS_OF),
        "recent_transactions": payments.recent_transactions,
        "transaction_cards": payments.transaction_cards,
        "payment_method_analysis": payments.payment_method_analysis,
        "payment_method_analysis_collated": lambda t: payments.payment_method_analysis(
            t.with_tables(transaction=_in_lower_case(t.transaction, "payment_method", "transaction_id")), COLLATION
        ),
        "today_stats": lambda t: payments.today_stats(t, AS_OF),
        # bookings
        "today_bookings": lambda t: bookings.today_bookings(t, AS_OF),
        "booking_list": lambda t: bookings.booking_list(t, AS_OF),
        "booking_cards": lambda t: bookings.booking_cards(t, AS_OF),
        "booking_stats": lambda t: bookings.booking_stats(t, AS_OF),
        # search
        "search_bookings": lambda t: bookings.search_bookings(t, "hot bolt", AS_OF),
        "search_bookings_people": lambda t: bookings.search_bookings(
            t, "#00000001", AS_OF, page=3, per_page=40
        ),
        "search_bookings_wildcard": lambda t: bookings.search_bookings(t, "bk%7_3", AS_OF),
        "search_bookings_everything": lambda t: bookings.search_bookings(t, "", AS_OF, page=2),
        "search_bookings_deep_page": lambda t: bookings.search_bookings(t, "0", AS_OF, page=130),
        "search_bookings_common_term": lambda t: bookings.search_bookings(t, "e", AS_OF),
        "search_bookings_common_term_meta": lambda t: bookings.search_bookings_meta(t, "e"),
        "search_bookings_json": lambda t: bookings.search_bookings_answer(t, "bk%7_3", AS_OF, per_page=40),
        "search_bookings_json_past_end": lambda t: bookings.search_bookings_answer(t, "hot bolt", AS_OF, page=900),
        "search_bookings_meta": lambda t: bookings.search_bookings_meta(t, "hot bolt"),
        "search_bookings_people_meta": lambda t: bookings.search_bookings_meta(
            t, "#00000001", page=3, per_page=40
        ),
        "search_customers": lambda t: search.search_customers(t, "machinery", page=2, per_page=50),
        "search_customers_deep_page": lambda t: search.search_customers(t, "0", page=1200, per_page=9),
        "search_customers_wildcard": lambda t: search.search_customers(t, "fur%e 1_"),
        "search_customers_meta": lambda t: search.search_customers_meta(t, "machinery", page=2, per_page=50),
        "search_customers_json": _customer_answer,
        "staff_search": lambda t: search.staff_search(t, "desk 1"),
        "customer_quick_search": lambda t: search.customer_quick_search(t, "ERY 2"),
        "customer_picker": lambda t: search.customer_picker(t, "#00000003"),
        # dashboard and notifications
        "dashboard_stats": lambda t: dashboard.dashboard_stats(t, AS_OF),
        "recent_bookings_dashboard": lambda t: dashboard.recent_bookings_dashboard(t, AS_OF),
        "activity_timeline": dashboard.activity_timeline,
        "activity_cards": dashboard.activity_cards,
        "notification_feed": notifications.notification_feed,
        "notification_cards": notifications.notification_cards,
        "mark_read": lambda t: notifications.mark_read(t.notification),
        # scalar functions over whole tables
        "booking_labels": _booking_labels,
        "car_labels": _car_labels,
    }


def _customer_answer(tables: RentalTables) -> DataFrame:
    return sinks.json_answer(
        search.search_customers(tables, "machinery", page=2, per_page=50),
        search.search_customers_meta(tables, "machinery", page=2, per_page=50),
        [F.asc("Name"), F.asc("ID_Card")],
        50,
    )


def _retried_batch(requests: DataFrame, tables: RentalTables) -> DataFrame:
    """Payments and bridge rows of each new booking after a batch that broke off and ran again."""
    spark = tables.spark
    folder = _work_folder(spark, "retried")
    micro_batch.write_base(tables, folder)
    highest = batches.highest_numbers(spark, folder, 0)
    broken = booking_intake.process_booking_requests(
        requests, read_parquet_tables(spark, folder), NOW, highest=highest
    )
    for name in ("customer", "car_transaction", "transaction"):
        batches.write_part(getattr(broken, name), folder, name, 0)
    micro_batch.book_batch(requests, 0, folder, NOW)
    after = read_parquet_tables(spark, folder)
    of_today = lookups.measured(after.booking.filter(F.col("date_preserved") == F.lit(NOW.date())), keep=True)
    older = lookups.matching_rows(tables.booking.select("booking_id"), "booking_id", of_today, "booking_id")
    new = lookups.measured(of_today.frame.select("booking_id").join(older, "booking_id", "left_anti"), keep=True)
    paid = lookups.measured(lookups.matching_rows(after.transaction, "booking_booking_id", new, "booking_id"), keep=True)
    rented = lookups.matching_rows(after.car_transaction, "transaction_transaction_id", paid, "transaction_id")
    return (
        new.frame.join(paid.frame, F.col("booking_id") == F.col("booking_booking_id"), "left")
        .join(rented, F.col("transaction_id") == F.col("transaction_transaction_id"), "left")
        .groupBy("booking_id")
        .agg(
            F.countDistinct("transaction_id").alias("payments"),
            F.count("car_car_id").alias("bridge_rows"),
            F.sum("amount").alias("amount"),
        )
    )


def _work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that a query writes and reads again."""
    return scratch_folder(spark, name)


# Upper and lower case are one letter, as in the database's own comparisons.
COLLATION = "UTF8_LCASE"


def _in_lower_case(rows: DataFrame, column: str, key: str) -> DataFrame:
    """About half of the values in lower case."""
    return rows.withColumn(column, F.when(F.crc32(F.col(key).cast("string")) % 2 == 0, F.lower(column)).otherwise(F.col(column)))


def _admitted_collated(requests: DataFrame, tables: RentalTables) -> DataFrame:
    asked = requests.withColumn("license_number", F.when(F.col("arrival") % 2 == 0, F.lower("license_number")).otherwise(F.col("license_number")))
    return intake.admit_customers(asked, tables.customer, COLLATION)


def _kept_folder(spark: SparkSession, name: str) -> str:
    """A folder that several queries read, so that no block of scratch tables may delete it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _halves(requests: DataFrame) -> list[DataFrame]:
    """All requests in two batches."""
    return [requests.filter(F.pmod("arrival", F.lit(2)) == n) for n in (0, 1)]


def _edited_after_bookings(spark: SparkSession, source: str) -> DataFrame:
    """Customers read back after a batch of bookings that adds some, and two batches of edits."""
    tables = load_tables(spark, source)
    folder = _work_folder(spark, "edited")
    micro_batch.write_base(tables, folder)
    micro_batch.book_batch(fixtures.booking_requests(spark, source), 0, folder, NOW)
    for n, edits in enumerate(_halves(fixtures.customer_changes(spark, source)), 1):
        micro_batch.edit_batch("customer", edits, n, folder, NOW)
    return read_parquet_tables(spark, folder).customer


def _staff_edited_twice(requests: DataFrame, tables: RentalTables) -> DataFrame:
    """Staff read back from a compacted folder after two batches of edits."""
    spark = tables.spark
    folder, into = _work_folder(spark, "staff"), _work_folder(spark, "staff-compact")
    micro_batch.write_base(tables, folder)
    for n, edits in enumerate(_halves(requests)):
        micro_batch.edit_batch("staff", edits, n, folder, NOW)
    micro_batch.compact(spark, folder, into)
    return read_parquet_tables(spark, into).staff


def _admitted_by_stream(requests: DataFrame, tables: RentalTables) -> DataFrame:
    """Requests decided by a stream that is stopped and started again after each third of the arrivals."""
    spark = tables.spark
    asked = _dated(requests).select("arrival", "car_id", "start", "end", "reject_reason")
    folder = _work_folder(spark, "admission")
    last = asked.agg(F.max("arrival")).first()[0] or 0
    taken = availability_stream.taken_ranges(tables, AS_OF)
    for third in range(3):
        inside = (F.col("arrival") > last * third // 3) & (F.col("arrival") <= last * (third + 1) // 3)
        now = asked.filter(inside if third else F.col("arrival") <= last // 3)
        now.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(asked.schema).parquet(f"{folder}/in")
        run = availability_stream.start_admission(stream, taken, f"{folder}/out", f"{folder}/progress", until_caught_up=True)
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@lru_cache(maxsize=2)
def _indexed_folder(spark: SparkSession, source: str) -> str:
    """The rental tables in two batches, both indexed."""
    tables = load_tables(spark, source)
    folder = _kept_folder(spark, "indexed")
    later = F.pmod(F.crc32("id_card"), F.lit(4)) == 0
    micro_batch.write_base(tables.with_tables(customer=tables.customer.filter(~later)), folder)
    trigrams.update_index(spark, folder)
    batches.write_batch(spark, folder, 0, {"customer": tables.customer.filter(later)}, {})
    trigrams.update_index(spark, folder)
    return folder


@lru_cache(maxsize=2)
def _maintained_folder(spark: SparkSession, source: str) -> str:
    """The rental tables in a base and three batches, then a batch of edits that mends what the base had wrong.

    The base has wrong amounts for some payments and customers that do not exist; bookings, payments and cars
    of a rental may come in different batches. Reports are brought up to date after every batch.
    """
    folder = _kept_folder(spark, "maintained")
    with scratch_tables(spark):
        _write_maintained(load_tables(spark, source), folder)
    return folder


def _by_batch(rows: DataFrame) -> DataFrame:
    """Rows written once, so that each batch reads its own (column ``n``)."""
    path = scratch_folder(rows.sparkSession, "dealt")
    rows.write.partitionBy("n").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _write_maintained(tables: RentalTables, folder: str) -> None:
    spark = tables.spark

    def dealt(key: str) -> Column:
        return F.pmod(F.crc32(key), F.lit(4)).cast("int") - 1

    booking = tables.booking.withColumn("n", dealt("booking_id"))
    late = F.greatest(F.coalesce(dealt("booking_booking_id"), F.lit(-1)), dealt("transaction_id"))
    payment = _by_batch(tables.transaction.withColumn("n", late))
    bridge = _by_batch(
        tables.car_transaction.join(
            payment.select(F.col("transaction_id").alias("transaction_transaction_id"), "n"), "transaction_transaction_id"
        ).withColumn("n", F.greatest("n", dealt("car_car_id")))
    )
    wrong = F.col("transaction_id").endswith("1")
    made_up = tables.customer.withColumn("id_card", F.concat(F.lit("made up "), "id_card"))

    def part(rows: DataFrame, n: int, columns: list[str]) -> DataFrame:
        return rows.filter(F.col("n") == n).select(*columns)

    for n in range(-1, 3):
        parts = {
            "booking": part(booking, n, tables.booking.columns),
            "transaction": part(payment, n, tables.transaction.columns),
            "car_transaction": part(bridge, n, tables.car_transaction.columns),
        }
        if n < 0:
            spoilt = F.when(wrong, F.col("amount") + 7).otherwise(F.col("amount")).cast(MONEY)
            parts["transaction"] = parts["transaction"].withColumn("amount", spoilt)
            parts |= {"customer": tables.customer.union(made_up), "car": tables.car, "staff": tables.staff}
            parts |= {"car_class": tables.car_class, "notification": tables.notification}
        batches.write_batch(spark, folder, n, parts, {})
        maintained.update_reports(spark, folder)
        distinct_counts.update_counts(spark, folder)
    base = read_parquet_tables(spark, folder).transaction.filter(wrong)
    right = part(payment.filter(wrong), -1, tables.transaction.columns)
    ended = {"transaction": base.join(right.select("transaction_id"), "transaction_id", "left_semi"), "customer": made_up}
    batches.write_batch(spark, folder, 3, {"transaction": right}, {}, ended)
    maintained.update_reports(spark, folder)
    distinct_counts.update_counts(spark, folder)


def maintained_runs() -> dict[str, Callable[[maintained.MaintainedReports], DataFrame]]:
    """Reports from sums that were kept up to date."""
    return {
        "monthly_bookings_maintained": lambda r: r.monthly_bookings(AS_OF),
        "revenue_growth_maintained": lambda r: r.revenue_growth(AS_OF),
        "monthly_revenue_report_maintained": lambda r: r.monthly_revenue_report(AS_OF),
        "monthly_revenue_recent_maintained": lambda r: r.monthly_revenue_recent(AS_OF),
        "today_stats_maintained": lambda r: r.today_stats(AS_OF),
        "dashboard_stats_maintained": lambda r: r.dashboard_stats(AS_OF),
    }


def distinct_runs() -> dict[str, Callable[[distinct_counts.DistinctCounts], DataFrame]]:
    """Distinct counts from bitmaps of several batches."""
    return {
        "customers_by_method_merged": lambda c: c.customers_by_method(),
        "customers_by_month_merged": lambda c: c.customers_by_month(AS_OF),
        "customers_merged": lambda c: c.customers(),
        "cars_ever_rented_merged": lambda c: c.cars_ever_rented(),
    }


def _maintained_query(run: Callable[[maintained.MaintainedReports], DataFrame]) -> Query:
    return lambda spark, source: comparable(run(maintained.MaintainedReports(spark, _maintained_folder(spark, source))))


def _distinct_query(run: Callable[[distinct_counts.DistinctCounts], DataFrame]) -> Query:
    return lambda spark, source: comparable(run(distinct_counts.DistinctCounts(spark, _maintained_folder(spark, source))))


def indexed_runs() -> dict[str, Callable[[RentalTables], DataFrame]]:
    """Searches that look in posting lists before they look at rows."""
    return {
        "search_bookings_indexed": lambda t: bookings.search_bookings(t, "hot bolt", AS_OF),
        "search_bookings_people_indexed": lambda t: bookings.search_bookings(t, "#00000001", AS_OF, page=3, per_page=40),
        "search_bookings_meta_indexed": lambda t: bookings.search_bookings_meta(t, "hot bolt"),
        "search_customers_indexed": lambda t: search.search_customers(t, "machinery", page=2, per_page=50),
        "search_customers_wildcard_indexed": lambda t: search.search_customers(t, "fur%e 1_"),
        "staff_search_indexed": lambda t: search.staff_search(t, "desk 1"),
        "customer_quick_search_indexed": lambda t: search.customer_quick_search(t, "ERY 2"),
        "customer_picker_indexed": lambda t: search.customer_picker(t, "#00000003"),
    }


def _indexed_query(run: Callable[[RentalTables], DataFrame]) -> Query:
    return lambda spark, source: comparable(run(trigrams.read_indexed_tables(spark, _indexed_folder(spark, source))))


def sql_texts() -> dict[str, str]:
    """Queries in SQL over the functions of ``sql_functions``; ``fleet_`` stands before their names."""
    day = f"DATE '{AS_OF}'"
    return {
        "top_customers_sql": "SELECT * FROM fleet_top_customers(10)",
        "monthly_bookings_sql": f"SELECT * FROM fleet_monthly_bookings({day}, 12)",
        "revenue_growth_sql": f"SELECT * FROM fleet_revenue_growth({day}, 12)",
        "monthly_revenue_report_sql": f"SELECT * FROM fleet_monthly_revenue_report({day}, 12)",
        "today_stats_sql": f"SELECT * FROM fleet_today_stats({day})",
        "class_utilization_sql": "SELECT * FROM fleet_class_utilization()",
        "booking_labels_sql": f"""SELECT booking_id, fleet_booking_status(start_date, end_date, {day}) AS status,
            fleet_inclusive_days(start_date, end_date) AS charged_days, fleet_or_default(customer_id_card, 'Unknown') AS customer
            FROM fleet_booking""",
        "car_labels_sql": """SELECT car_id, fleet_rupiah(car_price * 1234) AS price, fleet_truncate_text(car_name, 8) AS short_name,
            fleet_usage_status(char_length(car_name)) AS label FROM fleet_car""",
    }


def _sql_query(text: str) -> Query:
    def query(spark: SparkSession, source: str) -> DataFrame:
        sql_functions.create_functions(load_tables(spark, source), "fleet_")
        return comparable(spark.sql(text))

    return query


def _top_by_bounds(tables: RentalTables) -> DataFrame:
    """The best customers from lists of three batches; payments may come after their booking."""
    spark = tables.spark
    folder = _work_folder(spark, "ranked")
    booking = F.pmod(F.crc32("booking_id"), F.lit(3))
    payment = F.greatest(F.coalesce(F.pmod(F.crc32("booking_booking_id"), F.lit(3)), F.lit(0)), F.pmod(F.crc32("transaction_id"), F.lit(3)))
    for n in range(3):
        parts = {"booking": tables.booking.filter(booking == n), "transaction": tables.transaction.filter(payment == n)}
        batches.write_batch(spark, folder, n, parts, {})
    top_by_bounds.update_ranking(spark, folder, slice_rows=200)
    return top_by_bounds.top_customers(tables, folder).rows


def _dumped(name: str, split_bytes: int) -> Query:
    """A table written as statements of a dump and read back in byte ranges."""

    def query(spark: SparkSession, source: str) -> DataFrame:
        rows = getattr(load_tables(spark, source), name)
        folder = _work_folder(spark, f"dump-{name}")
        dump.write_dump(rows, folder, DATABASE_NAMES[name])
        return comparable(dump.read_dump(spark, folder, DATABASE_NAMES[name], rows.schema, split_bytes))

    return query


def _booking_labels(tables: RentalTables) -> DataFrame:
    start, end = F.col("start_date"), F.col("end_date")
    return tables.booking.select(
        "booking_id",
        booking_status(start, end, AS_OF).alias("status"),
        inclusive_days(start, end).alias("charged_days"),
        or_default(F.col("customer_id_card"), "Unknown").alias("customer"),
    )


def _car_labels(tables: RentalTables) -> DataFrame:
    return tables.car.select(
        "car_id",
        rupiah(F.col("car_price") * 1234).alias("price"),
        truncate_text(F.col("car_name"), 8).alias("short_name"),
        usage_status(F.char_length("car_name")).alias("label"),
    )


def _batch(requests: DataFrame, tables: RentalTables) -> booking_intake.BookingBatch:
    return booking_intake.process_booking_requests(requests, tables, NOW)


def _resolved(requests: DataFrame, tables: RentalTables) -> DataFrame:
    return booking_intake.resolve_booking_customer(
        booking_intake.validate_bookings(requests, AS_OF), tables.customer
    )


def _dated(requests: DataFrame) -> DataFrame:
    return booking_intake.validate_bookings(requests, AS_OF)


def intake_runs() -> dict[str, tuple[Query, Callable[[DataFrame, RentalTables], DataFrame]]]:
    """Queries over a batch of requests and the rental tables: (reader, query)."""
    queries: dict[str, tuple[Query, Callable[[DataFrame, RentalTables], DataFrame]]] = {}

    def on(read: Query, **runs: Callable[[DataFrame, RentalTables], DataFrame]) -> None:
        queries.update({name: (read, run) for name, run in runs.items()})

    on(
        fixtures.customer_requests,
        validate_customers=lambda r, t: intake.validate_customers(r),
        dedupe_against_master=lambda r, t: intake.admit_customers(r, t.customer),
        dedupe_against_master_collated=_admitted_collated,
        ingest_customers=lambda r, t: intake.ingest_customers(r, t.customer),
    )
    on(
        fixtures.car_requests,
        validate_cars=lambda r, t: intake.validate_cars(r, t.car_class, AS_OF),
        ingest_cars=lambda r, t: intake.ingest_cars(r, t.car, t.car_class, AS_OF),
    )
    on(
        fixtures.booking_requests,
        validate_bookings=lambda r, t: _dated(r).select("arrival", "start", "end", "reject_reason"),
        price_bookings=lambda r, t: booking_intake.price_bookings(_dated(r), t.car).select(
            "arrival", "days", "total_amount"
        ),
        resolve_booking_customer=lambda r, t: _resolved(r, t).select(
            "arrival", "reject_reason", "customer_id_card", "customer_drivers_license", "is_new_customer"
        ),
        customers_from_bookings=lambda r, t: booking_intake.customers_from_bookings(_resolved(r, t)),
        assign_staff=lambda r, t: booking_intake.assign_staff(_dated(r), t.staff, seed=7).select(
            "arrival", "staff_id"
        ),
        availability_conflicts=lambda r, t: availability.availability_conflicts(_dated(r), t).select(
            "arrival", "car_id", "conflict_count"
        ),
        admit_bookings=lambda r, t: availability.admit_bookings(
            _dated(r).select("arrival", "car_id", "start", "end", "reject_reason"), t
        ),
        admit_bookings_stream=_admitted_by_stream,
        booking_batch_retried=_retried_batch,
        process_booking_requests=lambda r, t: _batch(r, t).decisions,
        post_bookings=lambda r, t: _batch(r, t).booking,
        post_transactions=lambda r, t: _batch(r, t).transaction,
        post_car_transactions=lambda r, t: _batch(r, t).car_transaction,
        assign_ids=lambda r, t: intake.assign_ids(
            r.select("arrival"), intake.IdSeries(t.booking, "booking_id", "BK", 10)
        ),
    )
    on(
        fixtures.customer_changes,
        apply_customer_changes=lambda r, t: changes.apply_customer_changes(t.customer, r),
        customer_change_notifications=lambda r, t: notifications.customer_change_notifications(r, NOW),
    )
    on(
        fixtures.staff_changes,
        apply_staff_changes=lambda r, t: changes.apply_staff_changes(t.staff, r),
        staff_change_notifications=lambda r, t: notifications.staff_change_notifications(r, NOW),
        staff_edits_read_back=_staff_edited_twice,
    )
    on(
        fixtures.edit_failures,
        failure_notifications=lambda r, t: notifications.failure_notifications(r, NOW),
    )
    return queries


def stored_runs() -> dict[str, Query]:
    """Queries that write tables to the shared folder and read them back."""
    return {
        "edit_batches_read_back": _edited_after_bookings,
        "dump_bookings_read_back": _dumped("booking", 1 << 18),
        "dump_payments_read_back": _dumped("transaction", 1 << 20),
    }


def _report_query(run: Callable[[RentalTables], DataFrame]) -> Query:
    return lambda spark, folder: comparable(run(load_tables(spark, folder)))


def _intake_query(read: Query, run: Callable[[DataFrame, RentalTables], DataFrame]) -> Query:
    return lambda spark, folder: comparable(run(read(spark, folder), load_tables(spark, folder)))


def all_queries() -> dict[str, Query]:
    """Every query by name, as a function of (session, folder of the bundled files)."""
    reports = {name: _report_query(run) for name, run in report_runs().items()}
    intake = {name: _intake_query(*parts) for name, parts in intake_runs().items()}
    indexed = {name: _indexed_query(run) for name, run in indexed_runs().items()}
    kept = {name: _maintained_query(run) for name, run in maintained_runs().items()}
    merged = {name: _distinct_query(run) for name, run in distinct_runs().items()}
    written = {name: _sql_query(text) for name, text in sql_texts().items()}
    return {**reports, **intake, **stored_runs(), **indexed, **kept, **merged, **written}
