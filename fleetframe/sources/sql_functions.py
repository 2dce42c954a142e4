"""Reports and labels as SQL functions next to the temporary views of the tables.

``create_functions`` registers temporary SQL functions with parameters. The optimizer puts their bodies in the
place of the call, so ``SELECT * FROM top_customers(10) WHERE ...`` is planned like any other query: arguments fold to
literals, filters and columns are pushed down, a bound on a rank becomes a top-k, and no Python is run.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from fleetframe import fixed
from fleetframe.sources.tables import RentalTables


def _ratio(total: str, count: str, digits: int) -> str:
    """Rounded half away from zero; NULL when the count is 0."""
    return f"round(try_divide(CAST({total} AS DECIMAL(28,2)), CAST({count} AS DECIMAL(15,0))), {digits})"


def _share(part: str, whole: str) -> str:
    return f"round(try_divide(CAST(({part}) * 100 AS DECIMAL(28,2)), CAST({whole} AS DECIMAL(28,2))), 2)"


def _cases(rows: list[tuple[int, str]], sign: str, last: str) -> str:
    whens = " ".join(f"WHEN n {sign} {bound} THEN '{label}'" for bound, label in rows)
    return f"CASE {whens} ELSE '{last}' END"


# Scalar functions: parameters, type of the result, body.
SCALARS: dict[str, tuple[str, str, str]] = {
    "booking_status": (
        "first DATE, last DATE, as_of DATE",
        "STRING",
        f"""CASE WHEN first <= as_of AND last >= as_of THEN '{fixed.ACTIVE}' WHEN first > as_of THEN '{fixed.UPCOMING}'
            WHEN last < as_of THEN '{fixed.COMPLETED}' ELSE '{fixed.UNKNOWN}' END""",
    ),
    "customer_tier": ("n BIGINT", "STRING", _cases(fixed.CUSTOMER_TIERS, ">=", fixed.NO_BOOKINGS_TIER)),
    "usage_status": ("n BIGINT", "STRING", _cases(fixed.USAGE_LEVELS, "<", fixed.TOP_USAGE_LEVEL)),
    "rupiah": (
        "amount DECIMAL(28,2)",
        "STRING",
        "concat('Rp ', translate(format_number(round(coalesce(amount, 0), 0), 0), ',', '.'))",
    ),
    "truncate_text": (
        "value STRING, most INT",
        "STRING",
        "CASE WHEN char_length(value) > most THEN concat(substring(value, 1, most), '...') ELSE value END",
    ),
    "or_default": ("value STRING, otherwise STRING", "STRING", "coalesce(value, otherwise)"),
    "rental_days": ("first DATE, last DATE", "INT", "datediff(last, first)"),
    "inclusive_days": ("first DATE, last DATE", "INT", "datediff(last, first) + 1"),
    "month_label": ("year INT, month INT", "STRING", "date_format(make_date(year, month, 1), 'MMMM')"),
}


def _table_functions(prefix: str) -> dict[str, tuple[str, str, str]]:
    """Table functions: parameters, columns, query."""
    t = {name: f"`{prefix}{name}`" for name in ("customer", "booking", "transaction", "car_transaction", "car", "car_class")}
    paid = f"""SELECT booking_booking_id AS paid_booking_id, count(*) AS payments, count(amount) AS amounts, sum(amount) AS paid
               FROM {t['transaction']} WHERE booking_booking_id IS NOT NULL GROUP BY booking_booking_id"""
    # Payments are reduced to one row per booking before the join.
    per_customer = f"""
        SELECT b.customer_id_card, sum(p.payments) AS booking_rows, sum(p.paid) AS spent, sum(p.amounts) AS amounts,
               max(b.date_preserved) AS last_date, sum(datediff(b.end_date, b.start_date) * p.payments) AS days,
               sum(CASE WHEN datediff(b.end_date, b.start_date) IS NOT NULL THEN p.payments END) AS dated
        FROM {t['booking']} b JOIN ({paid}) p ON b.booking_id = p.paid_booking_id
        WHERE b.customer_id_card IS NOT NULL GROUP BY b.customer_id_card"""
    month = "year INT, month INT, month_name STRING"
    per_month = "CAST(year(payment_date) AS INT) AS year, CAST(month(payment_date) AS INT) AS month"
    recent = "payment_date >= add_months(as_of, -months)"
    return {
        "monthly_bookings": (
            "as_of DATE, months INT",
            f"{month}, booking_count BIGINT",
            f"""SELECT year, month, date_format(make_date(year, month, 1), 'MMMM'), booking_count FROM (
                SELECT year(date_preserved) AS year, month(date_preserved) AS month, count(*) AS booking_count
                FROM {t['booking']} WHERE date_preserved >= add_months(as_of, -months) GROUP BY 1, 2)""",
        ),
        "revenue_growth": (
            "as_of DATE, months INT",
            f"{month}, monthly_revenue DECIMAL(22,2), transaction_count BIGINT",
            f"""SELECT year, month, date_format(make_date(year, month, 1), 'MMMM'), monthly_revenue, transaction_count FROM (
                SELECT {per_month}, sum(amount) AS monthly_revenue, count(*) AS transaction_count
                FROM {t['transaction']} WHERE {recent} GROUP BY 1, 2)""",
        ),
        "monthly_revenue_report": (
            "as_of DATE, months INT",
            "Year INT, Month INT, Month_Name STRING, Total_Transactions BIGINT, Monthly_Revenue DECIMAL(22,2),"
            " Average_Transaction DECIMAL(32,2)",
            f"""SELECT year, month, date_format(make_date(year, month, 1), 'MMMM'), total, revenue, {_ratio('revenue', 'amounts', 2)}
                FROM (SELECT {per_month}, count(transaction_id) AS total, sum(amount) AS revenue, count(amount) AS amounts
                      FROM {t['transaction']} WHERE {recent} GROUP BY 1, 2)""",
        ),
        "today_stats": (
            "as_of DATE",
            "Today_Transactions BIGINT, Today_Revenue DECIMAL(24,2), Today_Average DECIMAL(32,6)",
            f"""SELECT count(*), coalesce(sum(amount), 0), coalesce({_ratio('sum(amount)', 'count(amount)', 6)}, 0)
                FROM {t['transaction']} WHERE to_date(payment_date) = as_of""",
        ),
        "top_customers": (
            "k INT",
            "Customer_Name STRING, Phone_Number STRING, Total_Bookings BIGINT, Total_Spent DECIMAL(28,2),"
            " Average_Booking_Value DECIMAL(32,2), Last_Booking_Date DATE, Avg_Rental_Days DECIMAL(32,1)",
            f"""SELECT name, phone_number, booking_rows, spent, {_ratio('spent', 'amounts', 2)}, last_date, {_ratio('days', 'dated', 1)}
                FROM (SELECT c.name, c.phone_number, s.*, row_number() OVER (ORDER BY s.spent DESC, c.id_card) AS place
                      FROM ({per_customer}) s JOIN {t['customer']} c ON s.customer_id_card = c.id_card)
                WHERE place <= k""",
        ),
        "class_utilization": (
            "",
            "Class_Name STRING, rental_count BIGINT, utilization_percentage DECIMAL(32,2)",
            f"""SELECT cc.class_name, coalesce(r.rentals, 0), {_share('coalesce(r.rentals, 0)', f"(SELECT count(*) FROM {t['car_transaction']})")}
                FROM {t['car_class']} cc LEFT JOIN (
                    SELECT c.car_class_cc_id, sum(n.rentals) AS rentals FROM {t['car']} c
                    JOIN (SELECT car_car_id, count(*) AS rentals FROM {t['car_transaction']} GROUP BY car_car_id) n
                      ON c.car_id = n.car_car_id GROUP BY c.car_class_cc_id) r ON cc.cc_id = r.car_class_cc_id""",
        ),
    }


def create_functions(tables: RentalTables, prefix: str = "") -> list[str]:
    """Register the views of the tables and all functions, each name behind ``prefix``; returns their names."""
    tables.create_views(prefix)
    spark: SparkSession = tables.spark
    made = []
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
        made.append(f"{prefix}{name}")
    for name, (parameters, columns, query) in _table_functions(prefix).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
        made.append(f"{prefix}{name}")
    return made
