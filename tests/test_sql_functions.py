"""Reports as SQL functions: the same rows as the operators, planned without Python."""

import datetime as dt

from fleetframe.operators import customers, fleet, months, payments
from fleetframe.sources.sql_functions import create_functions

TODAY = dt.date(2024, 3, 10)


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_reports(spark, small):
    create_functions(small, "f_")
    day = "DATE '2024-03-10'"
    for text, expected in (
        (f"SELECT * FROM f_monthly_bookings({day}, 12)", months.monthly_bookings(small, TODAY)),
        (f"SELECT * FROM f_revenue_growth({day}, 1)", months.revenue_growth(small, TODAY, 1)),
        (f"SELECT * FROM f_monthly_revenue_report({day}, 12)", months.monthly_revenue_report(small, TODAY)),
        (f"SELECT * FROM f_today_stats({day})", payments.today_stats(small, TODAY)),
        ("SELECT * FROM f_today_stats(DATE '2000-01-01')", payments.today_stats(small, dt.date(2000, 1, 1))),
        ("SELECT * FROM f_top_customers(1)", customers.top_customers(small, 1)),
        ("SELECT * FROM f_class_utilization()", fleet.class_utilization(small)),
    ):
        got = spark.sql(text)
        assert [c.lower() for c in got.columns] == [c.lower() for c in expected.columns]
        assert rows(got) == rows(expected), text


def test_labels(spark, small):
    create_functions(small)
    row = spark.sql(
        """SELECT booking_status(DATE '2024-03-08', DATE '2024-03-10', DATE '2024-03-10'), booking_status(NULL, NULL, DATE '2024-03-10'),
           customer_tier(4), customer_tier(0), usage_status(0), usage_status(9), rupiah(1234567.5), rupiah(NULL),
           truncate_text('abcdef', 3), or_default(NULL, 'x'), rental_days(DATE '2024-03-01', DATE '2024-03-03'),
           inclusive_days(DATE '2024-03-01', DATE '2024-03-03'), month_label(2024, 2)"""
    ).first()
    assert tuple(row) == (
        "Active", "Unknown", "Regular Customer", "Prospect", "Never Rented", "High Usage", "Rp 1.234.568", "Rp 0",
        "abc...", "x", 2, 3, "February",
    )


def test_calls_are_planned_like_queries(spark, small):
    create_functions(small, "f_")
    plan = spark.sql("SELECT Customer_Name FROM f_top_customers(3)")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=3" in plan and "Python" not in plan
