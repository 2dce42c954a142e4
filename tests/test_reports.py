import datetime as dt
from decimal import Decimal as D

from values import day, money
from fleetframe.operators import bookings, customers, dashboard, fleet, months, payments

TODAY = dt.date(2024, 3, 10)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_months_have_no_upper_bound_and_no_gap_rows(small):
    assert rows(months.monthly_bookings(small, dt.date(2024, 2, 1), 1)) == [
        (2024, 1, "January", 1),
        (2024, 2, "February", 1),
        (2024, 3, "March", 2),
    ]
    assert rows(months.monthly_revenue_report(small, TODAY)) == [
        (2024, 2, "February", 1, D("10.00"), D("10.00")),
        (2024, 3, "March", 4, D("320.25"), D("80.06")),
    ]
    assert [r.label for r in months.monthly_revenue_chart(small, TODAY).collect()] == [
        "February 2024",
        "March 2024",
    ]
    assert [r.label for r in months.revenue_growth_chart(small, TODAY).collect()] == ["Feb", "Mar"]


def test_seasonal_patterns_count_every_payment(small):
    # B1 and B2 have two payments each; all four fall on March.
    assert rows(months.seasonal_patterns(small, TODAY)) == [
        (2024, 3, "March", 4, D("320.25"), D("80.06"), 1, D("1.5"), D("100.00"))
    ]


def test_customers_are_weighted_by_payments(small):
    assert rows(customers.top_customers(small)) == [
        ("Ana", "0811", 4, D("320.25"), D("80.06"), day("2024-03-02"), D("1.5"))
    ]
    assert rows(customers.customer_history(small)) == [
        ("Ana", "0811", 4, D("320.25"), day("2024-03-02"), 1.5, "Regular Customer"),
        ("Budi", "0822", 1, None, day("2024-02-01"), 3.0, "New Customer"),
    ]


def test_cars_and_classes(small):
    share = D("100") / 5
    assert rows(fleet.vehicle_utilization(small)) == [
        ("K1", "Swift", "City", D("100.00"), 3, D("270.00"), D("90.00"), D("60.00")),
        ("K2", "Jazz", "City", D("250.50"), 1, D("100.00"), D("100.00"), share),
        ("K3", "Hiace", "Van", D("400.00"), 1, D("50.25"), D("50.25"), share),
    ]
    # K1 counts three times in the mean rate of its class.
    assert rows(fleet.popular_classes(small)) == [
        ("City", 2, 4, D("370.00"), D("137.63"), D("80.00")),
        ("Van", 1, 1, D("50.25"), D("400.00"), D("20.00")),
        ("Unused", 0, 0, None, None, D("0.00")),
    ]
    assert rows(fleet.class_utilization(small)) == [
        ("City", 4, D("80.00")),
        ("Van", 1, D("20.00")),
        ("Unused", 0, D("0.00")),
    ]
    assert rows(fleet.cars_by_class(small)) == [
        ("City", 2, D("175"), D("100.00"), D("250.50")),
        ("Van", 1, D("400"), D("400.00"), D("400.00")),
        ("Unused", 0, None, None, None),
    ]
    assert [r.Car_ID for r in fleet.fleet_list(small).collect()] == ["K1", "K2", "K3"]
    assert rows(fleet.fleet_stats(small)) == [(4, 2, D("190"), 2)]
    assert rows(fleet.rental_stats(small)) == [(3, 5, D("420.25"))]
    assert [r.Usage_Status for r in fleet.car_usage(small).collect()] == [
        "Medium Usage",
        "Low Usage",
        "Low Usage",
    ]


def test_never_rented_cars_and_empty_totals(make_tables):
    tables = make_tables(car_class=[("C1", "City")], car=[("K1", "Swift", "Manual", money("5.00"), "C1")])
    assert rows(fleet.vehicle_utilization(tables)) == [
        ("K1", "Swift", "City", D("5.00"), 0, None, None, None)
    ]
    assert rows(fleet.car_usage(tables)) == [("K1", "Swift", "City", D("5.00"), 0, D(0), "Never Rented")]
    assert rows(fleet.class_utilization(tables)) == [("City", 0, None)]
    assert rows(fleet.rental_stats(tables)) == [(0, 0, D(0))]
    assert rows(payments.today_stats(tables, TODAY)) == [(0, D(0), D(0))]
    assert rows(payments.summary_stats(tables, TODAY)) == [(0, 1, 0, None, 0, None)]
    assert rows(payments.payment_method_analysis(tables)) == []


def test_payment_shares_are_of_all_payments(small):
    assert rows(payments.payment_method_analysis(small)) == [
        ("Cash", 3, D("270.00"), D("90.00"), D("70.00"), D("100.00"), D("60.00"), D("81.76"), 1),
        ("Card", 1, D("50.25"), D("50.25"), D("50.25"), D("50.25"), D("20.00"), D("15.22"), 1),
    ]
    assert rows(payments.today_stats(small, TODAY)) == [(2, D("200.00"), D("100.000000"))]
    assert rows(payments.summary_stats(small, TODAY)) == [(3, 4, 4, D("330.25"), 2, D("200.00"))]


def test_recent_transactions_use_the_staff_of_the_payment(small):
    got = rows(payments.recent_transactions(small, k=4))
    assert [(r[0], r[6], r[7]) for r in got] == [
        ("T2", "Ana", "Sari"),
        ("T1", "Ana", "Sari"),
        ("T4", "Ana", "Tono"),
        ("T3", "Ana", "Tono"),
    ]
    shown = payments.transaction_cards(small, k=5).collect()[-1]
    assert (shown.Customer, shown.Staff, shown.Amount, shown.Paid_At) == (
        "N/A",
        "S9",
        "Rp 10",
        "2024-02-01 10:00",
    )


def test_detail_rows_split_by_amount_and_method(small):
    got = bookings.booking_list(small, TODAY).collect()
    # B1: two equal payments collapse. B2: two different ones stay apart.
    assert [(r.Booking_ID, r.Total_Amount, r.Cars_Rented, r.Booking_Status) for r in got] == [
        ("B2", D("50.25"), "Hiace", "Upcoming"),
        ("B2", D("70.00"), "Swift", "Upcoming"),
        ("B1", D("100.00"), "Jazz, Swift", "Active"),
        ("B3", None, None, "Completed"),
        ("B4", None, None, "Unknown"),
    ]
    assert len(bookings.booking_list(small, TODAY, k=1).collect()) == 1
    shown = bookings.booking_cards(small, TODAY).collect()
    assert [r.Customer for r in shown] == ["Ana", "Ana", "Ana", "Budi", "Unknown"]
    assert [r.Cars for r in shown][3:] == ["No cars", "No cars"]


def test_today_lists_every_car_occurrence(small):
    got = bookings.today_bookings(small, TODAY).collect()
    assert [(r.Booking_ID, r.Rented_Cars) for r in got] == [
        ("B1", "Jazz (CVT), Swift (Manual), Swift (Manual)")
    ]


def test_hot_booking_is_split_in_the_payment_join(spark, make_tables, monkeypatch):
    """With a third of the payments on one booking, their join is split. Cars of a payment are counted
    per label before they meet it, so that join has one row per payment and label."""
    from fleetframe.plans import lookups

    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    n = 30_000
    tables = make_tables(
        customer=[("1", None, "Hot", None, None)],
        car=[("K", "Swift", "Manual", money("1.00"), None)],
        booking=[(f"B{i}", TODAY, TODAY, TODAY, None, "1", None) for i in range(2000)],
    )
    numbers = spark.range(n)
    payment = numbers.selectExpr(
        "concat('T', id) transaction_id", "'Cash' payment_method", "cast(1 as decimal(12,2)) amount",
        "cast(null as timestamp_ntz) payment_date", "cast(null as string) staff_staff_id",
        "concat('B', if(id % 3 = 0, 0, id % 2000)) booking_booking_id",
    )
    bridge = numbers.selectExpr("'K' car_car_id", "concat('T', id) transaction_transaction_id")
    # A payment with very many cars of different names.
    cars = spark.range(20_000).selectExpr(
        "concat('C', id) car_id", "concat('Car ', id) car_name", "'Manual' car_type",
        "cast(1 as decimal(12,2)) car_price", "cast(null as string) car_class_cc_id",
    )
    bridge = bridge.union(cars.selectExpr("car_id", "'T5'"))
    tables = tables.with_tables(transaction=payment, car_transaction=bridge, car=tables.car.union(cars))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = bookings.today_bookings(tables, TODAY)
        rows = got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 2000
    split = [line for line in plan.split("Initial Plan")[0].splitlines() if "skew=true" in line]
    assert any("booking_booking_id" in line for line in split)
    counted = plan.split("Initial Plan")[0]
    assert "partial_count(1)" in counted and "rental_payment" in counted


def test_a_bridge_row_without_payment_counts_for_its_class(make_tables):
    tables = make_tables(
        car_class=[("C", "City")],
        car=[("K", "Swift", "Manual", money("10.00"), "C"), ("L", "Jazz", "Manual", money("40.00"), "C")],
        transaction=[("T1", "Cash", money("5.00"), None, None, None)],
        car_transaction=[("K", "T1"), ("K", None), ("K", None)],
    )
    got = fleet.popular_classes(tables).first()
    assert tuple(got) == ("City", 2, 3, D("5.00"), D("17.50"), D("100.00"))
    assert fleet.class_utilization(tables).first().rental_count == 3


def test_booking_stats(small):
    assert rows(bookings.booking_stats(small, TODAY)) == [(1, 1, 1, 1, D("2.0"))]


def test_dashboard(small):
    assert rows(dashboard.dashboard_stats(small, TODAY)) == [
        (D("200.00"), 2, 2, 4, 2, 3, D("50.00"))
    ]
    assert [r.Booking_ID for r in dashboard.recent_bookings_dashboard(small, TODAY, 2).collect()] == ["B2", "B2"]
    assert [(r.activity_type, r.activity_time) for r in dashboard.activity_cards(small, 3).collect()] == [
        ("payment_received", "Mar 10, 10:00"),
        ("payment_received", "Mar 10, 09:00"),
        ("payment_received", "Mar 03, 10:00"),
    ]


def test_top_rows_break_ties_by_key(make_tables):
    tables = make_tables(
        customer=[(str(i), None, f"N{i}", None, None) for i in range(5)],
        booking=[(f"B{i}", TODAY, TODAY, TODAY, None, str(i), None) for i in range(5)],
        transaction=[(f"T{i}", "Cash", money("1.00"), dt.datetime(2024, 1, 1), None, f"B{i}") for i in range(5)],
    )
    assert [r.Customer_Name for r in customers.top_customers(tables, 3).collect()] == ["N0", "N1", "N2"]


def test_one_booking_with_a_third_of_all_payments(make_tables):
    """A hot booking, customer and car give the same sums as separate ones."""
    hot = 300
    tables = make_tables(
        customer=[("1", None, "Hot", None, None), ("2", None, "Cold", None, None)],
        car_class=[("C", "City")],
        car=[("K", "Swift", "Manual", money("1.00"), "C")],
        booking=[("B0", TODAY, TODAY, day("2024-03-12"), None, "1", None)]
        + [(f"B{i}", TODAY, TODAY, TODAY, None, "2", None) for i in range(1, 601)],
        transaction=[
            (f"T{i}", "Cash", money("2.00"), dt.datetime(2024, 3, 1), None, "B0" if i < hot else f"B{i - hot + 1}")
            for i in range(900)
        ],
        car_transaction=[("K", f"T{i}") for i in range(900)],
    )
    got = {r.Customer_Name: (r.Total_Bookings, r.Total_Spent) for r in customers.top_customers(tables).collect()}
    assert got == {"Hot": (300, D("600.00")), "Cold": (600, D("1200.00"))}
    assert rows(fleet.rental_stats(tables)) == [(1, 900, D("1800.00"))]
    listed = [r for r in bookings.today_bookings(tables, TODAY).collect() if r.Booking_ID == "B0"]
    assert len(listed) == 1 and listed[0].Rented_Cars.count("Swift (Manual)") == 300
