import datetime as dt
import random
from decimal import Decimal as D

from values import day, money
from fleetframe import fixed
from fleetframe.operators import availability, booking_intake as intake_b, intake

NOW = dt.datetime(2024, 3, 10, 8, 30)
TODAY = NOW.date()
CUSTOMER_REQUEST = (
    "arrival long, full_name string, phone string, license_number string, address string, id_card string"
)
CAR_REQUEST = (
    "arrival long, brand string, model string, year string, car_class_id string, car_type string, daily_rate string"
)
BOOKING_REQUEST = (
    "arrival long, customer_search string, customer_selection string, customer_phone string, id_card string,"
    " license_number string, address string, car_id string, start_date string, end_date string"
)


def reasons(df):
    return {r.arrival: r.reject_reason for r in df.collect()}


def person(n, name="N", phone=None, licence=None, card=None):
    return (n, name, phone or f"{n:010d}", licence or f"L{n}", "Road", card or f"{n:016d}")


def test_customer_form_rules_in_order(spark):
    frame = spark.createDataFrame(
        [
            person(1),
            person(2, name="0", phone="1"),
            person(3, card="123", phone="1"),
            person(4, phone="123456789"),
            person(5, name=None),
            person(6, card="\t1234567890123456 "),
            person(7, card="123456789012345x"),
        ],
        CUSTOMER_REQUEST,
    )
    assert reasons(intake.validate_customers(frame)) == {
        1: None,
        2: "All fields are required",
        3: "ID Card must be exactly 16 digits",
        4: "Phone number must be at least 10 digits",
        5: "All fields are required",
        6: None,
        7: "ID Card must be exactly 16 digits",
    }


def test_duplicates_follow_the_order_of_arrival(spark, make_tables):
    master = make_tables(customer=[("9" * 16, "LM", "M", "0" * 10, "R")]).customer
    frame = spark.createDataFrame(
        [
            person(1, phone="1111111111", card="1" * 16),
            person(2, phone="1111111111", card="2" * 16),  # phone of 1
            person(3, phone="3333333333", card="2" * 16),  # 2 was turned away, so its card is free
            person(4, licence="LM", card="9" * 16),  # licence is checked before the card
            person(5, phone="0" * 10, licence="LM"),  # phone before licence
            person(6, card="2" * 16),
        ],
        CUSTOMER_REQUEST,
    )
    decided = intake.admit_customers(frame, master)
    assert reasons(decided) == {
        1: None,
        2: "Phone number already exists in our system",
        3: None,
        4: "Driver license number already exists in our system",
        5: "Phone number already exists in our system",
        6: "ID Card number already exists in our system",
    }
    assert intake.ingest_customers(frame, master).count() == 3


def test_random_signups_equal_one_by_one(spark, make_tables):
    rng = random.Random(11)
    pick = lambda n, width: f"{rng.randrange(n):0{width}d}"
    master = [(pick(80, 16), f"L{rng.randrange(80)}", "M", pick(80, 10), "R") for _ in range(20)]
    requests = [person(i, phone=pick(80, 10), licence=f"L{rng.randrange(80)}", card=pick(80, 16)) for i in range(250)]
    phones, licences, cards = ({m[i] for m in master} for i in (3, 1, 0))
    expected = {}
    for n, _, phone, licence, _, card in requests:
        expected[n] = (
            "Phone number already exists in our system"
            if phone in phones
            else "Driver license number already exists in our system"
            if licence in licences
            else "ID Card number already exists in our system"
            if card in cards
            else None
        )
        if expected[n] is None:
            phones.add(phone), licences.add(licence), cards.add(card)
    rng.shuffle(requests)
    got = intake.admit_customers(
        spark.createDataFrame(requests, CUSTOMER_REQUEST), make_tables(customer=master).customer
    )
    assert reasons(got) == expected


def test_car_rules_names_and_ids(spark, make_tables):
    tables = make_tables(
        car_class=[("C1", "City")], car=[("CAR00000041", "Old", "Manual", money("1.00"), "C1")]
    )
    ok = ("B", " M ", "2025", "C1", "CVT", "99.995")
    frame = spark.createDataFrame(
        [
            (7, *ok),
            (2, "B", "M", "1989", "C1", "CVT", "1"),
            (3, "B", "M", "2026", "C1", "CVT", "1"),
            (4, "B", "M", "2000", "C1", "CVT", "-1"),
            (5, "B", "M", "2000", "C9", "CVT", "1"),
            (6, "B", "M", "2000", "C1", "CVT", "0"),
            (8, "B", "M", "new", "C1", "CVT", "1"),
            (9, "B", "M", "1990", "C1", "CVT", "cheap"),
            (1, "B", "M", "1990", "C1", "CVT", "10"),
            (10, "B", "M", "1990", "C1", "CVT", "1e15"),
        ],
        CAR_REQUEST,
    )
    checked = intake.validate_cars(frame, tables.car_class, TODAY)
    year = "Invalid year. Must be between 1990 and 2025"
    assert reasons(checked) == {
        1: None,
        2: year,
        3: year,
        4: "Daily rate must be greater than 0",
        5: "Invalid car class selected",
        6: "All fields are required",
        7: None,
        8: year,
        9: "Daily rate must be greater than 0",
        10: "Daily rate is out of range",
    }
    added = intake.new_cars(checked, tables.car).collect()
    assert sorted((r.car_id, r.car_name, r.car_price) for r in added) == [
        ("CAR00000042", "B M 1990", D("10.00")),
        ("CAR00000043", "B M 2025", D("100.00")),
    ]
    assert intake.ingest_cars(frame, tables.car, tables.car_class, TODAY).count() == 3


def test_ids_grow_past_their_padding(spark):
    table = spark.createDataFrame([("X98",), (None,), ("odd",)], "id string")
    rows = spark.createDataFrame([(3,), (1,), (2,)], "arrival long")
    got = intake.assign_ids(rows, intake.IdSeries(table, "id", "X", 2)).collect()
    assert {r.arrival: r.id for r in got} == {1: "X99", 2: "X100", 3: "X101"}


def booking(n, car="K1", start="2024-04-10", end="2024-04-12", choose="1111", name="Guest", new=None):
    extra = new or (None, None, None, None)
    return (n, name, "new_customer" if new else choose, *extra, car, start, end)


def test_booking_date_rules(spark):
    frame = spark.createDataFrame(
        [
            booking(1),
            booking(2, name=" \t"),
            booking(3, end="2024-04-10"),
            booking(4, start="2024-03-09"),
            booking(5, start="2024-03-10"),
            booking(6, start="soon"),
            booking(7, end="later"),
            booking(8, start="soon", end="later"),
            booking(9, car="0"),
        ],
        BOOKING_REQUEST,
    )
    order, past = "End date must be after start date", "Start date cannot be in the past"
    assert reasons(intake_b.validate_bookings(frame, TODAY)) == {
        1: None,
        2: "All fields are required",
        3: order,
        4: past,
        5: None,
        6: past,
        7: order,
        8: order,
        9: "All fields are required",
    }


def test_prices_count_both_days(spark, small):
    checked = intake_b.validate_bookings(
        spark.createDataFrame([booking(1, "K2"), booking(2, "none")], BOOKING_REQUEST), TODAY
    )
    got = {r.arrival: (r.days, r.total_amount) for r in intake_b.price_bookings(checked, small.car).collect()}
    assert got == {1: (3, D("751.50")), 2: (3, D("0.00"))}


def test_customers_of_bookings(spark, small):
    new = ("0899", "5" * 16, "LN", "Road")
    frame = spark.createDataFrame(
        [
            booking(1, choose="2222"),
            booking(2, choose="5" * 16),  # not on file yet
            booking(3, name="Nina", new=new),
            booking(4, choose="5" * 16),  # added by 3
            booking(5, new=("0811", "6" * 16, "LN", "Road")),  # phone on file, before licence of 3
            booking(6, new=("0877", "5" * 16, "LN", "Road")),  # card before licence
            booking(7, new=("0866", "6" * 16, "LN", "Road")),
            booking(8, new=("0855", "66", "LX", "Road")),
            booking(9, new=("0844", "7" * 16, "LX", " ")),
            booking(10, choose=None),
        ],
        BOOKING_REQUEST,
    )
    resolved = intake_b.resolve_booking_customer(intake_b.validate_bookings(frame, TODAY), small.customer)
    got = {r.arrival: (r.reject_reason, r.customer_id_card, r.customer_drivers_license) for r in resolved.collect()}
    assert got == {
        1: (None, "2222", "L2"),
        2: ("Selected customer not found", None, None),
        3: (None, "5" * 16, "LN"),
        4: (None, "5" * 16, "LN"),
        5: ("Phone number already exists", None, None),
        6: ("ID Card already exists", None, None),
        7: ("Driver license already exists", None, None),
        8: ("ID Card must be exactly 16 digits", None, None),
        9: ("All customer fields are required for new customer", None, None),
        10: ("Selected customer not found", None, None),
    }


def test_staff_pick_is_stable_and_known(spark, small, make_tables):
    frame = spark.createDataFrame([(i, None) for i in range(200)], "arrival long, reject_reason string")
    first = {r.arrival: r.staff_id for r in intake_b.assign_staff(frame, small.staff, 3).collect()}
    again = {r.arrival: r.staff_id for r in intake_b.assign_staff(frame.repartition(3), small.staff, 3).collect()}
    assert first == again and set(first.values()) == {"S1", "S2"}
    nobody = intake_b.assign_staff(frame, make_tables().staff)
    assert set(reasons(nobody).values()) == {"No staff available to process booking"}


def test_conflicts_count_payments_per_car(spark, small):
    frame = spark.createDataFrame(
        [
            (1, "K1", day("2024-03-10"), day("2024-03-10")),  # B1 through T1 and T2
            (2, "K1", day("2024-03-10"), day("2024-03-11")),  # and B2 through T4
            (3, "K2", day("2024-03-11"), day("2024-03-20")),
            (4, "K3", day("2024-03-12"), day("2024-03-20")),  # touches the last day of B2
            (5, "K1", day("2024-02-02"), day("2024-02-03")),  # B3 has no payment
        ],
        "arrival long, car_id string, start date, end date",
    )
    got = availability.availability_conflicts(frame, small).collect()
    assert {r.arrival: r.conflict_count for r in got} == {1: 2, 2: 3, 3: 0, 4: 1, 5: 0}


def test_batch_blocks_itself(spark, small):
    dear = spark.createDataFrame([("K9", "Dear", "CVT", money("9999999999.00"), "C1")], small.car.schema)
    small = small.with_tables(car=small.car.unionByName(dear))
    frame = spark.createDataFrame(
        [
            booking(1, start="2024-05-10", end="2024-05-12"),
            booking(2, start="2024-05-11", end="2024-05-13"),
            booking(3, start="2024-05-13", end="2024-05-14"),
            booking(4, car="K2", start="2024-05-11", end="2024-05-13"),
            booking(5, car="K3", start="2024-03-12", end="2024-03-14"),  # booked by B2
            booking(6, car="K3", start="2024-03-12", end="2024-03-14", name="Nina", new=("0899", "5" * 16, "LN", "Road")),
            booking(7, car="K9", start="2025-05-11", end="9999-12-31"),
        ],
        BOOKING_REQUEST,
    )
    batch = intake_b.process_booking_requests(frame, small, NOW)
    assert reasons(batch.decisions) == {
        1: None,
        2: fixed.CAR_UNAVAILABLE,
        3: None,
        4: None,
        5: fixed.CAR_UNAVAILABLE,
        6: fixed.CAR_UNAVAILABLE,
        7: "Total amount is out of range",
    }
    # The customer of a booking that fails later is kept.
    assert [r.name for r in batch.customer.collect()] == ["Nina"]
    after = batch.applied_to(small)
    assert (after.customer.count(), after.booking.count(), after.transaction.count()) == (4, 7, 8)
    new = after.transaction.join(batch.booking, after.transaction.booking_booking_id == batch.booking.booking_id)
    got = {(r.amount, r.payment_method, r.payment_date, r.date_preserved) for r in new.collect()}
    assert got == {
        (D("300.00"), "Cash", NOW, TODAY),
        (D("200.00"), "Cash", NOW, TODAY),
        (D("751.50"), "Cash", NOW, TODAY),
    }
    # A second batch sees the bookings of the first.
    again = intake_b.process_booking_requests(frame.filter("arrival = 1"), after, NOW)
    assert reasons(again.decisions) == {1: fixed.CAR_UNAVAILABLE}


def test_empty_batch(spark, small):
    batch = intake_b.process_booking_requests(spark.createDataFrame([], BOOKING_REQUEST), small, NOW)
    assert batch.decisions.count() == batch.booking.count() == batch.customer.count() == 0
