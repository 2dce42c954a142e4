"""What a batch of booking requests writes on its way."""

import datetime as dt

from fleetframe import fixed
from fleetframe.operators import availability, booking_intake, intake
from fleetframe.plans import first_come, lookups

NOW = dt.datetime(2024, 3, 10, 8, 30)
REQUEST = (
    "arrival long, customer_search string, customer_selection string, customer_phone string, id_card string,"
    " license_number string, address string, car_id string, start_date string, end_date string"
)


def guest(n, phone="08", car="K2"):
    return (n, f"Guest {n}", fixed.NEW_CUSTOMER, f"{phone}{n}", f"{n:016d}", f"G{n}", "Road", car, f"2024-05-{n:02d}", f"2024-05-{n + 1:02d}")


def known(n, card, car="K1", *filled):
    return (n, f"Known {n}", card, *(filled or (None,) * 4), car, f"2024-06-{n:02d}", f"2024-06-{n + 1:02d}")


REQUESTS = [
    known(1, "1111"),
    known(2, f"{4:016d}"),  # not on file yet
    known(3, "2222", "K1", "0811", "1" * 16, "L1", "Road"),  # fields of a new customer do not count
    guest(4),
    known(5, f"{4:016d}"),  # added by 4
    known(6, "4444"),
    guest(8, "08"),
    (9, "Guest 9", fixed.NEW_CUSTOMER, "088", f"{9:016d}", "G9", "Road", "K3", "2024-05-09", "2024-05-10"),  # phone of 8
    known(11, "3333", "K3"),
    (12, "0", "1111", None, None, None, None, "K1", "2024-05-09", "2024-05-10"),
]
REASONS = {
    1: None,
    2: fixed.CUSTOMER_UNKNOWN,
    3: None,
    4: None,
    5: None,
    6: fixed.CUSTOMER_UNKNOWN,
    8: None,
    9: fixed.GUEST_PHONE_TAKEN,
    11: None,
    12: fixed.FIELDS_REQUIRED,
}


def reasons(frame):
    return {r.arrival: r.reject_reason for r in frame.collect()}


def check(batch):
    assert reasons(batch.decisions) == REASONS
    assert sorted((r.name, r.phone_number, r.address) for r in batch.customer.collect()) == [
        ("Guest 4", "084", "Road"),
        ("Guest 8", "088", "Road"),
    ]
    got = {r.start_date: (r.customer_id_card, r.customer_drivers_license) for r in batch.booking.collect()}
    assert got == {
        dt.date(2024, 6, 1): ("1111", "L1"),
        dt.date(2024, 6, 3): ("2222", "L2"),
        dt.date(2024, 5, 4): (f"{4:016d}", "G4"),
        dt.date(2024, 6, 5): (f"{4:016d}", "G4"),
        dt.date(2024, 5, 8): (f"{8:016d}", "G8"),
        dt.date(2024, 6, 11): ("3333", "L3"),
    }
    assert batch.transaction.count() == batch.car_transaction.count() == 6


def test_whole_requests_are_written_twice(spark, small, monkeypatch):
    written = []

    def noted(keep):
        def run(frame):
            written.append((set(frame.columns), frame.count()))
            return keep(frame)

        return run

    for module in (availability, first_come, intake, lookups):
        monkeypatch.setattr(module, "stored", noted(module.stored))
    frame = spark.createDataFrame(REQUESTS, REQUEST)
    check(booking_intake.process_booking_requests(frame, small, NOW))
    whole = [(columns, rows) for columns, rows in written if "car_id" in columns and "customer_phone" in columns]
    assert [rows for _, rows in whole] == [len(REQUESTS)] * 2
    assert not any("start_date" in columns for columns, _ in whole)
    # Arrivals and values of the few new customers.
    assert [rows for columns, rows in written if columns == {"arrival", "customer_phone", "id_card", "license_number"}] == [3]


def test_batch_beyond_all_bounds(spark, small, monkeypatch):
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(first_come, "GROUP_ROWS", 2)
    check(booking_intake.process_booking_requests(spark.createDataFrame(REQUESTS, REQUEST), small, NOW))


def test_repeated_arrivals_that_are_not_open_meet_nothing(spark, small):
    frame = spark.createDataFrame([*REQUESTS, known(4, "3333"), known(1, "2222")], REQUEST)
    resolved = booking_intake.resolve_booking_customer(
        booking_intake.validate_bookings(frame, NOW.date()), small.customer
    )
    got = sorted((r.arrival, r.reject_reason or "", r.customer_id_card or "") for r in resolved.collect())
    cards = {1: "1111", 3: "2222", 4: f"{4:016d}", 5: f"{4:016d}", 8: f"{8:016d}", 11: "3333"}
    expected = [(n, reason or "", cards.get(n, "")) for n, reason in REASONS.items()]
    assert got == sorted([*expected, (4, "", "3333"), (1, "", "2222")])
