"""Unique values and matches under a collation: the forms ask the database, which tells 'dl1' and 'DL1' not apart."""

import pytest

from fleetframe import fixed
from fleetframe.operators import booking_intake, intake, payments
from test_intake import BOOKING_REQUEST, TODAY
from values import money

REQUEST = "arrival bigint, full_name string, phone string, license_number string, address string, id_card string"


def sign_ups(spark, *licences):
    rows = [(n, f"P{n}", f"08{n:010}", licence, "x", f"{n:016}") for n, licence in enumerate(licences, 100)]
    return spark.createDataFrame(rows, REQUEST)


@pytest.mark.parametrize(
    "collation, taken", [(None, []), ("UTF8_LCASE", [0, 2, 5]), ("UNICODE_CI_AI", [0, 2, 4, 5])]
)
def test_new_values(spark, small, collation, taken):
    """'l1' is on file as 'L1'; of 'N1' and 'n1', and of 'É1', 'e1' and 'é1', the first wins."""
    asked = sign_ups(spark, "l1", "N1", "n1", "É1", "e1", "é1")
    got = {r.arrival - 100: r.reject_reason for r in intake.admit_customers(asked, small.customer, collation).collect()}
    assert sorted(n for n, reason in got.items() if reason == fixed.LICENCE_TAKEN) == taken
    assert all(reason is None for n, reason in got.items() if n not in taken)


def test_a_rejected_value_stays_free(spark, small):
    rows = [(1, "A", "0811", "L9", "x", "1" * 16), (2, "B", "0800000000", "l9", "x", "2" * 16), (3, "C", "0800000001", "L9", "x", "3" * 16)]
    got = intake.admit_customers(spark.createDataFrame(rows, REQUEST), small.customer, "UTF8_LCASE").collect()
    assert {r.arrival: r.reject_reason for r in got} == {1: fixed.PHONE_FORMAT, 2: None, 3: fixed.LICENCE_TAKEN}


def test_customers_on_file(spark, make_tables):
    tables = make_tables(customer=[("Ab1", "L1", "Ana", "0811", "x"), ("22", "L2", "Bo", "0822", "x")])
    rows = [(n, "Guest", choice, *[None] * 4, "K1", "2024-04-10", "2024-04-12") for n, choice in enumerate(["aB1", "22", "AB2"])]
    asked = booking_intake.validate_bookings(spark.createDataFrame(rows, BOOKING_REQUEST), TODAY)
    for collation, expected in ((None, [None, "22", None]), ("UTF8_LCASE", ["Ab1", "22", None])):
        got = booking_intake.resolve_booking_customer(asked, tables.customer, collation)
        assert [r.customer_id_card for r in got.orderBy("arrival").collect()] == expected
        assert got.schema["customer_id_card"].dataType.simpleString() == "string"


def test_methods_are_merged(spark, small, make_tables):
    more = make_tables(transaction=[("T9", "cash", money("1.00"), None, "S1", "B3")]).transaction
    tables = small.with_tables(transaction=small.transaction.union(more))
    plain = {r.Payment_Method: r.Transaction_Count for r in payments.payment_method_analysis(tables).collect()}
    merged = {r.Payment_Method: r.Transaction_Count for r in payments.payment_method_analysis(tables, "UTF8_LCASE").collect()}
    assert plain == {"Cash": 3, "cash": 1, "Card": 1} and merged == {"Cash": 4, "Card": 1}
