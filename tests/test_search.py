import datetime as dt
import json

from pyspark.sql import functions as F

from fleetframe.operators import bookings, customers, search
from fleetframe.plans import paging
from fleetframe.sources import sinks
from verification import catalog

TODAY = dt.date(2024, 3, 10)


def found(tables, query, **page):
    return [(r.Booking_ID, r.Cars_Rented) for r in bookings.search_bookings(tables, query, TODAY, **page).collect()]


def test_a_car_match_lists_only_matching_cars(small):
    assert found(small, "jazz") == [("B1", "Jazz")]
    assert found(small, "SWIFT") == [("B2", "Swift"), ("B1", "Swift")]


def test_a_customer_or_staff_match_lists_all_cars(small):
    assert found(small, "ana") == [("B2", "Hiace"), ("B2", "Swift"), ("B1", "Jazz, Swift")]
    assert found(small, "sari") == [("B1", "Jazz, Swift"), ("B4", None)]
    assert found(small, "b3") == [("B3", None)]
    assert found(small, "") == [("B2", "Hiace"), ("B2", "Swift"), ("B1", "Jazz, Swift"), ("B3", None), ("B4", None)]


def test_pages_and_their_totals_differ_for_split_bookings(small):
    assert found(small, "ana", page=2, per_page=2) == [("B1", "Jazz, Swift")]
    assert found(small, "ana", page=9) == []
    meta = bookings.search_bookings_meta(small, "ana", page=0, per_page=2).first()
    assert tuple(meta) == (2, 2, 1, 1)


def test_wildcards_in_customer_search(small):
    names = lambda q: [r.Name for r in search.search_customers(small, q).collect()]
    assert names("t_3") == ["Citra 100%"]
    assert names("%") == ["Ana", "Budi", "Citra 100%"]
    assert names("08_1") == ["Ana"]
    assert [r.Name for r in search.customer_quick_search(small, "%").collect()] == ["Citra 100%"]
    assert [r.Name for r in search.customer_picker(small, "i").collect()] == ["Budi", "Citra 100%"]
    assert [r.Name for r in search.staff_search(small, "AGENT").collect()] == ["Sari"]


def test_json_answer(small):
    page = search.search_customers(small, "", page=1, per_page=2)
    meta = search.search_customers_meta(small, "", page=1, per_page=2)
    answer = json.loads(sinks.json_answer(page, meta, [F.asc("Name"), F.asc("ID_Card")], 2).first().json)
    assert [row["Name"] for row in answer["data"]] == ["Ana", "Budi"]
    assert {k: v for k, v in answer.items() if k != "data"} == {
        "total": 3,
        "per_page": 2,
        "page": 1,
        "total_pages": 2,
    }
    empty = search.search_customers(small, "nobody")
    nothing = json.loads(sinks.json_answer(empty, search.search_customers_meta(small, "nobody"), [F.asc("Name")], 100).first().json)
    assert nothing["data"] == [] and nothing["total"] == 0 and nothing["total_pages"] == 0


def test_booking_answer_with_nulls_and_past_the_end(small):
    def answer(**page):
        return json.loads(bookings.search_bookings_answer(small, "", TODAY, **page).first().json)

    got = answer(per_page=3)
    assert [r["Booking_ID"] for r in got["data"]] == ["B2", "B2", "B1"]
    assert (got["total"], got["per_page"], got["page"], got["total_pages"]) == (4, 3, 1, 2)
    last = answer(page=2, per_page=3)["data"]
    assert [r["Booking_ID"] for r in last] == ["B3", "B4"]
    assert last[1]["Customer_Name"] is None and last[1]["Cars_Rented"] is None and last[0]["Staff_Name"] is None
    assert "Total_Amount" in last[0] and last[0]["Total_Amount"] is None
    assert answer(page=9)["data"] == []


def test_an_answer_never_gathers_more_than_a_page(spark, small):
    frame = spark.range(500)
    meta = frame.selectExpr("count(*) total")
    answer = json.loads(sinks.json_answer(frame, meta, [F.desc("id")], 7).first().json)
    assert [r["id"] for r in answer["data"]] == list(range(499, 492, -1))


def test_a_common_term_writes_no_copy_of_the_tables(make_tables, monkeypatch):
    """What a search pins stays within the bound of a broadcast, however many rows match."""
    from fleetframe.plans import lookups

    n, bound = 3_000, 8_000
    tables = make_tables(
        customer=[("1", None, "Ana", None, None)],
        car=[(f"K{i}", "Swift", "Manual", None, None) for i in range(50)],
        booking=[(f"B{i}", TODAY, TODAY, TODAY, None, "1", None) for i in range(n)],
        transaction=[(f"T{i}", "Cash", None, None, None, f"B{i}") for i in range(n)],
        car_transaction=[(f"K{i % 50}", f"T{i}") for i in range(n)],
    )
    pinned, pin = [], lookups.pin

    def counting(df):
        frame = pin(df)
        pinned.append(frame.count())
        return frame

    monkeypatch.setattr(lookups, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(lookups, "pin", counting)
    assert bookings.search_bookings_meta(tables, "swift").first().total == n
    assert len(pinned) == 4 and max(pinned) == bound // 16 + 1


def test_customer_pages_are_clamped(small, make_tables):
    assert [r.Name for r in customers.customer_page(small, 9, 2).collect()] == ["Citra 100%"]
    assert tuple(customers.customer_page_meta(small, 9, 2).first()) == (3, 2, 2, 3, 3)
    assert tuple(customers.customer_page_meta(small, -1, 2).first()) == (3, 2, 1, 1, 2)
    empty = make_tables()
    assert customers.customer_page(empty, 3).collect() == []
    assert tuple(customers.customer_page_meta(empty, 3).first()) == (0, 0, 1, 1, 0)


def test_the_deep_page_query_asks_for_a_page_cut_by_position(monkeypatch):
    asked = []
    monkeypatch.setattr(catalog.search, "search_customers", lambda tables, query, **page: asked.append(page))
    catalog.report_runs()["search_customers_deep_page"](None)
    assert asked == [{"page": 1200, "per_page": 9}] and paging.is_deep(**asked[0])
