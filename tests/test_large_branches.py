"""Queries whose plan depends on sizes, with all bounds set low, against their SQL."""

import os

import pytest

from fleetframe.plans import first_come, lookups, paging
from verification.compare import compare, oracle_connection

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# Users of measured frames, deep pages and first-come admission.
QUERIES = """
    admit_bookings apply_customer_changes apply_staff_changes availability_conflicts booking_cards booking_list
    booking_batch_retried customer_page customer_page_past_end dashboard_stats dedupe_against_master
    ingest_customers post_transactions process_booking_requests recent_bookings_dashboard recent_transactions
    resolve_booking_customer search_bookings search_bookings_common_term search_bookings_common_term_meta
    search_bookings_deep_page search_bookings_everything search_bookings_json search_bookings_json_past_end
    search_bookings_meta search_bookings_people search_customers search_customers_deep_page search_customers_json
    search_customers_indexed dedupe_against_master_collated today_bookings transaction_cards
""".split()


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="bundled tables are not here")
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql_beyond_all_bounds(spark, connection, monkeypatch, name):
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(paging, "SHALLOW_ROWS", 0)
    monkeypatch.setattr(first_come, "GROUP_ROWS", 7)
    same, note = compare(spark, connection, FOLDER, name)
    assert same, note
