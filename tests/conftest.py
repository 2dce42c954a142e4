import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetframe.session import build_session  # noqa: E402
from fleetframe.sources.tables import SCHEMAS, RentalTables  # noqa: E402
from values import day, money  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_tables(spark):
    """Build RentalTables from lists of tuples; tables not given are empty."""

    def make(**rows) -> RentalTables:
        return RentalTables(
            **{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}
        )

    return make


@pytest.fixture(scope="session")
def small(make_tables):
    """Two customers, three cars and a few bookings around 2024-03-10."""
    return make_tables(
        customer=[
            ("1111", "L1", "Ana", "0811", "North 1"),
            ("2222", "L2", "Budi", "0822", "South 2"),
            ("3333", "L3", "Citra 100%", "0833", "East_3"),
        ],
        staff=[("S1", "Sari", "Agent", "071"), ("S2", "Tono", "Manager", "072")],
        car_class=[("C1", "City"), ("C2", "Van"), ("C3", "Unused")],
        car=[
            ("K1", "Swift", "Manual", money("100.00"), "C1"),
            ("K2", "Jazz", "CVT", money("250.50"), "C1"),
            ("K3", "Hiace", "Manual", money("400.00"), "C2"),
            ("K4", "Loose", "Manual", money("9.00"), None),
        ],
        booking=[
            ("B1", day("2024-03-01"), day("2024-03-08"), day("2024-03-10"), "L1", "1111", "S1"),
            ("B2", day("2024-03-02"), day("2024-03-11"), day("2024-03-12"), "L1", "1111", "S2"),
            ("B3", day("2024-02-01"), day("2024-02-02"), day("2024-02-05"), "L2", "2222", None),
            ("B4", day("2024-01-01"), None, None, None, None, "S1"),
        ],
        transaction=[
            ("T1", "Cash", money("100.00"), dt.datetime(2024, 3, 10, 9, 0), "S1", "B1"),
            ("T2", "Cash", money("100.00"), dt.datetime(2024, 3, 10, 10, 0), "S1", "B1"),
            ("T3", "Card", money("50.25"), dt.datetime(2024, 3, 2, 10, 0), "S2", "B2"),
            ("T4", "Cash", money("70.00"), dt.datetime(2024, 3, 3, 10, 0), "S2", "B2"),
            ("T5", "Card", money("10.00"), dt.datetime(2024, 2, 1, 10, 0), "S9", None),
        ],
        car_transaction=[("K1", "T1"), ("K2", "T1"), ("K1", "T2"), ("K3", "T3"), ("K1", "T4")],
    )
