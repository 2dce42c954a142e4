"""Customer search and the quick filters over listed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetframe.functions import wildcard_match
from fleetframe.functions.text import literal_contains, literal_runs
from fleetframe.operators.bookings import search_meta
from fleetframe.operators.customers import CUSTOMER_COLUMNS, customer_columns, staff_list
from fleetframe.plans.paging import page_rows
from fleetframe.sources.tables import RentalTables


def _matching_customers(tables: RentalTables, query: str) -> DataFrame:
    rows = tables.narrowed("customer", literal_runs(query))
    return rows.filter(wildcard_match(query, *[F.col(c) for c in CUSTOMER_COLUMNS]))


def search_customers(
    tables: RentalTables, query: str, page: int = 1, per_page: int = 100
) -> DataFrame:
    """One page of the customers with a match in any column, by name."""
    found = customer_columns(_matching_customers(tables, query))
    return page_rows(found, [F.asc("Name"), F.asc("ID_Card")], page, per_page, ["Name", "ID_Card"])


def search_customers_meta(
    tables: RentalTables, query: str, page: int = 1, per_page: int = 100
) -> DataFrame:
    total = _matching_customers(tables, query).agg(F.count("*").alias("total"))
    return search_meta(total, page, per_page)


def quick_filter(rows: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows whose text contains the query, ignoring case; no wildcards."""
    return rows.filter(literal_contains(query, *[F.col(c) for c in columns or rows.columns]))


def staff_search(tables: RentalTables, query: str) -> DataFrame:
    """Staff with a match anywhere in the listed row."""
    return quick_filter(staff_list(tables.with_tables(staff=tables.narrowed("staff", [query]))), query)


def customer_quick_search(tables: RentalTables, query: str) -> DataFrame:
    """Customers with a match anywhere in the listed row."""
    return quick_filter(customer_columns(tables.narrowed("customer", [query])), query).orderBy("Name", "ID_Card")


def customer_picker(tables: RentalTables, query: str) -> DataFrame:
    """Customers whose name contains the query, as offered when booking."""
    listed = customer_columns(tables.narrowed("customer", [query])).select("ID_Card", "Name", "Phone_Number")
    return quick_filter(listed, query, ["Name"]).orderBy("Name", "ID_Card")
