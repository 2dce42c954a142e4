"""Checking SQL, one text per named query, for an independent engine.

The rental tables are spelled out as common table expressions over the bundled
files, and the reports follow in plain SQL: all joins first, then grouping.
"""

from __future__ import annotations

TODAY = "DATE '2001-02-13'"
NOW = "TIMESTAMP '2001-02-13 09:30:00'"

TABLES = {
    "r_customer": """
        SELECT lpad(c_custkey::VARCHAR, 16, '0') AS id_card, 'DL' || c_custkey AS drivers_license,
               c_name AS name, '08' || lpad(c_custkey::VARCHAR, 10, '0') AS phone_number,
               c_mktsegment || ' ' || c_nationkey AS address
        FROM customer""",
    "r_staff": """
        SELECT 'S' || lpad(s_suppkey::VARCHAR, 4, '0') AS staff_id, s_name AS name,
               'Desk ' || s_nationkey AS position, '07' || lpad(s_suppkey::VARCHAR, 10, '0') AS contact
        FROM supplier""",
    "r_car_class": """
        SELECT 'CC-' || class_name AS cc_id, class_name
        FROM (SELECT DISTINCT p_type AS class_name FROM part UNION ALL SELECT 'UNUSED')""",
    "r_car": """
        SELECT 'CAR' || lpad(p_partkey::VARCHAR, 8, '0') AS car_id, p_name AS car_name,
               CASE p_size % 3 WHEN 0 THEN 'Manual' WHEN 1 THEN 'Automatic' ELSE 'CVT' END AS car_type,
               p_retailprice::DECIMAL(12,2) AS car_price,
               CASE WHEN p_size <> 50 THEN 'CC-' || p_type END AS car_class_cc_id
        FROM part""",
    "r_booking": """
        SELECT 'BK' || lpad(o_orderkey::VARCHAR, 10, '0') AS booking_id, o_orderdate::DATE AS date_preserved,
               o_orderdate::DATE + (1 + o_orderkey % 14)::INT AS start_date,
               o_orderdate::DATE + (1 + o_orderkey % 14)::INT + (1 + o_orderkey % 10)::INT AS end_date,
               CASE WHEN o_custkey % 10 <> 0 THEN 'DL' || o_custkey END AS customer_drivers_license,
               CASE WHEN o_custkey % 10 <> 0 THEN lpad(o_custkey::VARCHAR, 16, '0') END AS customer_id_card,
               CASE WHEN o_orderstatus <> 'P' THEN 'S' || lpad((o_orderkey % 12)::VARCHAR, 4, '0') END AS staff_staff_id
        FROM orders""",
    "r_tx": """
        SELECT 'TX' || lpad((l_orderkey * 10 + l_linenumber)::VARCHAR, 12, '0') AS transaction_id,
               min(l_returnflag) AS payment_method,
               sum(l_extendedprice::DECIMAL(12,2))::DECIMAL(12,2) AS amount,
               min(l_shipdate) AS payment_date,
               'S' || lpad((l_orderkey % 12)::VARCHAR, 4, '0') AS staff_staff_id,
               CASE WHEN l_linenumber < 7 THEN 'BK' || lpad(l_orderkey::VARCHAR, 10, '0') END AS booking_booking_id
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "r_ct": """
        SELECT DISTINCT
               'CAR' || lpad((CASE WHEN l_partkey % 20 = 0 THEN l_partkey + 1 ELSE l_partkey END)::VARCHAR, 8, '0') AS car_car_id,
               'TX' || lpad((l_orderkey * 10 + l_linenumber)::VARCHAR, 12, '0') AS transaction_transaction_id
        FROM lineitem""",
    "r_notification": """
        SELECT user_id::VARCHAR AS user_id, event_type || ' ' || event_id AS message,
               CASE WHEN event_type = 'error' THEN 'danger'
                    WHEN event_type IN ('view', 'click') THEN 'info' ELSE 'success' END AS type,
               NULL::VARCHAR AS link, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS is_read,
               ts AS created_at
        FROM events""",
    "q_customer": """
        SELECT o_orderkey AS arrival,
               CASE WHEN o_orderkey % 17 = 0 THEN '0' ELSE 'Applicant ' || o_orderkey END AS full_name,
               CASE WHEN o_orderkey % 5 = 0 THEN '08' || lpad(o_custkey::VARCHAR, 10, '0')
                    WHEN o_orderkey % 11 = 0 THEN '12345'
                    ELSE '09' || lpad((o_orderkey // 3)::VARCHAR, 10, '0') END AS phone,
               CASE WHEN o_orderkey % 13 = 0 THEN 'DL' || o_custkey ELSE 'NL' || o_orderkey END AS license_number,
               'Street ' || o_orderpriority AS address,
               lpad((o_orderkey // 2)::VARCHAR, CASE WHEN o_orderkey % 7 = 0 THEN 15 ELSE 16 END, '0') AS id_card
        FROM orders""",
    "v_customer": """
        SELECT *, CASE WHEN full_name = '0' THEN 'All fields are required'
                       WHEN length(id_card) <> 16 THEN 'ID Card must be exactly 16 digits'
                       WHEN length(phone) < 10 THEN 'Phone number must be at least 10 digits' END AS reject_reason
        FROM q_customer""",
    # Identity cards repeat in pairs and phones in threes, so collisions stay within
    # blocks of six arrivals; the recursion walks through all blocks side by side.
    "walk_customer": """
        SELECT -1 AS step, arrival // 6 AS block, []::VARCHAR[] AS phones, []::VARCHAR[] AS cards,
               NULL::BIGINT AS arrival, NULL::VARCHAR AS reason
        FROM v_customer GROUP BY arrival // 6
        UNION ALL
        SELECT step + 1, block,
               CASE WHEN why IS NULL AND row_arrival IS NOT NULL THEN list_append(phones, phone) ELSE phones END,
               CASE WHEN why IS NULL AND row_arrival IS NOT NULL THEN list_append(cards, id_card) ELSE cards END,
               row_arrival, why
        FROM (
            SELECT w.step, w.block, w.phones, w.cards, v.arrival AS row_arrival, v.phone, v.id_card,
                   CASE WHEN v.reject_reason IS NOT NULL THEN v.reject_reason
                        WHEN v.phone IN (SELECT phone_number FROM r_customer) OR list_contains(w.phones, v.phone)
                            THEN 'Phone number already exists in our system'
                        WHEN v.license_number IN (SELECT drivers_license FROM r_customer)
                            THEN 'Driver license number already exists in our system'
                        WHEN v.id_card IN (SELECT id_card FROM r_customer) OR list_contains(w.cards, v.id_card)
                            THEN 'ID Card number already exists in our system' END AS why
            FROM walk_customer w
            LEFT JOIN v_customer v ON v.arrival // 6 = w.block AND v.arrival % 6 = w.step + 1
            WHERE w.step < 5
        )""",
    "d_customer": """
        SELECT v.* EXCLUDE (reject_reason), w.reason AS reject_reason
        FROM walk_customer w JOIN v_customer v ON w.arrival = v.arrival""",
    "v_car": """
        SELECT *, CASE WHEN model = '' THEN 'All fields are required'
                       WHEN year::INT NOT BETWEEN 1990 AND 2002 THEN 'Invalid year. Must be between 1990 and 2002'
                       WHEN daily_rate::DECIMAL(12,2) <= 0 OR daily_rate IS NULL THEN 'Daily rate must be greater than 0'
                       WHEN car_class_id NOT IN (SELECT cc_id FROM r_car_class) THEN 'Invalid car class selected'
                  END AS reject_reason,
               brand || ' ' || model || ' ' || year AS car_name
        FROM (
            SELECT p_partkey AS arrival, p_brand AS brand,
                   CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_name END AS model,
                   (1985 + p_size)::VARCHAR AS year,
                   CASE WHEN p_partkey % 17 = 0 THEN 'NONE' ELSE 'CC-' || p_type END AS car_class_id,
                   CASE p_size % 3 WHEN 0 THEN 'Manual' WHEN 1 THEN 'Automatic' ELSE 'CVT' END AS car_type,
                   (p_retailprice::DECIMAL(12,2) - 905)::VARCHAR AS daily_rate
            FROM part
        )""",
    "q_booking": f"""
        SELECT *, start + (arrival % 5)::INT AS "end" FROM (
            SELECT o_orderkey AS arrival, o_custkey AS cust,
                   CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE 'Guest ' || o_orderkey END AS customer_search,
                   CASE WHEN o_orderkey % 6 = 0 THEN 'new_customer'
                        WHEN o_orderkey % 31 = 0 THEN 'missing-' || o_custkey
                        ELSE lpad(o_custkey::VARCHAR, 16, '0') END AS customer_selection,
                   CASE WHEN o_orderkey % 36 = 0 THEN '08' || lpad(o_custkey::VARCHAR, 10, '0')
                        WHEN o_orderkey % 6 = 0 THEN '06' || lpad(o_orderkey::VARCHAR, 10, '0') END AS customer_phone,
                   CASE WHEN o_orderkey % 6 = 0 THEN '9' || lpad((o_orderkey // 12)::VARCHAR,
                        CASE WHEN o_orderkey % 42 = 0 THEN 14 ELSE 15 END, '0') END AS id_card,
                   CASE WHEN o_orderkey % 6 = 0 THEN 'RL' || o_orderkey END AS license_number,
                   CASE WHEN o_orderkey % 6 = 0 THEN 'Road ' || o_orderpriority END AS address,
                   'CAR' || lpad((o_orderkey % 50)::VARCHAR, 8, '0') AS car_id,
                   {TODAY} + (o_custkey % 90 - 2)::INT AS start
            FROM orders)""",
    "v_booking": f"""
        SELECT * REPLACE (CASE WHEN arrival % 37 = 0 THEN NULL ELSE start END AS start),
               CASE WHEN customer_search = '' THEN 'All fields are required'
                    WHEN arrival % 37 <> 0 AND arrival % 5 = 0 THEN 'End date must be after start date'
                    WHEN arrival % 37 = 0 OR start < {TODAY} THEN 'Start date cannot be in the past'
               END AS reject_reason
        FROM q_booking""",
    "w_booking": """
        SELECT v.* EXCLUDE (reject_reason),
               CASE WHEN reject_reason IS NOT NULL THEN reject_reason
                    WHEN customer_selection <> 'new_customer' AND customer_selection NOT IN (SELECT id_card FROM r_customer)
                        THEN 'Selected customer not found'
                    WHEN customer_selection = 'new_customer' AND length(id_card) <> 16 THEN 'ID Card must be exactly 16 digits'
                    WHEN customer_phone IN (SELECT phone_number FROM r_customer) THEN 'Phone number already exists'
               END AS reject_reason
        FROM v_booking v""",
    # The only values of new customers that repeat are identity cards.
    "s_booking": """
        SELECT w.* EXCLUDE (reject_reason), customer_selection = 'new_customer' AND reason IS NULL AS is_new_customer,
               reason AS reject_reason,
               CASE WHEN reason IS NULL THEN coalesce(id_card, customer_selection) END AS customer_id_card,
               CASE WHEN reason IS NULL THEN coalesce(license_number, 'DL' || cust) END AS customer_drivers_license
        FROM (
            SELECT *, CASE WHEN reject_reason IS NOT NULL THEN reject_reason
                           WHEN id_card IS NOT NULL AND arrival > min(CASE WHEN reject_reason IS NULL THEN arrival END)
                                OVER (PARTITION BY id_card) THEN 'ID Card already exists' END AS reason
            FROM w_booking
        ) w""",
    "c_booking": """
        SELECT s.arrival, count(b.booking_id) AS conflict_count
        FROM v_booking s
        LEFT JOIN r_ct ct ON ct.car_car_id = s.car_id
        LEFT JOIN r_tx t ON t.transaction_id = ct.transaction_transaction_id
        LEFT JOIN r_booking b ON b.booking_id = t.booking_booking_id
             AND ((b.start_date <= s.start AND b.end_date >= s.start)
               OR (b.start_date <= s."end" AND b.end_date >= s."end")
               OR (b.start_date >= s.start AND b.end_date <= s."end"))
        WHERE s.start <= s."end"
        GROUP BY s.arrival""",
}

# The greedy choice per car: step n looks at the n-th open request of every car.
WALK = """
    {queue} AS (
        SELECT o.arrival, o.car_id, o.start, o."end",
               row_number() OVER (PARTITION BY o.car_id ORDER BY o.arrival) AS n
        FROM {source} o JOIN c_booking c ON c.arrival = o.arrival
        WHERE o.reject_reason IS NULL AND c.conflict_count = 0
    ),
    {walk} AS (
        SELECT DISTINCT car_id, 0::BIGINT AS n, []::STRUCT(s DATE, e DATE)[] AS held,
               NULL::BIGINT AS arrival, FALSE AS fits
        FROM {queue}
        UNION ALL
        SELECT car_id, n, CASE WHEN clear THEN list_append(held, {{'s': start, 'e': "end"}}) ELSE held END, arrival, clear
        FROM (
            SELECT q.car_id, q.n, w.held, q.arrival, q.start, q."end",
                   len(list_filter(w.held, lambda h: h.s <= q."end" AND h.e >= q.start)) = 0 AS clear
            FROM {walk} w JOIN {queue} q ON q.car_id = w.car_id AND q.n = w.n + 1
        )
    ),
    {decided} AS (
        SELECT o.* EXCLUDE (reject_reason),
               CASE WHEN o.reject_reason IS NOT NULL THEN o.reject_reason
                    WHEN w.arrival IS NULL THEN 'Car is not available for the selected dates' END AS reject_reason
        FROM {source} o LEFT JOIN (SELECT arrival FROM {walk} WHERE fits) w ON w.arrival = o.arrival
    )"""
WALK_DATED = WALK.format(queue="k_dated", walk="g_dated", decided="d_dated", source="v_booking")
WALK_BOOKING = WALK.format(queue="k_booking", walk="g_booking", decided="d_booking", source="s_booking")

STAFF_PICK = """
        SELECT s.*, p.staff_id FROM {source} s
        JOIN (SELECT staff_id, row_number() OVER (ORDER BY staff_id) - 1 AS place FROM r_staff) p
          ON p.place = ('0x' || substr(md5(s.arrival || ':{seed}'), 1, 8))::BIGINT % (SELECT count(*) FROM r_staff)"""

POSTED = """
    p_booking AS (
        SELECT d.*, 'BK' || lpad((row_number() OVER (ORDER BY d.arrival) + (SELECT max(o_orderkey) FROM orders))::VARCHAR, 10, '0') AS booking_id,
               'TX' || lpad((row_number() OVER (ORDER BY d.arrival) + (SELECT max(l_orderkey * 10 + l_linenumber) FROM lineitem))::VARCHAR, 12, '0') AS transaction_id,
               ((d."end" - d.start + 1) * c.car_price)::DECIMAL(12,2) AS total_amount
        FROM (""" + STAFF_PICK.format(source="d_booking", seed=0) + """) d JOIN r_car c ON c.car_id = d.car_id
        WHERE d.reject_reason IS NULL
    )"""


def _with(tables: str, query: str, *extra: str, recursive: bool = False) -> str:
    parts = [f"{name} AS ({TABLES[name]})" for name in tables.split()] + list(extra)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + query


# ---- rounding, half away from zero, in whole numbers


def _mean(total: str, count: str, digits: int, scale: int = 100) -> str:
    """total/count for a total with ``scale`` units per 1, to ``digits`` decimals."""
    power = 10**digits
    units = f"CAST(({total}) * {scale} AS HUGEINT)"
    rows = f"CAST(nullif({count}, 0) AS HUGEINT)"
    return f"CAST((2 * {power} * {units} + {scale} * {rows}) // (2 * {scale} * {rows}) AS DOUBLE) / {power}"


def _share(part: str, whole: str, scale: int = 1) -> str:
    """100*part/whole to two decimals."""
    p, w = f"CAST(({part}) * {scale} AS HUGEINT)", f"CAST(nullif({whole}, 0) * {scale} AS HUGEINT)"
    return f"CAST((20000 * {p} + {w}) // (2 * {w}) AS DOUBLE) / 100"


def _status(alias: str) -> str:
    return f"""CASE WHEN {alias}.start_date <= {TODAY} AND {alias}.end_date >= {TODAY} THEN 'Active'
             WHEN {alias}.start_date > {TODAY} THEN 'Upcoming'
             WHEN {alias}.end_date < {TODAY} THEN 'Completed' ELSE 'Unknown' END"""


def _window(column: str, months: int) -> str:
    return f"{column} >= CAST({TODAY} - INTERVAL {months} MONTH AS DATE)"


def _rupiah(amount: str) -> str:
    return f"'Rp ' || replace(format('{{:,}}', CAST(round(coalesce({amount}, 0), 0) AS BIGINT)), ',', '.')"


_FIVE_JOINS = """
    FROM r_booking b
    LEFT JOIN r_customer c ON b.customer_id_card = c.id_card
    LEFT JOIN r_staff s ON b.staff_staff_id = s.staff_id
    LEFT JOIN r_tx t ON b.booking_id = t.booking_booking_id
    LEFT JOIN r_ct ct ON t.transaction_id = ct.transaction_transaction_id
    LEFT JOIN r_car car ON ct.car_car_id = car.car_id"""
_DETAIL_TABLES = "r_booking r_customer r_staff r_tx r_ct r_car"


def _details(where: str = "") -> str:
    """Detail rows, one per booking, amount and method."""
    return f"""
    SELECT b.booking_id AS "Booking_ID", b.date_preserved AS "Date_Preserved", b.start_date AS "Start_Date",
           b.end_date AS "End_Date", CAST(b.end_date - b.start_date AS INT) AS "Rental_Days",
           c.name AS "Customer_Name", c.phone_number AS "Customer_Phone", s.name AS "Staff_Name",
           string_agg(DISTINCT car.car_name, ', ' ORDER BY car.car_name) AS "Cars_Rented",
           CAST(t.amount AS DOUBLE) AS "Total_Amount", t.payment_method AS "Payment_Method",
           {_status('b')} AS "Booking_Status"
    {_FIVE_JOINS} {where}
    GROUP BY b.booking_id, b.date_preserved, b.start_date, b.end_date, c.name, c.phone_number, s.name,
             t.amount, t.payment_method"""


_NEWEST = '"Date_Preserved" DESC, "Booking_ID", "Total_Amount" NULLS FIRST, "Payment_Method" NULLS FIRST'


def _search_condition(query: str) -> str:
    columns = ["b.booking_id", "c.name", "c.phone_number", "s.name", "car.car_name"]
    return "WHERE " + " OR ".join(f"{c} ILIKE '%{query}%'" for c in columns)


def _search(query: str, page: int = 1, per_page: int = 100) -> str:
    return _with(
        _DETAIL_TABLES,
        f"{_details(_search_condition(query))} ORDER BY {_NEWEST} LIMIT {per_page} OFFSET {(page - 1) * per_page}",
    )


def _search_json(query: str, page: int = 1, per_page: int = 100) -> str:
    """The search answer, written field by field."""
    texts = "Booking_ID Date_Preserved Start_Date End_Date Customer_Name Customer_Phone Staff_Name Cars_Rented"
    texts += " Payment_Method Booking_Status"
    fields = "Booking_ID Date_Preserved Start_Date End_Date Rental_Days Customer_Name Customer_Phone Staff_Name"
    fields += " Cars_Rented Total_Amount Payment_Method Booking_Status"
    shown = " || ',' || ".join(
        f"""'"{f}":' || coalesce({'' if f not in texts.split() else "'\"' || "}"{f}"::VARCHAR{'' if f not in texts.split() else " || '\"'"}, 'null')"""
        for f in fields.split()
    )
    rows = _details(_search_condition(query)).replace("CAST(t.amount AS DOUBLE)", "t.amount")
    rows = f"{rows} ORDER BY {_NEWEST} LIMIT {per_page} OFFSET {(page - 1) * per_page}"
    total = f"SELECT count(DISTINCT b.booking_id) AS n {_FIVE_JOINS} {_search_condition(query)}"
    return _with(
        _DETAIL_TABLES,
        f"""SELECT '{{"data":[' || coalesce((SELECT string_agg('{{' || {shown} || '}}', ',' ORDER BY {_NEWEST})
            FROM ({rows})), '') || '],"total":' || total || ',"per_page":' || per_page || ',"page":' || page
            || ',"total_pages":' || total_pages || '}}' AS json FROM ({_meta(total, page, per_page)})""",
    )


def _meta(total: str, page: int, per_page: int) -> str:
    return f"""SELECT n AS total, {per_page}::BIGINT AS per_page, {page}::BIGINT AS page,
               CAST(ceil(n / {per_page}) AS BIGINT) AS total_pages FROM ({total})"""


def _search_meta(query: str, page: int = 1, per_page: int = 100) -> str:
    total = f"SELECT count(DISTINCT b.booking_id) AS n {_FIVE_JOINS} {_search_condition(query)}"
    return _with(_DETAIL_TABLES, _meta(total, page, per_page))


_CUSTOMER = """id_card AS "ID_Card", name AS "Name", phone_number AS "Phone_Number",
               address AS "Address", drivers_license AS "Drivers_License" """


def _customer_condition(query: str) -> str:
    columns = ["name", "phone_number", "id_card", "drivers_license", "address"]
    return "WHERE " + " OR ".join(f"{c} ILIKE '%{query}%'" for c in columns)


def _customer_search(query: str, page: int = 1, per_page: int = 100) -> str:
    return f"""SELECT {_CUSTOMER} FROM r_customer {_customer_condition(query)}
               ORDER BY name, id_card LIMIT {per_page} OFFSET {(page - 1) * per_page}"""


def _months() -> dict[str, str]:
    def month(column: str, moment: str, cap: bool) -> str:
        year, number, name = ("Year", "Month", "Month_Name") if cap else ("year", "month", "month_name")
        return f"""CAST(year({moment}) AS INT) AS "{year}", CAST(month({moment}) AS INT) AS "{number}",
                   monthname({moment}) AS "{name}" """

    group = "GROUP BY 1, 2, 3"
    bookings = f"""SELECT {month('', 'date_preserved', False)}, count(*) AS booking_count
        FROM r_booking WHERE {_window('date_preserved', 12)} {group}"""
    growth = f"""SELECT {month('', 'payment_date', False)}, CAST(sum(amount) AS DOUBLE) AS monthly_revenue,
        count(*) AS transaction_count FROM r_tx WHERE {_window('payment_date', 12)} {group}"""
    report = f"""SELECT {month('', 'payment_date', True)}, count(transaction_id) AS "Total_Transactions",
        CAST(sum(amount) AS DOUBLE) AS "Monthly_Revenue",
        {_mean('sum(amount)', 'count(amount)', 2)} AS "Average_Transaction"
        FROM r_tx WHERE {_window('payment_date', 12)} {group}"""
    recent = f"""SELECT {month('', 'payment_date', True)}, count(*) AS "Total_Transactions",
        CAST(sum(amount) AS DOUBLE) AS "Total_Revenue" FROM r_tx WHERE {_window('payment_date', 6)} {group}"""
    seasonal = f"""SELECT CAST(year(b.start_date) AS INT) AS "Booking_Year", CAST(month(b.start_date) AS INT) AS "Booking_Month",
        monthname(b.start_date) AS "Month_Name", count(b.booking_id) AS "Total_Bookings",
        CAST(sum(t.amount) AS DOUBLE) AS "Monthly_Revenue",
        {_mean('sum(t.amount)', 'count(t.amount)', 2)} AS "Average_Booking_Value",
        count(DISTINCT b.customer_id_card) AS "Unique_Customers",
        {_mean('sum(b.end_date - b.start_date)', 'count(*)', 1, 1)} AS "Average_Rental_Days",
        {_share('count(b.booking_id)', 'sum(count(b.booking_id)) OVER ()')} AS "Booking_Percentage"
        FROM r_booking b JOIN r_tx t ON b.booking_id = t.booking_booking_id
        WHERE {_window('b.start_date', 6)} {group}"""
    return {
        "monthly_bookings": _with("r_booking", bookings),
        "revenue_growth": _with("r_tx", growth),
        "monthly_revenue_report": _with("r_tx", report),
        "monthly_revenue_recent": _with("r_tx", recent),
        "seasonal_patterns": _with("r_booking r_tx", seasonal),
        "monthly_bookings_chart": _with(
            "r_booking", f"SELECT year, month, month_name[:3] AS label, booking_count FROM ({bookings})"
        ),
        "revenue_growth_chart": _with(
            "r_tx", f"SELECT year, month, month_name[:3] AS label, monthly_revenue FROM ({growth})"
        ),
        "monthly_revenue_chart": _with(
            "r_tx",
            f"""SELECT "Month_Name" || ' ' || "Year" AS label, "Monthly_Revenue", "Total_Transactions" FROM ({report})""",
        ),
    }


def _customers() -> dict[str, str]:
    history = """
        SELECT c.name AS "Customer_Name", c.phone_number AS "Phone_Number", count(b.booking_id) AS "Total_Bookings",
               CAST(sum(t.amount) AS DOUBLE) AS "Total_Spent", max(b.date_preserved) AS "Last_Booking_Date",
               CAST(sum(b.end_date - b.start_date) AS DOUBLE) / count(b.booking_id) AS "Avg_Rental_Days",
               CASE WHEN count(b.booking_id) >= 5 THEN 'VIP Customer' WHEN count(b.booking_id) >= 3 THEN 'Regular Customer'
                    WHEN count(b.booking_id) >= 1 THEN 'New Customer' ELSE 'Prospect' END AS "Customer_Type"
        FROM r_customer c LEFT JOIN r_booking b ON c.id_card = b.customer_id_card
        LEFT JOIN r_tx t ON b.booking_id = t.booking_booking_id
        GROUP BY c.id_card, c.name, c.phone_number HAVING count(b.booking_id) > 0"""
    pages = "(SELECT CAST(ceil(count(*) / 100) AS BIGINT) FROM r_customer)"

    def page(number: int, columns: str = _CUSTOMER) -> str:
        clamped = f"greatest(1, least({pages}, {number}))"
        return f"""SELECT {columns} FROM (
            SELECT *, row_number() OVER (ORDER BY name, id_card) AS n FROM r_customer)
            WHERE n > ({clamped} - 1) * 100 AND n <= {clamped} * 100"""

    def page_meta(number: int) -> str:
        return f"""SELECT total, total_pages, page, (page - 1) * 100 + 1 AS start_record,
            least(page * 100, total) AS end_record FROM (
            SELECT count(*) AS total, {pages} AS total_pages,
                   CAST(greatest(1, least({pages}, {number})) AS BIGINT) AS page FROM r_customer)"""

    cut = """id_card AS "ID_Card", name AS "Name", phone_number AS "Phone_Number", drivers_license AS "Drivers_License",
             CASE WHEN length(address) > 9 THEN address[:9] || '...' ELSE address END AS "Address" """
    return {
        "top_customers": _with(
            "r_customer r_booking r_tx",
            f"""SELECT c.name AS "Customer_Name", c.phone_number AS "Phone_Number", count(b.booking_id) AS "Total_Bookings",
                CAST(sum(t.amount) AS DOUBLE) AS "Total_Spent",
                {_mean('sum(t.amount)', 'count(t.amount)', 2)} AS "Average_Booking_Value",
                max(b.date_preserved) AS "Last_Booking_Date",
                {_mean('sum(b.end_date - b.start_date)', 'count(*)', 1, 1)} AS "Avg_Rental_Days"
                FROM r_customer c JOIN r_booking b ON c.id_card = b.customer_id_card
                JOIN r_tx t ON b.booking_id = t.booking_booking_id
                GROUP BY c.id_card, c.name, c.phone_number ORDER BY sum(t.amount) DESC, c.id_card LIMIT 10""",
        ),
        "customer_history": _with(
            "r_customer r_booking r_tx", history + " ORDER BY count(b.booking_id) DESC, c.id_card LIMIT 10"
        ),
        "customer_tiers": _with("r_customer r_booking r_tx", history),
        "staff_list": _with(
            "r_staff",
            """SELECT staff_id AS "Staff_ID", name AS "Name", contact AS "Contact", position AS "Position" FROM r_staff""",
        ),
        "customer_page": _with("r_customer", page(7)),
        "customer_page_past_end": _with("r_customer", page(10**6)),
        "customer_page_meta": _with("r_customer", page_meta(7)),
        "customer_page_past_end_meta": _with("r_customer", page_meta(10**6)),
        "customer_cards": _with("r_customer", page(2, cut)),
    }


def _fleet() -> dict[str, str]:
    all_rentals = "(SELECT count(*) FROM r_ct)"
    cars = """FROM r_car c JOIN r_car_class cc ON c.car_class_cc_id = cc.cc_id
        LEFT JOIN r_ct ct ON c.car_id = ct.car_car_id
        LEFT JOIN r_tx t ON ct.transaction_transaction_id = t.transaction_id
        GROUP BY c.car_id, c.car_name, cc.class_name, c.car_price"""
    usage = f"""SELECT c.car_id AS "Car_ID", c.car_name AS "Car_Name", cc.class_name AS "Class_Name",
        CAST(c.car_price AS DOUBLE) AS "Car_Price", count(ct.transaction_transaction_id) AS "Rental_Count",
        CAST(coalesce(sum(t.amount), 0) AS DOUBLE) AS "Total_Revenue",
        CASE WHEN count(ct.transaction_transaction_id) = 0 THEN 'Never Rented'
             WHEN count(ct.transaction_transaction_id) < 3 THEN 'Low Usage'
             WHEN count(ct.transaction_transaction_id) < 8 THEN 'Medium Usage' ELSE 'High Usage' END AS "Usage_Status"
        {cars}"""
    return {
        "class_utilization": _with(
            "r_car_class r_car r_ct",
            f"""SELECT cc.class_name AS "Class_Name", count(ct.car_car_id) AS rental_count,
                {_share('count(ct.car_car_id)', all_rentals)} AS utilization_percentage
                FROM r_car_class cc LEFT JOIN r_car c ON cc.cc_id = c.car_class_cc_id
                LEFT JOIN r_ct ct ON c.car_id = ct.car_car_id GROUP BY cc.cc_id, cc.class_name""",
        ),
        "vehicle_utilization": _with(
            "r_car_class r_car r_ct r_tx",
            f"""SELECT c.car_id AS "Car_ID", c.car_name AS "Car_Name", cc.class_name AS "Class_Name",
                CAST(c.car_price AS DOUBLE) AS "Car_Price", count(ct.transaction_transaction_id) AS "Rental_Count",
                CAST(sum(t.amount) AS DOUBLE) AS "Total_Revenue",
                {_mean('sum(t.amount)', 'count(t.amount)', 2)} AS "Average_Revenue_Per_Rental",
                {_share('count(ct.transaction_transaction_id)', all_rentals)} AS "Utilization_Percentage"
                {cars} ORDER BY sum(t.amount) DESC NULLS LAST, c.car_id LIMIT 15""",
        ),
        "popular_classes": _with(
            "r_car_class r_car r_ct r_tx",
            f"""SELECT cc.class_name AS "Class_Name", count(DISTINCT c.car_id) AS "Total_Cars_In_Class",
                count(ct.car_car_id) AS "Total_Rentals", CAST(sum(t.amount) AS DOUBLE) AS "Class_Revenue",
                {_mean('sum(c.car_price)', 'count(c.car_price)', 2)} AS "Average_Daily_Rate",
                {_share('count(ct.car_car_id)', all_rentals)} AS "Popularity_Percentage"
                FROM r_car_class cc LEFT JOIN r_car c ON cc.cc_id = c.car_class_cc_id
                LEFT JOIN r_ct ct ON c.car_id = ct.car_car_id
                LEFT JOIN r_tx t ON ct.transaction_transaction_id = t.transaction_id
                GROUP BY cc.cc_id, cc.class_name""",
        ),
        "fleet_list": _with(
            "r_car_class r_car",
            """SELECT c.car_id AS "Car_ID", c.car_name AS "Car_Name", c.car_type AS "Car_Type",
               CAST(c.car_price AS DOUBLE) AS "Car_Price", cc.class_name AS "Class_Name"
               FROM r_car c JOIN r_car_class cc ON c.car_class_cc_id = cc.cc_id""",
        ),
        "cars_by_class": _with(
            "r_car_class r_car",
            f"""SELECT cc.class_name AS "Class_Name", count(c.car_id) AS "Total_Cars",
                {_mean('sum(c.car_price)', 'count(c.car_price)', 0)} AS "Average_Price",
                CAST(min(c.car_price) AS DOUBLE) AS "Min_Price", CAST(max(c.car_price) AS DOUBLE) AS "Max_Price"
                FROM r_car_class cc LEFT JOIN r_car c ON cc.cc_id = c.car_class_cc_id
                GROUP BY cc.cc_id, cc.class_name""",
        ),
        "car_usage": _with(
            "r_car_class r_car r_ct r_tx", usage + " ORDER BY coalesce(sum(t.amount), 0) DESC, c.car_id LIMIT 20"
        ),
        "car_usage_all": _with("r_car_class r_car r_ct r_tx", usage),
        "fleet_stats": _with(
            "r_car",
            f"""SELECT count(*) AS "Total_Cars", count(DISTINCT car_class_cc_id) AS "Total_Classes",
                {_mean('sum(car_price)', 'count(car_price)', 0)} AS "Average_Price",
                (SELECT count(*) FROM r_car x, (SELECT sum(car_price) AS s, count(car_price) AS n FROM r_car) m
                 WHERE x.car_price * m.n > m.s) AS "Premium_Cars" FROM r_car""",
        ),
        "rental_stats": _with(
            "r_ct r_tx",
            """SELECT count(DISTINCT ct.car_car_id) AS "Cars_Ever_Rented",
               count(ct.transaction_transaction_id) AS "Total_Rentals",
               CAST(coalesce(sum(t.amount), 0) AS DOUBLE) AS "Total_Fleet_Revenue"
               FROM r_ct ct LEFT JOIN r_tx t ON ct.transaction_transaction_id = t.transaction_id""",
        ),
    }


def _payments() -> dict[str, str]:
    recent = """FROM r_tx t LEFT JOIN r_booking b ON t.booking_booking_id = b.booking_id
        LEFT JOIN r_customer c ON b.customer_id_card = c.id_card
        LEFT JOIN r_staff s ON t.staff_staff_id = s.staff_id
        ORDER BY t.payment_date DESC, t.transaction_id LIMIT 50"""
    return {
        "summary_stats": _with(
            "r_customer r_car r_booking r_tx",
            f"""SELECT (SELECT count(*) FROM r_customer) AS "Total_Customers", (SELECT count(*) FROM r_car) AS "Total_Cars",
                (SELECT count(*) FROM r_booking) AS "Total_Bookings",
                (SELECT CAST(sum(amount) AS DOUBLE) FROM r_tx) AS "Total_Revenue",
                (SELECT count(*) FROM r_tx WHERE payment_date::DATE = {TODAY}) AS "Today_Transactions",
                (SELECT CAST(sum(amount) AS DOUBLE) FROM r_tx WHERE payment_date::DATE = {TODAY}) AS "Today_Revenue" """,
        ),
        "recent_transactions": _with(
            "r_tx r_booking r_customer r_staff",
            f"""SELECT t.transaction_id AS "Transaction_ID", t.payment_method AS "Payment_Method",
                CAST(t.amount AS DOUBLE) AS "Amount", t.payment_date AS "Payment_Date",
                t.staff_staff_id AS "Staff_Staff_ID", t.booking_booking_id AS "Booking_Booking_ID",
                c.name AS "Customer_Name", s.name AS "Staff_Name" {recent}""",
        ),
        "transaction_cards": _with(
            "r_tx r_booking r_customer r_staff",
            f"""SELECT t.transaction_id AS "Transaction_ID", coalesce(c.name, 'N/A') AS "Customer",
                coalesce(s.name, t.staff_staff_id) AS "Staff", t.payment_method AS "Payment_Method",
                {_rupiah('t.amount')} AS "Amount", strftime(t.payment_date, '%Y-%m-%d %H:%M') AS "Paid_At" {recent}""",
        ),
        "payment_method_analysis": _with(
            "r_tx r_booking",
            f"""SELECT t.payment_method AS "Payment_Method", count(t.transaction_id) AS "Transaction_Count",
                CAST(sum(t.amount) AS DOUBLE) AS "Total_Revenue",
                {_mean('sum(t.amount)', 'count(t.amount)', 2)} AS "Average_Transaction_Value",
                CAST(min(t.amount) AS DOUBLE) AS "Minimum_Transaction",
                CAST(max(t.amount) AS DOUBLE) AS "Maximum_Transaction",
                {_share('count(t.transaction_id)', '(SELECT count(*) FROM r_tx)')} AS "Usage_Percentage",
                {_share('sum(t.amount)', '(SELECT sum(amount) FROM r_tx)', 100)} AS "Revenue_Percentage",
                count(DISTINCT b.customer_id_card) AS "Unique_Customers"
                FROM r_tx t JOIN r_booking b ON t.booking_booking_id = b.booking_id GROUP BY t.payment_method""",
        ),
        "today_stats": _with(
            "r_tx",
            f"""SELECT count(*) AS "Today_Transactions", CAST(coalesce(sum(amount), 0) AS DOUBLE) AS "Today_Revenue",
                coalesce({_mean('sum(amount)', 'count(amount)', 6)}, 0) AS "Today_Average"
                FROM r_tx WHERE payment_date::DATE = {TODAY}""",
        ),
    }


def _bookings() -> dict[str, str]:
    is_today = f"""(b.start_date = {TODAY} OR b.end_date = {TODAY}
                    OR (b.start_date <= {TODAY} AND b.end_date >= {TODAY}))"""
    newest = f"{_details()} ORDER BY {_NEWEST} LIMIT 50"
    latest_four = f"{_details()} ORDER BY {_NEWEST} LIMIT 4"
    return {
        "today_bookings": _with(
            _DETAIL_TABLES,
            f"""SELECT b.booking_id AS "Booking_ID", b.date_preserved AS "Date_Preserved", b.start_date AS "Start_Date",
                b.end_date AS "End_Date", CAST(b.end_date - b.start_date AS INT) AS "Rental_Days",
                c.name AS "Customer_Name", c.phone_number AS "Customer_Phone", s.name AS "Staff_Name",
                s.position AS "Staff_Position",
                string_agg(car.car_name || ' (' || car.car_type || ')', ', '
                           ORDER BY car.car_name || ' (' || car.car_type || ')') AS "Rented_Cars",
                CAST(t.amount AS DOUBLE) AS "Total_Amount", t.payment_method AS "Payment_Method",
                {_status('b')} AS "Booking_Status"
                {_FIVE_JOINS} WHERE {is_today}
                GROUP BY b.booking_id, b.date_preserved, b.start_date, b.end_date, c.name, c.phone_number,
                         s.name, s.position, t.amount, t.payment_method""",
        ),
        "booking_list": _with(_DETAIL_TABLES, newest),
        "booking_cards": _with(
            _DETAIL_TABLES,
            f"""SELECT "Booking_ID", coalesce("Customer_Name", 'Unknown') AS "Customer",
                coalesce("Customer_Phone", 'N/A') AS "Phone", coalesce("Cars_Rented", 'No cars') AS "Cars",
                strftime("Start_Date", '%b %d') AS "From", strftime("End_Date", '%b %d, %Y') AS "To",
                {_rupiah('"Total_Amount"')} AS "Amount", "Booking_Status" FROM ({newest})""",
        ),
        "booking_stats": _with(
            "r_booking",
            f"""SELECT count(CASE WHEN {is_today} THEN 1 END) AS "Today_Bookings",
                count(CASE WHEN b.start_date <= {TODAY} AND b.end_date >= {TODAY} THEN 1 END) AS "Active_Bookings",
                count(CASE WHEN b.start_date > {TODAY} THEN 1 END) AS "Upcoming_Bookings",
                count(CASE WHEN b.end_date < {TODAY} THEN 1 END) AS "Completed_Bookings",
                {_mean('sum(b.end_date - b.start_date)', 'count(*)', 1, 1)} AS "Avg_Rental_Duration"
                FROM r_booking b""",
        ),
        "search_bookings": _search("hot bolt"),
        "search_bookings_people": _search("#00000001", 3, 40),
        "search_bookings_wildcard": _search("bk%7_3"),
        "search_bookings_everything": _search("", 2),
        "search_bookings_deep_page": _search("0", 130),
        "search_bookings_common_term": _search("e"),
        "search_bookings_common_term_meta": _search_meta("e"),
        "search_bookings_json": _search_json("bk%7_3", 1, 40),
        "search_bookings_json_past_end": _search_json("hot bolt", 900),
        "search_bookings_meta": _search_meta("hot bolt"),
        "search_bookings_people_meta": _search_meta("#00000001", 3, 40),
        "recent_bookings_dashboard": _with(
            _DETAIL_TABLES,
            f"""SELECT "Booking_ID", "Customer_Name" AS customer_name, "Customer_Phone" AS customer_phone,
                "Cars_Rented" AS car_name, "Rental_Days" AS duration_days, "Booking_Status" AS status,
                "Total_Amount" AS total_amount FROM ({latest_four})""",
        ),
        "booking_labels": _with(
            "r_booking",
            f"""SELECT b.booking_id, {_status('b')} AS status, CAST(b.end_date - b.start_date + 1 AS INT) AS charged_days,
                coalesce(b.customer_id_card, 'Unknown') AS customer FROM r_booking b""",
        ),
    }


def _search_and_feed() -> dict[str, str]:
    matching = f"SELECT count(*) AS n FROM r_customer {_customer_condition('machinery')}"
    rows = _customer_search("machinery", 2, 50)
    newest_notes = "ORDER BY created_at DESC, message, type, user_id LIMIT 50"
    timeline = """SELECT * FROM (
        SELECT 'booking_created' AS activity_type, 'success' AS activity_status,
               'Booking ' || booking_id || ' created' AS activity_message,
               CAST(date_preserved AS TIMESTAMP) AS activity_time FROM r_booking
        UNION ALL
        SELECT 'payment_received', 'info', 'Payment ' || transaction_id || ' received', payment_date FROM r_tx)
        ORDER BY activity_time DESC, activity_type, activity_message LIMIT 5"""
    return {
        "search_customers": _with("r_customer", rows),
        "search_customers_deep_page": _with("r_customer", _customer_search("0", 1200, 9)),
        "search_customers_wildcard": _with("r_customer", _customer_search("fur%e 1_")),
        "search_customers_meta": _with("r_customer", _meta(matching, 2, 50)),
        "search_customers_json": _with(
            "r_customer",
            f"""SELECT '{{"data":[' || coalesce((SELECT string_agg('{{"ID_Card":"' || "ID_Card" || '","Name":"' || "Name"
                || '","Phone_Number":"' || "Phone_Number" || '","Address":"' || "Address" || '","Drivers_License":"'
                || "Drivers_License" || '"}}', ',' ORDER BY "Name", "ID_Card") FROM ({rows})), '') || '],"total":' || total
                || ',"per_page":' || per_page || ',"page":' || page || ',"total_pages":' || total_pages || '}}' AS json
                FROM ({_meta(matching, 2, 50)})""",
        ),
        "staff_search": _with(
            "r_staff",
            """SELECT staff_id AS "Staff_ID", name AS "Name", contact AS "Contact", position AS "Position" FROM r_staff
               WHERE contains(lower(staff_id || ' ' || name || ' ' || contact || ' ' || position), 'desk 1')""",
        ),
        "customer_quick_search": _with(
            "r_customer",
            f"""SELECT {_CUSTOMER} FROM r_customer WHERE contains(lower(id_card || ' ' || name || ' ' || phone_number
                || ' ' || address || ' ' || drivers_license), 'ery 2')""",
        ),
        "customer_picker": _with(
            "r_customer",
            """SELECT id_card AS "ID_Card", name AS "Name", phone_number AS "Phone_Number" FROM r_customer
               WHERE contains(lower(name), '#00000003')""",
        ),
        "dashboard_stats": _with(
            "r_customer r_car r_booking r_tx r_ct",
            f"""SELECT today_revenue, today_transactions, active_rentals, total_cars,
                total_cars - active_rentals AS available_cars, total_customers,
                {_share('active_rentals', 'total_cars')} AS utilization_rate FROM (
                SELECT CAST(coalesce(sum(amount), 0) AS DOUBLE) AS today_revenue, count(*) AS today_transactions,
                    (SELECT count(DISTINCT ct.car_car_id) FROM r_booking b JOIN r_tx t ON b.booking_id = t.booking_booking_id
                     JOIN r_ct ct ON t.transaction_id = ct.transaction_transaction_id
                     WHERE b.start_date <= {TODAY} AND b.end_date >= {TODAY}) AS active_rentals,
                    (SELECT count(*) FROM r_car) AS total_cars, (SELECT count(*) FROM r_customer) AS total_customers
                FROM r_tx WHERE payment_date::DATE = {TODAY})""",
        ),
        "activity_timeline": _with("r_booking r_tx", timeline),
        "activity_cards": _with(
            "r_booking r_tx",
            f"""SELECT activity_type, activity_status, activity_message,
                strftime(activity_time, '%b %d, %H:%M') AS activity_time FROM ({timeline})""",
        ),
        "notification_feed": _with("r_notification", f"SELECT * FROM r_notification {newest_notes}"),
        "notification_cards": _with(
            "r_notification",
            f"""SELECT * REPLACE (1 AS is_read, strftime(created_at, '%d %b %Y %H:%M') AS created_at)
                FROM (SELECT * FROM r_notification {newest_notes})""",
        ),
        "mark_read": _with("r_notification", "SELECT * REPLACE (1 AS is_read) FROM r_notification"),
        "car_labels": _with(
            "r_car",
            f"""SELECT car_id, {_rupiah('car_price * 1234')} AS price,
                CASE WHEN length(car_name) > 8 THEN car_name[:8] || '...' ELSE car_name END AS short_name,
                CASE WHEN length(car_name) = 0 THEN 'Never Rented' WHEN length(car_name) < 3 THEN 'Low Usage'
                     WHEN length(car_name) < 8 THEN 'Medium Usage' ELSE 'High Usage' END AS label FROM r_car""",
        ),
    }


def _intake() -> dict[str, str]:
    accepted_customers = """SELECT id_card, license_number AS drivers_license, full_name AS name,
        phone AS phone_number, address FROM d_customer WHERE reject_reason IS NULL"""
    customer_walk = "r_customer q_customer v_customer walk_customer d_customer"
    booking_tables = "r_customer r_staff r_car r_booking r_tx r_ct q_booking v_booking w_booking s_booking c_booking"

    def processed(query: str) -> str:
        return _with(booking_tables, query, WALK_BOOKING, POSTED, recursive=True)

    return {
        "validate_customers": _with("q_customer v_customer", "SELECT * FROM v_customer"),
        "dedupe_against_master": _with(customer_walk, "SELECT * FROM d_customer", recursive=True),
        "dedupe_against_master_collated": _with(
            customer_walk,
            """SELECT * REPLACE (CASE WHEN arrival % 2 = 0 THEN lower(license_number) ELSE license_number END AS license_number)
               FROM d_customer""",
            recursive=True,
        ),
        "ingest_customers": _with(
            customer_walk, f"SELECT * FROM r_customer UNION ALL BY NAME {accepted_customers}", recursive=True
        ),
        "validate_cars": _with("r_car_class v_car", "SELECT * FROM v_car"),
        "ingest_cars": _with(
            "r_car_class r_car v_car",
            """SELECT car_id, car_name, car_type, CAST(car_price AS DOUBLE) AS car_price, car_class_cc_id FROM (
               SELECT * FROM r_car UNION ALL BY NAME
               SELECT 'CAR' || lpad((row_number() OVER (ORDER BY arrival) + (SELECT max(p_partkey) FROM part))::VARCHAR, 8, '0') AS car_id,
                      car_name, car_type, daily_rate::DECIMAL(12,2) AS car_price, car_class_id AS car_class_cc_id
               FROM v_car WHERE reject_reason IS NULL)""",
        ),
        "validate_bookings": _with(
            "q_booking v_booking", """SELECT arrival, start, "end", reject_reason FROM v_booking"""
        ),
        "price_bookings": _with(
            "r_car q_booking v_booking",
            """SELECT b.arrival, CAST(b."end" - b.start + 1 AS INT) AS days,
               CAST(coalesce(c.car_price, 0) * (b."end" - b.start + 1) AS DOUBLE) AS total_amount
               FROM v_booking b LEFT JOIN r_car c ON c.car_id = b.car_id""",
        ),
        "resolve_booking_customer": _with(
            "r_customer q_booking v_booking w_booking s_booking",
            "SELECT arrival, reject_reason, customer_id_card, customer_drivers_license, is_new_customer FROM s_booking",
        ),
        "customers_from_bookings": _with(
            "r_customer q_booking v_booking w_booking s_booking",
            """SELECT id_card, license_number AS drivers_license, customer_search AS name,
               customer_phone AS phone_number, address FROM s_booking WHERE is_new_customer""",
        ),
        "assign_staff": _with(
            "r_staff q_booking v_booking",
            f"SELECT arrival, staff_id FROM ({STAFF_PICK.format(source='v_booking', seed=7)})",
        ),
        "availability_conflicts": _with(
            "r_booking r_tx r_ct q_booking v_booking c_booking",
            """SELECT v.arrival, v.car_id, c.conflict_count FROM v_booking v LEFT JOIN c_booking c ON c.arrival = v.arrival""",
        ),
        "admit_bookings": _with(
            "r_booking r_tx r_ct q_booking v_booking c_booking",
            """SELECT arrival, car_id, start, "end", reject_reason FROM d_dated""",
            WALK_DATED,
            recursive=True,
        ),
        "admit_bookings_stream": _with(
            "r_booking r_tx r_ct q_booking v_booking c_booking",
            "SELECT arrival, car_id, reject_reason FROM d_dated",
            WALK_DATED,
            recursive=True,
        ),
        "process_booking_requests": processed(
            """SELECT d.arrival, d.reject_reason, p.booking_id, p.transaction_id
               FROM d_booking d LEFT JOIN p_booking p ON p.arrival = d.arrival"""
        ),
        "booking_batch_retried": processed(
            """SELECT booking_id, 1::BIGINT AS payments, 1::BIGINT AS bridge_rows,
               CAST(total_amount AS DOUBLE) AS amount FROM p_booking"""
        ),
        "post_bookings": processed(
            f"""SELECT booking_id, {TODAY} AS date_preserved, start AS start_date, "end" AS end_date,
                customer_drivers_license, customer_id_card, staff_id AS staff_staff_id FROM p_booking"""
        ),
        "post_transactions": processed(
            f"""SELECT transaction_id, 'Cash' AS payment_method, CAST(total_amount AS DOUBLE) AS amount,
                {NOW} AS payment_date, staff_id AS staff_staff_id, booking_id AS booking_booking_id FROM p_booking"""
        ),
        "post_car_transactions": processed(
            "SELECT car_id AS car_car_id, transaction_id AS transaction_transaction_id FROM p_booking"
        ),
        "assign_ids": """SELECT o_orderkey AS arrival, 'BK' || lpad((row_number() OVER (ORDER BY o_orderkey)
            + (SELECT max(o_orderkey) FROM orders))::VARCHAR, 10, '0') AS booking_id FROM orders""",
    }


def _changes() -> dict[str, str]:
    customer_edits = """
        SELECT o_orderkey AS arrival, CASE WHEN o_orderkey % 23 = 0 THEN 'delete' WHEN o_orderkey % 41 = 0 THEN 'view'
               ELSE 'update' END AS action, lpad((o_custkey + 40)::VARCHAR, 16, '0') AS id_card,
               'Renamed ' || o_orderkey AS name, '05' || lpad(o_orderkey::VARCHAR, 10, '0') AS phone_number,
               o_orderpriority AS address, 'CL' || o_orderkey AS drivers_license
        FROM orders"""
    staff_edits = """
        SELECT c_custkey AS arrival, CASE WHEN c_custkey % 31 = 0 THEN 'delete' ELSE 'update' END AS action,
               'S' || lpad((c_custkey % 120)::VARCHAR, 4, '0') AS staff_id, 'Agent ' || c_custkey AS name,
               c_mktsegment AS position, '04' || lpad(c_custkey::VARCHAR, 10, '0') AS contact
        FROM customer"""

    def after(table: str, key: str, fields: list[str], edits: str = "edits") -> str:
        """The rows of a table after edits."""
        columns = ", ".join(f"CASE WHEN e.{key} IS NULL THEN t.{f} ELSE e.{f} END AS {f}" for f in fields)
        return f"""SELECT t.{key}, {columns} FROM {table} t
                LEFT JOIN (SELECT * FROM {edits} WHERE action = 'update'
                           QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY arrival DESC) = 1) e ON e.{key} = t.{key}
                WHERE t.{key} NOT IN (SELECT {key} FROM {edits} WHERE action = 'delete')"""

    def applied(table: str, edits: str, key: str, fields: list[str]) -> str:
        return _with(table, after(table, key, fields), f"edits AS ({edits})")

    def halves(edits: str) -> list[str]:
        return [f"edits_{n} AS (SELECT * FROM ({edits}) WHERE arrival % 2 = {n})" for n in (0, 1)]

    customer_fields = ["name", "phone_number", "address", "drivers_license"]
    staff_fields = ["name", "position", "contact"]
    booked = """n_customer AS (
        SELECT * FROM r_customer UNION ALL BY NAME
        SELECT id_card, license_number AS drivers_license, customer_search AS name, customer_phone AS phone_number,
               address FROM s_booking WHERE is_new_customer)"""
    customer_once = "(" + after("n_customer", "id_card", customer_fields, "edits_0") + ")"
    staff_twice = after("(" + after("r_staff", "staff_id", staff_fields, "edits_0") + ")", "staff_id", staff_fields, "edits_1")

    def log(edits: str, key: str, subject: str, kind: str, link: str) -> str:
        return f"""SELECT NULL::VARCHAR AS user_id,
            CASE action WHEN 'update' THEN '{subject} ''' || name || ''' updated successfully!'
                 ELSE '{subject} ID ''' || {key} || ''' deleted!' END AS message,
            CASE action WHEN 'update' THEN '{kind}' ELSE 'danger' END AS type,
            CASE action WHEN 'update' THEN '/pages/users.php?{link}=' || {key} ELSE '/pages/users.php' END AS link,
            0 AS is_read, {NOW} AS created_at
            FROM ({edits}) WHERE action IN ('update', 'delete')"""

    return {
        "apply_customer_changes": applied("r_customer", customer_edits, "id_card", customer_fields),
        "apply_staff_changes": applied("r_staff", staff_edits, "staff_id", staff_fields),
        "edit_batches_read_back": _with(
            "r_customer q_booking v_booking w_booking s_booking",
            after(customer_once, "id_card", customer_fields, "edits_1"),
            booked,
            *halves(customer_edits),
        ),
        "staff_edits_read_back": _with("r_staff", staff_twice, *halves(staff_edits)),
        "customer_change_notifications": log(customer_edits, "id_card", "Customer", "success", "customer_id"),
        "staff_change_notifications": log(staff_edits, "staff_id", "Staff", "info", "staff_id"),
        "failure_notifications": f"""SELECT NULL::VARCHAR AS user_id, 'Database error: event ' || event_id AS message,
            'danger' AS type, '/pages/users.php' AS link, 0 AS is_read, {NOW} AS created_at
            FROM events WHERE event_type = 'error'""",
    }


def _stored() -> dict[str, str]:
    return {
        "dump_bookings_read_back": _with("r_booking", "SELECT * FROM r_booking"),
        "customers_by_method_merged": _with(
            "r_tx r_booking",
            """SELECT t.payment_method AS "Payment_Method", count(DISTINCT b.customer_id_card) AS "Unique_Customers"
               FROM r_tx t JOIN r_booking b ON t.booking_booking_id = b.booking_id
               WHERE b.customer_id_card IS NOT NULL GROUP BY t.payment_method""",
        ),
        "customers_by_month_merged": _with(
            "r_tx r_booking",
            f"""SELECT CAST(year(b.start_date) AS INT) AS "Booking_Year", CAST(month(b.start_date) AS INT) AS "Booking_Month",
                monthname(b.start_date) AS "Month_Name", count(DISTINCT b.customer_id_card) AS "Unique_Customers"
                FROM r_tx t JOIN r_booking b ON t.booking_booking_id = b.booking_id
                WHERE {_window('b.start_date', 6)} AND b.customer_id_card IS NOT NULL GROUP BY 1, 2, 3""",
        ),
        "customers_merged": _with(
            "r_tx r_booking",
            """SELECT count(DISTINCT b.customer_id_card) AS "Unique_Customers"
               FROM r_tx t JOIN r_booking b ON t.booking_booking_id = b.booking_id""",
        ),
        "cars_ever_rented_merged": _with("r_ct", 'SELECT count(DISTINCT car_car_id) AS "Cars_Ever_Rented" FROM r_ct'),
        "dump_payments_read_back": _with("r_tx", "SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM r_tx"),
    }


def all_oracles() -> dict[str, str]:
    groups = (_months, _customers, _fleet, _payments, _bookings, _search_and_feed, _intake, _changes, _stored)
    found = {name: sql for group in groups for name, sql in group().items()}
    # The same searches by posting lists.
    lists = "search_bookings search_bookings_people search_bookings_meta search_customers search_customers_wildcard"
    lists += " staff_search customer_quick_search customer_picker"
    kept = "monthly_bookings revenue_growth monthly_revenue_report monthly_revenue_recent today_stats dashboard_stats"
    functions = "top_customers monthly_bookings revenue_growth monthly_revenue_report today_stats class_utilization"
    functions += " booking_labels car_labels"
    return (
        found
        | {f"{name}_indexed": found[name] for name in lists.split()}
        | {f"{name}_maintained": found[name] for name in kept.split()}
        | {f"{name}_sql": found[name] for name in functions.split()}
        | {"top_customers_by_bounds": found["top_customers"]}
        | {"payment_method_analysis_collated": found["payment_method_analysis"]}
    )
