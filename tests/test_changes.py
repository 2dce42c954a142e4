import datetime as dt

from fleetframe.operators import changes, notifications

NOW = dt.datetime(2024, 3, 10, 8, 30)
CHANGE = "arrival long, action string, id_card string, name string, phone_number string, address string, drivers_license string"


def test_edits_in_order_of_arrival(spark, small):
    frame = spark.createDataFrame(
        [
            (2, "update", "1111", "Second", "2", "A2", "D2"),
            (1, "update", "1111", "First", "1", "A1", "D1"),
            (3, "delete", "2222", None, None, None, None),
            (4, "update", "2222", "Back", "4", "A4", "D4"),
            (5, "update", "nobody", "Ghost", "5", "A5", "D5"),
            (6, "view", "3333", "Seen", "6", "A6", "D6"),
        ],
        CHANGE,
    )
    after = changes.apply_customer_changes(small.customer, frame)
    assert after.columns == small.customer.columns
    assert sorted(tuple(r) for r in after.collect()) == [
        ("1111", "D2", "Second", "2", "A2"),
        ("3333", "L3", "Citra 100%", "0833", "East_3"),
    ]
    log = notifications.customer_change_notifications(frame, NOW).collect()
    assert sorted((r.message, r.type, r.link) for r in log) == [
        ("Customer 'Back' updated successfully!", "success", "/pages/users.php?customer_id=2222"),
        ("Customer 'First' updated successfully!", "success", "/pages/users.php?customer_id=1111"),
        ("Customer 'Ghost' updated successfully!", "success", "/pages/users.php?customer_id=nobody"),
        ("Customer 'Second' updated successfully!", "success", "/pages/users.php?customer_id=1111"),
        ("Customer ID '2222' deleted!", "danger", "/pages/users.php"),
    ]
    assert {(r.user_id, r.is_read, r.created_at) for r in log} == {(None, 0, NOW)}


def test_updates_can_clear_fields(spark, small):
    frame = spark.createDataFrame([(1, "update", "1111", None, None, "A", None)], CHANGE)
    after = changes.apply_customer_changes(small.customer, frame).filter("id_card = '1111'").first()
    assert tuple(after) == ("1111", None, None, None, "A")


def test_staff_edits(spark, small):
    frame = spark.createDataFrame(
        [(1, "update", "S1", "Sinta", "Lead", "9"), (2, "delete", "S2", None, None, None)],
        "arrival long, action string, staff_id string, name string, position string, contact string",
    )
    assert [tuple(r) for r in changes.apply_staff_changes(small.staff, frame).collect()] == [
        ("S1", "Sinta", "Lead", "9")
    ]
    log = notifications.staff_change_notifications(frame, NOW).collect()
    assert sorted((r.message, r.type, r.link) for r in log) == [
        ("Staff 'Sinta' updated successfully!", "info", "/pages/users.php?staff_id=S1"),
        ("Staff ID 'S2' deleted!", "danger", "/pages/users.php"),
    ]


def test_feed_is_read_and_newest_first(make_tables):
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    tables = make_tables(
        notification=[(None, f"m{n}", "info", None, [0, 1, None][n % 3], at(n)) for n in range(55)]
    )
    feed = notifications.notification_feed(tables).collect()
    assert [r.message for r in feed] == [f"m{n}" for n in range(54, 4, -1)]
    read = notifications.mark_read(tables.notification)
    assert {r.is_read for r in read.collect()} == {1, None}
    assert notifications.notification_cards(tables, 1).first().created_at == "01 Jan 2024 00:54"


def test_failures_are_logged(spark):
    frame = spark.createDataFrame([("gone away",)], "error string")
    row = notifications.failure_notifications(frame, NOW).first()
    assert (row.message, row.type) == ("Database error: gone away", "danger")
