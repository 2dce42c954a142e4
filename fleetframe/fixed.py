"""Texts, limits and defaults that callers and stored data rely on."""

# Booking status, by date.
ACTIVE = "Active"
UPCOMING = "Upcoming"
COMPLETED = "Completed"
UNKNOWN = "Unknown"

# Customer tiers with the fewest bookings of each, highest first.
CUSTOMER_TIERS = [(5, "VIP Customer"), (3, "Regular Customer"), (1, "New Customer")]
NO_BOOKINGS_TIER = "Prospect"

# Usage labels with the number of rentals they stay below, lowest first.
USAGE_LEVELS = [(1, "Never Rented"), (3, "Low Usage"), (8, "Medium Usage")]
TOP_USAGE_LEVEL = "High Usage"

# Form checks.
BLANKS = " \t\n\r\0\x0b"
MISSING_TEXTS = ("", "0")
SIXTEEN_DIGITS = r"^[0-9]{16}\z"
PHONE_BYTES = 10
FIRST_MODEL_YEAR = 1990
NEW_CUSTOMER = "new_customer"

# Messages of new customers, in the order of their rules.
FIELDS_REQUIRED = "All fields are required"
CARD_FORMAT = "ID Card must be exactly 16 digits"
PHONE_FORMAT = "Phone number must be at least 10 digits"
PHONE_TAKEN = "Phone number already exists in our system"
LICENCE_TAKEN = "Driver license number already exists in our system"
CARD_TAKEN = "ID Card number already exists in our system"

# Messages of new cars, in the order of their rules.
YEAR_RANGE = "Invalid year. Must be between 1990 and {}"
RATE_POSITIVE = "Daily rate must be greater than 0"
CLASS_UNKNOWN = "Invalid car class selected"

# Messages of new bookings, in the order of their rules.
END_BEFORE_START = "End date must be after start date"
START_IN_PAST = "Start date cannot be in the past"
GUEST_FIELDS_REQUIRED = "All customer fields are required for new customer"
GUEST_PHONE_TAKEN = "Phone number already exists"
GUEST_CARD_TAKEN = "ID Card already exists"
GUEST_LICENCE_TAKEN = "Driver license already exists"
CUSTOMER_UNKNOWN = "Selected customer not found"
NO_STAFF = "No staff available to process booking"
CAR_UNAVAILABLE = "Car is not available for the selected dates"

# Payment method of a new booking.
FIRST_PAYMENT_METHOD = "Cash"

# Notification texts, kinds and links.
CUSTOMER_UPDATED = "Customer '{}' updated successfully!"
CUSTOMER_DELETED = "Customer ID '{}' deleted!"
STAFF_UPDATED = "Staff '{}' updated successfully!"
STAFF_DELETED = "Staff ID '{}' deleted!"
WRITE_FAILED = "Database error: {}"
USERS_LINK = "/pages/users.php"
CUSTOMER_LINK = "/pages/users.php?customer_id={}"
STAFF_LINK = "/pages/users.php?staff_id={}"

# Text shown in place of a missing value.
NOT_AVAILABLE = "N/A"
NO_CARS = "No cars"

# Our own messages, for values that do not fit their column.
RATE_TOO_LARGE = "Daily rate is out of range"
AMOUNT_TOO_LARGE = "Total amount is out of range"
