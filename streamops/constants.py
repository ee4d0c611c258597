"""Values that define results."""

# Results depend on these exact texts and numbers.

USD_RATES = {"USD": "1", "EUR": "1.09", "UAH": "0.024"}
HIGH_RISK_ABOVE_USD = 1000
RISK_HIGH, RISK_LOW = "HIGH", "LOW"

PRICE_LIST = {"SKU-KEYBOARD": "79.99", "SKU-MONITOR": "349.00"}
HEADER_CORRELATION_ID = "correlation-id"
HEADER_REPLY_TO = "reply-to"
REPLY_TIMEOUT_SECONDS = 5

WINDOW_SIZE = "5 seconds"
EMIT_INTERVAL = "1 second"

RIDE_FARE_ABOVE = 10

ACCOUNT_CREDIT, ACCOUNT_DEBIT = "Deposited", "Withdrawn"

IMAGE_SUFFIX = ".jpg"
NO_DECODER = "no decoder for this file type"
FAILING_ENDPOINT = "always-500"
ENDPOINT_ERROR = "endpoint returned 500 Internal Server Error"
MAX_DELIVERY_ATTEMPTS = 3
RETRY_WAIT_MS = 200
DEAD_LETTER_TOPIC = "deadletter"

OP_CREATE, OP_UPDATE, OP_DELETE = "Create", "Update", "Delete"

OUTBOX_PENDING, OUTBOX_COMPLETED, OUTBOX_FAILED = "Pending", "Completed", "Failed"
DECODE_FAILED = "Failed to deserialize"
MAX_PUBLISH_RETRIES = 3

STEP_ORDER_CREATED = "order.created"
STEP_PAYMENT_CAPTURED = "payment.captured"
STEP_INVENTORY_FAILED = "inventory.failed"
STEP_ORDER_COMPLETED = "order.completed"
STEP_ORDER_CANCELLED = "order.cancelled"
ITEM_IN_STOCK, ITEM_RARE = "in-stock-item", "rare-item"
STATUS_OK, STATUS_FAILED, STATUS_REFUNDED = "ok", "failed", "refunded"
OUT_OF_STOCK = "out of stock"

REGION_PARTITIONS = {"eu": 0, "us": 1}

DEDUP_RETENTION_HOURS = 24
MICRO_BATCH_RECORDS = 100
MICRO_BATCH_INTERVAL = "5 seconds"

# Outcomes of handling one record.
SUCCESS, POISON, TRANSIENT = "success", "poison", "transient"
NO_ID = "record has no id"
