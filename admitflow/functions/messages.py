"""The messages the services answer with, and the limits
they enforce. Results must carry exactly these strings, so they are kept
here together, in the order each handler checks them."""

# Product create (catalog service).
SKU_REQUIRED = "sku is required"
NAME_REQUIRED = "name is required"
PRICE_NEGATIVE = "price_cents must not be negative"
STOCK_NEGATIVE = "stock must not be negative"
CURRENCY_CODE = "currency must be a 3-letter code"

# Order create (orders service).
NO_ITEMS = "an order must have at least one item"
TOO_MANY_ITEMS = "too many items in one order"
ITEM_NO_PRODUCT = "each item needs a product_id"
ITEM_BAD_QUANTITY = "each item needs a positive quantity"
ITEM_REPEATED = "each product may appear only once per order"
MAX_ITEMS_PER_ORDER = 50

# Charge (payment service).
ORDER_ID_REQUIRED = "order_id is required"
AMOUNT_NOT_POSITIVE = "amount_cents must be positive"
RESERVATION_IDS_REQUIRED = "order_id and product_id are required"
RESERVATION_BAD_QUANTITY = "quantity must be positive"

# Sign-up (auth service).
EMAIL_REQUIRED = "email is required"
EMAIL_TOO_LONG = "email is too long"
EMAIL_INVALID = "email is not a valid address"
EMAIL_MAX_BYTES = 254

# Payment outcome and order compensation.
CARD_DECLINED = "card declined"
PAYMENT_FAILED = "payment failed"
