"""Column types of the shop tables. Keys and foreign keys are bigint, money is double at rest."""

from __future__ import annotations

from pyspark.sql import types as T

# Table and column names, types, not-null flags.
_DDL = {
    "customers": """customer_id bigint not null, customer_name string not null, email string not null,
        phone string, city string, state string, country string, registration_date date,
        gender string, age int""",
    "categories": "category_id bigint not null, category_name string not null, description string",
    "products": """product_id bigint not null, product_name string not null, category_id bigint,
        price double, stock_quantity int, brand string, rating double""",
    "orders": """order_id bigint not null, customer_id bigint not null, order_date date,
        order_status string, total_amount double""",
    "order_items": """order_item_id bigint not null, order_id bigint not null,
        product_id bigint not null, quantity int not null, unit_price double""",
    "payments": """payment_id bigint not null, order_id bigint not null, payment_date date,
        payment_method string, payment_status string, amount double""",
    "shipping": """shipping_id bigint not null, order_id bigint not null, shipping_date date,
        delivery_date date, shipping_status string, shipping_city string""",
    "reviews": """review_id bigint not null, customer_id bigint not null, product_id bigint not null,
        rating int, review_text string, review_date date""",
}

PRIMARY_KEYS = {
    "customers": "customer_id",
    "categories": "category_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_item_id",
    "payments": "payment_id",
    "shipping": "shipping_id",
    "reviews": "review_id",
}

# Columns that identify the same real-world row when a batch is loaded twice.
NATURAL_KEYS = {
    "customers": ["email"],
    "categories": ["category_name"],
    "products": ["product_name", "category_id", "price", "brand"],
    "orders": ["order_id"],
    "order_items": ["order_item_id"],
    "payments": ["order_id", "payment_date", "payment_method", "amount"],
    "shipping": ["order_id"],
    "reviews": ["customer_id", "product_id", "review_date"],
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[table])


def as_text(table: str) -> T.StructType:
    """The same columns, all strings: the shape of raw form or CSV rows."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema(table).fields])
