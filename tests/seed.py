"""The ten-customer sample shop, and helpers to build small shops."""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession

from cartlight import schemas
from cartlight.tables import TABLE_NAMES, Tables

CATEGORIES = """1,Electronics
2,Clothing
3,Home Appliances
4,Books
5,Sports
6,Beauty"""

# id, name, category, price, stock, rating
PRODUCTS = """1,Laptop,1,65000,25,4.5
2,Smartphone,1,30000,40,4.4
3,Wireless Mouse,1,1200,100,4.3
4,Keyboard,1,1800,80,4.2
5,T-Shirt,2,800,150,4.1
6,Jeans,2,1800,100,4.4
7,Washing Machine,3,32000,20,4.5
8,Microwave Oven,3,12000,30,4.2
9,Python Programming,4,900,50,4.6
10,Data Science Book,4,1200,45,4.7
11,Cricket Bat,5,2500,35,4.3
12,Running Shoes,5,3500,60,4.5
13,Face Wash,6,500,100,4.0
14,Perfume,6,2500,40,4.2"""

CITIES = """1,Kolkata
2,Delhi
3,Siliguri
4,Mumbai
5,Ahmedabad
6,Kolkata
7,Bangalore
8,Pune
9,Patna
10,Guwahati"""

# id, customer, date, status, total
ORDERS = """1,1,2025-05-01,Delivered,66200
2,2,2025-05-03,Delivered,30800
3,3,2025-05-05,Delivered,2500
4,4,2025-05-08,Delivered,12000
5,5,2025-05-10,Delivered,3500
6,6,2025-05-15,Shipped,67000
7,7,2025-05-18,Delivered,4200
8,8,2025-05-20,Delivered,30000
9,9,2025-05-22,Pending,1800
10,10,2025-05-25,Delivered,900"""

# order, product, quantity, unit price
ORDER_ITEMS = """1,1,1,65000
1,3,1,1200
2,2,1,30000
2,4,1,1800
3,11,1,2500
4,8,1,12000
5,12,1,3500
6,1,1,65000
6,3,1,1200
6,4,1,1800
7,5,1,800
7,6,1,1800
7,13,2,500
8,2,1,30000
9,6,1,1800
10,9,1,900"""

PAYMENT_METHODS = """UPI
Credit Card
UPI
Debit Card
UPI
Credit Card
UPI
Net Banking
Cash on Delivery
UPI"""

# order, shipped, delivered, status
SHIPPING = """1,2025-05-02,2025-05-05,Delivered
2,2025-05-04,2025-05-07,Delivered
3,2025-05-06,2025-05-09,Delivered
4,2025-05-09,2025-05-13,Delivered
5,2025-05-11,2025-05-14,Delivered
6,2025-05-16,,In Transit
7,2025-05-19,2025-05-23,Delivered
8,2025-05-21,2025-05-25,Delivered
9,,,Processing
10,2025-05-26,2025-05-29,Delivered"""

# customer, product, rating
REVIEWS = """1,1,5
1,3,4
2,2,5
3,11,4
4,8,4
5,12,5
6,1,5
7,5,4
8,2,4
10,9,5"""


def _lines(text: str) -> list[list[str]]:
    return [line.split(",") for line in text.splitlines()]


def _day(text: str) -> date | None:
    return date.fromisoformat(text) if text else None


def customer(key, city=None, name=None):
    return (key, name or f"Customer {key}", f"c{key}@example.com", None, city, None, "India", None, None, None)


def product(key, name, category, price, stock=10, rating=4.0):
    return (key, name, category, price, stock, None, rating)


def order(key, who, day="2025-05-01", status="Delivered", total=100.0):
    return (key, who, _day(day) if isinstance(day, str) else day, status, total)


def item(key, order_id, product_id, quantity=1, price=100.0):
    return (key, order_id, product_id, quantity, price)


def shop(spark: SparkSession, **rows) -> Tables:
    """A shop with the given rows per table; missing tables are empty."""
    return Tables({
        name: spark.createDataFrame(rows.get(name, []), schemas.schema(name)) for name in TABLE_NAMES
    })


def seed_rows() -> dict[str, list[tuple]]:
    orders = [order(int(a), int(b), c, d, float(e)) for a, b, c, d, e in _lines(ORDERS)]
    methods = PAYMENT_METHODS.splitlines()
    return {
        "categories": [(int(a), b, None) for a, b in _lines(CATEGORIES)],
        "products": [product(int(a), b, int(c), float(d), int(e), float(f)) for a, b, c, d, e, f in _lines(PRODUCTS)],
        "customers": [customer(int(a), b) for a, b in _lines(CITIES)],
        "orders": orders,
        "order_items": [
            (i, int(a), int(b), int(c), float(d)) for i, (a, b, c, d) in enumerate(_lines(ORDER_ITEMS), 1)
        ],
        "payments": [
            (o[0], o[0], o[2], methods[o[0] - 1], "Pending" if o[0] == 9 else "Paid", o[4]) for o in orders
        ],
        "shipping": [(int(a), int(a), _day(b), _day(c), d, None) for a, b, c, d in _lines(SHIPPING)],
        "reviews": [(i, int(a), int(b), int(c), None, None) for i, (a, b, c) in enumerate(_lines(REVIEWS), 1)],
    }


def seed_tables(spark: SparkSession) -> Tables:
    return shop(spark, **seed_rows())
