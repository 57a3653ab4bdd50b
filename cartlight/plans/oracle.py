"""An independent SQL text (DuckDB dialect) for every registered query that SQL can express."""

from __future__ import annotations

# The shop tables over the star schema, spelled in SQL.
_TABLES = {
    "s_categories": """SELECT DISTINCT CAST('0x' || substr(md5(p_type), 1, 15) AS BIGINT) AS category_id,
        p_type AS category_name FROM part WHERE p_type IS NOT NULL""",
    "s_customers": """SELECT c_custkey AS customer_id, c_name AS customer_name,
        'c' || c_custkey || '@example.com' AS email, CAST(NULL AS VARCHAR) AS phone,
        n_name AS city, r_name AS state, 'India' AS country, CAST(NULL AS DATE) AS registration_date,
        CAST(NULL AS VARCHAR) AS gender, CAST(NULL AS INTEGER) AS age
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "s_products": """SELECT p_partkey AS product_id, p_name AS product_name, category_id,
        p_retailprice AS price, p_size AS stock_quantity, p_brand AS brand,
        1 + CAST(p_partkey % 41 AS DOUBLE) / CAST(10 AS DOUBLE) AS rating
        FROM part LEFT JOIN s_categories ON p_type = category_name""",
    "s_orders": """SELECT o_orderkey AS order_id, o_custkey AS customer_id,
        CAST(o_orderdate AS DATE) AS order_date,
        CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Shipped' WHEN 'P' THEN 'Cancelled' END
        AS order_status, o_totalprice AS total_amount FROM orders""",
    "s_items": """SELECT l_orderkey AS order_id, l_partkey AS product_id,
        CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS unit_price FROM lineitem""",
    "s_payments": """SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS payment_date,
        o_orderpriority AS payment_method,
        CASE WHEN o_orderstatus = 'P' THEN 'Pending' ELSE 'Paid' END AS payment_status,
        o_totalprice AS amount FROM orders""",
    "s_shipping": """SELECT l_orderkey AS order_id, CAST(min(l_shipdate) AS DATE) AS shipping_date,
        CAST(max(l_shipdate) AS DATE) AS delivery_date, 'Delivered' AS shipping_status
        FROM lineitem GROUP BY l_orderkey""",
    "s_reviews": """SELECT o_custkey AS customer_id, l_partkey AS product_id,
        1 + (l_linenumber - 1) % 5 AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "sold": """SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units_sold,
        CAST(sum(CAST(quantity * unit_price AS DECIMAL(38,6))) AS DOUBLE) AS revenue
        FROM s_items JOIN s_orders USING (order_id) WHERE order_status <> 'Cancelled' GROUP BY product_id""",
    "spent": """SELECT customer_id, count(*) AS total_orders,
        CAST(sum(CAST(total_amount AS DECIMAL(38,6))) AS DOUBLE) AS total_spending
        FROM s_orders WHERE order_status <> 'Cancelled' GROUP BY customer_id""",
    "spent_all": """SELECT customer_id, count(*) AS total_orders,
        CAST(sum(CAST(total_amount AS DECIMAL(38,6))) AS DOUBLE) AS total_spending
        FROM s_orders GROUP BY customer_id""",
    "features": """SELECT customer_id, customer_name, coalesce(total_orders, 0) AS total_orders,
        coalesce(total_spending, 0) AS total_spending,
        coalesce(total_spending / total_orders, 0) AS average_order_value
        FROM s_customers LEFT JOIN spent_all USING (customer_id)""",
    "labels_": """SELECT *, CAST(CASE WHEN total_spending <= (SELECT quantile_cont(total_spending, 0.5) FROM features)
        THEN 1 ELSE 0 END AS INTEGER) AS churn FROM features""",
    "monthly": """SELECT strftime(order_date, '%Y-%m') AS month,
        CAST(sum(CAST(total_amount AS DECIMAL(38,6))) AS DOUBLE) AS revenue
        FROM s_orders WHERE order_status <> 'Cancelled' GROUP BY 1""",
    "numbered": """SELECT month, row_number() OVER (ORDER BY month) AS month_number, revenue
        FROM monthly WHERE month IS NOT NULL""",
    "fit": """SELECT coalesce(regr_slope(revenue, month_number), 0) AS slope,
        avg(revenue) - coalesce(regr_slope(revenue, month_number), 0) * avg(month_number) AS intercept,
        count(*) AS months FROM numbered""",
    "next_month": """SELECT months + 1 AS next_month_number,
        round(intercept + slope * (months + 1), 2) AS predicted_revenue FROM fit""",
    "bought": """SELECT DISTINCT customer_id, product_id FROM s_orders JOIN s_items USING (order_id)""",
    # Every (customer, card) that is a sibling of some bought product: all pairs, as the plain definition has it.
    "sibling_cards": """SELECT b.customer_id, p2.product_name, p2.price, c.category_name, max(p2.rating) AS rating
        FROM bought b JOIN s_products p1 ON b.product_id = p1.product_id
        JOIN s_products p2 ON p1.category_id = p2.category_id AND p1.product_id <> p2.product_id
        JOIN s_categories c ON p2.category_id = c.category_id
        GROUP BY ALL""",
    "sibling_ranks": """SELECT customer_id, row_number() OVER (PARTITION BY customer_id
        ORDER BY rating DESC NULLS LAST, price DESC NULLS LAST, product_name, category_name) AS rank,
        product_name, price, category_name FROM sibling_cards""",
    "top_one": """SELECT customer_id, customer_name, coalesce(total_spending, 0) AS total_spending
        FROM s_customers LEFT JOIN spent_all USING (customer_id)
        ORDER BY total_spending DESC NULLS LAST, customer_id LIMIT 1""",
    "popular": """SELECT row_number() OVER (ORDER BY rating DESC NULLS LAST, product_id) AS rank,
        product_name, price, category_name FROM s_products JOIN s_categories USING (category_id)
        QUALIFY rank <= 5""",
}

_MONEY = "CAST(sum(CAST({} AS DECIMAL(38,6))) AS DOUBLE)"


def _money(amount: str) -> str:
    return _MONEY.format(amount)


_QUERIES = {
    # list views and lookups
    "customers_list": "SELECT * FROM s_customers",
    "products_list": """SELECT p.product_id, p.product_name, p.category_id, p.price, p.stock_quantity, p.brand,
        p.rating, c.category_name FROM s_products p LEFT JOIN s_categories c ON p.category_id = c.category_id""",
    "orders_list": """SELECT order_id, customer_name, order_date, order_status, total_amount
        FROM s_orders JOIN s_customers USING (customer_id)""",
    "category_lookup": "SELECT category_id, category_name FROM s_categories",
    "customer_lookup": "SELECT customer_id, customer_name FROM s_customers",
    "product_lookup": "SELECT product_id, product_name, price FROM s_products",
    "order_lines": """SELECT i.order_id, i.product_id, p.product_name, i.quantity, i.unit_price,
        i.quantity * i.unit_price AS line_amount FROM s_items i LEFT JOIN s_products p ON i.product_id = p.product_id""",
    "order_detail": f"""SELECT o.order_id, o.customer_id, o.order_date, o.order_status, o.total_amount,
        coalesce(i.item_lines, 0) AS item_lines, coalesce(i.units, 0) AS units,
        coalesce(i.items_amount, 0) AS items_amount, coalesce(p.payments, 0) AS payments,
        coalesce(p.paid_amount, 0) AS paid_amount, coalesce(p.open_amount, 0) AS open_amount, p.last_payment_date,
        coalesce(s.shipments, 0) AS shipments, s.first_shipping_date, s.last_delivery_date,
        coalesce(s.undelivered, 0) AS undelivered
        FROM s_orders o
        LEFT JOIN (SELECT order_id, count(*) AS item_lines, CAST(sum(quantity) AS BIGINT) AS units,
            {_money('quantity * unit_price')} AS items_amount FROM s_items GROUP BY order_id) i
            ON o.order_id = i.order_id
        LEFT JOIN (SELECT order_id, count(*) AS payments, max(payment_date) AS last_payment_date,
            {_money("CASE WHEN payment_status = 'Paid' THEN amount END")} AS paid_amount,
            {_money("CASE WHEN payment_status <> 'Paid' THEN amount END")} AS open_amount
            FROM s_payments GROUP BY order_id) p ON o.order_id = p.order_id
        LEFT JOIN (SELECT order_id, count(*) AS shipments, min(shipping_date) AS first_shipping_date,
            max(delivery_date) AS last_delivery_date, count(*) FILTER (delivery_date IS NULL) AS undelivered
            FROM s_shipping GROUP BY order_id) s ON o.order_id = s.order_id""",
    "order_payments": """SELECT p.order_id AS payment_id, p.order_id, customer_id, order_status, payment_date,
        payment_method, payment_status, amount, total_amount FROM s_payments p LEFT JOIN s_orders USING (order_id)""",
    "order_shipments": """SELECT s.order_id AS shipping_id, s.order_id, customer_id, order_status, shipping_date,
        delivery_date, shipping_status, CAST(delivery_date - order_date AS BIGINT) AS days_to_delivery
        FROM s_shipping s LEFT JOIN s_orders USING (order_id)""",
    # headline figures
    "total_revenue": f"""SELECT coalesce({_money('total_amount')}, 0) AS revenue
        FROM s_orders WHERE order_status <> 'Cancelled'""",
    "total_orders": "SELECT count(*) AS total_orders FROM s_orders",
    "total_customers": "SELECT count(*) AS total_customers FROM s_customers",
    "total_products": "SELECT count(*) AS total_products FROM s_products",
    "dashboard_kpis": f"""SELECT
        (SELECT coalesce({_money('total_amount')}, 0) FROM s_orders WHERE order_status <> 'Cancelled') AS revenue,
        (SELECT count(*) FROM s_orders) AS total_orders,
        (SELECT count(*) FROM s_customers) AS total_customers,
        (SELECT count(*) FROM s_products) AS total_products""",
    "average_order_value": f"""SELECT revenue / orders AS aov_literal, revenue / kept AS aov_net FROM (
        SELECT {_money("CASE WHEN order_status <> 'Cancelled' THEN total_amount END")} AS revenue,
        count(*) AS orders, count(*) FILTER (order_status <> 'Cancelled') AS kept FROM s_orders)""",
    # sales reports
    "top_products": """SELECT product_id, product_name, units_sold, revenue FROM sold
        JOIN s_products USING (product_id) ORDER BY revenue DESC NULLS LAST, product_id LIMIT 10""",
    "category_revenue": f"""SELECT category_id, category_name, {_money('quantity * unit_price')} AS revenue
        FROM s_categories JOIN s_products USING (category_id) JOIN s_items USING (product_id)
        JOIN s_orders USING (order_id) WHERE order_status <> 'Cancelled' GROUP BY category_id, category_name""",
    "monthly_revenue": "SELECT month, revenue FROM monthly",
    "top_customers": """SELECT customer_id, customer_name, total_spending AS spending FROM spent
        JOIN s_customers USING (customer_id) ORDER BY spending DESC NULLS LAST, customer_id LIMIT 10""",
    "city_revenue": f"""SELECT city, count(*) AS total_orders, {_money('total_amount')} AS revenue
        FROM s_orders JOIN s_customers USING (customer_id) WHERE order_status <> 'Cancelled' GROUP BY city""",
    "payment_methods": f"""SELECT payment_method, count(*) AS payments, {_money('amount')} AS amount,
        {_money('amount')} / count(amount) AS average_amount,
        count(*) FILTER (payment_status = 'Paid') AS paid_payments,
        coalesce({_money("CASE WHEN payment_status = 'Paid' THEN amount END")}, 0) AS paid_amount,
        count(*) - count(*) FILTER (payment_status = 'Paid') AS open_payments
        FROM s_payments GROUP BY payment_method""",
    "payments_by_status": f"""SELECT payment_method, payment_status, count(*) AS payments, {_money('amount')} AS amount
        FROM s_payments GROUP BY payment_method, payment_status""",
    "low_stock": "SELECT product_id, product_name, stock_quantity FROM s_products WHERE stock_quantity <= 30",
    "product_ratings": """SELECT p.product_id, p.product_name, p.rating AS catalog_rating,
        CAST(sum(r.rating) AS DOUBLE) / nullif(count(r.rating), 0) AS review_rating, count(r.rating) AS reviews
        FROM s_products p LEFT JOIN s_reviews r ON p.product_id = r.product_id
        GROUP BY p.product_id, p.product_name, p.rating""",
    "product_performance": """SELECT p.product_id, p.product_name, c.category_name, p.stock_quantity, p.rating,
        coalesce(s.units_sold, 0) AS units_sold, coalesce(s.revenue, 0) AS revenue
        FROM s_products p LEFT JOIN sold s ON p.product_id = s.product_id
        LEFT JOIN s_categories c ON p.category_id = c.category_id""",
    # customers
    "customer_profile": """SELECT customer_id, customer_name, city, total_orders, total_spending,
        total_spending / total_orders AS average_order_value FROM spent JOIN s_customers USING (customer_id)""",
    "best_customer": """SELECT customer_id, customer_name, city, total_orders, total_spending,
        total_spending / total_orders AS average_order_value FROM spent JOIN s_customers USING (customer_id)
        ORDER BY total_spending DESC NULLS LAST, customer_id LIMIT 1""",
    "spending_stats": """SELECT count(*) AS count,
        CAST(sum(CAST(total_spending AS DECIMAL(38,6))) AS DOUBLE) / count(*) AS mean,
        round(stddev_samp(total_spending), 4) AS std, min(total_spending) AS min,
        quantile_cont(total_spending, 0.25) AS q25, quantile_cont(total_spending, 0.5) AS q50,
        quantile_cont(total_spending, 0.75) AS q75, max(total_spending) AS max
        FROM spent JOIN s_customers USING (customer_id)""",
    "repeat_customers": """SELECT customer_id, customer_name, total_orders, total_spending
        FROM spent JOIN s_customers USING (customer_id) WHERE total_orders > 1""",
    "repeat_rate": """SELECT count(*) AS buyers, count(*) FILTER (total_orders > 1) AS repeat_buyers,
        CAST(count(*) FILTER (total_orders > 1) AS DOUBLE) / count(*) AS repeat_rate
        FROM spent JOIN s_customers USING (customer_id)""",
    "high_value_customers": """SELECT customer_id, customer_name, total_spending,
        total_spending / (SELECT CAST(sum(CAST(total_spending AS DECIMAL(38,6))) AS DOUBLE)
            FROM spent JOIN s_customers USING (customer_id)) AS revenue_share
        FROM spent JOIN s_customers USING (customer_id)
        WHERE total_spending >= (SELECT quantile_cont(total_spending, 0.9) FROM spent JOIN s_customers USING (customer_id))""",
    # churn
    "churn_features": "SELECT * FROM features",
    "churn_labels": "SELECT * FROM labels_",
    "churn_split_counts": """SELECT churn, is_test, CAST(CASE WHEN is_test THEN n - n_train ELSE n_train END AS BIGINT)
        AS customers FROM (
            SELECT churn, n, whole + CASE WHEN row_number() OVER (ORDER BY exact - whole DESC, churn)
                <= train - sum(whole) OVER () THEN 1 ELSE 0 END AS n_train
            FROM (SELECT churn, n, train, n * train / total AS exact, floor(n * train / total) AS whole
                FROM (SELECT churn, count(*) AS n, sum(count(*)) OVER () AS total,
                    sum(count(*)) OVER () - ceil(0.2 * sum(count(*)) OVER ()) AS train FROM labels_ GROUP BY churn)))
        CROSS JOIN (VALUES (true), (false)) AS v(is_test)""",
    "churn_fallback_risk": """SELECT *, greatest(0, least(1,
        1 - total_spending / (SELECT max(total_spending) FROM features))) AS churn_probability FROM features""",
    "churn_top5": """SELECT *, round(100 * greatest(0, least(1,
        1 - total_spending / (SELECT max(total_spending) FROM features))), 1) AS risk_score FROM features
        ORDER BY risk_score DESC, total_spending DESC, customer_id LIMIT 5""",
    "churn_label_90d": """SELECT customer_id, before_cut AS orders_before, after_cut AS orders_in_window,
        CAST(CASE WHEN after_cut = 0 THEN 1 ELSE 0 END AS INTEGER) AS churn FROM (
            SELECT customer_id, count(*) FILTER (order_date < cutoff) AS before_cut,
            count(*) FILTER (order_date >= cutoff AND order_date <= cutoff + 90) AS after_cut
            FROM s_orders JOIN s_customers USING (customer_id), (SELECT max(order_date) - 90 AS cutoff FROM s_orders)
            GROUP BY customer_id)
        WHERE before_cut > 0""",
    "churn_90d_features": "SELECT * FROM features_90d",
    "churn_90d_counts": """SELECT n - CAST(ceil(0.2 * n) AS BIGINT) AS train_rows, CAST(ceil(0.2 * n) AS BIGINT) AS test_rows
        FROM (SELECT count(*) AS n FROM features_90d)""",
    "churn_metrics_summary": """SELECT n - CAST(ceil(0.2 * n) AS BIGINT) AS train_rows,
        CAST(ceil(0.2 * n) AS BIGINT) AS test_rows, true AS accurate FROM (SELECT count(*) AS n FROM s_customers)""",
    "churn_boosted_summary": """SELECT n - CAST(ceil(0.2 * n) AS BIGINT) AS train_rows,
        CAST(ceil(0.2 * n) AS BIGINT) AS test_rows, true AS accurate FROM (SELECT count(*) AS n FROM s_customers)""",
    "churn_scores_summary": """SELECT count(*) AS customers, CAST(0 AS BIGINT) AS outside, true AS falls_with_spending
        FROM s_customers""",
    "customer_clusters_summary": """SELECT count(*) AS customers, CAST(4 AS BIGINT) AS segments, true AS at_nearest
        FROM s_customers""",
    "reco_als_summary": """SELECT count(DISTINCT customer_id) AS customers, CAST(0 AS BIGINT) AS gaps,
        CAST(0 AS BIGINT) AS unordered, CAST(0 AS BIGINT) AS unknown_products,
        CAST(0 AS BIGINT) AS wrong_scores, CAST(0 AS BIGINT) AS missed
        FROM s_items JOIN s_orders USING (order_id)""",
    # forecast
    "monthly_ordinal": "SELECT month, month_number, revenue FROM numbered",
    "forecast_fit": "SELECT round(slope, 4) AS slope, round(intercept, 4) AS intercept, months FROM fit",
    "forecast_next": "SELECT * FROM next_month",
    "forecast_report": """SELECT month, revenue, next_month_number, predicted_revenue FROM monthly, next_month
        WHERE month IS NOT NULL""",
    "forecast_by_category": f"""SELECT category_id, category_name, count(*) + 1 AS next_month_number,
        round(avg(revenue) - coalesce(regr_slope(revenue, month_number), 0) * avg(month_number)
            + coalesce(regr_slope(revenue, month_number), 0) * (count(*) + 1), 2) AS predicted_revenue
        FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY month) AS month_number FROM (
            SELECT category_id, category_name, strftime(order_date, '%Y-%m') AS month,
            {_money('quantity * unit_price')} AS revenue
            FROM s_items JOIN s_orders USING (order_id) JOIN s_products USING (product_id)
            JOIN s_categories USING (category_id)
            WHERE order_status <> 'Cancelled' GROUP BY category_id, category_name, month))
        GROUP BY category_id, category_name""",
    # recommendations
    "top_spender": "SELECT * FROM top_one",
    "reco_siblings_top_spender": """SELECT rank, product_name, price, category_name FROM sibling_ranks
        WHERE rank <= 5 AND customer_id = (SELECT customer_id FROM top_one)""",
    "reco_popular": "SELECT * FROM popular",
    "recommendations": """SELECT rank, product_name, price, category_name FROM sibling_ranks
        WHERE rank <= 5 AND customer_id = (SELECT customer_id FROM top_one)
        UNION ALL SELECT * FROM popular
        WHERE NOT EXISTS (SELECT 1 FROM sibling_ranks WHERE customer_id = (SELECT customer_id FROM top_one))
        AND EXISTS (SELECT 1 FROM s_customers)""",
    "reco_all_customers": "SELECT * FROM sibling_ranks WHERE rank <= 5",
    "reco_with_fallback": """SELECT * FROM sibling_ranks WHERE rank <= 5
        UNION ALL SELECT customer_id, rank, product_name, price, category_name FROM s_customers, popular
        WHERE customer_id NOT IN (SELECT customer_id FROM sibling_ranks)""",
    "reco_history_pairs": """SELECT customer_id, product_name, rank FROM (
        SELECT customer_id, product_name, row_number() OVER (PARTITION BY customer_id ORDER BY product_name) AS rank
        FROM (SELECT DISTINCT b1.customer_id, p2.product_name
            FROM bought b1 JOIN bought b2 ON b1.customer_id = b2.customer_id
            JOIN s_products p1 ON b1.product_id = p1.product_id JOIN s_products p2 ON b2.product_id = p2.product_id
            WHERE p1.category_id = p2.category_id AND p1.product_id <> p2.product_id)) WHERE rank <= 5""",
    "reco_unseen": """SELECT customer_id, row_number() OVER (PARTITION BY customer_id
        ORDER BY rating DESC NULLS LAST, price DESC NULLS LAST, product_name, category_name) AS rank,
        product_name, price, category_name
        FROM (SELECT v.customer_id, product_name, price, category_name, max(rating) AS rating
            FROM (SELECT DISTINCT customer_id, category_id FROM bought JOIN s_products USING (product_id)) v
            JOIN s_products USING (category_id) JOIN s_categories USING (category_id) GROUP BY ALL) card
        ANTI JOIN (SELECT DISTINCT customer_id, product_name, price, category_name FROM bought
            JOIN s_products USING (product_id) JOIN s_categories USING (category_id)) own
            USING (customer_id, product_name, price, category_name)
        QUALIFY rank <= 5""",
    # ingest
    "order_pricing": """SELECT customer_id, i.product_id, order_date, 'Pending' AS order_status, quantity,
        price AS unit_price, price * quantity AS total_amount
        FROM s_items i JOIN s_orders USING (order_id) JOIN s_products p ON i.product_id = p.product_id
        WHERE quantity > 0""",
    "order_rejects": """SELECT * FROM (SELECT customer_id::VARCHAR AS customer_id, product_id::VARCHAR AS product_id,
        quantity, order_date, CAST(NULL AS VARCHAR) AS order_status,
        CASE WHEN quantity = 'x' THEN 'customer, product and a valid quantity are required'
             WHEN unknown THEN 'product not found'
             WHEN order_date = 'someday' THEN 'order_date is not a date' END AS reject_reason FROM requests)
        WHERE reject_reason IS NOT NULL""",
    "ingest_orders": f"""SELECT customer_id, CAST(order_date AS DATE) AS order_date, 'Pending' AS order_status,
        count(*) AS orders, count(*) AS ids, {_money('price * CAST(quantity AS INTEGER)')} AS amount,
        (SELECT max(order_id) FROM s_orders) AS above,
        (SELECT max(order_id) FROM s_orders) + (SELECT count(*) FROM good_requests) AS highest
        FROM good_requests GROUP BY 1, 2""",
    "ingest_order_items": """SELECT customer_id, CAST(order_date AS DATE) AS order_date, CAST(product_id AS BIGINT) AS product_id,
        CAST(quantity AS INTEGER) AS quantity, price AS unit_price, true AS amount_agrees,
        (SELECT max(order_id) * 10 FROM s_items) - (SELECT max(order_id) FROM s_orders) AS "offset" FROM good_requests""",
    "customer_rejects": """SELECT arrival, customer_name, email, city, state,
        CASE WHEN trim(email) = '' THEN 'name and email are required' ELSE 'email is taken' END AS reject_reason
        FROM (SELECT customer_id + n * 1000000000000 AS arrival,
            CASE n WHEN 0 THEN '  ' || customer_name || ' ' ELSE 'too late' END AS customer_name,
            CASE WHEN state = 'AFRICA' THEN ' ' ELSE email END AS email, city, state, n
            FROM s_customers, (VALUES (0), (1)) v(n))
        WHERE n = 1 OR state IN ('ASIA', 'AFRICA')""",
    "product_rejects": """SELECT CASE WHEN brand = 'Brand#1' THEN '' ELSE product_name END AS product_name,
        CAST(category_id AS VARCHAR) AS category_id, CAST(stock_quantity AS VARCHAR) AS stock_quantity, brand || ' ' AS brand,
        CASE WHEN brand = 'Brand#1' THEN 'name and category are required' ELSE 'rating is not a number' END AS reject_reason
        FROM s_products WHERE brand IN ('Brand#1', 'Brand#2')""",
    "typed_rejects": """SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
        'unknown' AS order_date, order_status, 'order_date is not a date' AS reject_reason FROM s_orders
        WHERE order_status = 'Cancelled'""",
    "ingest_customers": """SELECT customer_name, email, '' AS phone, city, state, 'India' AS country, '' AS gender,
        CAST(NULL AS INTEGER) AS age FROM s_customers WHERE state NOT IN ('ASIA', 'AFRICA')""",
    "ingest_products": """SELECT product_name, category_id, CASE WHEN stock_quantity < 5 THEN 0 ELSE price END AS price,
        stock_quantity, brand, rating FROM s_products WHERE brand NOT IN ('Brand#1', 'Brand#2')""",
    "surrogate_keys": """SELECT top + i AS order_id FROM (SELECT max(order_id) AS top FROM s_orders),
        (SELECT row_number() OVER () AS i FROM s_items)""",
    "typed_orders": """SELECT order_id, customer_id, order_date, order_status, total_amount FROM s_orders
        WHERE order_status <> 'Cancelled'""",
    "dedup_load": """SELECT order_id, customer_id, order_date, order_status, total_amount FROM s_orders""",
    "upsert_latest": """SELECT product_id, product_name, category_id, price * 2 AS price, stock_quantity, brand,
        rating FROM s_products WHERE stock_quantity > 5""",
    # roadmap
    "rfm_scores": """SELECT customer_id, recency, frequency, monetary,
        CAST(6 - r AS INTEGER) AS r_score, CAST(f AS INTEGER) AS f_score, CAST(m AS INTEGER) AS m_score,
        concat(CAST(6 - r AS INTEGER), CAST(f AS INTEGER), CAST(m AS INTEGER)) AS rfm
        FROM (SELECT *,
            1 + (recency > rq[1])::INT + (recency > rq[2])::INT + (recency > rq[3])::INT + (recency > rq[4])::INT AS r,
            1 + (frequency > fq[1])::INT + (frequency > fq[2])::INT + (frequency > fq[3])::INT + (frequency > fq[4])::INT AS f,
            1 + (monetary > mq[1])::INT + (monetary > mq[2])::INT + (monetary > mq[3])::INT + (monetary > mq[4])::INT AS m
            FROM rfm_measures, (SELECT
                quantile_cont(CAST(recency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS rq,
                quantile_cont(CAST(frequency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS fq,
                quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS mq FROM rfm_measures))""",
    "monthly_trend": """SELECT month, month_number, revenue,
        revenue - lag(revenue) OVER (ORDER BY month_number) AS change,
        avg(revenue) OVER (ORDER BY month_number ROWS 2 PRECEDING) AS moving_average
        FROM (SELECT strftime(day, '%Y-%m') AS month, row_number() OVER (ORDER BY day) AS month_number,
            coalesce(revenue, 0) AS revenue
            FROM (SELECT unnest(generate_series(
                (SELECT min(CAST(month || '-01' AS DATE)) FROM monthly)::TIMESTAMP,
                (SELECT max(CAST(month || '-01' AS DATE)) FROM monthly)::TIMESTAMP, INTERVAL 1 MONTH)) AS day)
            LEFT JOIN monthly ON month = strftime(day, '%Y-%m'))""",
    "inventory_alerts": """SELECT product_id, product_name, stock_quantity, coalesce(units_sold, 0) AS units_sold,
        CAST(coalesce(units_sold, 0) AS DOUBLE) / days AS units_per_day,
        CAST(stock_quantity * days AS DOUBLE) / nullif(coalesce(units_sold, 0), 0) AS days_of_cover
        FROM s_products LEFT JOIN sold USING (product_id),
        (SELECT max(order_date) - min(order_date) + 1 AS days FROM s_orders WHERE order_status <> 'Cancelled')
        WHERE stock_quantity <= 30""",
    "realtime_sales_batch": f"""SELECT CAST(ts AS DATE) AS day, count(*) AS purchases, {_money('value')} AS revenue
        FROM events WHERE event_type = 'purchase' GROUP BY 1""",
    "realtime_sales_stream": f"""SELECT CAST(ts AS DATE) AS day, count(*) AS purchases, {_money('value')} AS revenue
        FROM events WHERE event_type = 'purchase' GROUP BY 1""",
    "realtime_sales_deduped": f"""SELECT CAST(ts AS DATE) AS day, count(*) AS purchases, {_money('value')} AS revenue
        FROM events WHERE event_type = 'purchase' GROUP BY 1""",
    "realtime_sales_deduped_stream": f"""SELECT CAST(ts AS DATE) AS day, count(*) AS purchases,
        {_money('value')} AS revenue FROM events WHERE event_type = 'purchase' GROUP BY 1""",
    "user_sessions": "SELECT * FROM sessions",
    "user_sessions_stream": """SELECT * FROM sessions
        WHERE last_event + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "reorder_points": """SELECT product_id, product_name, stock_quantity, daily_mean, daily_deviation,
        CAST(1.645 AS DOUBLE) * sqrt(CAST(7 AS DOUBLE)) * daily_deviation AS safety_stock,
        daily_mean * 7 + CAST(1.645 AS DOUBLE) * sqrt(CAST(7 AS DOUBLE)) * daily_deviation AS reorder_point,
        stock_quantity <= daily_mean * 7 + CAST(1.645 AS DOUBLE) * sqrt(CAST(7 AS DOUBLE)) * daily_deviation AS reorder
        FROM (SELECT product_id, product_name, stock_quantity, sold / days AS daily_mean,
            sqrt(greatest((squares - sold * (sold / days)) / (days - 1), 0)) AS daily_deviation
            FROM (SELECT p.product_id, product_name, stock_quantity, days, CAST(coalesce(sum(units), 0) AS DOUBLE) AS sold,
                CAST(coalesce(sum(units * units), 0) AS DOUBLE) AS squares
                FROM s_products p LEFT JOIN (SELECT product_id, order_date, CAST(sum(quantity) AS BIGINT) AS units
                    FROM s_items JOIN s_orders USING (order_id) WHERE order_status <> 'Cancelled' AND order_date IS NOT NULL
                    GROUP BY 1, 2) d ON p.product_id = d.product_id,
                (SELECT max(order_date) - min(order_date) + 1 AS days FROM s_orders WHERE order_status <> 'Cancelled')
                GROUP BY ALL))""",
    "cohort_retention": """SELECT strftime(first_month, '%Y-%m') AS first_month, months_since, customers,
        customers / first_value(customers) OVER (PARTITION BY first_month ORDER BY months_since) AS share
        FROM (SELECT first_month, datediff('month', first_month, month) AS months_since, count(*) AS customers
            FROM (SELECT DISTINCT customer_id, date_trunc('month', order_date) AS month,
                min(date_trunc('month', order_date)) OVER (PARTITION BY customer_id) AS first_month
                FROM s_orders WHERE order_status <> 'Cancelled' AND order_date IS NOT NULL AND customer_id IS NOT NULL)
            GROUP BY 1, 2)""",
    "churn_auc": """SELECT count(*) FILTER (churn = 1) AS positives, count(*) FILTER (churn = 0) AS negatives,
        (SELECT sum(CASE WHEN a.score > b.score THEN 2 WHEN a.score = b.score THEN 1 ELSE 0 END)::DOUBLE
            FROM scored_churn a, scored_churn b WHERE a.churn = 1 AND b.churn = 0)
        / (CAST(2 AS DOUBLE) * count(*) FILTER (churn = 1) * count(*) FILTER (churn = 0)) AS auc FROM scored_churn""",
    "churn_lift": """SELECT decile, count(*) AS customers, count(*) FILTER (churn = 1) AS positives,
        count(*) FILTER (churn = 1) / count(*) AS rate,
        (count(*) FILTER (churn = 1) / count(*)) / (SELECT count(*) FILTER (churn = 1) / count(*) FROM scored_churn) AS lift
        FROM (SELECT churn, CAST(floor((rank() OVER (ORDER BY score DESC) - 1) * 10 / count(*) OVER ()) AS BIGINT) + 1 AS decile
            FROM scored_churn) GROUP BY decile""",
    # price history
    "price_history": "SELECT product_id, valid_from, price, valid_to FROM prices",
    "price_history_merged": "SELECT product_id, valid_from, price, valid_to FROM prices",
    "order_price_asof": """SELECT i.product_id, i.order_id, i.quantity, i.unit_price, i.order_date,
        p.valid_from AS price_since, p.price AS price_before
        FROM (SELECT * FROM s_items LEFT JOIN s_orders USING (order_id)) i
        ASOF LEFT JOIN prices p ON i.product_id = p.product_id AND i.order_date - 1 >= p.valid_from""",
    "order_pricing_asof": """SELECT customer_id, i.product_id, order_date, 'Pending' AS order_status, quantity,
        coalesce(h.price, p.price) AS unit_price, coalesce(h.price, p.price) * quantity AS total_amount
        FROM (SELECT * FROM s_items JOIN s_orders USING (order_id)) i JOIN s_products p ON i.product_id = p.product_id
        ASOF LEFT JOIN prices h ON i.product_id = h.product_id AND i.order_date >= h.valid_from
        WHERE quantity > 0""",
    # the last six months
    "recent_monthly_revenue": """SELECT month, revenue FROM monthly
        WHERE month >= (SELECT strftime(max(order_date) - INTERVAL 5 MONTH, '%Y-%m') FROM s_orders)""",
    "recent_category_revenue": f"""SELECT category_id, category_name, {_money('quantity * unit_price')} AS revenue
        FROM s_items JOIN s_orders USING (order_id) JOIN s_products USING (product_id) JOIN s_categories USING (category_id)
        WHERE order_status <> 'Cancelled' AND strftime(order_date, '%Y-%m') >=
            (SELECT strftime(max(order_date) - INTERVAL 5 MONTH, '%Y-%m') FROM s_orders)
        GROUP BY category_id, category_name""",
    # figures from partials
    "incremental_dashboard": f"""SELECT
        (SELECT coalesce({_money('total_amount')}, 0) FROM s_orders WHERE order_status <> 'Cancelled') AS revenue,
        (SELECT count(*) FROM s_orders) AS total_orders,
        (SELECT count(*) FROM s_customers) AS total_customers,
        (SELECT count(*) FROM s_products) AS total_products""",
    "incremental_monthly": "SELECT month, revenue FROM monthly",
}

_TABLES["scored_churn"] = """SELECT f.customer_id,
    greatest(0, least(1, 1 - total_spending / (SELECT max(total_spending) FROM features))) AS score, l.churn
    FROM features f JOIN (SELECT customer_id, CAST(CASE WHEN after_cut = 0 THEN 1 ELSE 0 END AS INTEGER) AS churn
        FROM (SELECT customer_id, count(*) FILTER (order_date < cutoff) AS before_cut,
            count(*) FILTER (order_date >= cutoff AND order_date <= cutoff + 90) AS after_cut
            FROM s_orders JOIN s_customers USING (customer_id), (SELECT max(order_date) - 90 AS cutoff FROM s_orders)
            GROUP BY customer_id) WHERE before_cut > 0) l ON f.customer_id = l.customer_id"""
_TABLES["prices"] = """SELECT *, lead(valid_from) OVER (PARTITION BY product_id ORDER BY valid_from) AS valid_to FROM (
    SELECT product_id, order_date AS valid_from, max(unit_price) AS price FROM s_items JOIN s_orders USING (order_id)
    WHERE order_status <> 'Cancelled' AND order_date IS NOT NULL GROUP BY 1, 2)"""
_TABLES["sessions"] = f"""SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS events,
    count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
    coalesce({_money("CASE WHEN event_type = 'purchase' THEN value END")}, 0) AS revenue
    FROM (SELECT *, count(*) FILTER (WHERE before IS NULL OR ts - before > INTERVAL 30 MINUTE)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
        FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))
    WHERE user_id IS NOT NULL GROUP BY user_id, session"""

_TABLES["requests"] = """SELECT o.customer_id, i.product_id % 7 = 0 AS unknown,
    CASE WHEN i.product_id % 7 = 0 THEN '9000000000' || i.product_id ELSE i.product_id::VARCHAR END AS product_id,
    CASE WHEN o.customer_id % 5 = 0 THEN 'x' ELSE i.quantity::VARCHAR END AS quantity,
    CASE WHEN o.customer_id % 11 = 0 THEN 'someday' ELSE o.order_date::VARCHAR END AS order_date
    FROM s_items i JOIN s_orders o USING (order_id)"""
_TABLES["good_requests"] = """SELECT r.*, p.price FROM requests r JOIN s_products p ON r.product_id = p.product_id::VARCHAR
    WHERE quantity <> 'x' AND NOT unknown AND order_date <> 'someday' AND CAST(quantity AS INTEGER) > 0"""
_TABLES["features_90d"] = f"""SELECT customer_id, count(*) AS total_orders, {_money('total_amount')} AS total_spending,
    {_money('total_amount')} / count(*) AS average_order_value, any_value(churn) AS churn
    FROM s_orders JOIN (SELECT customer_id, any_value(cutoff) AS cutoff,
        CAST(CASE WHEN count(*) FILTER (order_date >= cutoff AND order_date <= cutoff + 90) = 0 THEN 1 ELSE 0 END AS INTEGER) AS churn
        FROM s_orders JOIN s_customers USING (customer_id), (SELECT max(order_date) - 90 AS cutoff FROM s_orders)
        GROUP BY customer_id HAVING count(*) FILTER (order_date < cutoff) > 0) USING (customer_id)
    WHERE order_date < cutoff GROUP BY customer_id"""
_TABLES["rfm_measures"] = f"""SELECT customer_id,
    CAST((SELECT max(order_date) FROM s_orders WHERE order_status <> 'Cancelled') - max(order_date) AS BIGINT) AS recency,
    count(*) AS frequency, {_money('total_amount')} AS monetary
    FROM s_orders WHERE order_status <> 'Cancelled' AND customer_id IN (SELECT customer_id FROM s_customers)
    GROUP BY customer_id"""


def _needed(text: str) -> list[str]:
    """Names of the helper tables that a query reads, directly or not, in order of definition."""
    found = {name for name, body in _TABLES.items() if name in text}
    while True:
        more = found | {name for name, body in _TABLES.items() if any(name in _TABLES[f] for f in found)}
        if more == found:
            return [name for name in _TABLES if name in found]
        found = more


def sql() -> dict[str, str]:
    texts = {}
    for name, body in _QUERIES.items():
        helpers = ",\n".join(f"{helper} AS ({_TABLES[helper]})" for helper in _needed(body))
        texts[name] = f"WITH {helpers}\n{body}" if helpers else body
    return texts
