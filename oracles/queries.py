"""Oracle SQL per query key."""

from __future__ import annotations

from .base import with_ctes

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, *extra: str) -> None:
    ORACLES[name] = with_ctes(body, *extra)


# ---------------------------------------------------------------- warehouse
oracle("stage_snapshot", """
SELECT 'sale' AS table_name, COUNT(*) AS rows FROM sale UNION ALL
SELECT 'sale_item', COUNT(*) FROM sale_item UNION ALL
SELECT 'product', COUNT(*) FROM product UNION ALL
SELECT 'central_product', COUNT(*) FROM central_product UNION ALL
SELECT 'brand', COUNT(*) FROM brand UNION ALL
SELECT 'category', COUNT(*) FROM category UNION ALL
SELECT 'offer', COUNT(*) FROM offer UNION ALL
SELECT 'product_offer', COUNT(*) FROM product_offer UNION ALL
SELECT 'store', COUNT(*) FROM store UNION ALL
SELECT 'customer', COUNT(*) FROM customer_src UNION ALL
SELECT 'city_zone', COUNT(*) FROM city_zone UNION ALL
SELECT 'return_item', COUNT(*) FROM return_item UNION ALL
SELECT 'return_reason', COUNT(*) FROM return_reason""")

oracle("dim_date", """
SELECT date_sk::BIGINT AS date_sk, date, year::BIGINT AS year, quarter::BIGINT AS quarter,
       month::BIGINT AS month, month_name, week::BIGINT AS week, day::BIGINT AS day,
       day_of_week::BIGINT AS day_of_week, day_name, is_weekend FROM dim_date""")
oracle("dim_customer", "SELECT customer_sk, customer_nk, first_name, last_name, is_unknown FROM dim_customer")
oracle("dim_product", """
SELECT product_sk, product_nk, name, category, brand, price::DOUBLE AS price,
       unit_cost::DOUBLE AS unit_cost, margin_pct::DOUBLE AS margin_pct, is_unknown FROM dim_product""")
oracle("dim_store", "SELECT store_sk, store_nk, name, city, postal_code, is_unknown FROM dim_store")
oracle("dim_zone", "SELECT * FROM dim_zone")
oracle("dim_offer", "SELECT offer_sk, offer_nk, name, discount_pct::DOUBLE AS discount_pct, is_no_offer FROM dim_offer")
oracle("dim_return_reason", "SELECT * FROM dim_return_reason")
oracle("returns_by_line", "SELECT * FROM returns_by_line")
oracle("fact_sales", """
SELECT date_sk::BIGINT AS date_sk, customer_sk, product_sk, store_sk, zone_sk, offer_sk, sale_id,
       sale_item_id, quantity, unit_price::DOUBLE AS unit_price, gross_amount::DOUBLE AS gross_amount,
       cost_amount::DOUBLE AS cost_amount, gross_margin::DOUBLE AS gross_margin,
       margin_pct::DOUBLE AS margin_pct, is_returned, returned_qty::BIGINT AS returned_qty,
       net_amount::DOUBLE AS net_amount FROM fact_sales""")
oracle("fact_returns", """
SELECT date_sk::BIGINT AS date_sk, customer_sk, product_sk, store_sk, reason_sk, return_id, sale_item_id,
       returned_qty, returned_amount::DOUBLE AS returned_amount, returned_cost::DOUBLE AS returned_cost
FROM fact_returns""")

# --------------------------------------------------------------------- mart
oracle("customer_360", """
SELECT customer_sk, customer_nk, name, num_orders, num_lines, first_purchase, last_purchase,
       tenure_days, recency_days, gross_revenue::DOUBLE AS gross_revenue,
       net_revenue::DOUBLE AS net_revenue, total_cost::DOUBLE AS total_cost,
       gross_margin::DOUBLE AS gross_margin, margin_pct::DOUBLE AS margin_pct, aov::DOUBLE AS aov,
       monthly_frequency::DOUBLE AS monthly_frequency, units_bought, units_returned,
       return_rate::DOUBLE AS return_rate, return_rate_raw::DOUBLE AS return_rate_raw,
       cltv::DOUBLE AS cltv
FROM customer_360""")

oracle("customer_zone", """
SELECT customer_sk, zone_sk, district, area_type, orientation, lines FROM (
  SELECT p.*, z.district, z.area_type, z.orientation,
         ROW_NUMBER() OVER (PARTITION BY p.customer_sk ORDER BY p.lines DESC, p.zone_sk) AS rn
  FROM (SELECT customer_sk, zone_sk, COUNT(*) AS lines FROM fact_sales WHERE customer_sk <> 1
        GROUP BY customer_sk, zone_sk) p
  JOIN dim_zone z ON z.zone_sk = p.zone_sk) t
WHERE rn = 1""")

oracle("surrogate_keys", """
SELECT 'customer' AS dimension, -1::BIGINT AS natural_key, 1::BIGINT AS surrogate_key UNION ALL
SELECT 'customer', customer_id, ROW_NUMBER() OVER (ORDER BY customer_id) + 1 FROM customer_src UNION ALL
SELECT 'product', -1, 1 UNION ALL
SELECT 'product', product_id, ROW_NUMBER() OVER (ORDER BY product_id) + 1 FROM product UNION ALL
SELECT 'store', -1, 1 UNION ALL
SELECT 'store', store_id, ROW_NUMBER() OVER (ORDER BY store_id) + 1 FROM store""")

oracle("build_warehouse", """
SELECT 'stg' AS layer, 'product' AS table_name, COUNT(*) AS row_count FROM product UNION ALL
SELECT 'stg', 'central_product', COUNT(*) FROM central_product UNION ALL
SELECT 'stg', 'brand', COUNT(*) FROM brand UNION ALL
SELECT 'stg', 'category', COUNT(*) FROM category UNION ALL
SELECT 'stg', 'sale', COUNT(*) FROM sale UNION ALL
SELECT 'stg', 'sale_item', COUNT(*) FROM sale_item UNION ALL
SELECT 'stg', 'offer', COUNT(*) FROM offer UNION ALL
SELECT 'stg', 'product_offer', COUNT(*) FROM product_offer UNION ALL
SELECT 'stg', 'store', COUNT(*) FROM store UNION ALL
SELECT 'stg', 'customer', COUNT(*) FROM customer_src UNION ALL
SELECT 'stg', 'city_zone', COUNT(*) FROM city_zone UNION ALL
SELECT 'stg', 'return_item', COUNT(*) FROM return_item UNION ALL
SELECT 'stg', 'return_reason', COUNT(*) FROM return_reason UNION ALL
SELECT 'dwh', 'dim_date', COUNT(*) FROM dim_date UNION ALL
SELECT 'dwh', 'dim_customer', COUNT(*) FROM dim_customer UNION ALL
SELECT 'dwh', 'dim_product', COUNT(*) FROM dim_product UNION ALL
SELECT 'dwh', 'dim_store', COUNT(*) FROM dim_store UNION ALL
SELECT 'dwh', 'dim_zone', COUNT(*) FROM dim_zone UNION ALL
SELECT 'dwh', 'dim_offer', COUNT(*) FROM dim_offer UNION ALL
SELECT 'dwh', 'dim_return_reason', COUNT(*) FROM dim_return_reason UNION ALL
SELECT 'dwh', 'fact_sales', COUNT(*) FROM fact_sales UNION ALL
SELECT 'dwh', 'fact_returns', COUNT(*) FROM fact_returns UNION ALL
SELECT 'marts', 'customer_360', COUNT(*) FROM customer_360""")
