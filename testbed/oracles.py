"""DuckDB SQL for each registered query, written against the supplied tables.

The log fields are taken from the columns the XML was built from, never from the XML.
"""

from __future__ import annotations

from reelmart.functions.text import ENGLISH_STOP_WORDS
from testbed.catalogue import AS_OF

_LOGS = """
    SELECT event_id AS log_id,
           CAST(ts AS DATE) + CAST(event_id % 365 AS INTEGER) AS log_date,
           event_type AS device,
           'os_' || CAST(event_id % 4 AS VARCHAR) AS os,
           n_name AS location,
           '10.0.0.' || CAST(user_id AS VARCHAR) AS ip,
           '555-' || CAST(user_id AS VARCHAR) AS phone_number
    FROM events JOIN nation ON n_nationkey = user_id % 25
"""

# The forms of the documents by event_id % 10, see mixed_log_reviews.
_MIXED_LOGS = f"""
    SELECT log_id,
           CASE WHEN log_id % 10 NOT IN (6, 8, 9) THEN log_date END AS log_date,
           CASE WHEN log_id % 10 IN (1, 4) THEN ''
                WHEN log_id % 10 = 3 THEN '  ' || device || ' '
                WHEN log_id % 10 NOT IN (6, 8) THEN device END AS device,
           CASE WHEN log_id % 10 NOT IN (6, 8) THEN os END AS os,
           CASE WHEN log_id % 10 NOT IN (6, 8) THEN location END AS location,
           CASE WHEN log_id % 10 NOT IN (6, 8) THEN ip END AS ip,
           CASE WHEN log_id % 10 NOT IN (6, 8) THEN phone_number END AS phone_number
    FROM ({_LOGS})
"""

_LOG_QUALITY = """
    SELECT count(*) AS total_logs, count(*) FILTER (event_id % 10 IN (6, 8)) AS malformed_logs,
           count(*) FILTER (event_id % 10 = 9) AS unreadable_dates, 0::BIGINT AS logs_without_id
    FROM events JOIN nation ON n_nationkey = user_id % 25
"""

_PURCHASES = """
    SELECT CAST(o_orderkey AS VARCHAR) AS invoice_number,
           CAST(l_partkey AS VARCHAR) AS stock_code,
           p_name AS detail,
           CAST(l_quantity AS INTEGER) AS quantity,
           CAST(o_orderdate AS TIMESTAMP) AS invoice_date,
           CAST(p_retailprice AS DECIMAL(8,3)) AS unit_price,
           CAST(o_custkey AS INTEGER) AS customer_id,
           n_name AS country
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
"""

_REVIEW_TEXT = "SELECT doc_id % 150 AS cid, text AS review_str, doc_id AS id_review FROM documents"

_STRAY_QUOTES = f"""
    SELECT cid, id_review,
           CASE WHEN id_review % 2 = 0 THEN regexp_replace(flat, '[,"]', ' ', 'g') || ' 5" screen' ELSE flat END
               AS review_str
    FROM (SELECT cid, id_review, regexp_replace(review_str, '[\\r\\n]', ' ', 'g') AS flat FROM ({_REVIEW_TEXT}))
"""

_STOP_WORDS = ", ".join("'" + word.replace("'", "''") + "'" for word in ENGLISH_STOP_WORDS)

_TOKENS = """
    SELECT doc_id % 150 AS user_id, doc_id AS review_id,
           CASE WHEN trimmed = '' AND lowered <> '' THEN CAST([] AS VARCHAR[])
                ELSE string_split_regex(trimmed, '[ \\t\\n\\x0B\\f\\r]') END AS tokens
    FROM (SELECT doc_id, lower(text) AS lowered,
                 regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+$', '') AS trimmed
          FROM documents)
"""

_CLEAN = f"""
    SELECT user_id, review_id, len(tokens) AS n_tokens,
           array_to_string(list_filter(tokens, lambda w: w NOT IN ({_STOP_WORDS})), ' ')
               AS review_clean_str
    FROM ({_TOKENS})
"""


def _classified(keyword: str) -> str:
    return f"""
    SELECT user_id,
           CAST(CASE WHEN contains(review_clean_str, '{keyword}') THEN 1 ELSE 0 END AS INTEGER)
               AS positive_review,
           review_id
    FROM ({_CLEAN})
    """


def _scores(keyword: str) -> str:
    return f"""
    SELECT user_id, CAST(SUM(positive_review) AS BIGINT) AS review_score,
           COUNT(review_id) AS review_count
    FROM ({_classified(keyword)}) GROUP BY user_id
    """


_SPEND = f"""
    SELECT CAST(customer_id AS BIGINT) AS customer_id,
           CAST(SUM(quantity * unit_price) AS DECIMAL(18,5)) AS amount_spent
    FROM ({_PURCHASES}) GROUP BY customer_id
"""

# Seasons by counting months from December, three at a time.
# Fixed values that must match: the season of each month; a date that is not known counts as Fall.
_SEASONS = """
    VALUES (1, 'Winter'), (2, 'Winter'), (3, 'Spring'), (4, 'Spring'), (5, 'Spring'), (6, 'Summer'),
           (7, 'Summer'), (8, 'Summer'), (9, 'Fall'), (10, 'Fall'), (11, 'Fall'), (12, 'Winter')
"""

def _dim(key: str, id_col: str, first: str = "0") -> str:
    """Ids in key order, after the keys whose ``first`` load came before."""
    return f"""
    SELECT row_number() OVER (ORDER BY load, {key} NULLS FIRST) AS {id_col}, {key}
    FROM (SELECT {key}, min({first}) AS load FROM ({_LOGS}) GROUP BY {key})
    """


def _dim_date(first: str = "0") -> str:
    return f"""
    SELECT id_dim_date, log_date,
           strftime(log_date, '%d') AS day, strftime(log_date, '%b') AS month,
           strftime(log_date, '%Y') AS year, coalesce(season, 'Fall') AS season
    FROM ({_dim("log_date", "id_dim_date", first)})
    LEFT JOIN ({_SEASONS}) AS seasons (month_number, season) ON month_number = month(log_date)
    """


_DIM_DATE = _dim_date()
_DIM_DEVICES = _dim("device", "id_dim_devices")
_DIM_LOCATION = _dim("location", "id_dim_location")
_DIM_OS = _dim("os", "id_dim_os")

# The load of a log.
_LOAD = "(log_id // 100) % 3"


def _lookup(first: str = "0") -> str:
    return f"""
    SELECT log_id, id_dim_date, id_dim_devices, id_dim_location, id_dim_os
    FROM ({_LOGS})
    LEFT JOIN ({_dim_date(first)}) USING (log_date)
    LEFT JOIN ({_dim("device", "id_dim_devices", first)}) USING (device)
    LEFT JOIN ({_dim("location", "id_dim_location", first)}) USING (location)
    LEFT JOIN ({_dim("os", "id_dim_os", first)}) USING (os)
    """


_LOOKUP = _lookup()


def _fact(keyword: str, first: str = "0") -> str:
    return f"""
    SELECT customer_id AS customerid, id_dim_date, id_dim_devices, id_dim_location, id_dim_os,
           amount_spent, review_score, review_count, DATE '{AS_OF.isoformat()}' AS insert_date
    FROM ({_classified(keyword)})
    JOIN ({_scores(keyword)}) USING (user_id)
    JOIN ({_SPEND}) ON customer_id = user_id
    JOIN ({_lookup(first)}) ON log_id = review_id
    """


# Kinds of the values of mixed_values, by the order's key.
_KIND_ROWS = """
    SELECT 'whole' AS "column", 'int' AS type, 'int' AS kind FROM orders
    UNION ALL SELECT 'large', 'bigint', CASE WHEN o_orderkey % 10 = 0 AND o_orderkey > 0 THEN 'bigint' ELSE 'int' END FROM orders
    UNION ALL SELECT 'fraction', 'double', CASE WHEN o_orderkey % 10 = 1 THEN 'double' ELSE 'int' END FROM orders
    UNION ALL SELECT 'huge', 'decimal(' || (20 + (SELECT max(length(o_orderkey::VARCHAR)) FROM orders WHERE o_orderkey % 10 = 2)) || ',0)',
        CASE WHEN o_orderkey % 10 = 2 THEN 'decimal' ELSE 'int' END FROM orders
    UNION ALL SELECT 'day', 'date', 'date' FROM orders
    UNION ALL SELECT 'time', 'timestamp', CASE WHEN o_orderkey % 10 = 3 THEN 'timestamp' ELSE 'date' END FROM orders
    UNION ALL SELECT 'flag', 'boolean', CASE WHEN o_orderkey % 10 <> 4 THEN 'boolean' END FROM orders
    UNION ALL SELECT 'text', 'string', CASE WHEN o_orderkey % 10 = 5 THEN 'string' ELSE 'int' END FROM orders
    UNION ALL SELECT 'nothing', 'string', NULL FROM orders
"""

_COLUMN_KINDS = f"""
    SELECT "column", coalesce(kind, 'none') AS kind, count(kind) AS n_values, type FROM ({_KIND_ROWS})
    WHERE kind IS NOT NULL OR "column" = 'nothing' GROUP BY ALL
"""

# The types that inference finds are wider where the text does not show the declared one.
_INFERRED_PURCHASES = f"""
    SELECT invoice_number::INTEGER AS invoice_number, stock_code::INTEGER AS stock_code, detail, quantity,
           invoice_date, unit_price::DOUBLE AS unit_price, customer_id, country
    FROM ({_PURCHASES})
"""

_PURCHASE_REJECTS = f"""
    SELECT CASE WHEN reason IS NULL
                THEN concat_ws(',', invoice_number, detail || ', "boxed"' || chr(10) || 'in two', quantity, country)
                ELSE concat_ws(',', invoice_number, stock_code, '"' || detail || ', ""boxed""' || chr(10) || 'in two"',
                    CASE WHEN kind = 1 THEN 'many' ELSE quantity::VARCHAR END,
                    CASE WHEN kind = 5 THEN 'on ' ELSE '' END || strftime(invoice_date, '%Y-%m-%d %H:%M:%S'), unit_price,
                    customer_id, country || CASE WHEN kind = 3 THEN ' and its overseas territories' ELSE '' END)
           END AS record,
           coalesce(reason, 'none') AS reason
    FROM (SELECT *, invoice_number::BIGINT % 7 AS kind,
              CASE WHEN invoice_number::BIGINT % 7 IN (1, 5) THEN 'fields' WHEN invoice_number::BIGINT % 7 = 3 THEN 'length of country' END
                  AS reason
          FROM ({_PURCHASES}))
"""

_TOTALS = f"""
    SELECT customer_id, CAST(amount_spent AS DECIMAL(38,3)) AS amount_spent, coalesce(purchase_lines, 0) AS purchase_lines,
           review_score, review_count, coalesce(reviews, 0) AS reviews
    FROM (SELECT customer_id::BIGINT AS customer_id, sum(quantity * unit_price) AS amount_spent, count(*) AS purchase_lines
          FROM ({_PURCHASES}) GROUP BY customer_id)
    FULL JOIN (SELECT user_id AS customer_id, sum(positive_review)::BIGINT AS review_score, count(review_id) AS review_count,
                   count(*) AS reviews
               FROM ({_classified("data")}) GROUP BY user_id) USING (customer_id)
"""


def oracles() -> dict[str, str]:
    return {
        "stage_user_purchase": _PURCHASES,
        "row_count_gate": f"""
            SELECT COUNT(*) AS total_rows, COUNT(*) > 0 AS is_loaded FROM ({_PURCHASES})
        """,
        "customer_spend": _SPEND,
        "review_tokens": f"""
            SELECT review_id, CAST(n_tokens AS INTEGER) AS n_tokens, review_clean_str
            FROM ({_CLEAN})
        """,
        "classify_reviews": _classified("good"),
        "classify_reviews_data": _classified("data"),
        "classify_reviews_the": _classified("the"),
        "review_scores": _scores("data"),
        "customer_review_spend": f"""
            SELECT customer_id, amount_spent, review_score, review_count
            FROM ({_SPEND}) JOIN ({_scores("data")}) ON customer_id = user_id
        """,
        "parse_review_logs": _LOGS,
        "dim_date": _DIM_DATE,
        "dim_devices": _DIM_DEVICES,
        "dim_location": _DIM_LOCATION,
        "dim_location_by_ranges": _DIM_LOCATION,
        "dim_os": _DIM_OS,
        "dim_lookup": _LOOKUP,
        "dim_lookup_by_shuffle": _LOOKUP,
        "fact_movie_analytics": _fact("data"),
        "fact_with_hot_users": _fact("data"),
        "fact_prefiltered": _fact("data"),
        "fact_over_buckets": _fact("data"),
        "fact_over_buckets_hot_users": _fact("data"),
        "csv_review_logs": _LOGS,
        "csv_movie_reviews": _REVIEW_TEXT,
        "csv_large_files": _REVIEW_TEXT,
        "csv_stray_quotes": _STRAY_QUOTES,
        "parse_review_logs_mixed": _MIXED_LOGS,
        "log_quality": _LOG_QUALITY,
        "load_stage_tables": f"""
            SELECT review_id, positive_review, device, lines
            FROM ({_classified("data")}) JOIN ({_LOGS}) ON log_id = review_id
            LEFT JOIN (SELECT customer_id, count(*) AS lines FROM ({_PURCHASES}) GROUP BY customer_id)
                ON customer_id = user_id
        """,
        "csv_classified_reviews": _classified("data"),
        "csv_user_purchase": _PURCHASES,
        "replace_user_purchase": _PURCHASES,
        "append_dim_devices": _DIM_DEVICES,
        "refresh_warehouse": _fact("data"),
        "csv_returns_and_blocks": _REVIEW_TEXT,
        "csv_column_kinds": _COLUMN_KINDS,
        "csv_inferred_purchases": _INFERRED_PURCHASES,
        "purchase_rejects": _PURCHASE_REJECTS,
        "refresh_at_once": f"""
            SELECT *, 'before' AS seen FROM ({_fact("good")}) UNION ALL SELECT *, 'now' AS seen FROM ({_fact("data")})
        """,
        "extend_dim_date": _dim_date(_LOAD),
        "extend_dim_location": _dim("location", "id_dim_location", _LOAD),
        "incremental_totals": _TOTALS,
        "incremental_fact": _fact("data", _LOAD),
    }
