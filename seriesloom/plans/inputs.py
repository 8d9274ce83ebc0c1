"""Series and history tables derived from the given tables.

Each text is plain SQL that both Spark and the oracle engine read, so a query and
its oracle start from the same rows. ``{name}`` stands for a table or another input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

READINGS_A_TASK = 50_000

INPUTS: dict[str, str] = {
    # typed readings of one supplier: several per day, some missing
    "supplier_readings": """
        SELECT concat('S', CAST(l_suppkey AS STRING)) AS series_id, l_orderkey * 8 + l_linenumber AS row_no,
               CAST(l_shipdate AS DATE) AS ds, CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE l_quantity END AS y
        FROM {lineitem}""",
    # one value per supplier and shipping day
    "supplier_daily": """
        SELECT concat('S', CAST(l_suppkey AS STRING)) AS series_id, CAST(l_shipdate AS DATE) AS ds, SUM(l_quantity) AS y
        FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "priority_daily": """
        SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ds, SUM(o_totalprice) AS y
        FROM {orders} GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)""",
    "brand_daily": """
        SELECT p_brand AS series_id, CAST(l_shipdate AS DATE) AS ds, SUM(l_quantity) AS y
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)""",
    # event values at their full timestamp, far more than one per day
    "event_readings": """
        SELECT event_type AS series_id, event_id AS row_no, ts AS ds, value AS y FROM {events}""",
    # three sheets of one workbook, a column per metric
    "wide_sheets": """
        SELECT concat('returns_', l_returnflag) AS sheet, CAST(l_shipdate AS DATE) AS ds,
               SUM(l_quantity) AS quantity, SUM(l_extendedprice) AS revenue, MAX(l_discount) AS discount
        FROM {lineitem} GROUP BY l_returnflag, CAST(l_shipdate AS DATE)""",
    # text cells as they come from a file: bad dates, words, negatives, spikes, repeats
    "raw_orders": """
        SELECT CAST(o_orderkey AS STRING) AS order_ref,
               CASE WHEN o_custkey % 11 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS STRING) END AS amount,
               CASE WHEN o_orderkey % 23 = 0 THEN 'soon' WHEN o_orderkey % 29 = 0 THEN NULL
                    ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS placed,
               CAST(o_custkey + 2500 AS BIGINT) AS big_number, o_orderpriority AS priority
        FROM {orders}""",
    "raw_readings": """
        SELECT concat('lineitem/S', CAST(l_suppkey AS STRING)) AS series_id, l_orderkey * 8 + l_linenumber AS row_no,
               CASE WHEN l_orderkey % 211 = 0 THEN 'not a date' WHEN l_orderkey % 223 = 0 THEN NULL
                    ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS ds_raw,
               CASE WHEN l_partkey % 101 = 0 THEN 'n/a' WHEN l_partkey % 89 = 0 THEN NULL
                    WHEN l_partkey % 61 = 0 THEN CAST(-l_quantity AS STRING)
                    WHEN l_partkey % 151 = 0 THEN CAST(l_quantity * 100 AS STRING)
                    ELSE CAST(l_quantity AS STRING) END AS y_raw
        FROM {lineitem}
        UNION ALL
        SELECT concat('events/', event_type), event_id, CAST(ts AS STRING), CAST(value AS STRING) FROM {events}
        UNION ALL
        SELECT concat('weekly/', o_orderpriority), MIN(o_orderkey), CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS STRING),
               CAST(CAST(COUNT(*) AS DOUBLE) AS STRING)
        FROM {orders} GROUP BY o_orderpriority, CAST(date_trunc('week', o_orderdate) AS DATE)
        UNION ALL
        SELECT concat('daily/', o_orderpriority), MIN(o_orderkey), CAST(CAST(o_orderdate AS DATE) AS STRING),
               CASE WHEN CAST(o_orderdate AS DATE) > DATE '2001-06-01' THEN '0' ELSE CAST(CAST(COUNT(*) AS DOUBLE) AS STRING) END
        FROM {orders} GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)
        UNION ALL
        SELECT concat('customer/C', CAST(o_custkey AS STRING)), o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING),
               CAST(o_totalprice AS STRING)
        FROM {orders}""",
    # one actual and two competing predictions per supplier and shipping day
    "scored_pairs": """
        SELECT concat('S', CAST(l_suppkey AS STRING)) AS series_id, 'ByQuantity' AS model, CAST(l_shipdate AS DATE) AS ds,
               SUM(CASE WHEN l_partkey % 7 = 0 THEN 0.0 ELSE l_quantity END) AS actual,
               SUM(l_quantity * (1.0 - l_discount)) AS predicted
        FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
        UNION ALL
        SELECT concat('S', CAST(l_suppkey AS STRING)), 'ByPrice', CAST(l_shipdate AS DATE),
               SUM(CASE WHEN l_partkey % 7 = 0 THEN 0.0 ELSE l_quantity END),
               SUM(l_extendedprice / 2000.0)
        FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    # run history
    "jobs": """
        SELECT o_orderkey AS id, o_custkey % 13 AS user_id,
               CASE WHEN o_orderkey % 17 = 0 THEN 'stopped' WHEN o_orderkey % 19 = 0 THEN 'pending'
                    WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END AS status,
               concat('run ', CAST(o_orderkey AS STRING)) AS name,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('file_', CAST(o_custkey AS STRING)) END AS file_name,
               CAST(o_orderdate AS DATE) AS created_at, o_orderdate AS started_at,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    WHEN o_orderkey % 31 = 0 THEN o_orderdate - INTERVAL '1' HOUR
                    WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '2' HOUR
                    WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL '45' MINUTE
                    ELSE o_orderdate + INTERVAL '3' HOUR END AS completed_at
        FROM {orders}""",
    "model_runs": """
        SELECT row_no AS id, job_id, sheet_name, metric_name, model_name, stage, position, wmape, mae, mape, rmse,
               accuracy, composite_score, demand_type, status,
               position = MIN(position) OVER (PARTITION BY job_id, sheet_name, metric_name) AS is_champion
        FROM (
          SELECT l_orderkey AS job_id, concat('sheet_', l_returnflag) AS sheet_name, concat('metric_', l_linestatus) AS metric_name,
                 CASE l_linenumber WHEN 1 THEN 'Croston' WHEN 2 THEN 'Theta' WHEN 3 THEN 'LightGBM' WHEN 4 THEN 'ExpSmoothing'
                      WHEN 5 THEN 'Prophet' WHEN 6 THEN 'SARIMAX' ELSE 'Baseline_SMA' END AS model_name,
                 CASE WHEN l_linenumber = 3 THEN 'Multivariate' ELSE 'Univariate' END AS stage,
                 l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS position,
                 (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS row_no,
                 CASE WHEN l_partkey % 37 = 0 THEN NULL WHEN l_partkey % 41 = 0 THEN CAST('Infinity' AS DOUBLE)
                      ELSE l_discount + l_quantity / 100.0 END AS wmape,
                 l_quantity AS mae, l_tax * 100 AS mape, l_quantity * 1.5 AS rmse, 100.0 - l_quantity AS accuracy,
                 CASE WHEN l_partkey % 43 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_discount + l_tax + l_quantity / 100.0 END AS composite_score,
                 CASE l_suppkey % 6 WHEN 0 THEN 'Smooth' WHEN 1 THEN 'Erratic' WHEN 2 THEN 'Intermittent' WHEN 3 THEN 'Lumpy'
                      WHEN 4 THEN 'Odd' ELSE NULL END AS demand_type,
                 CASE WHEN l_partkey % 53 = 0 THEN 'failed' ELSE 'completed' END AS status
          FROM {lineitem}) AS r""",
    "evaluations": """
        SELECT (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS id,
               l_orderkey AS job_id, o_custkey % 13 AS user_id, concat('sheet_', l_returnflag) AS sheet_name,
               concat('metric_', l_linestatus) AS metric_name, CAST(l_shipdate AS DATE) AS created_at,
               CAST(CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE l_quantity END AS BIGINT) AS matched_points,
               CAST(30 AS BIGINT) AS forecast_points,
               CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount + l_tax END AS wmape
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # stored forecasts of every order's run: one per day the order ships
    "stored_records": """
        SELECT l_orderkey AS job_id, concat('sheet_', l_returnflag) AS sheet_name, 'quantity' AS metric_name,
               CAST(l_shipdate AS DATE) AS ds,
               CASE WHEN SUM(l_quantity) > 45 THEN NULL ELSE SUM(l_quantity) END AS forecast,
               CASE WHEN SUM(l_quantity) > 45 THEN SUM(l_quantity) ELSE NULL END AS train_actual
        FROM {lineitem} GROUP BY l_orderkey, l_returnflag, CAST(l_shipdate AS DATE)""",
    # up to three edits per stored run, in sequence; those of finished lines belong to runs that are not stored
    "stored_edits": """
        SELECT job_id, sheet_name, metric_name, sequence_no,
               CASE sequence_no WHEN 1 THEN 'scale_range' WHEN 2 THEN 'clip_bounds' ELSE 'set_value_range' END AS operation_type,
               CASE WHEN sequence_no = 3 THEN 7.5 ELSE NULL END AS value,
               CASE WHEN sequence_no = 1 THEN 120.0 ELSE NULL END AS scale_pct,
               CASE WHEN sequence_no = 2 THEN 10.0 ELSE NULL END AS min_value,
               CASE WHEN sequence_no = 2 THEN 40.0 ELSE NULL END AS max_value,
               CASE WHEN job_id % 3 = 0 THEN DATE '1997-01-01' ELSE NULL END AS date_from,
               CASE WHEN job_id % 5 = 0 THEN DATE '2000-06-30' ELSE NULL END AS date_to,
               sequence_no = 3 AS weekend_only
        FROM (SELECT CASE WHEN l_linestatus = 'O' THEN l_orderkey ELSE -l_orderkey END AS job_id,
                     concat('sheet_', l_returnflag) AS sheet_name, 'quantity' AS metric_name,
                     CAST((l_linenumber % 3) + 1 AS INT) AS sequence_no
              FROM {lineitem}
              GROUP BY CASE WHEN l_linestatus = 'O' THEN l_orderkey ELSE -l_orderkey END, l_returnflag,
                       (l_linenumber % 3) + 1) AS e""",
    # what arrived later: for the stored forecasts of finished lines, and for runs that are not stored
    "arrived_actuals": """
        SELECT CASE WHEN l_linestatus = 'F' THEN l_orderkey ELSE -l_orderkey END AS job_id,
               concat('sheet_', l_returnflag) AS sheet_name, 'quantity' AS metric_name,
               l_orderkey * 8 + l_linenumber AS row_no, CAST(l_shipdate AS DATE) AS ds,
               CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN -l_tax ELSE l_quantity * (1.0 - l_tax) END AS y
        FROM {lineitem}""",
    # forecasts as they were stored, several a day, in the order of row_no
    "forecast_log": """
        SELECT l_suppkey AS job_id, concat('sheet_', l_returnflag) AS sheet_name, 'quantity' AS metric_name,
               l_orderkey * 8 + l_linenumber AS row_no, l_shipdate AS ds,
               CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS forecast
        FROM {lineitem}""",
    # edit requests as free text
    "edit_requests": """
        SELECT event_id AS request_id,
               CASE event_id % 11
                 WHEN 0 THEN concat('{{"operation_type":"set_value_range","value":', CAST(value AS STRING), ',"days_of_week":[5,6]}}')
                 WHEN 1 THEN concat('{{"operation_type":"scale_range","scale_pct":', CAST(value AS STRING), '}}')
                 WHEN 2 THEN concat('{{"operation_type":"clip_bounds","min_value":null,"max_value":', CAST(value AS STRING), '}}')
                 WHEN 3 THEN concat('{{"operation_type":"clip_bounds","min_value":50,"max_value":', CAST(value AS STRING), '}}')
                 WHEN 4 THEN '{{"operation_type":"none"}}'
                 WHEN 5 THEN concat('Sure, here it is: {{"operation_type":"scale_range","scale_pct":', CAST(user_id AS STRING), '}} as asked.')
                 WHEN 6 THEN concat('{{"operation_type":"set_value_range","value":', CAST(user_id AS STRING), ',"days_of_week":[', CAST(user_id % 9 AS STRING), ']}}')
                 WHEN 7 THEN concat('make it ', event_type)
                 WHEN 8 THEN concat('{{"operation_type":"', event_type, '","value":1}}')
                 WHEN 9 THEN '{{"operation_type":"set_value_range","date_from":"2024-01-05"}}'
                 ELSE concat('{{"operation_type":"set_value_range","value":3,"date_from":"2024-0', CAST(user_id % 12 AS STRING), '-10"}}') END AS raw_text
        FROM {events}""",
    # result trees as JSON: nested, flat, and with entries that are no objects
    "result_texts": """
        SELECT o_orderkey AS job_id,
               CASE WHEN o_orderkey % 3 = 0 THEN concat('{{"sheet_', o_orderstatus, '":{{"metrics":{{"quantity":{{"best_model":"Theta","wmape":0.', CAST(o_custkey AS STRING), '}},"broken":5}}}},"note":"x"}}')
                    WHEN o_orderkey % 3 = 1 THEN concat('{{"sheet_', o_orderstatus, '":{{"quantity":{{"best_model":"Croston","wmape":0.', CAST(o_custkey AS STRING), '}},"price":{{"wmape":null}}}}}}')
                    ELSE '{{"empty":{{}},"list":[1,2]}}' END AS result
        FROM {orders}""",
    "uploads": """
        SELECT l_orderkey * 10 + l_linenumber AS upload_id, MIN(o_custkey % 13) AS user_id, CAST(MAX(l_shipdate) AS DATE) AS created_at
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber""",
    "upload_columns": """
        SELECT DISTINCT l_orderkey * 10 + l_linenumber AS upload_id, concat('metric_', CAST(l_partkey % 40 AS STRING)) AS column_name
        FROM {lineitem}""",
    "job_metrics": """
        SELECT DISTINCT l_orderkey AS job_id, concat('metric_', CAST(l_suppkey % 40 AS STRING)) AS metric FROM {lineitem}""",
}


def sql_text(name: str) -> str:
    """The input as one self-contained SELECT for the oracle engine."""
    text = INPUTS[name]
    for inner in re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text):
        text = text.replace("{" + inner + "}", inner if inner in TABLES else f"({sql_text(inner)})")
    return text.replace("{{", "{").replace("}}", "}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input as a DataFrame."""
    text = INPUTS[name]
    used = {
        inner: table(spark, sf_dir, inner) if inner in TABLES else load(spark, sf_dir, inner)
        for inner in set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))
    }
    return spark.sql(text, **used)


def reading_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Into how many tasks the suppliers' readings are dealt."""
    return max(1, -(-table(spark, sf_dir, "lineitem").count() // READINGS_A_TASK))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier_daily`` dealt by series into tasks of a bounded number of readings.

    A series is gridded, sorted and filled where it lies, with several times its readings' size, so the number of
    tasks follows the input: left to Spark, tasks would be merged by the small size of what was shuffled."""
    return load(spark, sf_dir, "supplier_daily").repartition(reading_tasks(spark, sf_dir), "series_id")


def ctes(*names: str, **more: str) -> str:
    """A WITH clause naming inputs and further steps, for oracle texts."""
    parts = [f"{n} AS ({sql_text(n)})" for n in names] + [f"{n} AS ({t})" for n, t in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"
