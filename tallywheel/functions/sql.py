"""SQL functions of the hex and key expressions, for users who write SQL; Catalyst inlines their bodies."""

from pyspark.sql import SparkSession

FUNCTIONS = {
    "topic_to_address(t STRING) RETURNS STRING": "CASE WHEN length(t) = 66 THEN concat('0x', lower(right(t, 40))) END",
    "method_selector(d STRING) RETURNS STRING": "CASE WHEN length(coalesce(d, '')) < 10 THEN '0x' ELSE lower(left(d, 10)) END",
    "word_to_decimal(w STRING) RETURNS DECIMAL(38,0)": "CASE WHEN lower(w) RLIKE '^0{32}[0-9a-f]{32}$' THEN try_cast(try_add(try_multiply(CAST(CAST(conv(substr(w, 33, 16), 16, 10) AS DECIMAL(20,0)) AS DECIMAL(38,0)), CAST(18446744073709551616 AS DECIMAL(38,0))), CAST(CAST(conv(substr(w, 49, 16), 16, 10) AS DECIMAL(20,0)) AS DECIMAL(38,0))) AS DECIMAL(38,0)) END",
    "raw_log_id(chain INT, block BIGINT, tx STRING, i INT) RETURNS STRING": "sha2(concat('raw_log|', coalesce(CAST(chain AS STRING), ''), '|', coalesce(CAST(block AS STRING), ''), '|', coalesce(lower(tx), ''), '|', coalesce(CAST(i AS STRING), '')), 256)",
    "decoded_event_id(chain INT, block BIGINT, tx STRING, i INT) RETURNS STRING": "sha2(concat('decoded_event|', coalesce(CAST(chain AS STRING), ''), '|', coalesce(CAST(block AS STRING), ''), '|', coalesce(lower(tx), ''), '|', coalesce(CAST(i AS STRING), '')), 256)",
    "safe_ratio(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "try_divide(a, b)",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
