"""Ordered rows of events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomewright.operators.sequences import discriminators, groups_between, last_label, last_set, segments, squeezed
from tomewright.queries import query, table

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS until FROM events")
def segment_lead(spark, sf_dir):
    return segments(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query(f"SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) {_W} AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def squeeze_adjacent(spark, sf_dir):
    return squeezed(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id")


@query(f'SELECT user_id, event_id, "group" FROM (SELECT user_id, event_id, event_type, CAST(sum(CASE WHEN event_type = \'signup\' THEN 1 ELSE 0 END) {_W} AS BIGINT) AS "group" FROM events) WHERE event_type <> \'signup\'')
def splitby_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return groups_between(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "signup").select("user_id", "event_id", "group")


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS label FROM events""")
def asof_label(spark, sf_dir):
    """The last purchase before each event."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return last_label(rows, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id"))).select("user_id", "event_id", "label")


@query("""SELECT conv_id, turn, CAST(CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) END AS INT) AS discriminator FROM conversations""")
def discriminator_numbers(spark, sf_dir):
    return discriminators(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"])


@query("SELECT conv_id, arg_max(role, turn) AS role FROM conversations WHERE role <> 'assistant' GROUP BY ALL")
def last_nonempty(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "assistant", "").otherwise(F.col("role")))
    return last_set(rows, "conv_id", "turn", "role")
