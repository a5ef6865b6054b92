"""Side tables of the match bridge: uploads, match windows and the like, each read from the given tables."""

from pyspark.sql import functions as F

JOBS_SQL = """
SELECT user_id, job_id, job_no,
  CASE WHEN job_no % 7 = 6 THEN 'failed' ELSE 'done' END AS status,
  CASE job_no % 3 WHEN 0 THEN 'showdown' WHEN 1 THEN 'url' ELSE 'upload' END AS source_type,
  first_ts FROM (SELECT user_id_text AS user_id, job_id, job_no, min(ts) AS first_ts FROM ev GROUP BY ALL
  UNION ALL SELECT user_id_text, job_id || '-lost', job_no, min(ts) FROM ev WHERE job_no % 5 = 3 GROUP BY ALL)
"""


def jobs(events):
    """One row per upload; every seventh failed, created when its first event arrived.

    Uploads number 3, 8, 13, ... came with another one that lost its events.
    """
    found = events.groupBy("user_id", "job_id", "job_no").agg(F.min("ts").alias("first_ts"))
    lost = found.where("job_no % 5 = 3").withColumn("job_id", F.concat("job_id", F.lit("-lost")))
    return found.unionByName(lost).select(
        "user_id", "job_id", "job_no",
        F.when(F.col("job_no") % 7 == 6, "failed").otherwise("done").alias("status"),
        F.when(F.col("job_no") % 3 == 0, "showdown").when(F.col("job_no") % 3 == 1, "url").otherwise("upload").alias("source_type"),
        F.date_format("first_ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
    )


def match_windows(events):
    """Start and end second of each match within its upload; every sixth match has none."""
    rows = events.where("match_id % 6 <> 5").groupBy("job_id", "match").agg(
        (F.min("event_idx") * 5).cast("double").alias("start_seconds"),
        (F.max("event_idx") * 5 + F.max("match_id") % 4).cast("double").alias("end_seconds"))
    return rows.withColumn("duration_seconds", F.col("end_seconds") - F.col("start_seconds")).withColumn("line", F.col("match"))
