"""5. Mixing sources to target weights: weighted fair queueing, globally ordered and cut at the budget.

Sizes are words `[^\\x20\\x09-\\x0D]+`. Sources in code point order, null last, weigh 1, 2, 3 and so on in turn. Their targets share
the size of all documents by weight; a target stops at 3 times its source, and the excess is shared anew by weight. That level
is found in closed form: sources reach their bound in the order of size over weight.

Each source's documents are shuffled by a hash of their id and queued up to three times. An entry finishes at
(words of its source queued so far, itself included) / target. Entries that start before their source has its target
are ordered by finish time and taken while the words add up to no more than the budget.

Running sums are taken in two levels (hash buckets of a source, slices of finish time), about `BUCKET_ROWS` rows each,
so no source and no order needs one task. Texts are only counted in the scan; every shuffle is over narrow rows.

Edge cases: null or blank text: size 0, taken 0. Null source: a source of its own, last. Null ids count as empty text in
the shuffle order. Rows that repeat an id are queued each for itself. All sizes 0: targets 0. Empty table: no rows.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm import frames

MOST = 3
WEIGHTS = 3
BUCKET_ROWS = 20_000


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, target, total) for each source; the tables here have a row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(by_name)).withColumn("w", (F.col("sid") - 1) % WEIGHTS + 1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy(F.col("source_size") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    per = per.withColumn("free", (F.col("total") - F.coalesce(F.sum(MOST * F.col("source_size")).over(filling), F.lit(0))).cast("double"))
    per = per.withColumn("free_w", (F.col("all_w") - F.coalesce(F.sum("w").over(filling), F.lit(0))).cast("double"))
    per = per.withColumn("level", F.col("free") / F.col("free_w")).withColumn("full", F.col("level") * F.col("w") >= MOST * F.col("source_size"))
    # The level of all unbounded sources is that of the first of them in filling order.
    first = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("w")).alias("r"), "sid", "level"))).over(everything)
    target = F.when(F.col("full"), (MOST * F.col("source_size")).cast("double")).otherwise(first["level"] * F.col("w"))
    return per.select("source", "sid", "source_size", target.alias("target"), "total")


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per document."""
    sizes = frames.stored(sized(docs), "sizes")
    goal = frames.stored(targets(sizes), "targets")
    rows = sizes.count()
    digits = 1
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    queue = sizes.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queue = queue.withColumn("b", F.substring("h", 1, digits))
    per_bucket = queue.groupBy("sid", "b").agg(F.sum("size").alias("s"))
    earlier = Window.partitionBy("sid").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("sid", "b", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = queue.join(per_bucket, ["sid", "b"]).withColumn("cum", F.col("before") + F.sum("size").over(inside))
    queue = frames.stored(queue.select("doc_id", "h", "sid", "size", "source_size", "target", "total", "cum"), "queue")

    slices = 16**digits
    entries = queue.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("e"))
    entries = entries.filter(F.col("e") * F.col("source_size") + F.col("cum") - F.col("size") < F.col("target"))
    entries = entries.withColumn("rank", _rank(F.col("e"))).withColumn("slice", F.least(F.floor(F.col("rank.f") * slices), F.lit(slices)))
    per_slice = entries.groupBy("slice").agg(F.sum("size").alias("s"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.select("slice", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("slice").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    within = entries.join(per_slice, "slice").withColumn("upto", F.col("before") + F.sum("size").over(inside))
    last = within.filter("upto <= total").agg(F.max("rank").alias("last")).first()["last"]  # the last entry that the budget holds
    last = _constant(last) if last else F.lit(None)
    taken = F.lit(0).cast("long")
    for e in range(MOST):
        starts = F.lit(e) * F.col("source_size") + F.col("cum") - F.col("size") < F.col("target")
        taken = taken + F.when((F.col("size") > 0) & starts & (_rank(F.lit(e)) <= last), F.col("size")).otherwise(0)
    return queue.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def _rank(e):
    """Order of an entry: finish time, then source, round, hash and id."""
    finish = (e * F.col("source_size") + F.col("cum")) / F.col("target")
    return F.struct(finish.alias("f"), F.col("sid"), e.cast("int").alias("e"), F.col("h"), F.coalesce(F.col("doc_id"), F.lit(-1)).alias("id"), F.col("cum"))


def _constant(rank):
    return F.struct(F.lit(rank["f"]).alias("f"), F.lit(rank["sid"]).cast("int").alias("sid"), F.lit(rank["e"]).cast("int").alias("e"), F.lit(rank["h"]).alias("h"),
                    F.lit(rank["id"]).cast("long").alias("id"), F.lit(rank["cum"]).cast("long").alias("cum"))


def op5_mixing(spark, sf_dir):
    return mixed(frames.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
p AS (SELECT *, (sid - 1) % 3 + 1 AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s GROUP BY source)),
q AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, source_size / w AS r,
        (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
      FROM p WINDOW before AS (ORDER BY source_size / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, sid, source_size, total, CASE WHEN level * w >= 3 * source_size THEN (3 * source_size)::DOUBLE
        ELSE (SELECT level FROM q WHERE level * w < 3 * source_size ORDER BY r, sid LIMIT 1) * w END AS target FROM q),
c AS (SELECT row_number() OVER () AS no, doc_id, size, h, sid, source_size, target, total,
        sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS cum
      FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
e AS (SELECT c.*, e, (e * source_size + cum)::DOUBLE / target AS f FROM c, (VALUES (0), (1), (2)) v(e) WHERE size > 0 AND e * source_size + cum - size < target),
t AS (SELECT no, size FROM (SELECT *, sum(size) OVER (ORDER BY f, sid, e, h, coalesce(doc_id, -1), cum ROWS UNBOUNDED PRECEDING) AS upto FROM e) WHERE upto <= total)
SELECT doc_id, size, source_size, target, CAST(coalesce(x.taken, 0) AS BIGINT) AS taken
FROM c LEFT JOIN (SELECT no, sum(size) AS taken FROM t GROUP BY no) x USING (no)
"""
