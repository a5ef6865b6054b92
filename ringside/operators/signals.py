"""Time series of frames, labels and motion: nearest frames, segmentation, duplicates and votes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.contracts import KEY
from ringside.functions import columns as c
from ringside.operators.record import top_n
from ringside.operators.teams import default_dex, narrow_species_by_types
from ringside.plans.folds import fold
from ringside.plans.jumps import chained
from ringside.plans.nearest import around, attach, best_within
from ringside.plans.ordering import sorted_index
from ringside.plans.scan import count_of, last_of, max_of, scan


def nearest_frame(events: DataFrame, frames: DataFrame, keys=KEY, event_time="timestamp", frame_time="t", width=None) -> DataFrame:
    """Add `nearest_frame`: the frame closest in time, the earlier one on ties; no time, no frame.

    `frames` has the keys, t, path and ord (place in the frame list).
    """
    found = around(events, frames, keys, event_time, frame_time, F.min_by("path", "ord"), width)
    back, ahead = F.col("_t") - F.col("before.t"), F.col("after.t") - F.col("_t")
    closer = F.when(F.col("after").isNull() | (back <= ahead), F.col("before.mark")).otherwise(F.col("after.mark"))
    found = found.select(*keys, "_t", closer.alias("nearest_frame"))
    return attach(events, found, keys, event_time)


def attach_reference_frames(events: DataFrame, frames: DataFrame, quality: DataFrame = None, keys=KEY, reach=1.5,
                            width=None) -> DataFrame:
    """Set `reference_frame`: the sharpest quality frame within `reach` seconds, else the nearest frame.

    `quality` has the keys, t, path, ord and sharpness.
    """
    rows = nearest_frame(events, frames, keys, width=width)
    chosen = F.col("nearest_frame")
    if quality is not None:
        rank = F.struct("sharpness", (-F.col("ord")).alias("first"), "path")
        sharp = quality.where(F.col("sharpness").isNotNull())
        best = best_within(events, sharp, keys, "timestamp", "t", rank, reach, width)
        best = best.select(*keys, "_t", F.col("best.path").alias("_sharp"))
        rows = attach(rows, best, keys, "timestamp")
        chosen = F.coalesce("_sharp", "nearest_frame")
    old = F.col("reference_frame") if "reference_frame" in events.columns else F.lit(None).cast("string")
    return rows.withColumn("reference_frame", F.coalesce(chosen, old)).drop("nearest_frame", "_sharp")


def dedupe_vectors(frames: DataFrame, keys, order, vector, threshold=2.0, width=None) -> DataFrame:
    """Keep a frame when its mean absolute difference to the last kept frame reaches the threshold."""
    if threshold <= 0:
        return frames

    def step(kept, row):
        gap = F.aggregate(F.zip_with(kept, row["_v"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x)
        new = (F.size(kept) == 0) | (gap / F.size(row["_v"]) >= threshold)
        return F.struct(F.when(new, row["_v"]).otherwise(kept).alias("state"), new.alias("out"))

    rows = frames.withColumn("_v", F.col(vector).cast("array<double>"))
    kept = fold(rows, keys, order, ["_v"], F.array(), step, "array<double>", "boolean", width)
    return frames.join(kept.where("out").select(*keys, order), [*keys, order], "left_semi")


def activity_windows(signals: DataFrame, keys, time="t", span=4.0, motion=6.0, dark=20.0, width=None) -> DataFrame:
    """Windows that start at a sample and end at the first sample `span` later, with mean motion and brightness.

    A sample without time is in no window. `span` is positive.
    """
    if span <= 0:
        raise ValueError("span must be positive")
    timed = signals.where(F.col(time).isNotNull())
    rows = sorted_index(timed.select(*keys, F.col(time).cast("double").alias("t"), "motion", "brightness"), [*keys, "t"])
    starts, _ = chained(rows, keys, "t", span, width=width)
    opened = rows.join(starts.withColumn("_opens", F.lit(True)), "_seq", "left")
    tagged = scan(opened, keys, "_seq", {"start": last_of(F.when(F.col("_opens"), F.col("t")))}).drop("_opens")
    sums = tagged.groupBy(*keys, "start").agg(
        F.avg("motion").alias("motion"), F.avg("brightness").alias("brightness"), F.min("_seq").alias("_seq"))
    first = rows.groupBy(*keys).agg(F.max("t").alias("_last"), F.min("t").alias("_t0"), F.count(F.lit(1)).alias("_n"))
    second = top_n(rows, keys, ["_seq"], 2).where("rank = 2").select(*keys, F.col("t").alias("_t1"))
    windows = scan(sums, keys, "_seq", {"_next": last_of(F.col("start"), inclusive=False)}, reverse=True)
    windows = windows.join(first, keys).join(second, keys, "left")
    tail = F.col("_last") + F.when(F.col("_n") > 1, F.col("_t1") - F.col("_t0")).otherwise(1.0)
    active = (F.col("motion") >= motion) & (F.col("brightness") >= dark)
    return windows.select(*keys, "start", F.coalesce("_next", tail).alias("end"), "motion", "brightness", active.alias("active"))


def merge_intervals(windows: DataFrame, keys, pad=2.0) -> DataFrame:
    """Pad active windows (not below zero) and join those that touch."""
    padded = windows.where("active").select(
        *keys, F.greatest(F.lit(0.0), F.col("start") - pad).alias("s"), (F.col("end") + pad).alias("e"))
    rows = sorted_index(padded, [*keys, "s", "e"])
    rows = scan(rows, keys, "_seq", {"_reach": max_of(F.col("e"), inclusive=False)})
    fresh = F.col("_reach").isNull() | (F.col("s") > F.col("_reach"))
    rows = scan(rows, keys, "_seq", {"segment": count_of(fresh)})
    return rows.groupBy(*keys, "segment").agg(F.min("s").alias("start_seconds"), F.max("e").alias("end_seconds"))


def label_runs(series: DataFrame, keys, time="ts", label="label", wanted="battle") -> DataFrame:
    """Stretches of consecutive samples with the wanted label; `run` numbers grow with time."""
    rows = sorted_index(series.select(*keys, F.col(time).alias("t"), F.col(label).alias("l")), [*keys, "t"])
    rows = scan(rows, keys, "_seq", {"run": count_of(F.col("l") != wanted)})
    return rows.where(F.col("l") == wanted).groupBy(*keys, "run").agg(F.min("t").alias("start"), F.max("t").alias("end"))


def segment_matches(runs: DataFrame, keys, interval=10.0, merge_gap=40.0, min_duration=60.0) -> DataFrame:
    """Runs joined over short gaps, short ones dropped, numbered from 1; the length test precedes the interval."""
    rows = scan(runs, keys, "run", {"_end": last_of(F.col("end"), inclusive=False)})
    fresh = F.col("_end").isNull() | (F.col("start") - F.col("_end") > merge_gap)
    rows = scan(rows, keys, "run", {"_m": count_of(fresh)})
    merged = rows.groupBy(*keys, "_m").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    kept = merged.where(F.col("end") - F.col("start") >= min_duration)
    numbered = scan(kept, keys, "_m", {"match": count_of()})
    return numbered.select(*keys, F.col("match").cast("int").alias("match"), F.col("start").alias("start_seconds"),
                           (F.col("end") + interval).alias("end_seconds"),
                           (F.col("end") + interval - F.col("start")).alias("duration_seconds"))


def label_counts(series: DataFrame, keys, label="label") -> DataFrame:
    return series.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("frames"))


def average_match_length(windows: DataFrame, keys) -> DataFrame:
    return windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), F.avg("duration_seconds").alias("avg_seconds"))


def compare_labels(first: DataFrame, second: DataFrame, keys, time="ts", label="label") -> DataFrame:
    """Agreement of two labelings of the same samples."""
    a = first.select(*keys, time, F.col(label).alias("_a"))
    both = a.join(second.select(*keys, time, F.col(label).alias("_b")), [*keys, time])
    agreed = F.count_if(F.col("_a").eqNullSafe(F.col("_b")))
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), agreed.alias("agreed"),
        F.bround(c.ratio_pct(agreed, F.count(F.lit(1))), 1).alias("agreement_pct"))


def label_disagreements(first: DataFrame, second: DataFrame, keys, time="ts", label="label") -> DataFrame:
    a = first.select(*keys, time, F.col(label).alias("label_a"))
    both = a.join(second.select(*keys, time, F.col(label).alias("label_b")), [*keys, time])
    return both.where(~F.col("label_a").eqNullSafe(F.col("label_b")))


def prefilter_report(segments: DataFrame, lengths: DataFrame, keys, fps=1.0) -> DataFrame:
    """Seconds kept (at most the video length), share dropped and cost with and without the filter."""
    kept = segments.groupBy(*keys).agg(F.sum(F.col("end_seconds") - F.col("start_seconds")).alias("_k"))
    rows = lengths.join(kept, keys, "left").fillna(0.0, ["_k"])
    length = F.col("video_seconds")
    kept_s = F.when(length > 0, F.least("_k", length)).otherwise(F.col("_k"))
    dropped = F.when(length > 0, F.greatest(F.lit(0.0), length - kept_s)).otherwise(0.0)
    return rows.select(
        *keys, kept_s.alias("kept_seconds"), dropped.alias("dropped_seconds"),
        c.ratio_pct(dropped, length).alias("dropped_pct"),
        c.cost_estimate(length, fps)["cost"].alias("cost_all"), c.cost_estimate(kept_s, fps)["cost"].alias("cost_kept"))


def vote_types(reads: DataFrame, keys, cap=3) -> DataFrame:
    """Types seen in at least min(n // 2 + 1, cap) frames of a row, and the most frequent badge count."""
    frames = reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    need = F.least(F.expr("n_frames div 2 + 1"), F.lit(cap))
    votes = reads.select(*keys, F.explode(F.array_distinct("types")).alias("type")).groupBy(*keys, "type").agg(
        F.count(F.lit(1)).alias("_v"))
    sure = votes.join(frames, keys).where(F.col("_v") >= need)
    # At most eighteen types per row.
    types = sure.groupBy(*keys).agg(F.array_sort(F.collect_list("type")).alias("identified_types"))
    badges = reads.groupBy(*keys, "num_badges").agg(F.count(F.lit(1)).alias("_b")).groupBy(*keys).agg(
        F.max_by("num_badges", F.struct("_b", "num_badges")).alias("num_badges_found"))
    rows = frames.join(badges, keys).join(types, keys, "left")
    return rows.withColumn("identified_types", F.coalesce("identified_types", F.array().cast("array<string>")))


def _base_name(name):
    """A species name in lower case without its form."""
    return "".join(x for x in name.split("-")[0].lower() if x.isalnum())


def row_type_hints(reads: DataFrame, keys, dex=None, legal=None) -> DataFrame:
    """Candidate species of each roster row from its voted types; rows without a sure type give nothing."""
    voted = vote_types(reads, keys).where(F.size("identified_types") > 0)
    if legal is not None:
        # Forms count as their base species; a list that allows nothing leaves an empty dex.
        allowed = {_base_name(name) for name in legal}
        dex = {k: v for k, v in (default_dex() if dex is None else dex).items() if _base_name(k) in allowed}
    return narrow_species_by_types(voted, "identified_types", "num_badges_found", dex)


def best_read_by_row(scores: DataFrame, crop, row, least=0.5, margin=0.05) -> DataFrame:
    """Per crop and row the top candidate if it is good and clear of the runner-up; then the best per row."""
    ranked = top_n(scores, [*crop, *row], [F.col("score").desc(), F.col("species")], 2)
    pair = ranked.groupBy(*crop, *row).agg(
        F.max(F.when(F.col("rank") == 1, F.struct("score", "species"))).alias("top"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("next"))
    gap = F.col("top.score") - F.coalesce("next", F.lit(0.0))
    good = pair.where((F.col("top.score") >= least) & (gap >= margin))
    confidence = F.bround("top.score", 3)
    first = F.struct((-confidence).alias("c"), *crop)
    return good.groupBy(*row).agg(F.min_by(F.struct(
        F.col("top.species").alias("species"), confidence.alias("confidence"), F.bround(gap, 3).alias("runner_up_margin")), first).alias("_b")).select(*row, "_b.*")


def assign_to_windows(points: DataFrame, windows: DataFrame, keys, time="t", block=600.0) -> DataFrame:
    """Points with the windows that hold them, joined on time blocks so that only neighbours meet."""
    spread = windows.select(*keys, "match", "start_seconds", "end_seconds", F.explode(F.sequence(
        F.floor(F.col("start_seconds") / block), F.floor(F.col("end_seconds") / block))).alias("_b"))
    rows = points.withColumn("_b", F.floor(F.col(time) / block)).join(spread, [*keys, "_b"])
    inside = (F.col(time) >= F.col("start_seconds")) & (F.col(time) < F.col("end_seconds"))
    return rows.where(inside).drop("_b", "start_seconds", "end_seconds")


def transcript_stats(segments: DataFrame, keys) -> DataFrame:
    words = F.size(F.filter(F.split(F.trim("text"), "\\s+"), lambda w: w != ""))
    return segments.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"), F.sum(words).alias("words"))


def match_context(events: DataFrame, transcript: DataFrame, limit=60) -> DataFrame:
    """Lines of a match in reading order: the event log, then at most `limit` commentary segments."""
    said = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}="), value))
    joined = lambda name: said(name, F.array_join(name, ", "))
    seconds = F.concat(F.rint("timestamp").cast("bigint"), F.lit("s"))
    line = F.concat(F.lit("  "), F.concat_ws(
        " | ", seconds, "event", F.when(F.col("actor") != "", F.col("actor")), said("pokemon", F.col("pokemon")),
        said("detail", F.col("detail")), joined("player_active"), joined("opponent_active"), joined("player_brought"),
        joined("opponent_brought"), said("winner", F.col("winner")), said("turn", F.nullif(F.col("turn"), F.lit(0)).cast("string"))))
    log = events.select(*KEY, F.lit(1).alias("part"), F.col("event_idx").alias("place"), line.alias("line"))
    heard = top_n(transcript, KEY, ["start"], limit)
    spoken = heard.select(*KEY, F.lit(2).alias("part"), F.col("rank").cast("bigint").alias("place"), F.concat(
        F.lit("  "), F.rint("start").cast("bigint"), F.lit("s: "), "text").alias("line"))
    return log.unionByName(spoken)
