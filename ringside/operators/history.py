"""Uploads of one player as one history: sessions, renumbered matches, trends and comparisons."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.functions import columns as c
from ringside.operators import record as r
from ringside.plans.ordering import ranked
from ringside.plans.scan import null_safe, scan, sum_of

USER = ["user_id"]


def completed_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == "done").withColumn("created_ts", c.created_at_ts("created_at"))


def sessions(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Chronological number of each finished upload; uploads without events keep theirs but give no row."""
    numbered = ranked(completed_jobs(jobs), USER, ["created_ts", "job_id"], "session")
    found = events.groupBy("user_id", "job_id").agg(F.count_distinct("match").alias("matches_in_session"))
    return numbered.join(found, ["user_id", "job_id"]).withColumn("session", F.col("session").cast("int"))


def global_matches(session_rows: DataFrame, events: DataFrame) -> DataFrame:
    """Career number of every (session, match)."""
    local = events.where(F.col("match").isNotNull()).select("user_id", "job_id", "match").distinct()
    local = local.join(session_rows.select("user_id", "job_id", "session"), ["user_id", "job_id"])
    return ranked(local, USER, ["session", "match"], "global_match").withColumn(
        "global_match", F.col("global_match").cast("int"))


def merged_events(session_rows: DataFrame, events: DataFrame, numbers: DataFrame = None) -> DataFrame:
    """Events of every session with career match numbers; rows without a match keep none."""
    numbers = global_matches(session_rows, events) if numbers is None else numbers
    rows = events.join(session_rows.select("user_id", "job_id", "session"), ["user_id", "job_id"])
    keyed = numbers.select(
        F.col("user_id").alias("_u"), F.col("job_id").alias("_j"), F.col("match").alias("_m"), "global_match")
    on = null_safe(rows, keyed, [("user_id", "_u"), ("job_id", "_j"), ("match", "_m")])
    return rows.join(keyed, on, "left").drop("_u", "_j", "_m").withColumn("source_job_id", F.col("job_id"))


def filter_by_date(session_rows: DataFrame, since=None, until=None) -> DataFrame:
    """Whole sessions inside the inclusive day range; malformed bounds do not filter."""
    low = c.date_boundary(F.lit(since).cast("string"))
    high = c.date_boundary(F.lit(until).cast("string"), end_of_day=True)
    when = F.col("created_ts")
    return session_rows.where((low.isNull() | (when >= low)) & (high.isNull() | (when <= high)))


def events_of_sessions(events: DataFrame, session_rows: DataFrame) -> DataFrame:
    return events.join(session_rows.select("user_id", "job_id"), ["user_id", "job_id"], "left_semi")


def events_for_session(merged: DataFrame, number) -> DataFrame:
    return merged.where(F.col("session") == number)


def events_through_session(merged: DataFrame, number) -> DataFrame:
    return merged.where(F.col("session") <= number)


def with_session(matches: DataFrame, session_rows: DataFrame) -> DataFrame:
    return matches.join(session_rows.select("user_id", "job_id", "session"), ["user_id", "job_id"])


def _running_entropy(games, base, choice, out):
    """Entropy over all sessions so far.

    When an option's count goes from a to b, the sum of c*ln(c) changes by
    b*ln(b) - a*ln(a), so running sums per option and per user give the
    entropy of every prefix without pairing sessions.
    """
    keys = [*USER, "_o"]
    counts = games.select(*USER, "session", choice.alias("_o")).where(F.col("_o").isNotNull())
    counts = counts.groupBy(*keys, "session").agg(F.count(F.lit(1)).alias("_c"))
    steps = scan(counts, keys, "session", {"_b": sum_of(F.col("_c"))})
    term = lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)
    before = F.col("_b") - F.col("_c")
    change = steps.groupBy(*USER, "session").agg(
        F.sum("_c").alias("_n"), F.sum(term(F.col("_b")) - term(before)).alias("_s"),
        F.count_if(before == 0).alias("_k"))
    rows = base.select(*USER, "session").join(change, [*USER, "session"], "left").fillna(0)
    total = scan(rows, USER, "session", {x: sum_of(F.col(x)) for x in ("_n", "_s", "_k")})
    return total.select(*USER, "session", r.entropy_of(F.col("_n"), F.col("_s"), F.col("_k")).alias(out))


def skill_trend(matches: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Skill scores of each session alone and of all sessions up to it."""
    played = with_session(matches, session_rows)
    games = r.decided(played)
    on = [*USER, "session"]
    sums = games.groupBy(*on).agg(*[v.alias(k) for k, v in r.skill_sums().items()])
    base = session_rows.select(*on).join(sums, on, "left").fillna(0)
    total = scan(base, USER, "session", {k: sum_of(F.col(k)) for k in r.skill_sums()})
    for choice, out in ((r.lead_choice(), "lead_entropy"), (r.bring_choice(), "bring_entropy")):
        total = total.join(_running_entropy(games, base, choice, out), on, "left")
    cumulative = total.where("n > 0").select(*on, *r.score_columns())
    alone = r.skill_scores(played, on)
    named = lambda rows, prefix: rows.select(*on, *[F.col(x).alias(f"{prefix}_{x}") for x in rows.columns if x not in on])
    return (
        session_rows.select(*on, "job_id", "matches_in_session")
        .join(named(alone, "session"), on, "left").join(named(cumulative, "total"), on, "left")
    )


def matches_through(matches: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Running record over sessions: matches, wins and losses up to each one."""
    played = r.real_matches(with_session(matches, session_rows))
    on = [*USER, "session"]
    sums = played.groupBy(*on).agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col("winner") == "player").alias("wins"),
        F.count_if(F.col("winner") == "opponent").alias("losses"))
    base = session_rows.select(*on).join(sums, on, "left").fillna(0)
    return scan(base, USER, "session", {x: sum_of(F.col(x)) for x in ("games", "wins", "losses")})


def period_compare(matches_a: DataFrame, matches_b: DataFrame, by=USER) -> DataFrame:
    """Second period minus first: win rate, overall and the four scores; NULL when either lacks a figure."""
    def figures(matches, prefix):
        both = r.record(matches, by).select(*by, "win_rate").join(r.skill_scores(matches, by), by, "left")
        kept = ["win_rate", "overall", "tempo", "adaptability", "execution", "closing"]
        return both.select(*by, *[F.col(x).alias(f"{prefix}_{x}") for x in kept]), kept

    a, kept = figures(matches_a, "a")
    b, _ = figures(matches_b, "b")
    both = a.join(b, by, "full")
    return both.select(*by, *[F.bround(F.col(f"a_{x}") - F.col(f"b_{x}"), 1).alias(f"{x}_delta") for x in kept])


def match_durations(session_rows: DataFrame, numbers: DataFrame, windows: DataFrame) -> DataFrame:
    """Duration of each career match; matches without a window have NULL, never 0."""
    spans = windows.groupBy("job_id", "match").agg(F.max_by("duration_seconds", "line").alias("duration_seconds"))
    return numbers.join(spans, ["job_id", "match"], "left").select(
        "user_id", "session", "job_id", "match", "global_match", "duration_seconds")


def session_blocks(matches: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Text of each session: a header and the profile lines; sessions without matches are left out."""
    on = [*USER, "session"]
    profile = r.profile_summary(with_session(matches, session_rows), on)
    n = F.col("matches_in_session")
    header = F.concat(
        F.lit("SESSION "), "session", F.lit(" ("), F.date_format(F.timestamp_seconds("created_ts"), "yyyy-MM-dd"),
        F.lit(", "), n, F.when(n == 1, " match, job ").otherwise(" matches, job "), "job_id", F.lit("):"))
    rows = session_rows.join(profile, on)
    return rows.select(*on, F.concat(header, F.lit("\n"), "profile").alias("block"))
