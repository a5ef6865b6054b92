"""Read side of sharing and coaching: links, rosters, notes and aggregate profiles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.functions import columns as c
from ringside.operators import record as r


def active_share_links(links: DataFrame, now) -> DataFrame:
    """Links neither revoked nor expired at `now` (a timestamp expression)."""
    return links.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") >= now)))


def share_links_list(links: DataFrame, owner=None) -> DataFrame:
    """All links of an owner, revoked ones too, newest first."""
    mine = links if owner is None else links.where(F.col("owner_user_id") == owner)
    return mine.orderBy(F.col("created_at").desc(), "token")


def students_list(students: DataFrame, coach=None) -> DataFrame:
    mine = students if coach is None else students.where(F.col("coach_user_id") == coach)
    return mine.orderBy(F.col("added_at").desc(), "player_user_id")


def authorized_students(students: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests of a coach for a player on the coach's current roster."""
    return requests.join(students, ["coach_user_id", "player_user_id"], "left_semi")


def notes_by_coach(notes: DataFrame, students: DataFrame = None) -> DataFrame:
    """Notes of coaches about their students, newest first."""
    mine = notes if students is None else notes.join(students, ["coach_user_id", "player_user_id"], "left_semi")
    return mine.orderBy(F.col("created_at").desc(), "id")


def notes_about(notes: DataFrame, player) -> DataFrame:
    return notes.where(F.col("player_user_id") == player).orderBy(F.col("created_at").desc(), "id")


def mentioned_matches(messages: DataFrame, known: DataFrame, keys, text="text") -> DataFrame:
    """(columns of messages but the text, match): the matches that a message names and its owner has.

    `known` has the keys and match; a number that stands for no match there goes.
    """
    named = messages.withColumn("match", F.explode(c.referenced_matches(text))).drop(text)
    return named.join(known.select(*keys, F.col("match").cast("bigint").alias("match")).distinct(), [*keys, "match"], "left_semi")


def student_profiles(students: DataFrame, matches: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Aggregates of every student of every coach; raw events never leave the player's tables."""
    by = ["user_id"]
    sessions = session_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("sessions_count"))
    scores = r.skill_scores(matches, by).select(*by, "overall", "tier")
    profile = r.record(matches, by).join(scores, by, "left").join(sessions, by, "left").fillna(0, ["sessions_count"])
    return students.select("coach_user_id", F.col("player_user_id").alias("user_id")).distinct().join(profile, by)
