"""Arriving replays, live match state and audit counts as Structured Streaming jobs."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ringside.contracts import KEY
from ringside.operators import replay
from ringside.plans.ordering import materialise


def stream_replays(arrivals: DataFrame, time, room="room_id", delay="1 hour") -> DataFrame:
    """Each room once: repeats within the watermark are dropped."""
    return arrivals.withWatermark(time, delay).dropDuplicatesWithinWatermark([room])


def replay_sink(legal, path):
    """foreachBatch function: parse each batch of whole replays and store its events under its number.

    Matches go on after those of the batches stored before, and a batch that is tried again replaces itself.
    """

    def write(batch: DataFrame, batch_id):
        keys = ["user_id", "job_id"]
        events = replay.import_replays(batch, legal)
        try:
            stored = batch.sparkSession.read.parquet(path).where(F.col("batch_id") < batch_id)
        except AnalysisException:  # the first batch finds no folder
            stored = None
        if stored is not None:
            last = materialise(stored.groupBy(*keys).agg(F.max("match").alias("_m"), (F.max("event_idx") + 1).alias("_i")))
            events = events.join(last, keys, "left").withColumns({
                "match": (F.col("match") + F.coalesce("_m", F.lit(0))).cast("int"), "event_idx": F.col("event_idx") + F.coalesce("_i", F.lit(0))}).drop("_m", "_i")
        events.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


STATE_SCHEMA = "user_id string, job_id string, match int, ko_diff bigint, turn int, events bigint, closed boolean, winner string"


class MatchState(StatefulProcessor):
    """Running knockout difference and turn of a live match; closed by its end or by silence."""

    def __init__(self, silence_ms=3600000):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.state = handle.getValueState("state", "ko_diff bigint, turn int, events bigint, closed boolean")

    def _keep(self, state, until):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update(state)
        self.handle.registerTimer(until)

    @staticmethod
    def _row(key, ko_diff, turn, seen, closed, winner):
        row = pd.DataFrame([(*key, ko_diff, turn, seen, closed, winner)], columns=[
            "user_id", "job_id", "match", "ko_diff", "turn", "events", "closed", "winner"])
        return row.astype({"turn": "Int32"})

    def handleInputRows(self, key, rows, timerValues):
        ko_diff, turn, seen, closed = self.state.get() if self.state.exists() else (0, None, 0, False)
        winner, latest = None, 0
        if closed:  # late rows of a match that has ended
            return
        for pdf in rows:
            scored = pdf[pdf["event"] == "pokemon_fainted"]["actor"].str.strip().str.lower()
            ko_diff += int((scored == "opponent").sum()) - int((scored != "opponent").sum())
            read = pdf["turn"].dropna()
            if len(read):
                turn = max(int(read.max()), turn or 0)
            ends = pdf[pdf["event"] == "battle_end"]["winner"]
            if len(ends):
                winner = ends.iloc[0] or "unknown"
            seen += len(pdf)
            latest = max(latest, int(pdf["event_ms"].max()))
        # A match that ended is remembered until its silence is over, so that late rows cannot open it again.
        self._keep((ko_diff, turn, seen, winner is not None), latest + self.silence_ms)
        yield self._row(key, ko_diff, turn, seen, winner is not None, winner)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ko_diff, turn, seen, closed = self.state.get()
        self.state.clear()
        if not closed:
            yield self._row(key, ko_diff, turn, seen, True, None)

    def close(self):
        pass


def stream_match_state(events: DataFrame, time="event_time", delay="10 minutes", silence_ms=3600000) -> DataFrame:
    """Updates of running match state; rows later than the watermark are dropped."""
    slim = events.select(*KEY, "event", "actor", "turn", "winner", time, F.unix_millis(time).alias("event_ms")).withWatermark(time, delay)
    return slim.groupBy(*KEY).transformWithStateInPandas(
        MatchState(silence_ms), outputStructType=STATE_SCHEMA, outputMode="Update", timeMode="EventTime")


def audit_window_counts(audit: DataFrame, time="created_at", size="1 day", slide=None, delay=None) -> DataFrame:
    """Counts by kind in tumbling or sliding windows; works on a batch or, with `delay`, on a stream."""
    rows = audit if delay is None else audit.withWatermark(time, delay)
    window = F.window(time, size) if slide is None else F.window(time, size, slide)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), "event_type", "n")


def audit_sessions(audit: DataFrame, time="created_at", user="user_id", gap="6 hours", delay=None) -> DataFrame:
    """Activity sessions by user: bursts with no longer pause than `gap`."""
    rows = audit if delay is None else audit.withWatermark(time, delay)
    return rows.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")
