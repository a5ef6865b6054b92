"""Readers and writers over real files, and the streaming jobs."""

import json
import time

from pyspark.sql import functions as F

from ringside.sources import readers, sinks
from ringside.streaming import live

EVENTS = [
    {"timestamp": 0, "event": "team_preview", "actor": "both", "player_brought": "A, B", "match": 1},
    {"timestamp": "5.5", "event": "hp_change", "actor": "player", "pokemon": {"name": "A"}, "hp_percent": "69/157", "match": 1},
    {"timestamp": 9, "event": "field_state", "turn": "2", "player_active": [{"name": "A"}, "B"], "match": 1},
    {"timestamp": "x", "event": "move_used", "turn": "unknown", "hp_percent": True, "match": "1"},
]


def test_events_json(spark, tmp_path):
    for job, text in {"one": json.dumps(EVENTS), "two": "{not json", "three": json.dumps({"events": EVENTS[:2]})}.items():
        (tmp_path / job).mkdir()
        (tmp_path / job / "events.json").write_text(text)
    bronze = readers.read_events_json(spark, str(tmp_path / "*" / "events.json"))
    assert {r["job_id"]: r["count"] for r in bronze.groupBy("job_id").count().collect()} == {"one": 4, "three": 2}
    rows = readers.silver_events(bronze).where("job_id = 'one'").orderBy("event_idx").collect()
    assert [r["timestamp"] for r in rows] == [0.0, 5.5, 9.0, None]
    assert rows[0]["player_brought"] == ["A", "B"] and rows[1]["pokemon"] == "A"
    assert round(rows[1]["hp_percent"], 2) == 43.95 and rows[3]["hp_percent"] is None
    assert rows[2]["turn"] == 2 and rows[3]["turn"] is None and rows[2]["player_active"] == ["A", "B"]
    assert [r["match"] for r in rows] == [1, 1, 1, 1]


def test_places_of_a_file_never_mix(spark, tmp_path):
    """All events with an index of their own keep it; one without, or two alike, and the whole file counts by place."""
    files = {"all": [2, 0, 1], "one_less": [1, None, 0], "twice": [1, 1, 0]}
    for job, numbers in files.items():
        (tmp_path / job).mkdir()
        rows = [{"event": f"e{k}"} | ({} if n is None else {"event_idx": n}) for k, n in enumerate(numbers)]
        (tmp_path / job / "events.json").write_text(json.dumps(rows))
    got = readers.silver_events(readers.read_events_json(spark, str(tmp_path / "*" / "events.json"))).orderBy("event_idx").collect()
    order = {job: [r["event"] for r in got if r["job_id"] == job] for job in files}
    assert order == {"all": ["e1", "e2", "e0"], "one_less": ["e0", "e1", "e2"], "twice": ["e0", "e1", "e2"]}


def test_small_readers(spark, tmp_path):
    job = tmp_path / "job7"
    job.mkdir()
    (job / "matches.csv").write_text("match,start_seconds,end_seconds,duration_seconds\n1,0.0,60.0,60.0\nx,1,2,3\n2,70,100,30\n")
    rows = readers.read_match_windows(spark, str(job / "matches.csv")).orderBy("match").collect()
    assert [(r["job_id"], r["match"], r["duration_seconds"]) for r in rows] == [("job7", 1, 60.0), ("job7", 2, 30.0)]
    assert readers.read_match_windows(spark, str(job / "matches.csv"), by_order=True).count() == 3
    (job / "frames.csv").write_text("filename,timestamp_seconds\na.jpg,1.5\nb.jpg,\n")
    assert [(r["path"], r["t"]) for r in readers.read_frame_manifest(spark, str(job / "frames.csv")).orderBy("ord").collect()] == [("a.jpg", 1.5), ("b.jpg", 1.0)]
    (job / "audit.jsonl").write_text('{"event_type": "a", "created_at": 1}\nbroken\n{"event_type": "b", "created_at": 2}\n{"event_type": "c"}\n')
    assert [r["event_type"] for r in readers.read_audit(spark, str(job / "audit.jsonl"), 2).collect()] == ["b", "c"]
    (job / "transcript.json").write_text(json.dumps([{"match": 1, "start": 0.5, "end": 2.0, "text": "hi"}]))
    assert readers.read_transcript(spark, str(job / "transcript.json")).first()["text"] == "hi"
    (job / "learn.json").write_bytes(json.dumps({"garchomp": ["earthquake", "protect"], "snorlax": ["rest"]}).encode("utf-16"))
    base = readers.read_reference(spark, str(job / "learn.json"), encoding="UTF-16")
    over = spark.createDataFrame([("garchomp", "surf")], "species string, moves string")
    got = readers.override_reference(base, over)
    assert sorted((r["species"], r["moves"]) for r in got.collect()) == [("garchomp", "surf"), ("snorlax", "rest")]
    (job / "log.txt").write_text("|move|p1a: X|Surf")
    assert readers.read_replays(spark, str(job / "log.txt")).first()["raw"].startswith("|move")
    (job / "events.csv").write_text("timestamp,event\n1,move_used\n2,battle_end\n")
    rows = readers.silver_events(readers.read_events_csv(spark, str(job / "events.csv"))).orderBy("event_idx").collect()
    assert [(r["timestamp"], r["event"]) for r in rows] == [(1.0, "move_used"), (2.0, "battle_end")] and rows[0]["job_id"] == "job7"


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("j1", 1, ["A", "B"]), ("j2", 2, [])], "job_id string, n int, names array<string>")
    sinks.write_events(rows, str(tmp_path / "ev"))
    sinks.write_events(rows.where("job_id = 'j2'").withColumn("n", F.lit(5)), str(tmp_path / "ev"))
    assert sorted((r["job_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "ev")).collect()) == [("j1", 1), ("j2", 5)]
    sinks.write_events_csv(rows, str(tmp_path / "csv"))
    assert {r["names"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"A, B", None}
    sinks.write_csv(rows.select("job_id", "n"), str(tmp_path / "win"))
    sinks.write_report_md(rows.select("job_id", F.lit("# Report").alias("value")), str(tmp_path / "md"), ["job_id"])
    assert spark.read.text(str(tmp_path / "md")).count() == 2
    assert sinks.append_audit(rows.select("job_id"), str(tmp_path / "audit"))
    assert sinks.append_audit(rows.select("job_id"), str(tmp_path / "audit")) and spark.read.json(str(tmp_path / "audit")).count() == 4
    (tmp_path / "blocked").write_text("a file")
    assert sinks.append_audit(rows.select("job_id"), str(tmp_path / "blocked" / "x")) is False


def _stream(spark, tmp_path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).parquet(str(tmp_path / name))


def _memory(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    return q


def test_stream_match_state(spark, tmp_path):
    schema = "user_id string, job_id string, match int, event string, actor string, turn int, winner string, event_time timestamp"
    when = lambda s: time.strftime("2024-01-01 00:00:%02d" % s)
    base = [("u", "j", 1, e, a, t, w) for e, a, t, w in [
        ("field_state", "both", 1, None), ("pokemon_fainted", "opponent", None, None), ("pokemon_fainted", "player", None, None),
        ("pokemon_fainted", "opponent", None, None), ("field_state", "both", 3, None)]]
    rows = [(*r, None) for r in base]
    stream = _stream(spark, tmp_path, rows, schema, "live").withColumn("event_time", F.to_timestamp(F.lit(when(5))))
    out = str(tmp_path / "states")

    def drain():
        q = (live.stream_match_state(stream).writeStream.outputMode("update").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "state_log"))
             .foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).start())
        assert q.awaitTermination(40)

    drain()
    spark.createDataFrame([("u", "j", 1, "battle_end", "player", None, "player", None)], schema).write.mode("append").parquet(str(tmp_path / "live"))
    drain()
    got = spark.read.parquet(out).select("ko_diff", "turn", "events", "closed", "winner").orderBy("events").collect()
    assert [tuple(r) for r in got] == [(1, 3, 5, False, None), (1, 3, 6, True, "player")]


def test_stream_counts_and_rooms(spark, tmp_path):
    schema = "event_type string, created_at timestamp, user_id long"
    rows = spark.sql("select 'a' as event_type, timestamp'2024-01-01 10:00:00' as created_at, 1L as user_id union all "
                     "select 'a', timestamp'2024-01-01 11:00:00', 1L union all select 'b', timestamp'2024-01-05 10:00:00', 2L").collect()
    stream = _stream(spark, tmp_path, rows, schema, "audit")
    q = _memory(live.audit_window_counts(stream, delay="1 hour"), "audit_counts", "append")
    got = {(r["event_type"], r["n"]) for r in spark.sql("select * from audit_counts").collect()}
    q.stop()
    assert got == {("a", 2)}
    q = _memory(live.audit_sessions(stream, delay="1 hour"), "audit_sessions", "append")
    assert [r["n"] for r in spark.sql("select * from audit_sessions").collect()] == [2]
    q.stop()
    rooms = _stream(spark, tmp_path, [("r1", rows[0][1]), ("r1", rows[1][1]), ("r2", rows[1][1])], "room_id string, seen timestamp", "rooms")
    q = _memory(live.stream_replays(rooms, "seen"), "rooms_once", "append")
    assert sorted(r["room_id"] for r in spark.sql("select * from rooms_once").collect()) == ["r1", "r2"]
    q.stop()


def test_replay_sink_writes_events(spark, tmp_path):
    from test_replay import LOG

    batch = spark.createDataFrame([("r", 1, LOG, "p1", "u", "j")], "replay_id string, ord int, raw string, player string, user_id string, job_id string")
    live.replay_sink(["Garchomp"], str(tmp_path / "out"))(batch, 0)
    assert spark.read.parquet(str(tmp_path / "out")).where("event = 'battle_end'").count() == 1
