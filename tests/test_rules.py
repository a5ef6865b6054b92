"""Order-dependent operators against plain loops written from the rules."""

import json
import random

from pyspark.sql import functions as F

from ringside.operators import clean, history, record, review, signals, strategy, turns
from ringside.plans.ordering import in_time_order

KEY = "user_id string, job_id string, match int"


def test_dedupe_anchored_is_not_sliding(spark):
    rows = [("u", "j", 1, i, "move_used", None, "d", t, "player") for i, t in enumerate([0.0, 2.0, 4.0, 5.0, 8.0])]
    df = spark.createDataFrame(rows, KEY + ", event_idx long, event string, pokemon string, detail string, timestamp double, actor string")
    assert sorted(r["timestamp"] for r in clean.dedupe_anchored(df).collect()) == [0.0, 4.0, 8.0]


def test_dedupe_anchored_random(spark):
    rnd = random.Random(5)
    rows, t = [], 0.0
    for i in range(250):
        t += rnd.choice([0.0, 0.5, 1.0, 4.0])
        rows.append(("u", "j", 1, i, "e", None, rnd.choice("xy"), t, rnd.choice(["player", "opponent", None])))
    df = spark.createDataFrame(rows, KEY + ", event_idx long, event string, pokemon string, detail string, timestamp double, actor string")
    kept = []
    for r in rows:
        near = [k for k in kept if r[7] - k[7] <= 3.0 and k[6] == r[6] and (not k[8] or not r[8] or k[8] == r[8])]
        if not near:
            kept.append(r)
    for width in (3, None):
        assert sorted(r["event_idx"] for r in clean.dedupe_anchored(df, width=width).collect()) == [k[3] for k in kept]


def test_dedupe_vectors(spark):
    rnd = random.Random(6)
    rows = [("v", i, [rnd.uniform(0, 9) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "v string, i long, vec array<double>")
    kept = [rows[0]]
    for r in rows[1:]:
        if sum(abs(a - b) for a, b in zip(kept[-1][2], r[2])) / 4 >= 3.0:
            kept.append(r)
    got = signals.dedupe_vectors(df, ["v"], "i", "vec", 3.0, width=5).collect()
    assert sorted(r["i"] for r in got) == [k[1] for k in kept]


def _random_match(seed, n=120):
    rnd = random.Random(seed)
    names = {"player": ["A", "B", "C", "D"], "opponent": ["W", "X", "Y", "Z"]}
    rows, turn = [], 0
    for i in range(n):
        kind = rnd.choice(["field_state", "pokemon_sent_out", "move_used", "pokemon_fainted", "pokemon_sent_out"])
        side = rnd.choice(["player", "opponent"])
        if i == 0:
            kind = "team_preview"
        active = {s: rnd.sample(names[s], rnd.choice([0, 0, 1, 2, 3])) for s in names}
        if kind == "field_state":
            turn += rnd.choice([0, 1, 1])
        rows.append({
            "user_id": "u", "job_id": "j", "match": seed, "event_idx": i, "event": kind, "timestamp": float(i),
            "actor": "both" if kind in ("field_state", "team_preview") else side,
            "pokemon": None if kind in ("field_state", "team_preview") else rnd.choice(names[side]),
            "detail": rnd.choice(["Surf", "Protect (failed)", "Fake Out"]) if kind == "move_used" else None,
            "turn": turn if kind == "field_state" and rnd.random() < .8 and turn else None,
            "player_active": active["player"] if kind == "field_state" else None,
            "opponent_active": active["opponent"] if kind == "field_state" else None,
            "player_team": names["player"] if kind == "team_preview" else None,
            "opponent_team": names["opponent"] if kind == "team_preview" else None,
            "player_brought": None, "opponent_brought": names["opponent"][:3] if kind == "team_preview" else None,
            "player_lead": ["A", "B"] if kind == "team_preview" else None,
            "opponent_lead": ["W", "X"] if kind == "team_preview" else None,
        })
    return rows


SHAPE = (KEY + ", event_idx long, event string, timestamp double, actor string, pokemon string, detail string, turn int, "
         "player_active array<string>, opponent_active array<string>, player_team array<string>, opponent_team array<string>, "
         "player_brought array<string>, opponent_brought array<string>, player_lead array<string>, opponent_lead array<string>, "
         "move string, hp_percent double, tailwind string, trick_room boolean, weather string, terrain string, screens string, "
         "winner string, confidence double, corrected boolean, roster_conflict boolean, reference_frame string")


def frame(spark, rows):
    names = [x.strip().split(" ")[0] for x in SHAPE.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SHAPE)


def _drop(names, gone):
    names = list(names)
    while len(names) > 2:
        names.remove(next((x for x in names if x in gone), names[0]))
    return names


def test_board_against_a_loop(spark):
    rows = [r for seed in range(1, 9) for r in _random_match(seed)]
    got = {}
    t = turns.turns_of(frame(spark, rows))
    for width in (2, None):
        got = {(r["match"], r["turn"], r["side"]): r["board"] for r in turns.board(t, width=width).collect()}
        for match in range(1, 9):
            buckets, now = {}, None
            for r in (x for x in rows if x["match"] == match):
                if r["event"] == "field_state":
                    now = r["turn"] if r["turn"] is not None else now
                    if now is not None:
                        buckets.setdefault(now, []).append(r)
                elif now is not None and r["event"] != "team_preview":
                    buckets[now].append(r)
            for side in ("player", "opponent"):
                board, gone = [], set()
                for turn in sorted(buckets):
                    for r in buckets[turn]:
                        if r["event"] == "field_state" and r[f"{side}_active"]:
                            board = r[f"{side}_active"]
                    assert got[(match, turn, side)] == board
                    for r in buckets[turn]:
                        if r["actor"] == side and r["event"] == "pokemon_fainted":
                            gone.add(r["pokemon"])
                        if r["actor"] == side and r["event"] == "pokemon_sent_out" and r["pokemon"] not in board:
                            board = board + [r["pokemon"]]
                    board = _drop(board, gone)


def test_event_boards_against_a_loop(spark):
    rows = [r for seed in range(11, 15) for r in _random_match(seed)]
    for width in (3, None):
        got = {(r["match"], r["event_idx"]): r for r in review.boards_by_event(frame(spark, rows), width=width).collect()}
        for match in range(11, 15):
            boards, gone = {"player": [], "opponent": []}, {"player": set(), "opponent": set()}
            for r in (x for x in rows if x["match"] == match):
                for side in boards:
                    if r["event"] == "team_preview":
                        boards[side] = list(r[f"{side}_lead"])
                    elif r["event"] == "field_state":
                        boards[side] = list(r[f"{side}_active"]) or boards[side]
                    elif r["actor"] == side and r["pokemon"]:
                        if r["event"] == "pokemon_fainted":
                            gone[side].add(r["pokemon"])
                        if r["pokemon"] not in boards[side]:
                            boards[side] = _drop(boards[side] + [r["pokemon"]], gone[side])
                    assert got[(match, r["event_idx"])][f"{side}_board"] == boards[side]


def test_activity_windows_against_a_loop(spark):
    rnd = random.Random(7)
    t, samples = 0.0, []
    for _ in range(80):
        t += rnd.choice([0.5, 1.0, 3.0])
        samples.append(("v", t, rnd.uniform(0, 12), rnd.uniform(0, 40)))
    df = spark.createDataFrame(samples, "v string, t double, motion double, brightness double")
    want, bucket, start = [], [], samples[0][1]
    for s in samples:
        if s[1] - start >= 4.0 and bucket:
            want.append((start, s[1], len(bucket)))
            bucket, start = [], s[1]
        bucket.append(s)
    want.append((start, samples[-1][1] + samples[1][1] - samples[0][1], len(bucket)))
    got = sorted((r["start"], r["end"]) for r in signals.activity_windows(df, ["v"], width=4).collect())
    assert [(round(a, 9), round(b, 9)) for a, b in got] == [(round(a, 9), round(b, 9)) for a, b, _ in want]


def test_correction_chain(spark):
    names = "user_id string, job_id string, match int, actor string, old_name string, new_name string, seq int"
    fixes = [("u", "j", 1, "player", "A", "B", 1), ("u", "j", 1, "player", "B", "C", 2), ("u", "j", 1, "player", "C", "A", 3),
             ("u", "j", 1, "player", "Z", "C", 4), ("u", "j", 1, "both", "A", "Q", 5)]
    got = {r["old_name"]: r["final_name"] for r in clean.final_names(spark.createDataFrame(fixes, names)).collect()}
    assert got == {"A": "A", "B": "A", "C": "A", "Z": "C"}


def test_running_entropy_equals_prefix_entropy(spark):
    rnd = random.Random(8)
    rows = [("u", f"j{s}", s, rnd.choice("abc")) for s in range(1, 7) for _ in range(rnd.randint(0, 5))]
    games = spark.createDataFrame(rows, "user_id string, job_id string, session int, lead string")
    base = spark.createDataFrame([("u", s) for s in range(1, 7)], "user_id string, session int")
    got = {r["session"]: r["e"] for r in history._running_entropy(games, base, F.col("lead"), "e").collect()}
    for s in range(1, 7):
        prefix = games.where(F.col("session") <= s)
        want = record.entropy(prefix, ["user_id"], "lead", "e").first()
        assert abs(got[s] - (want["e"] if want else 0.0)) < 1e-9


def test_match_numbers_from_previews(spark):
    rows = [{"user_id": "u", "job_id": "j", "match": None, "event_idx": i, "event": e} for i, e in enumerate(
        ["move_used", "team_preview", "move_used", "team_preview", "battle_end"])]
    got = record.with_match_numbers(frame(spark, rows)).orderBy("event_idx").collect()
    assert [r["match"] for r in got] == [1, 1, 1, 2, 2]


def test_windows_follow_time_and_readings_follow_arrival(spark):
    base = {"user_id": "u", "job_id": "j", "match": 1}
    rows = [
        {**base, "event": "team_preview", "timestamp": 0.0, "player_brought": ["A", "B"], "opponent_brought": ["W", "X"]},
        {**base, "event": "field_state", "timestamp": 10.0, "turn": 1},
        {**base, "event": "field_state", "timestamp": 40.0, "turn": 2, "tailwind": "player"},
        {**base, "event": "pokemon_fainted", "timestamp": 12.0, "actor": "player", "pokemon": "A"},
        {**base, "event": "battle_end", "timestamp": 50.0, "winner": "opponent"},
    ]
    events = frame(spark, [{**r, "event_idx": i} for i, r in enumerate(rows)])
    s = strategy.strategy_of(in_time_order(events), "event_idx", "time_idx")
    one, two = s.timeline.orderBy("turn").collect()
    # In time the faint belongs to turn 1, so the loss shows in turn 2; by arrival it belongs to turn 2.
    assert (one["player_alive"], two["player_alive"], two["player_lost"]) == (2, 1, ["A"])
    assert (one["player_faints"], two["player_faints"]) == (0, 1)
    assert (two["score"], two["delta"], two["reasons"]) == (-15, -15, ["Player lost A", "Player gained Tailwind"])
    trace = strategy.loss_trace(s, events).first()
    assert (trace["loser"], trace["decisive_turn"], trace["final_blow_turn"], trace["course"]) == ("player", 1, 2, "turned")


def test_field_status_is_corrected(spark):
    status = '{"note": "x", "player_active": [{"pokemon": "A", "hp": 40}, {"pokemon": "B"}], "opponent_active": [{"pokemon": "A"}]}'
    rows = [("u", "j", 1, 0, "both", None, status, False), ("u", "j", 2, 1, "both", None, status, False)]
    events = spark.createDataFrame(rows, KEY + ", event_idx long, actor string, pokemon string, field_status string, corrected boolean").withColumn(
        "player_active", F.array(F.lit("A")))
    fixes = spark.createDataFrame([("u", "j", 1, "player", "A", "C", 1)], KEY + ", actor string, old_name string, new_name string, seq int")
    got = {r["match"]: r for r in clean.apply_corrections(events, fixes).collect()}
    assert json.loads(got[1]["field_status"]) == {
        "note": "x", "player_active": [{"pokemon": "C", "hp": 40}, {"pokemon": "B"}], "opponent_active": [{"pokemon": "A"}]}
    assert got[1]["player_active"] == ["C"] and got[1]["corrected"] is True
    assert got[2]["field_status"] == status and got[2]["corrected"] is False
