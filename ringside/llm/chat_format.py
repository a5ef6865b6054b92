"""9. Chat formatting: a hidden Markov model over marker and line features recovers the roles of a transcript by Viterbi.

A transcript is numbered lines of text. A line's features are the speaker named by its marker (`User:`, `[assistant]`,
`<|system|>`, `### Human`, `Q:` and so on), whether it is blank, follows a blank line, or ends with a question mark. States are (role, first line of
a turn or a later one). Viterbi finds the best states, turns begin at first-line states, and each turn is rendered
canonically without its marker.

A transcript may hold any share of all lines: Viterbi is a product of matrices in (max, +), so lines are cut into runs of
`RUN`; each run gives its 8 x 8 matrix, the matrices of a transcript are multiplied (in groups of `GROUP`, level by
level, so that no group is large), and each run is then traced between its known first and last states.

Edge cases: null text is an empty line. Null role (query): the turn carries no marker but follows a blank line. A
transcript without any marker: alternating turns are not guessed, it is one user turn. Repeated (conv_id, turn) rows are turns of their own.
Rows without conv_id form one transcript. Empty table: no rows.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm import frames
from ringside.plans.ordering import ranked

ROLES = ("system", "user", "assistant", "tool")
NAMES = {"system": "system", "instruction": "system", "user": "user", "human": "user", "you": "user", "q": "user", "question": "user", "customer": "user",
         "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "a": "assistant", "answer": "assistant", "agent": "assistant", "tool": "tool", "function": "tool"}
_NAME = "|".join(sorted(NAMES, key=len, reverse=True))
_MARKER = re.compile(rf"^(?:<\|(?P<a>{_NAME})\|>|\[(?P<b>{_NAME})\]|#{{2,4}} (?P<c>{_NAME}):?(?=\n|$)|\*\*(?P<d>{_NAME}):?\*\*:?|(?P<e>{_NAME}) ?[:>])(?: |$)?", re.I)
RUN, GROUP = 2048, 512

_STATES = 2 * len(ROLES)
_TINY = -60.0


def marker(line: str):
    """(role or None, line without its marker)."""
    found = _MARKER.match(line)
    if not found:
        return None, line
    return NAMES[next(v for v in found.groupdict().values() if v).lower()], line[found.end():]


def _transitions():
    """Log chances from state to state; 2r is the first line of a turn of role r, 2r + 1 a later line."""
    after = {"system": {"user": 0.9, "assistant": 0.1}, "user": {"assistant": 0.85, "user": 0.08, "tool": 0.02, "system": 0.05},
             "assistant": {"user": 0.8, "assistant": 0.08, "tool": 0.1, "system": 0.02}, "tool": {"assistant": 0.9, "tool": 0.1}}
    out = np.full((_STATES, _STATES), _TINY)
    for r, role in enumerate(ROLES):
        for k in (2 * r, 2 * r + 1):
            out[k, 2 * r + 1] = np.log(0.7)
            for other, p in after[role].items():
                out[k, 2 * ROLES.index(other)] = np.log(0.3 * p)
    return out


TRANSITIONS = _transitions()
START = np.array([np.log(p) if k % 2 == 0 else _TINY for k, p in enumerate(np.repeat([0.3, 0.6, 0.08, 0.02], 2))])


def emission(said, blank, after_blank, asks):
    """Log chances of a line's features in each state."""
    out = np.zeros(_STATES)
    for r, role in enumerate(ROLES):
        if said is None:
            # An unmarked first line is rare, and hardly ever without a blank line before it.
            out[2 * r] = np.log(0.02 if after_blank and not blank else 1e-5)
            out[2 * r + 1] = np.log(0.98)
        else:
            out[2 * r] = np.log(0.9 if said == role else 1e-4)
            out[2 * r + 1] = np.log(2e-4 if said == role else 1e-6)
        if asks:
            out[2 * r: 2 * r + 2] += np.log(0.5 if role == "user" else 0.3)
    return out


def _emissions(lines, before):
    """Matrix lines x states, the roles said, and the lines without markers; `before`: is there a line before, and is it blank?"""
    rows, bodies = np.zeros((len(lines), _STATES)), []
    blank_before = before
    for i, line in enumerate(lines):
        said, body = marker(line)
        blank = not line.strip()
        rows[i] = emission(said, blank, blank_before, body.rstrip().endswith("?"))
        bodies.append(body)
        blank_before = blank
    return rows, bodies


def product(a, b):
    """(max, +) product; the best state in between is found again when it is needed."""
    return (a[:, :, None] + b[None]).max(axis=1)


def _shifted(lines: DataFrame) -> DataFrame:
    """Runs of lines: conv, run, and whether the line before a run is blank."""
    lines = lines.withColumn("run", F.expr(f"no div {RUN}"))
    last = lines.filter(F.col("no") % RUN == RUN - 1).select(F.col("conv").alias("_c"), (F.col("run") + 1).alias("_r"), (F.trim("line") == "").alias("blank_before"))
    joined = lines.join(last, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("run") == F.col("_r")), "left")
    return joined.select("conv", "run", "no", "line", F.coalesce("blank_before", F.lit(False)).alias("blank_before"))


def _matrix(rows):
    out = np.full((_STATES, _STATES), _TINY * 10)
    np.fill_diagonal(out, 0.0)
    for e in rows:
        out = product(out, TRANSITIONS + e[None])
    return out


def _packed(m):
    return m.astype(np.float64).tobytes()


def _unpacked(b):
    return np.frombuffer(b, np.float64).reshape(_STATES, _STATES)


def roles(lines: DataFrame) -> DataFrame:
    """(conv, no, role, first, body) from (conv, no, line); no counts from 0 without gaps."""
    frames.reach(lines)
    runs = frames.stored(_shifted(lines), "lines")

    def run_matrix(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        e, _ = _emissions(rows["line"].tolist(), bool(rows["blank_before"].iloc[0]))
        first = rows["run"].iloc[0] == 0
        # The first line of all has the start chances in place of a transition: any state before it is the same.
        m = np.tile(START + e[0], (_STATES, 1)) if first else TRANSITIONS + e[0][None]
        for x in e[1:]:
            m = product(m, TRANSITIONS + x[None])
        return pd.DataFrame({"conv": rows["conv"].iloc[:1], "run": rows["run"].iloc[:1], "m": [_packed(m)]})

    schema = "conv long, run long, m binary"
    levels = [frames.stored(runs.groupBy("conv", "run").applyInPandas(run_matrix, schema), "level0")]

    def group_matrix(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run")
        m = None
        for b in rows["m"]:
            m = _unpacked(b) if m is None else product(m, _unpacked(b))
        return pd.DataFrame({"conv": rows["conv"].iloc[:1], "run": rows["run"].iloc[:1] // GROUP, "m": [_packed(m)]})

    while (levels[-1].agg(F.max("run")).first()[0] or 0) > 0:
        grouped = levels[-1].withColumn("g", F.expr(f"run div {GROUP}"))
        levels.append(frames.stored(grouped.groupBy("conv", "g").applyInPandas(lambda key, rows: group_matrix(rows.drop(columns="g")), schema), f"level{len(levels)}"))

    # From the whole transcript down: a group's first and last states settle those of its members.
    def top_states(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"conv": rows["conv"], "run": rows["run"], "a": 0, "z": [int(_unpacked(b)[0].argmax()) for b in rows["m"]]})

    states = levels[-1].groupBy("conv", "run").applyInPandas(lambda key, rows: top_states(rows), "conv long, run long, a int, z int")

    def inner_states(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run")
        ms = [_unpacked(b) for b in rows["m"]]
        a, z = int(rows["ga"].iloc[0]), int(rows["gz"].iloc[0])
        reach = [ms[0][a]]
        for m in ms[1:]:
            reach.append((reach[-1][:, None] + m).max(axis=0))
        ends = [z]
        for k in range(len(ms) - 1, 0, -1):
            ends.append(int((reach[k - 1] + ms[k][:, ends[-1]]).argmax()))
        ends.reverse()
        return pd.DataFrame({"conv": rows["conv"], "run": rows["run"], "a": [a, *ends[:-1]], "z": ends})

    for level in reversed(levels[:-1]):
        of = states.select(F.col("conv").alias("_c"), F.col("run").alias("_g"), F.col("a").alias("ga"), F.col("z").alias("gz"))
        members = level.withColumn("g", F.expr(f"run div {GROUP}"))
        members = members.join(of, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("g") == F.col("_g"))).select("conv", "run", "m", "g", "ga", "gz")
        states = frames.stored(members.groupBy("conv", "g").applyInPandas(lambda key, rows: inner_states(rows), "conv long, run long, a int, z int"), "states")

    def traced(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        e, bodies = _emissions(rows["line"].tolist(), bool(rows["blank_before"].iloc[0]))
        a, z = int(rows["a"].iloc[0]), int(rows["z"].iloc[0])
        score = START + e[0] if rows["run"].iloc[0] == 0 else TRANSITIONS[a] + e[0]
        back = []
        for x in e[1:]:
            step = score[:, None] + TRANSITIONS
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + x
        path = [z]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = np.array(path[::-1])
        return pd.DataFrame({"conv": rows["conv"], "run": rows["run"], "no": rows["no"], "role": [ROLES[k // 2] for k in path], "first": path % 2 == 0, "body": bodies})

    of = states.select(F.col("conv").alias("_c"), F.col("run").alias("_r"), "a", "z")
    known = runs.join(of, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("run") == F.col("_r"))).select("conv", "run", "no", "line", "blank_before", "a", "z")
    return known.groupBy("conv", "run").applyInPandas(traced, "conv long, run long, no long, role string, first boolean, body string")


def turns(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rendered), one row per recovered turn, turns from 0."""
    marked = frames.stored(roles(lines), "roles")
    per_run = marked.groupBy("conv", "run").agg(F.sum(F.col("first").cast("long")).alias("k"))
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    per_run = per_run.select(F.col("conv").alias("_c"), F.col("run").alias("_r"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv", "run").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.join(per_run, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("run") == F.col("_r")))
    numbered = numbered.withColumn("turn", F.col("before") + F.sum(F.col("first").cast("long")).over(inside) - 1)
    lines_of = F.array_sort(F.collect_list(F.struct("no", "body")))
    out = numbered.groupBy(F.col("conv").alias("conv_id"), "turn").agg(F.first("role").alias("role"), F.array_join(F.transform(lines_of, lambda x: x["body"]), "\n").alias("text"))
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))


#: Marker of a role in each style of transcript; %s is the role, with a capital.
STYLES = ["%s: ", "[%s] ", "<|%s|> ", "### %s\n", "**%s:** ", "%s> "]


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv, no, line): stored turns as raw transcripts, each conversation in one of `STYLES` by its id."""
    style = F.element_at(F.array(*[F.lit(s) for s in STYLES]), (F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(len(STYLES))) + 1).cast("int"))
    text = F.concat(F.coalesce(F.replace(style, F.lit("%s"), F.initcap("role")), F.lit("\n")), F.coalesce("text", F.lit("")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", "role", "text", F.posexplode(F.split(text, "\n", -1)).alias("k", "line"))
    numbered = ranked(rows, ["conv"], ["turn", "role", "text", "k"], "no")
    return numbered.select("conv", (F.col("no") - 1).cast("long").alias("no"), "line")


def op9_chat_format(spark, sf_dir):
    return turns(transcripts(frames.table(spark, sf_dir, "conversations")))


#: A round trip: recovered turns are the stored ones. A marker on a line of its own leaves an empty first line.
ORACLE_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS turn, role,
             CASE WHEN conv_id % 6 = 3 THEN chr(10) ELSE '' END || coalesce(text, '') AS text FROM conversations)
SELECT conv_id, turn, role, text, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' AS rendered FROM t
"""
