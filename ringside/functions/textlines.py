"""One line of battle text to one event.

A line is read as a sentence: its closing marks are set apart, fixed sentences are looked up, and the rest is cut at
the word that carries the message ("fainted", "used", "sent out", the possessive). No line pattern is kept.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringside.functions.columns import let

# The words of the messages.
STATS = ["Attack", "Defense", "Sp. Atk", "Sp. Def", "Speed", "Accuracy", "Evasiveness"]
STAGES = ["sharply rose", "sharply fell", "harshly fell", "rose", "fell", "won't go any higher", "won't go any lower"]
STATUSES = ["was poisoned", "is paralyzed", "was paralyzed", "was burned", "fell asleep", "was frozen solid", "became confused", "was confused", "flinched", "is confused"]
WEATHERS = ["rain", "sunlight", "sandstorm", "snow", "hail"]
TERRAINS = ["electric terrain", "grassy terrain", "misty terrain", "psychic terrain"]

_STOP = ["", ".", "!", ".!"]
_SHOUT = ["", "!"]


def _bare(text):
    """Without outer blanks, stops and quotes."""
    marks = F.lit(".,!'\"")
    return F.trim(F.ltrim(F.rtrim(F.trim(text), marks), marks))


class _Sentence:
    """A line with its closing marks set apart; `low` is for finding words, `body` for quoting them."""

    def __init__(self, line, body):
        self.line, self.body = line, body
        self.all_low = F.lower(self.line)
        self.low = F.lower(self.body)
        self.marks = F.substring(self.line, F.length(self.body) + 1, F.length(self.line))

    def first(self, word):
        """Place of a word after at least one character, from 1; 0 if there is none."""
        at = F.instr(self.low, F.lit(word)) if isinstance(word, str) else F.position(word, self.low)
        return F.when(at > 1, at).otherwise(0)

    def before(self, place):
        return F.substring(self.body, F.lit(1), place - 1)

    def after(self, place, length):
        return F.substring(self.body, place + length, F.length(self.body))

    def owner(self):
        """Place of the last possessive."""
        tail = F.substring_index(self.low, "'s ", -1)
        at = F.length(self.low) - F.length(tail) - 2
        return F.when(at > 1, at).otherwise(0)


def _any_in(text, words):
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _event(kind, pokemon=None, actor=None, detail=None, sure=0.95, winner=None, hp=None):
    column = lambda value, kind: value if isinstance(value, Column) else F.lit(value).cast(kind)
    return F.struct(
        F.lit(kind).alias("event"), column(pokemon, "string").alias("pokemon"), column(actor, "string").alias("actor"), column(detail, "string").alias("detail"),
        F.lit(sure).alias("confidence"), column(winner, "string").alias("winner"), F.lit(hp).cast("double").alias("hp_percent"))


def _faints(s):
    who = F.substring(s.body, F.lit(1), F.length(s.body) - len(" fainted"))
    theirs = F.lower(who).startswith("the opposing ")
    name = _bare(F.when(theirs, F.substring(who, F.lit(len("the opposing ") + 1), F.length(who))).otherwise(who))
    is_so = s.low.endswith(" fainted") & (F.length(who) > 0) & s.marks.isin(_STOP)
    return [(is_so, _event("pokemon_fainted", name, F.when(theirs, "opponent").otherwise("player"), F.concat(name, F.lit(" fainted")), hp=0.0))]


def _hits(s):
    said = F.replace(s.low, F.lit("'"), F.lit(""))
    spared = "it doesnt affect "
    name = _bare(F.substring(s.body, F.length(s.body) - F.length(said) + len(spared) + 1, F.length(s.body)))
    return [
        ((said == "its super effective") & s.marks.isin(_SHOUT), _event("super_effective_hit", detail="It's super effective!")),
        ((said == "its not very effective") & s.marks.rlike("^[.]*!?$"), _event("not_very_effective_hit", detail="It's not very effective...")),
        (said.startswith(spared) & s.marks.rlike("^[.]*!?$") & (F.length(said) > len(spared)), _event("not_very_effective_hit", name, detail=F.concat(F.lit("No effect on "), name))),
        ((said == "a critical hit") & s.marks.isin(_SHOUT), _event("critical_hit", detail="A critical hit!")),
    ]


def _stat_changes(s):
    at = s.owner()
    said = s.after(at, 3)
    change = [F.struct(F.lit(stat.lower()).alias("stat"), F.lit(f"{stat} {stage}".lower()).alias("said")) for stat in STATS for stage in STAGES]
    found = F.get(F.filter(F.array(*change), lambda x: x["said"] == F.lower(said)), F.lit(0))
    stat = F.length(found["stat"])
    detail = F.concat(_bare(F.substring(said, F.lit(1), stat)), F.lit(" "), F.substring(said, stat + 2, F.length(said)))
    return [((at > 0) & found.isNotNull() & s.marks.isin(_STOP), _event("stat_change", _bare(s.before(at)), detail=detail))]


def _statuses(s):
    places = F.filter(F.array(*[F.struct(F.instr(s.all_low, F.lit(f" {word}")).alias("at"), F.lit(len(word)).alias("n")) for word in STATUSES]), lambda x: x["at"] > 1)
    first = F.array_min(places)
    name = _bare(F.substring(s.line, F.lit(1), first["at"] - 1))
    return [(F.size(places) > 0, _event("status_inflicted", name, detail=F.concat(name, F.lit(" "), F.substring(s.line, first["at"] + 1, first["n"]))))]


def _moves(s):
    at = s.first(" used ")
    said = s.after(at, len(" used "))
    failed = ", but it failed"
    misses = F.lower(said).endswith(failed)
    move = F.trim(F.when(misses, F.substring(said, F.lit(1), F.length(said) - len(failed))).otherwise(said))
    named = (at > 0) & move.rlike("^[A-Za-z][\\w' -]*$")
    name = _bare(s.before(at))
    return [
        (named & misses & s.marks.isin(_STOP), _event("move_used", name, detail=F.concat(move, F.lit(" (failed)")), sure=0.9)),
        (named & ~misses & s.marks.isin(_SHOUT), _event("move_used", name, detail=move)),
    ]


def _entries(s):
    called = _bare(F.substring(s.line, F.lit(4), F.length(s.line)))
    at = s.first(" sent out ")
    sent = _bare(s.after(at, len(" sent out ")))
    told = lambda name: F.concat(name, F.lit(" sent out"))
    return [
        (F.substring(s.all_low, 1, 3).isin("go!", "go,") & (F.length(F.trim(s.line)) > 3), _event("pokemon_sent_out", called, "player", told(called))),
        ((at > 0) & (F.length(s.after(at, len(" sent out "))) > 0), _event("pokemon_sent_out", sent, detail=told(sent))),
    ]


def _fields(s):
    closed = s.line.endswith(".") | s.line.endswith("!")
    return [(closed & _any_in(s.all_low, WEATHERS + TERRAINS), _event("weather_or_terrain_set", detail=s.line))]


def _effects(s):
    at, last = s.first("'s "), s.owner()
    effect = s.after(at, 3)
    thing = _bare(F.substring(effect, F.lit(1), F.length(effect) - len(" activated")))
    works = (at > 0) & F.lower(effect).endswith(" activated") & (F.length(effect) > len(" activated")) & s.marks.isin(_STOP)
    named = s.after(last, 3)
    return [
        (works, _event("item_or_ability_activated", _bare(s.before(at)), detail=F.concat(thing, F.lit(" activated")))),
        ((last > 0) & named.rlike("^[A-Za-z][\\w -]*$") & s.marks.isin(_SHOUT), _event("item_or_ability_activated", _bare(s.before(last)), detail=_bare(named), sure=0.75)),
    ]


def _ends(s):
    end = lambda side: _event("battle_end", detail=s.line, sure=0.98, winner=side)
    beaten = s.all_low.endswith(" defeated you!") & (F.length(s.line) > len(" defeated you!"))
    return [(s.all_low.isin("you won the battle!", "congratulations! you won!"), end("player")), ((s.all_low == "you lost the battle!") | beaten, end("opponent"))]


def parse_battle_line(text) -> Column:
    """struct(event, pokemon, actor, detail, confidence, winner, hp_percent); NULL when it is no known message."""
    def told(line, body):
        s, out = _Sentence(line, body), F
        for group in (_faints, _hits, _stat_changes, _statuses, _moves, _entries, _fields, _effects, _ends):
            for fits, event in group(s):
                out = out.when(fits, event)
        return out.otherwise(F.lit(None))

    return let(F.trim(text), lambda line: let(F.rtrim(line, F.lit(".!")), lambda body: told(line, body)))
