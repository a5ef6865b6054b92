"""Registered queries and the SQL each is checked against."""

import re

from ringside.plans.bridge import match_events, oracle_view, raw_matches

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    """Register `fn(spark, sf_dir)`; `{ev}` in the SQL stands for the bridge table."""

    def keep(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_view(oracle)
        return fn

    return keep


def with_view(sql):
    body = sql.strip().replace("{ev}", "ev")
    if not re.search(r"\b(FROM|JOIN) ev\b", body):
        return body
    word = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
    joint = ", " + body[len(word):] if body.startswith(word) else " " + body
    return word + oracle_view("ev") + joint


def on_matches(name, oracle=None, raw=False):
    """Register `fn(events)` over the bridge table."""

    def keep(fn):
        def run(spark, sf_dir):
            return fn((raw_matches if raw else match_events)(spark, sf_dir))

        run.__doc__ = fn.__doc__
        return query(name, oracle)(run)

    return keep
