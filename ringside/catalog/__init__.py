"""Registered queries by topic."""

import importlib

TOPICS = ["records", "turns", "strategy", "scalars", "careers", "cleaning", "series", "matchups", "replays", "reviews", "knowledge"]


def load():
    for topic in TOPICS:
        importlib.import_module(f"ringside.catalog.{topic}")
    from ringside.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
