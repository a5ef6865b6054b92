"""Registered queries of this subpackage, one for each operator, and their SQL."""

import importlib

#: Module of each numbered operator; `op<N>_...` in it is its query, `ORACLE_SQL` its SQL where there is one.
OPERATORS = ["license_scan", "decontaminate", "quality", "html_text", "mixing", "language_id", "toxicity", "jaccard_join", "chat_format", "nearest",
             "whitening", "hard_negatives", "packing"]


def load():
    queries, oracles = {}, {}
    for name in OPERATORS:
        module = importlib.import_module(f"ringside.llm.{name}")
        query = next(k for k in vars(module) if k.startswith("op") and k[2].isdigit())
        queries[query] = getattr(module, query)
        if getattr(module, "ORACLE_SQL", None):
            oracles[query] = module.ORACLE_SQL
    return queries, oracles
