"""1. License scans: ordered signature rules behind a keyword prefilter, native DataFrame expressions only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Base: the places where the words of `BASE` phrases
stand consecutively. Rules: `NOTICES` (sentences of licence texts) and `NAMED` (names of licences in the forms of
`FORMS`); each has a label, a priority and a keyword. Each rule and base phrase has one or two neighbouring words that any text
it matches must hold (`gate`, derived from the rules); a text with none of them is only counted. In the others, rules whose keyword occurs are tried where their first word stands, as a regular expression over the next
`REACH` words. A detection goes if another of higher priority (or the same and longer) contains its interval.
Everything is computed in a row; there is no shuffle and work is linear in the text.

score: the confidence of the best detection left, at least 0.6 with a base place, else 0.

Edge cases: null or wordless text: n_words 0, n_base 0, no positions, empty labels, score 0. Repeated rows are
returned as often as they are there. Empty table: no rows. Other columns are ignored.
"""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm import frames

#: Fixed by the contract.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Longest rule in words.
REACH = 16

#: label, keyword, name as words (`?w` optional, `a|b` either).
NAMED = [
    ("mit", "mit", "mit ?x11|expat"), ("mit-0", "attribution", "mit no attribution"), ("apache-1.1", "apache", "apache ?software ?license ?version 1 1"),
    ("apache-2.0", "apache", "apache ?software ?license ?version 2 ?0"), ("apache", "apache", "apache ?software"),
    ("gpl-1.0", "gnu", "gnu general public license ?version ?v 1|v1"), ("gpl-2.0", "gnu", "gnu general public license ?version ?v 2|v2"),
    ("gpl-3.0", "gnu", "gnu general public license ?version ?v 3|v3"), ("gpl-2.0", "gplv2", "gplv2"), ("gpl-3.0", "gplv3", "gplv3"),
    ("gpl", "gpl", "gnu ?gpl"), ("gpl", "gpl", "gpl"), ("gpl", "general", "gnu general public"), ("lgpl-2.1", "lesser", "gnu lesser general public license ?version 2 1"),
    ("lgpl-3.0", "lesser", "gnu lesser general public license ?version 3"), ("lgpl", "lesser", "gnu lesser general public"), ("lgpl", "lgpl", "lgpl"),
    ("lgpl-2.0", "library", "gnu library general public"), ("agpl-3.0", "affero", "gnu affero general public"), ("agpl-3.0", "agpl", "agpl ?v3"),
    ("gfdl", "documentation", "gnu free documentation"), ("bsd", "bsd", "bsd ?style"), ("bsd-2-clause", "bsd", "bsd 2 clause"), ("bsd-2-clause", "simplified", "simplified bsd"),
    ("bsd-3-clause", "bsd", "bsd 3 clause"), ("bsd-3-clause", "revised", "new|modified|revised bsd"), ("bsd-4-clause", "bsd", "original bsd"),
    ("0bsd", "zero", "zero clause bsd"), ("mpl-1.1", "mozilla", "mozilla public license ?version 1 1"), ("mpl-2.0", "mozilla", "mozilla public license ?version 2 ?0"),
    ("mpl", "mozilla", "mozilla public"), ("epl-1.0", "eclipse", "eclipse public license ?version 1 0"), ("epl-2.0", "eclipse", "eclipse public license ?version 2 0"),
    ("epl", "eclipse", "eclipse public"), ("cddl", "development", "common development and distribution"), ("cpl", "common", "common public"), ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib ?libpng"), ("bsl-1.0", "boost", "boost software"), ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl"),
    ("artistic-2.0", "artistic", "artistic license 2 0"), ("artistic", "artistic", "artistic"), ("ms-pl", "microsoft", "microsoft public"), ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("psf", "python", "python software foundation"), ("php", "php", "php ?license ?version 3"), ("ruby", "ruby", "ruby"), ("ofl-1.1", "sil", "sil open font"), ("eupl", "european", "european union public"),
    ("postgresql", "postgresql", "postgresql"), ("openssl", "openssl", "openssl"), ("ncsa", "ncsa", "university of illinois ncsa open source"), ("upl", "universal", "universal permissive"),
    ("cc0-1.0", "cc0", "cc0"), ("cc-by-4.0", "creative", "creative commons attribution 4 0"), ("cc-by-sa-4.0", "creative", "creative commons attribution sharealike 4 0"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial"), ("cc-by-nd", "noderivatives", "creative commons attribution noderivatives"),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike"), ("cc-by", "creative", "creative commons attribution"), ("cc", "creative", "creative commons"), ("odbl", "database", "open database"),
]
#: words before the name, words after it, priority, confidence.
FORMS = [
    ("", "license|licence", 40, 0.8), ("licensed|licenced under ?the ?terms ?of ?the", "?license|licence", 70, 0.95),
    ("released|distributed|published|available|provided under ?the ?terms ?of ?the", "?license|licence", 60, 0.9), ("spdx license identifier", "", 80, 1.0),
    ("governed|covered by ?the", "?license|licence", 55, 0.85), ("license|licence is ?the", "?license|licence", 50, 0.8),
    ("subject to ?the ?terms ?of ?the", "?license|licence", 50, 0.75),
]
#: label, keyword, sentence, priority, confidence.
NOTICES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 90, 1.0),
    ("isc", "permission", "permission to use copy modify and or distribute this software", 90, 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 90, 1.0),
    ("bsd-3-clause", "endorse", "neither the name of", 30, 0.6), ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of", 85, 0.95),
    ("gpl", "copyleft", "copyleft ?license", 20, 0.5), ("apache-2.0", "compliance", "you may not use this file except in compliance with the license", 90, 1.0),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 90, 0.95), ("unlicense", "unencumbered", "this is free and unencumbered software", 95, 1.0),
    ("public-domain", "public", "public domain dedication", 45, 0.8), ("public-domain", "public", "released|dedicated|placed into|to|in the public domain", 65, 0.9), ("public-domain", "public", "in the public domain", 35, 0.6),
    ("proprietary", "reserved", "all rights reserved", 25, 0.5), ("proprietary", "unauthorized", "unauthorized copying of this file", 75, 0.9), ("warranty-disclaimer", "warranty", "without warranty of any kind", 25, 0.5),
    ("warranty-disclaimer", "warranty", "without any warranty", 25, 0.5), ("commercial", "commercial", "commercial license", 35, 0.6), ("mpl-2.0", "mozilla", "subject to the terms of the mozilla public license", 88, 0.95),
    ("gpl-3.0", "version", "gnu general public license version 3", 75, 0.95), ("gpl-2.0", "version", "gnu general public license version 2", 75, 0.95), ("apache-2.0", "version", "apache license version 2 0", 75, 0.95),
]


def _tokens(text):
    return [t for t in text.split(" ") if t]


def _pattern(tokens):
    """Each word stands between blanks of its own, so neighbours share none."""
    return "^" + "".join(f"(?: (?:{t[1:]}) )?" if t[0] == "?" else f" (?:{t}) " for t in tokens)


def _sentences():
    """(label, keyword, tokens, priority, confidence) of all rules."""
    sentences = [(label, key, _tokens(text), rank, sure) for label, key, text, rank, sure in NOTICES]
    for label, key, name in NAMED:
        for before, after, rank, sure in FORMS:
            tail = _tokens(name)
            # A name that says "license" itself needs no second one.
            closing = [f"?{after.lstrip('?')}"] if after and "license" in name else _tokens(after)
            sentences.append((label, key, _tokens(before) + tail + closing, rank + min(9, len(tail)), sure))
    return sentences


def _needed(key, tokens):
    """Words that a match of these tokens must hold, next to each other: a word like "license", the keyword and a
    neighbour, or the first two; else the keyword alone, which any text of the rule must hold."""
    for t in tokens:
        if all(w.startswith("licen") for w in t.split("|")):
            return (t,)
    pairs = [p for p in zip(tokens, tokens[1:], strict=False) if not any(t[0] == "?" for t in p)]
    return next((p for p in reversed(pairs) if key in p), pairs[0] if pairs else (key,))


def gate():
    """A regular expression that finds something in every lower-cased text that a rule or base phrase matches."""
    needed = {_needed(key, tokens) for _, key, tokens, _, _ in _sentences()} | {_needed("license", phrase.split()) for phrase, _ in BASE}
    words = "|".join(sorted(f"{_BETWEEN}+".join(f"(?:{t})" for t in words) for words in needed))
    return rf"(?:^|{_BETWEEN})(?:{words})(?:{_BETWEEN}|$)"


def rules():
    """All rules as (number, first word, keyword, priority, confidence, label, pattern); first words that may be absent or vary give a rule each."""
    out = []
    for label, key, tokens, rank, sure in _sentences():
        for first in tokens[0].lstrip("?").split("|"):
            out.append((len(out), first, key, rank, sure, label, _pattern([first, *tokens[1:]])))
    return out


def _rule_column():
    """The rules as one constant array."""
    names = ("first", "key", "rank", "sure", "label", "pattern")
    text = json.dumps([dict(zip(names, rule[1:], strict=True)) for rule in rules()])
    return F.from_json(F.lit(text), "array<struct<first:string,key:string,rank:int,sure:double,label:string,pattern:string>>")


def _let(value, body):
    """body(value) with the value computed once; a column named inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _base(w):
    """Places of the base phrases: array of (start, label)."""
    def ends(i):
        found = []
        for phrase, label in BASE:
            parts = phrase.split()
            test = F.lit(True)
            for k, part in enumerate(parts[:-1]):
                test = test & (F.get(w, i - (len(parts) - 1 - k)) == part)
            found.append(F.when(test, F.struct((i - (len(parts) - 1)).cast("long").alias("start"), F.lit(label).alias("label"))))
        return F.coalesce(*found)

    last = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: F.get(w, i) == "license")
    return F.filter(F.transform(last, ends), lambda x: x.isNotNull())


def _tried(s, active):
    """Detections of the rules that begin at one word."""
    hit = F.filter(active, lambda r: (r["first"] == s["first"]) & F.rlike(s["line"], r["pattern"]))
    return F.transform(hit, lambda r: F.struct(
        s["i"].alias("start"), (s["i"] + _count(F.regexp_extract_all(s["line"], r["pattern"], F.lit(0))[0])).alias("end"), r["rank"].alias("rank"), r["sure"].alias("sure"), r["label"].alias("label")))


def _left(groups):
    """Detections that no other suppresses. Groups have distinct starts, so the last REACH of them hold all that can contain one."""
    def kept(group, k):
        near = F.slice(groups, F.greatest(k + 1 - (REACH - 1), F.lit(1)), F.lit(REACH))
        return F.filter(group, lambda d: ~F.exists(near, lambda g: F.exists(g, lambda e: _contains(e, d))))

    return F.flatten(F.transform(groups, kept))


def _found(w):
    """Detections left after suppression: array of (start, end, rank, sure, label)."""
    def with_rules(active):
        def at_words(firsts):
            starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: F.array_contains(firsts, F.coalesce(F.get(w, i), F.lit(""))))
            here = F.transform(starts, lambda i: F.struct(i.alias("i"), F.get(w, i).alias("first"), F.concat(F.lit(" "), F.array_join(F.slice(w, i + 1, F.lit(REACH)), "  "), F.lit(" ")).alias("line")))
            return _let(F.filter(F.transform(here, lambda s: _tried(s, active)), lambda g: F.size(g) > 0), _left)

        return _let(F.array_distinct(F.transform(active, lambda r: r["first"])), at_words)

    def with_line(line):
        return _let(F.filter(_rule_column(), lambda r: F.contains(line, F.concat(F.lit(" "), r["key"], F.lit(" ")))), with_rules)

    return _let(F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" ")), with_line)


_NONE = "cast(named_struct('base', array(), 'found', array()) as struct<base:array<struct<start:bigint,label:string>>,found:array<struct<start:int,end:int,rank:int,sure:double,label:string>>>)"


def scanned(docs: DataFrame) -> DataFrame:
    """`docs` with _n_words and _scan: base (start, label) and found (start, end, rank, sure, label)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    scan = F.when(F.rlike(low, F.lit(gate())), _let(words, lambda w: F.struct(_base(w).alias("base"), _found(w).alias("found"))))
    return docs.withColumn("_n_words", F.regexp_count(text, F.lit(_WORD_ANY_CASE)).cast("long")).withColumn("_scan", F.coalesce(scan, F.expr(_NONE)))


def _count(line):
    return ((F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))) / 2).cast("int")


def _contains(e, d):
    longer = (e["end"] - e["start"]) > (d["end"] - d["start"])
    return (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & ((e["rank"] > d["rank"]) | ((e["rank"] == d["rank"]) & longer))


def digest(docs: DataFrame) -> DataFrame:
    out = scanned(docs).select("doc_id", "_n_words", F.col("_scan.base").alias("_base"), F.col("_scan.found").alias("_found"))
    starts, base_labels = F.transform("_base", lambda x: x["start"]), F.transform("_base", lambda x: x["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    sure = F.coalesce(F.array_max(F.transform("_found", lambda d: d["sure"])), F.lit(0.0))
    return out.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, F.transform("_found", lambda d: d["label"]))).alias("labels"),
        F.when(F.size("_base") > 0, F.greatest(sure, F.lit(0.6))).otherwise(sure).alias("score"))


def op1_license_scan(spark, sf_dir):
    return digest(frames.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle():
    values = ", ".join(f"({i}, '{first}', '{key}', {rank}, {float(sure)}, '{label}', '{pattern}')" for i, first, key, rank, sure, label, pattern in rules())
    base = " UNION ALL ".join(
        f"SELECT r, i - {len(p.split()) - 1} AS s, '{label}' AS label FROM t WHERE w[i + 1] = 'license' AND " + " AND ".join(f"i - {len(p.split()) - 1 - k} >= 0 AND w[i + 1 - {len(p.split()) - 1 - k}] = '{part}'" for k, part in enumerate(p.split()[:-1]))
        for p, label in BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
t AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM d),
b AS ({base}),
bb AS (SELECT r, count(*) AS n, min(s) AS f, max(s) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY r),
rules(no, first, key, rank, sure, label, pattern) AS (VALUES {values}),
m AS (SELECT r, i AS s, rank, sure, label, regexp_extract(' ' || array_to_string(w[i + 1:i + {REACH}], '  ') || ' ', pattern) AS hit
      FROM t JOIN rules ON w[i + 1] = first AND list_contains(w, key)),
f AS (SELECT r, s, s + (length(hit) - length(replace(hit, ' ', ''))) // 2 AS e, rank, sure, label FROM m WHERE hit <> ''),
k AS (SELECT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.r = x.r AND y.s <= x.s AND y.e >= x.e AND (y.rank > x.rank OR (y.rank = x.rank AND y.e - y.s > x.e - x.s)))),
kk AS (SELECT r, max(sure) AS sure FROM k GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(bb.n, 0) AS n_base, bb.f AS first_word, bb.l AS last_word, coalesce(bb.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
       CASE WHEN bb.n > 0 THEN greatest(coalesce(kk.sure, 0), 0.6) ELSE coalesce(kk.sure, 0) END::DOUBLE AS score
FROM d LEFT JOIN bb USING (r) LEFT JOIN kk USING (r) LEFT JOIN al USING (r)
"""


ORACLE_SQL = _oracle()
