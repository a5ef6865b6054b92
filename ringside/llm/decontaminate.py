"""2. Benchmark decontamination: an Aho-Corasick automaton over normalised test items, run once over each text.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. The automaton holds every window of
`WINDOW` consecutive item words (a shorter item is one window), each framed by spaces, and reads a text as its words
joined by spaces. Ends of matches become word numbers, and those become byte offsets in the original text.

The automaton is broadcast in blocks of at most `BLOCK_CHARS` characters of item text; a larger benchmark takes
several blocks over the same documents, and their hits are united per document. Documents are mapped, never shuffled,
while one block is enough.

Edge cases: null or wordless text: no words, no hit. Items that are null or wordless have no window. An item without
id marks words but is in neither n_items nor the digest. No benchmark: no hits. Items that repeat an id count once.
A document's row is returned once for each time it is in the table. Empty table: no rows.
"""

import hashlib
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm import frames, words

WINDOW = 10
#: Item text in one automaton: about 60 bytes of automaton for each of these characters times windows a word.
BLOCK_CHARS = 4_000_000

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TABLE = words.TRANSLATE[words.ALNUM_WORDS]


def windows_of(text: bytes, width=WINDOW):
    """The item's windows, as words joined by spaces and framed by them."""
    w = text.translate(_TABLE).split()
    return {b" %b " % b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def automaton(items, width=WINDOW):
    """items: (id or None, text). The value of a window: its number of words and the ids of its items."""
    owners = {}
    for item, text in items:
        for window in windows_of((text or "").encode(), width):
            owners.setdefault(window.decode("utf-8", "surrogateescape"), set()).add(item)
    if not owners:
        return None
    machine = ahocorasick.Automaton()
    for window, ids in owners.items():
        machine.add_word(window, (window.count(" ") - 1, tuple(ids - {None})))
    machine.make_automaton()
    return machine


def hits(text: bytes, machine):
    """(number of words, merged word intervals hit, item ids)."""
    w = text.translate(_TABLE).split()
    if not w or machine is None:
        return len(w), [], set()
    line = f" {b' '.join(w).decode('utf-8', 'surrogateescape')} "
    items, ends = set(), []
    for end, (count, ids) in machine.iter(line):
        ends.append((end, count))
        items.update(ids)
    intervals, seen, at = [], 0, 0
    for end, count in ends:
        seen += line.count(" ", at, end + 1)
        at = end + 1
        last = seen - 1
        first = last - count
        while intervals and intervals[-1][1] >= first:
            first = min(first, intervals.pop()[0])
        intervals.append((first, last))
    return len(w), intervals, items


def original_spans(text: bytes, intervals):
    """Word intervals as (start, end) bytes of the original text."""
    if not intervals:
        return []
    bounds = [m.span() for m in _WORD.finditer(text)]
    return [(bounds[a][0], bounds[b - 1][1]) for a, b in intervals]


def _blocks(benchmark: DataFrame):
    """Items in blocks of bounded size, read in id order one partition at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id").toLocalIterator():
        if block and size + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    yield block


_FIELDS = {"_n_words": "long", "_intervals": "array<array<long>>", "_items": "array<string>", "_spans": "array<array<long>>"}


def _maker(items, width):
    def make():
        machine = automaton(items.value, width)

        def step(batch):
            found = [[], [], [], []]
            for text in words.texts(batch.column(batch.schema.get_field_index("text"))):
                n, intervals, ids = hits(text, machine)
                for column, value in zip(found, (n, intervals, [str(i) for i in ids], original_spans(text, intervals)), strict=True):
                    column.append(value)
            return found

        return step

    return make


def marked(docs: DataFrame, benchmark: DataFrame, width=WINDOW) -> DataFrame:
    """`docs` with _n_words, _intervals (words from 0, end exclusive), _items and _spans (bytes of the text)."""
    out = docs
    context = docs.sparkSession.sparkContext
    for number, block in enumerate(_blocks(benchmark)):
        if number:
            before = {n: f"{n}_before" for n in _FIELDS}
            out = out.withColumnsRenamed(before)
        out = frames.added(out, _maker(context.broadcast(block), width), _FIELDS)
        if number:
            merged = {n: F.concat(n, before[n]) for n in ("_intervals", "_spans")} | {"_items": F.array_union("_items", before["_items"])}
            out = out.withColumns(merged).drop(*before.values())
    return out


def hit_words(column="_intervals"):
    """Size of the union of intervals."""
    by_start = F.array_sort(F.col(column))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), x[1] - F.greatest(x[0], acc["end"]))).alias("n"), F.greatest(acc["end"], x[1]).alias("end"))
    return F.aggregate(by_start, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step, lambda acc: acc["n"])


def digest(docs: DataFrame) -> DataFrame:
    out = docs.withColumn("_n_hit", hit_words())
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width=WINDOW) -> DataFrame:
    """The documents without any hit word, columns as they were."""
    return marked(docs, benchmark, width).filter(F.size("_intervals") == 0).select(docs.columns)


def op2_benchmark_decontamination(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(marked(docs, frames.table(spark, sf_dir, "benchmark")))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT dw.r, dw.i, dw.k, iw.item_id FROM dw JOIN iw USING (k, win)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM h)) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
