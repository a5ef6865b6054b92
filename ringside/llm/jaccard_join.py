"""8. N-gram Jaccard join: adaptive multi-match prefixes, verified on whole texts, closed to classes.

Sets: distinct 5-word shingles (64-bit hashes) of the words `[^\\x20\\x09-\\x0D]+` of the text with A-Z
lower-cased; a text of fewer words is one shingle; a text without words has an empty set and no link.

1. `profiles`: one map over the texts gives each document's set size and a 128-bit digest of its words, and
   each task's counts of hashed shingles. The counts add up to a frequency sketch of fixed size (16 MB).
2. Copies (equal digests) share one node, the smallest doc_id. Postings carry 64 bits of the digest, so copies meet
   by their token and only postings that another text shares are joined to nodes.
3. `postings`: shingles are ordered by (sketch frequency, hash), rarest first. With n shingles and
   T = ceil(0.75 n), two sets that link share at least l shingles among their first n - T + l ones. Each
   document picks l between half of `most_matches` and all of it with the least estimated cost (rows read plus candidates
   to verify) and posts that prefix.
4. `live_postings`: only postings that two texts share are kept, with their exact counts, and only of nodes that still have as
   many as a link asks for. A pair is a candidate if it shares at least the smaller of both l, and if the shared
   postings that are left to either node and what the prefixes leave out allow the overlap that both sizes ask for.
5. Groups of near copies would give all pairs, so `rounds` first verify each node against one node per shingle
   (the one that shares most: the one with fewest rarer postings, and one drawn anew in every round) and close
   the links to classes. Then pairs that are in one class already need no check, and the rest are taken in full: no
   link between classes is lost.

Edge cases: null or blank text: n_shingles 0, component_id = doc_id. A row without doc_id: n_shingles as counted,
component_id null, and it links nothing. Rows that repeat a doc_id with other texts are one document for
linking. Empty table: no rows. Other columns of the input are ignored.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm import frames, words

WIDTH = 5
NUM, DEN = 75, 100
#: Counters of the frequency sketch; its size does not depend on the data.
SLOT_BITS, BLOCK_BITS = 22, 14
#: Matches asked for at most: so many, or one in so many shingles of longer sets.
MOST_MATCHES, LONG_SHARE = 8, 32
#: Cost of one verification in units of one posting read.
VERIFY_COST = 20.0
#: Texts of this many nodes at most are picked out with a broadcast list of ids (8 MB); more take a shuffled join.
BROADCAST_IDS = 1_000_000
#: A token whose counter stands this far above chance is dealt to `SALTS` tasks and taken as shared without counting it.
HOT_EXCESS, SALTS = 1024, 1024
LEVEL_BITS = 20
#: Pivot rounds: at least one, more while there are more pairs left than postings and the last round linked
#: this share of the nodes in question. What rounds cannot settle is taken in full.
SETTLED = 0.02

_Q = np.array([pow(0xD1342543DE82EF95, k, 1 << 64) for k in range(64)], np.uint64)


def shingle_sets(array, hasher, width=WIDTH):
    """(row, sorted distinct shingle hashes) for every text with words."""
    for first, data, offsets in words.chunks(array):
        starts, ends, bounds = words.word_bounds(data, offsets, words.SPACED_WORDS)
        if not len(starts):
            continue
        h = hasher.load(data).ranges(starts, ends)
        full = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            full += h[k:len(full) + k] * _Q[k]
        full = words.mix(full)
        for i in range(len(offsets) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= width:
                yield first + i, np.unique(full[a:b - width + 1])
            elif b > a:
                yield first + i, words.mix((h[a:b] * _Q[:b - a]).sum(keepdims=True, dtype=np.uint64) + _Q[40 + b - a])


def digest_of(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(text.translate(words.TRANSLATE[words.SPACED_WORDS]).split()), digest_size=16).digest()


def key_of(digest: bytes) -> int:
    """64 bits of a digest, as a long."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _profile_maker(width):
    def make():
        hasher = words.Hasher()
        counts = np.zeros(1 << SLOT_BITS, np.uint8)  # of one task; the order needs no counts above 255

        def step(batch):
            array = batch.column("text")
            n = np.zeros(len(array), np.int64)
            for row, s in shingle_sets(array, hasher, width):
                n[row] = len(s)
                at = _slots(s)
                counts[at] += counts[at] < 255
            none = [None] * len(array)
            digests = [digest_of(t) for t in words.texts(array)]
            return batch.column("doc_id"), n, digests, [key_of(d) for d in digests], none, none

        def end():
            blocks = counts.reshape(-1, 1 << BLOCK_BITS)
            used = np.flatnonzero(blocks.any(axis=1))
            none = [None] * len(used)
            return none, none, none, none, used, [blocks[i].tobytes() for i in used]

        return step, end

    return make


def profiles(docs: DataFrame, width=WIDTH) -> DataFrame:
    """One row per document (doc_id, n, digest, key) and per task and block of counters (block, counts)."""
    return frames.emitted(docs.select("doc_id", "text"), _profile_maker(width),
                          "doc_id long, n long, digest binary, key long, block int, counts binary")


def sketch(profile: DataFrame) -> np.ndarray:
    """Add up all tasks' counters; blocks are summed in the tasks they hash to, one running sum per block."""

    def make():
        sums = {}

        def step(batch):
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, np.uint8).astype(np.int64)

        return step, lambda: (list(sums), [np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in sums.values()])

    blocks = profile.filter("block is not null").select("block", "counts").repartition("block")
    out = np.zeros((1 << SLOT_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.int32)
    for row in frames.emitted(blocks, make, "block int, counts binary").collect():
        out[row["block"]] = np.frombuffer(row["counts"], np.int32)
    return out.ravel()


def _slots(s):
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def least_overlap(n, num=NUM, den=DEN):
    return -(-num * n // den)


def most_matches(n, num=NUM, den=DEN):
    """The largest l of a set of n shingles; the smallest is half of it, at least 1. Both never fall as n grows."""
    return min(max(MOST_MATCHES, n // LONG_SHARE), least_overlap(n, num, den), (1 << LEVEL_BITS) - 1)


def prefix(s, freq, floor, num=NUM, den=DEN):
    """The posted shingles of one set and its l, by least estimated cost."""
    f = freq[_slots(s)]
    order = np.lexsort((s, f))
    need = least_overlap(len(s), num, den)
    base = len(s) - need + 1
    most = most_matches(len(s), num, den)
    least = max(1, most // 2)
    shared = np.cumsum(np.maximum(f[order[:base + most - 1]] - floor, 0.0))[base - 1:]
    level = np.arange(1, most + 1)
    best = int(np.argmin((shared + VERIFY_COST * shared / level)[least - 1:])) + least
    return s[order[:base + best - 1]], best


def _posting_maker(freq, width, num, den):
    excess = HOT_EXCESS

    def make():
        hasher, seen = words.Hasher(), set()
        counts = freq.value
        floor = counts.mean() + 3 * np.sqrt(counts.mean()) + 1
        hot = floor + excess

        def step(batch):
            array, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            raw = words.texts(array)
            tokens, nodes, facts, salts = [], [], [], []
            for row, s in shingle_sets(array, hasher, width):
                digest = digest_of(raw[row])
                if ids[row] is None or digest in seen:
                    continue
                seen.add(digest)
                posted, level = prefix(s, counts, floor, num=num, den=den)
                tokens.append(posted)
                nodes.append(np.full(len(posted), key_of(digest), np.int64))
                facts.append(np.full(len(posted), (len(s) << LEVEL_BITS) + level, np.int64))
                salt = int.from_bytes(digest[:8], "little") % SALTS
                salts.append(np.where(counts[_slots(posted)] > hot, 1 + salt, 0).astype(np.int16))
            if tokens:
                return np.concatenate(tokens).view(np.int64), np.concatenate(nodes), np.concatenate(facts), np.concatenate(salts)

        return step, None

    return make


def postings(docs: DataFrame, freq, width=WIDTH, num=NUM, den=DEN) -> DataFrame:
    """(token, key: 64 bits of the text's digest; facts: n and l, packed; salt, 0 but for hot tokens); copies within a task post once."""
    return frames.emitted(docs.select("doc_id", "text"), _posting_maker(freq, width, num, den), "token long, key long, facts long, salt short")


def shared_postings(posted: DataFrame) -> DataFrame:
    """The postings of tokens that two texts or more post, and their number c; they are made and moved once, and copies go on the way.

    Tokens that the sketch does not call hot have few rows, so counting them in place gathers no large group;
    hot ones are spread over `SALTS` keys (copies have one salt) and kept as they are.
    """
    here = Window.partitionBy("token", "salt")
    texts = posted.withColumn("before", F.lag("key").over(here.orderBy("key"))).filter("before is null or before <> key").drop("before")
    return texts.withColumn("c", F.count("*").over(here)).filter("salt > 0 or c > 1")


def live_postings(shared: DataFrame, reps: DataFrame, num=NUM, den=DEN) -> DataFrame:
    """(token, node, n, l, comp, rest, before) of the nodes that can link.

    rest counts the node's shared postings behind this one, rarest first; before all its rarer postings.
    A link takes the l of one of both, and the sizes differ by num / den at most, which bounds the l of the other.
    """
    n, level = F.shiftright("facts", LEVEL_BITS), F.col("facts").bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))
    mine, rare_last = Window.partitionBy("key"), [F.desc("hot"), F.desc("c"), F.desc("token")]
    live = shared.select("token", "key", n.alias("n"), level.alias("l"), (F.col("salt") > 0).cast("int").alias("hot"), F.when(F.col("salt") > 0, 0).otherwise(F.col("c")).alias("c"))
    live = live.withColumn("rest", F.row_number().over(mine.orderBy(*rare_last)) - 1).withColumn("all", F.count("*").over(mine))
    small = _overlap("n", num, den)
    least = F.greatest(F.lit(1), F.floor(F.least(F.greatest(F.lit(MOST_MATCHES), F.floor(small / LONG_SHARE)), _overlap(small, num, den), F.lit((1 << LEVEL_BITS) - 1)) / 2))
    live = live.filter(F.col("all") >= least).join(reps, "key")
    before = F.col("n") - _overlap("n", num, den) + F.col("l") - 1 - F.col("rest")
    return live.select("token", "node", "n", "l", F.col("node").alias("comp"), "rest", before.alias("before"))


def _overlap(n, num, den):
    """`least_overlap` of a column."""
    n = F.col(n) if isinstance(n, str) else n
    return F.floor((n * num + (den - 1)) / den)


def _brings(num, den):
    """Can this shared token be the first that a linked pair shares, rarest first?

    Sizes must allow a link, and so must the postings from here on: of what a pair shares, all up to the earlier
    of the two last posted shingles is among the postings left to both, the rest among the T - l shingles that this set
    does not post. Every linked pair has such a token: its first shared one.
    """
    most = F.least("rest", "prest") + 1 + _not_posted(num, den)
    return (den * F.least("n", "pn") >= num * F.greatest("n", "pn")) & ((num + den) * most >= num * (F.col("n") + F.col("pn")))


def _not_posted(num, den):
    return F.greatest(_overlap("n", num, den) - F.col("l"), _overlap("pn", num, den) - F.col("pl"))


def _enough(num, den):
    """Do k shared posted shingles, with the l of both, leave room for a link?

    All shared shingles up to the earlier of the two last posted ones are among the k; the others are among the
    T - l shingles that this set does not post.
    """
    most = F.col("k") + _not_posted(num, den)
    return (F.col("k") >= F.least("l", "pl")) & ((num + den) * most >= num * (F.col("n") + F.col("pn")))


def verified(pairs: DataFrame, texts: DataFrame, width=WIDTH, num=NUM, den=DEN) -> DataFrame:
    """The pairs (a, b) whose whole texts link."""

    def make():
        hasher = words.Hasher()

        def step(batch):
            left, right = dict(shingle_sets(batch.column("ta"), hasher, width)), dict(shingle_sets(batch.column("tb"), hasher, width))
            keep = []
            for i in range(batch.num_rows):
                x, y = left.get(i), right.get(i)
                if x is not None and y is not None:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(den * both >= num * (len(x) + len(y) - both))
                else:
                    keep.append(False)
            keep = np.array(keep, bool)
            return np.array(batch.column("a"))[keep], np.array(batch.column("b"))[keep]

        return step, None

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    with_both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return frames.emitted(with_both.select("a", "b", "ta", "tb"), make, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each connected class, by alternating large and small stars.

    Every step takes minima with map-side combining and joins them back; nothing gathers a node's links.
    """
    edges = frames.stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = frames.stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots.select("v", "v"))


def _with_class(live, classes):
    return live.drop("comp").join(classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _unsettled(live):
    """Postings of tokens whose nodes are in several classes."""
    mixed = live.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi").select("token")
    return live.join(mixed, "token")


def _pairs_left(live):
    per = live.groupBy("token", "comp").agg(F.count("*").alias("m"))
    per = per.groupBy("token").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"))
    row = per.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2), F.lit(0.0)), F.coalesce(F.sum("all"), F.lit(0))).first()
    return row[0], row[1]


def _star_pairs(live, round_no, num, den):
    """Pairs of a node and the pivots of its tokens that share enough: two per node at most, those that share most.

    A token has two pivots: the least of a hash drawn for the round, and in the first round the node that has fewest
    rarer postings before the token (the least edited copy of a group), later the least of another hash.
    k counts all tokens whose pivot the node is, which is at most what the pair shares, so the rounds ask for the multi-match
    count and one token that can be the first shared. What they leave is taken by `_all_pairs`.
    """
    facts = ("n", "l", "comp", "rest")
    rank = [F.xxhash64("node", F.lit(2 * round_no + k)) for k in range(2)]
    if round_no == 0:
        rank[1] = F.struct("before", "node")
    as_pivot = [F.col("node").alias("p"), *[F.col(c).alias(f"p{c}") for c in facts]]
    pivots = live.groupBy("token").agg(*[F.min(F.struct(h.alias("h"), *as_pivot)).alias(f"pivot{k}") for k, h in enumerate(rank)])
    pivots = pivots.select("token", *[F.struct(*[f"pivot{k}.{c}" for c in ("p", *[f"p{c}" for c in facts])]).alias(f"pivot{k}") for k in range(2)])
    met = live.join(pivots, "token").select("node", *facts, F.explode(F.array_distinct(F.array("pivot0", "pivot1"))).alias("pivot"))
    met = met.select("node", *facts, "pivot.*", _brings(num, den).alias("brings")).filter(F.col("comp") != F.col("pcomp"))
    shared = met.groupBy("node", "p", "n", "l", "pn", "pl").agg(F.count("*").alias("k"), F.max("brings").alias("brings"))
    shared = shared.filter(F.col("brings") & (F.col("k") >= F.least("l", "pl")))
    best = shared.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("k"), "p"))).filter("r <= 2")
    return best.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()


def _all_pairs(live, num, den):
    """Pairs of different classes that share as many posted tokens as a link asks for.

    Tokens that can be a pair's first shared one bring it forward; then all posted tokens of these pairs are counted.
    """
    other = live.select("token", F.col("node").alias("p"), *[F.col(c).alias(f"p{c}") for c in ("n", "l", "comp", "rest")])
    met = live.join(other, "token").filter((F.col("node") < F.col("p")) & (F.col("comp") != F.col("pcomp")) & _brings(num, den))
    pairs = frames.stored(met.select(F.col("node").alias("a"), F.col("p").alias("b")).distinct(), "met")
    mine = live.select(F.col("node").alias("a"), "token", "n", "l")
    theirs = live.select(F.col("node").alias("b"), "token", F.col("n").alias("pn"), F.col("l").alias("pl"))
    shared = pairs.join(mine, "a").join(theirs, ["b", "token"])
    counted = shared.groupBy("a", "b", "n", "l", "pn", "pl").agg(F.count("*").alias("k"))
    return counted.filter(_enough(num, den)).select("a", "b").distinct()


def node_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of these nodes: by a broadcast list of ids while it is small, else by a shuffled join."""
    nodes = nodes.select(F.col("node").alias("doc_id"))
    if nodes.count() <= BROADCAST_IDS:
        nodes = F.broadcast(nodes)
    return docs.select("doc_id", "text").join(nodes, "doc_id", "leftsemi").select(F.col("doc_id").alias("node"), "text")


def jaccard_classes(docs: DataFrame, width=WIDTH, num=NUM, den=DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    spark = docs.sparkSession
    profile = frames.stored(profiles(docs, width), "profile")
    members = profile.filter("block is null").select("doc_id", "n", "digest", "key")
    ids = members.filter("n > 0 and doc_id is not null")
    copies = ids.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1").select("digest", "rep")
    members = frames.stored(members.join(copies, "digest", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    repeated = members.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("c"))
    links = [repeated.filter("c > 1 and a < b").select("doc_id", "a").join(members.filter("n > 0"), "doc_id").select("a", F.col("rep").alias("b"))]
    freq = spark.sparkContext.broadcast(sketch(profile))

    reps = ids.groupBy("key").agg(F.min("doc_id").alias("node"))
    live = live_postings(shared_postings(postings(docs, freq, width, num, den)), reps, num, den)
    live = frames.stored(live, "live")

    round_no, found, classes = 0, None, None
    while True:
        last = False
        if round_no:
            left, size = _pairs_left(live)
            if not left:
                break
            last = left <= size or found < SETTLED * live.select("node").distinct().count()
        pairs = frames.stored(_all_pairs(live, num, den) if last else _star_pairs(live, round_no, num, den), "pairs")
        texts = frames.stored(node_texts(docs, pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")), "texts")
        links.append(frames.stored(verified(pairs, texts, width, num, den), "links"))
        frames.discard(texts)
        if last:
            classes = classes if links[-1].isEmpty() else components(_union(links))
            break
        round_no, found = round_no + 1, links[-1].count()
        classes = frames.stored(components(links[0] if len(links) == 1 else _union(links)), "classes")
        live = frames.stored(_unsettled(_with_class(live, classes)), "live")
    if classes is None:
        classes = components(_union(links))
    out = members.join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("comp", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each class of rows, columns as they were; rows without doc_id stay.

    Rows that repeat a doc_id with other texts are told apart: each belongs to the class of its own text.
    """
    known = docs.filter("doc_id is not null")
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        heads = jaccard_classes(docs).filter("doc_id = component_id").select("doc_id")
        return docs.join(heads, "doc_id", "leftsemi").select(docs.columns).unionByName(docs.filter("doc_id is null"))
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = frames.stored(known.withColumn(row, F.monotonically_increasing_id()), "rows")
    classes = jaccard_classes(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    heads = numbered.select(row, "doc_id").join(classes, row).groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("least"))
    kept = numbered.join(heads.select(F.col(f"least.{row}").alias(row)), row, "leftsemi")
    return kept.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def _union(frames_):
    out = frames_[0]
    for more in frames_[1:]:
        out = out.union(more)
    return out


def op8_ngram_jaccard_join(spark, sf_dir):
    return jaccard_classes(frames.table(spark, sf_dir, "documents"))
