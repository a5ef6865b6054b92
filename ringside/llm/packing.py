"""13. Best-fit packing: documents cut to pieces of at most 2048 tokens, packed by swap-based local search.

Tokens. A text's ids come from a public tokenizer (its file is a parameter) and id 0 ends each document. No token of this
vocabulary crosses white space, so ids are looked up by word and only words not met lately are encoded; a text is never
held as one encoding. Documents longer than the capacity are cut into full pieces and one rest.

Packing. Pieces are dealt by hash into groups of about `GROUP_ROWS`, however common one length is, and a full piece is a sequence.
In a group each piece first goes where it fits best, longest first. Then local search runs over the underfull bins, fullest
first: it moves a document, exchanges one for one, or two for one (either way), always with a less filled bin and by
the largest gain that fits. Each step raises the sum of squared fill, so the search ends and donors run empty.
What is underfull after a round is dealt anew by bin to groups of the next, `ROUNDS` times, so the rests of many groups meet.

Edge cases: null or blank text: one piece of length 1, the id 0. Repeated rows and null ids: each row is packed for itself.
Empty table: no rows. Extra columns are not read; the columns of `pieces` other than key and length pass through `packed`.
Very long texts are taken word by word; only one run of letters without any break is encoded whole.
"""

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm import frames, words

CAPACITY = 2048
GROUP_ROWS = 8192
ROUNDS = 3
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker keeps, and as many of the time before.
KEPT_WORDS = 250_000
DONORS = 4


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: Words of printable ASCII signs and Latin-1 letters, and how this vocabulary cuts them once they are lower-cased. Other words, and
#: those that may hold a special token, go through the tokenizer whole.
ACCENTED = "À-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[!-~{ACCENTED}]+")
CUTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{ACCENTED}]+|[0-9]|[^\\sa-z0-9{ACCENTED}]+")
SPECIAL = "<|"


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, by the words between ASCII white space."""

    def __init__(self, path, kept=KEPT_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kept, self.ids, self.before = Tokenizer.from_file(path), kept, {}, {}
        # The vocabulary spells a letter by one sign for each of its UTF-8 bytes.
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytewise = {c: spell(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def encode(self, text: bytes) -> bytes:
        parts = []
        for start, end in spans(text):
            found = text[start:end].split()
            new = set(found).difference(self.ids)
            if new:
                if len(self.ids) + len(new) > self.kept:
                    self.ids, self.before = {}, self.ids
                    new = set(found)
                known = {w: self.before[w] for w in new if w in self.before}
                self.ids.update(known)
                self._learn(new.difference(known))
            parts += map(self.ids.__getitem__, found)
        return b"".join(parts)

    def _learn(self, new):
        odd, tokenize = [], self.tokenizer.model.tokenize
        for raw in new:
            if raw.isalpha():  # ASCII letters only
                ids = [t.id for t in tokenize(raw.lower().decode())]
                self.ids[raw] = struct.pack(f"<{len(ids)}I", *ids)
                continue
            word = raw.decode("utf-8", "replace")
            if PLAIN.fullmatch(word) and SPECIAL not in word:
                ids = [t.id for cut in CUTS.findall(word.lower()) for t in tokenize(cut if cut.isascii() else cut.translate(self.bytewise))]
                self.ids[raw] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                odd.append((raw, word))
        made = self.tokenizer.encode_batch([word for _, word in odd], add_special_tokens=False)
        self.ids.update((raw, np.array(e.ids, "<u4").tobytes()) for (raw, _), e in zip(odd, made, strict=True))


def spans(text: bytes, size=1 << 16):
    """Stretches of about `size` bytes that end at a blank or line end (or where the text does)."""
    start = 0
    while len(text) - start > size:
        cuts = [c for c in (text.find(b" ", start + size), text.find(b"\n", start + size)) if c >= 0]
        if not cuts:
            break
        yield start, min(cuts)
        start = min(cuts)
    yield start, len(text)


_encoders = {}


def pieces(docs: DataFrame, key="doc_id", text="text", path=None, capacity=CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids are the piece's tokens as little-endian unsigned 32-bit numbers."""
    path = path or vocabulary()

    def make():
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]

        def step(batch):
            out = []
            for row, body in enumerate(words.texts(batch.column("_text"))):
                ids = encoder.encode(body) + np.array([END_ID], "<u4").tobytes()
                for no, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((row, no, at // 4, len(part) // 4, part))
            rows, *columns = zip(*out, strict=True) if out else [()] * 5
            return [batch.column("_id").take(np.array(rows, np.int64)), *columns]

        return step, None

    kind = docs.schema[key].dataType.simpleString()
    found = frames.emitted(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), make, f"_id {kind}, piece int, start long, length long, ids binary")
    return found.withColumnRenamed("_id", key)


class Bin:
    __slots__ = ("fill", "held", "pairs")

    def __init__(self):
        self.fill, self.held, self.pairs = 0, {}, None

    def put(self, length, piece):
        self.held.setdefault(length, []).append(piece)
        self.fill += length
        self.pairs = None

    def take(self, length):
        left = self.held[length]
        piece = left.pop()
        if not left:
            del self.held[length]
        self.fill -= length
        self.pairs = None
        return piece

    def pair_sums(self):
        """Bit s is set where two documents of the bin have s tokens together."""
        if self.pairs is None:
            single = sum(1 << length for length in self.held)
            self.pairs = 0
            for length, held in self.held.items():
                self.pairs |= (single if len(held) > 1 else single & ~(1 << length)) << length
        return self.pairs


def _highest(bits, limit):
    """Largest set bit at or below `limit`; -1 if none."""
    return (bits & ((2 << limit) - 1)).bit_length() - 1 if limit >= 0 else -1


def best_fit(lengths, capacity) -> list[Bin]:
    """Longest first, each into the fullest bin that has room."""
    bins, spare, mask = [], {}, 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room = mask >> n
        if room:
            left = n + (room & -room).bit_length() - 1
            b = spare[left].pop()
            if not spare[left]:
                mask &= ~(1 << left)
        else:
            b, left = len(bins), capacity
            bins.append(Bin())
        bins[b].put(n, i)
        left -= n
        spare.setdefault(left, []).append(b)
        mask |= 1 << left
    return bins


class Search:
    """Local search over underfull bins. Donors never hold more than the bin that gains, so squared fill only rises."""

    def __init__(self, bins, capacity):
        self.capacity = capacity
        self.bins = [b for b in bins if b.fill < capacity]

    def run(self):
        while self._pass():
            pass

    def _pass(self):
        order = sorted((b for b in self.bins if b.fill), key=lambda b: -b.fill)
        self.bins = order
        self.at, self.mask = {}, 0
        for no, b in enumerate(order):
            for length in b.held:
                self.at.setdefault(length, set()).add(no)
                self.mask |= 1 << length
        changed = False
        for no, a in enumerate(order):
            for length in list(a.held):
                self._drop(length, no)
            while a.fill < self.capacity and a.fill:
                step = self._best(no)
                if step is None:
                    break
                self._apply(no, *step)
                changed = True
        return changed

    def _drop(self, length, no):
        holders = self.at.get(length)
        if holders and no in holders:
            holders.discard(no)
            if not holders:
                del self.at[length]
                self.mask &= ~(1 << length)

    def _best(self, no):
        """(gain, documents given, documents got, donor or None) of the largest gain that fits."""
        a = self.bins[no]
        gap = self.capacity - a.fill
        mine = sorted(a.held)
        best = (0,)

        def one(given, total):
            nonlocal best
            y = _highest(self.mask, total + gap)
            if y - total > best[0]:
                best = (y - total, given, (y,), None)

        one((), 0)
        for i, x in enumerate(mine):
            if best[0] == gap:
                break
            one((x,), x)
            for z in mine[i if len(a.held[x]) > 1 else i + 1:]:
                one((x, z), x + z)
        donor, seen = len(self.bins) - 1, 0
        while best[0] < gap and donor > no and seen < DONORS:
            b = self.bins[donor]
            if b.fill:
                seen += 1
                for x in mine:
                    two = _highest(b.pair_sums(), x + gap)
                    if two - x > best[0]:
                        first = next(y for y in sorted(b.held) if two - y in b.held and (two - y != y or len(b.held[y]) > 1))
                        best = (two - x, (x,), (first, two - first), donor)
            donor -= 1
        return best if best[0] else None

    def _apply(self, no, gain, given, got, donor):
        a = self.bins[no]
        if donor is None:
            donor = max(self.at[got[0]])  # the emptiest that has it
        b = self.bins[donor]
        out = [(x, a.take(x)) for x in given]
        for y in got:
            a.put(y, b.take(y))
            if y not in b.held:
                self._drop(y, donor)
        for x, piece in out:
            b.put(x, piece)
            self.at.setdefault(x, set()).add(donor)
            self.mask |= 1 << x


def pack(lengths, capacity=CAPACITY, bins=None) -> list[list[int]]:
    """Pieces of each bin, longest first; `bins` gives lists of pieces to start from instead of best fit."""
    if bins is None:
        found = best_fit(lengths, capacity)
    else:
        found = []
        for members in bins:
            found.append(Bin())
            for i in members:
                found[-1].put(lengths[i], i)
    Search(found, capacity).run()
    return [[i for length in sorted(b.held, reverse=True) for i in sorted(b.held[length])] for b in found if b.fill]


def _placed(rows: pd.DataFrame, capacity: int, fresh: bool) -> pd.DataFrame:
    """One group: (key, length, sequence_id, offset, fill); a sequence is named by its smallest key."""
    rows = rows.sort_values("key", ignore_index=True)
    lengths = rows["length"].tolist()
    start = None if fresh else [at.tolist() for at in rows.groupby("sequence_id", sort=True).indices.values()]
    key, name, offset, fill = rows["key"].to_numpy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    size = rows["length"].to_numpy()
    for members in pack(lengths, capacity, start):
        ends = np.cumsum(size[members])
        name[members], offset[members], fill[members] = key[members].min(), ends - size[members], ends[-1]
    return pd.DataFrame({"key": key, "length": size, "sequence_id": name, "offset": offset, "fill": fill})


def _place(capacity, fresh):
    return lambda rows: _placed(rows, capacity, fresh)


def packed(parts: DataFrame, capacity=CAPACITY, group_rows=GROUP_ROWS, rounds=ROUNDS) -> DataFrame:
    """`parts` (key: a different long for each row, length: 1 to capacity, any other columns) with sequence_id and offset."""
    frames.reach(parts)
    full = parts.filter(F.col("length") >= capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    waiting = parts.filter(F.col("length") < capacity).select("key", "length")
    schema = "key long, length long, sequence_id long, offset long, fill long"
    settled = [full]
    for turn in range(rounds):
        groups = max(1, round(waiting.count() / group_rows))
        by = F.xxhash64("key" if turn == 0 else "sequence_id", F.lit(turn))
        dealt = waiting.withColumn("g", F.pmod(by, F.lit(groups)))

        found = frames.stored(dealt.groupBy("g").applyInPandas(_place(capacity, fresh=turn == 0), schema), "packed")
        waiting = found.filter(F.col("fill") < capacity)
        settled.append((found if turn == rounds - 1 else found.filter(F.col("fill") >= capacity)).select("key", "sequence_id", "offset"))
        if groups == 1:
            settled[-1] = found.select("key", "sequence_id", "offset")
            break
    where = settled[0]
    for more in settled[1:]:
        where = where.unionByName(more)
    return parts.join(where, "key")


def keyed(parts: DataFrame) -> DataFrame:
    """`parts` stored, with a key for each row that stays as it is."""
    return frames.stored(parts.withColumn("key", F.monotonically_increasing_id()), "pieces")


def sequences(docs: DataFrame, key="doc_id", text="text", path=None, capacity=CAPACITY) -> DataFrame:
    """(sequence_id, ids binary, docs): the packed token sequences; docs lists (doc_id, piece, offset, length) in order."""
    placed = packed(keyed(pieces(docs, key, text, path, capacity)), capacity)
    item = F.struct("offset", "length", F.col(key).alias(key), "piece", "ids")
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(item)).alias("rows"))  # at most `capacity` pieces
    ids = F.aggregate("rows", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("rows", lambda x: F.struct(x[key].alias(key), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("docs"))


def op13_best_fit_packing(spark, sf_dir):
    made = pieces(frames.table(spark, sf_dir, "documents"))
    digest = made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packed(keyed(digest)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
