"""Benchmark decontamination: find benchmark items in documents up to word edits.

The CGK random walk turns edit distance into Hamming distance: it copies the word under a pointer at each step and
moves on or stays by a random bit of that word and step. Several walks, each with samples of a few places of its
output, make keys; a window of a document about as long as an item is a candidate if it shares a key with it, and
word edit distance decides exactly. How many walks a window length gets is found by trying them on edited texts until
the target recall is reached, so long items get more than short ones.

Bitmaps of fixed size keep the search cheap without losing anything: k edits leave all but q * k of the runs of q
words of a window in place, so only stretches with enough runs that some item has too are walked over.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, pieces, rolling, stored, word_hashes

#: An item of n words is found where a stretch of words is at most this share of n edits away.
EDITS = 0.2
#: Share of items with that many edits (substituted, added, dropped or mixed, whichever is worst) that the walks must find.
RECALL = 0.99
#: Walks come in steps of WALKS; each has SAMPLES samples of PLACES places that stand within SPAN steps.
WALKS, SAMPLES, PLACES, SPAN = 4, 12, 4, 12
#: Steps of a walk as a multiple of the window: a walk moves at every second step, and a text with words dropped ends early.
STEPS = 1.6
#: Half of the samples stand in this first share of the steps, where walks over texts with many edits still agree.
EARLY = 0.4
#: Window lengths grow by this factor; an item belongs to the longest not above its own length.
GROWTH = 1.15
#: Longer items are searched by segments of at most so many words.
WINDOW = 128
RUNS = (3, 2, 1)
RUN_BITS, KEY_BITS = 24, 26
#: Up to so many item keys (words of items, too), the table of keys and items is sent to all tasks; beyond, it is joined by a shuffle.
SENT_KEYS = 500_000
#: Bytes of text, pointers of walks and cells of edit tables that a task handles at a time.
CHUNK, SLAB, CELLS = 2_000_000, 1_000_000, 1_000_000
SEED = 5

_LETTER = np.zeros(256, bool)
_LETTER[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_LETTER[128:] = True


def allowed(n: int) -> int:
    return int(EDITS * n)


def size_for(n: int) -> int:
    """The window length of an item of ``n`` words."""
    size = 1
    while (more := max(size + 1, int(size * GROWTH))) <= n:
        size = more
    return size


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Starts and ends of the words in the lower-cased text, and its bytes; words are ASCII letters and digits and whatever is not ASCII."""
    data = (text or "").lower().encode()
    return *_bounds(data), data


def _bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = _LETTER[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, a zero after each text, and each text's first place and the place of its zero."""
    # The separator is no letter, so no word runs over two texts.
    parts = [t.lower().encode() for t in texts]
    data = b"\n".join(parts)
    low, high = _bounds(data)
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    bounds = np.searchsorted(low, starts)
    number = np.arange(len(texts))
    flat = np.zeros(len(low) + len(texts), np.uint64)
    flat[np.arange(len(low)) + np.repeat(number, np.diff(bounds))] = word_hashes(np.frombuffer(data, np.uint8), low, high)
    return flat, bounds[:-1] + number, bounds[1:] + number


@dataclass(frozen=True)
class Plan:
    """The walks over windows of ``size`` words; the draws depend on the size alone, so that items and documents agree."""

    size: int
    walks: int

    @property
    def steps(self) -> int:
        return max(int(STEPS * self.size), 1)

    def keys(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Keys of the windows at ``starts`` in ``flat``, one column for each walk and sample; ``flat[ends]`` is the zero after each window's text."""
        reach = np.minimum(starts + self.steps, ends)
        # The walks' random bits are drawn only for places that some window covers.
        edge = np.zeros(len(flat) + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, reach + 1, -1)
        covered = np.cumsum(edge[:-1]) > 0
        number = np.cumsum(covered) - 1
        words = flat[covered]
        start, end = number[starts], number[reach]
        span = min(SPAN, self.steps)
        out = np.empty((len(starts), self.walks * SAMPLES), np.uint64)
        for w in range(self.walks):
            rng = np.random.default_rng([SEED, self.size, w])
            salts = rng.integers(1, 2**63, (self.steps + 63) // 64, dtype=np.uint64)
            until = np.where(np.arange(SAMPLES) % 2, max(int(EARLY * self.steps), span), self.steps)
            first = rng.integers(0, until - span + 1)
            places = np.sort(first[:, None] + rng.random((SAMPLES, span)).argsort(1)[:, :PLACES], 1)
            wanted, seen = set(places.ravel().tolist()), {}
            at = start
            for step in range(max(wanted) + 1):
                if step % 64 == 0:
                    bits = mix(words ^ salts[step // 64])
                if step in wanted:
                    seen[step] = words[at]
                at = np.minimum(at + ((bits[at] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64), end)
            for s in range(SAMPLES):
                key = np.full(len(starts), np.uint64(self.size * 65536 + w * SAMPLES + s))
                with np.errstate(over="ignore"):
                    for p in places[s].tolist():
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + seen[p])
                out[:, w * SAMPLES + s] = key
        return out


def edited(rng: np.random.Generator, words: np.ndarray, edits: int, kind: str) -> list[int]:
    """``words`` after random edits within it."""
    out = words.tolist()
    for _ in range(edits):
        k = int(rng.integers(1, len(out)))
        how = kind if kind != "mixed" else ("substituted", "added", "dropped")[rng.integers(3)]
        out[k : k + (how != "added")] = [] if how == "dropped" else [int(rng.integers(1, 2**62))]
    return out


def recall(plan: Plan, kind: str, trials: int = 100, seed: int = SEED) -> float:
    """Share of texts of ``plan.size`` random words that share a key with an edited copy in a longer text, at a start within three words."""
    rng = np.random.default_rng([seed, plan.size])
    n, around = plan.size, 4
    items, texts = [], []
    for _ in range(trials):
        item = rng.integers(1, 2**62, n)
        items.append([*item.tolist(), 0])
        texts.append([*rng.integers(1, 2**62, around).tolist(), *edited(rng, item, allowed(n), kind), *rng.integers(1, 2**62, plan.steps).tolist(), 0])
    found = []
    for rows, offsets in ((items, [0]), (texts, range(around - 3, around + 4))):
        stop = np.cumsum([len(r) for r in rows])
        first = stop - [len(r) for r in rows]
        starts = (first[:, None] + np.array(offsets)).ravel()
        found.append(plan.keys(np.fromiter(chain.from_iterable(rows), np.uint64), starts, np.repeat(stop - 1, len(offsets))).reshape(trials, len(offsets), -1))
    return float((found[0] == found[1]).any((1, 2)).mean())


@cache
def plan_for(size: int) -> Plan:
    """The fewest walks, in steps of WALKS, with a recall of RECALL for the worst kind of edits; ``size`` is at most WINDOW."""
    walks = WALKS
    while allowed(size) and min(recall(Plan(size, walks), kind) for kind in ("dropped", "added", "substituted")) < RECALL:
        walks += WALKS
    return Plan(size, walks)


def needed(size: int, most: int) -> tuple[int, int]:
    """The longest runs of which ``most`` edits leave some of a window in place, and how many they leave at least."""
    return next((q, left) for q in RUNS if (left := size - q + 1 - q * most) >= 1)


def within_reach(marks: dict[int, np.ndarray], size: int, most: int, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Starts of windows of ``size`` words in which enough runs are known, for an item that ``most`` edits may take away from.

    A place beyond the stretch that an item matches counts as an edit (the words it lacks were dropped), so the bound
    holds for stretches of any length. ``marks[q]`` are the places of known runs of q words, in order.
    """
    q, need = needed(size, most)
    known = marks[q]
    if len(known) < need:
        return np.empty(0, np.int64)
    a, b = known[: len(known) - need + 1], known[need - 1 :]
    near = (b - a <= size - q) & (owner[a] == owner[b])
    a, b = a[near], b[near]
    low, high = np.maximum(b - (size - q), first[owner[a]]), a
    # The union of the ranges low to high: both ends rise along the text.
    low = np.maximum(low, np.r_[0, high[:-1] + 1]) if len(low) else low
    length = np.maximum(high - low + 1, 0)
    return np.repeat(low - (np.cumsum(length) - length), length) + np.arange(length.sum())


def best_places(items: list[np.ndarray], stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the smallest word edit distance of the item to any part of the stretch, and the first word of such a part (the first such part)."""
    edits, begin = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda k: (len(items[k]), len(stretches[k])))
    one = 1 << 32
    a = 0
    while a < len(order):
        n = len(items[order[a]])
        b = a + 1
        while b < len(order) and len(items[order[b]]) == n and (b + 1 - a) * len(stretches[order[b]]) <= CELLS:
            b += 1
        rows = order[a:b]
        width = max(len(stretches[k]) for k in rows)
        text = np.zeros((len(rows), width), np.uint64)
        for r, k in enumerate(rows):
            text[r, : len(stretches[k])] = stretches[k]
        item = np.array([items[k] for k in rows])
        # A cell holds edits * 2^32 + the start, so that the smallest one is the best place that starts first.
        at = np.arange(width + 1, dtype=np.int64)
        row = np.tile(at, (len(rows), 1))
        for i in range(n):
            new = row + one
            np.minimum(new[:, 1:], row[:, :-1] + (text != item[:, i : i + 1]) * one, out=new[:, 1:])
            row = np.minimum.accumulate(new - at * one, 1) + at * one
        best = row.min(1)
        edits[rows], begin[rows] = best >> 32, best & (one - 1)
        a = b
    return edits, begin


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits, 8 to a byte, from rows (slot); what reaches the driver has a fixed size at most."""
    packed = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[packed["at"].to_numpy()] = packed["word"].to_numpy()
    return out.view(np.uint8)


def in_bitmap(known: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    slot = x & np.uint64((1 << bits) - 1)
    return (known[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _items(items: DataFrame) -> DataFrame:
    """(item_id, n, hashes) of the items that have words, their hashes as bytes."""

    def work(batches):
        for batch in pieces(batches, "text", CHUNK):
            flat, first, last = hashed_words([t or "" for t in batch.column("text").to_pylist()])
            rows = [(i, int(b - a), flat[a:b].tobytes()) for i, a, b in zip(batch.column("item_id").to_pylist(), first, last) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["item_id", "n", "hashes"])

    return items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(work, "item_id bigint, n bigint, hashes binary")


def _segments(items: DataFrame) -> DataFrame:
    """(item_id, scale, size, n, before, after, words): the segments of each item, and the words that an item takes before and after the start of a segment.

    Items of more than WINDOW words are cut in equal segments. If the item is within EDITS, one of its segments is too.
    """

    def work(batches):
        for batch in pieces(batches, "hashes", CHUNK):
            rows = []
            for item, n, data in zip(*(batch.column(c).to_pylist() for c in ("item_id", "n", "hashes"))):
                edges = np.linspace(0, n, -(-n // WINDOW) + 1).astype(np.int64).tolist()
                rows += [(item, size_for(n), size_for(b - a), b - a, a + allowed(n), n - a + allowed(n), data[8 * a : 8 * b]) for a, b in zip(edges, edges[1:])]
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], ["item_id", "scale", "size", "n", "before", "after", "words"])

    return items.mapInArrow(work, "item_id bigint, scale bigint, size bigint, n bigint, before bigint, after bigint, words binary")


def _keyed(segments: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """(item_id, keys, runs_q...) of segments: the keys of their walks and the hashes of their runs of words."""

    def work(batches):
        for batch in pieces(batches, "words", CHUNK):
            rows = [np.frombuffer(h, np.uint64) for h in batch.column("words").to_pylist()]
            keys = [plans[size_for(len(w))].keys(np.r_[w, np.uint64(0)], np.zeros(1, np.int64), np.array([len(w)]))[0] for w in rows]
            lists = [keys, *([rolling(w, q) for w in rows] for q in RUNS)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), *(pa.array([x.view(np.int64) for x in col], pa.list_(pa.int64())) for col in lists)], ["item_id", "keys", *(f"runs_{q}" for q in RUNS)])

    return segments.mapInArrow(work, "item_id bigint, keys array<bigint>, " + ", ".join(f"runs_{q} array<bigint>" for q in RUNS))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start_word): the best place of each item in each row's text, for items found in it.

    An item of n words is in a text if a stretch of words of any length is at most EDITS * n word edits away. Of
    equally good places the first counts. Case and punctuation do not matter. Null or wordless texts and items match
    nothing; texts and items of any length are searched whole. Rows that share a doc_id give one row for each item,
    rows of equal items one for each id; a null id is an id like others. Words are compared by 64-bit hashes. Other
    columns, whatever their names, are not looked at. Empty tables give an empty one.
    """
    listed = stored(_items(items), "items")
    segments = stored(_segments(listed), "segments")
    # Lengths grow by a factor from class to class, so there are few of them however many items there are.
    most = [F.max(c).alias(c) for c in ("n", "before", "after")]
    classes = [tuple(r) for r in segments.groupBy("scale", "size").agg(*most).orderBy("scale", "size").collect()]
    if not classes:
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).limit(0).select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0).alias("edits"), F.lit(0).alias("start_word"))
    plans = {size: plan_for(size) for _, size, *_ in classes}
    known = stored(_keyed(segments, plans), "keys")
    spark = docs.sparkSession

    def packed(column: str, bits: int) -> np.ndarray:
        return bitmap(known.select(F.explode(column).alias("x")).select(F.col("x").bitwiseAND((1 << bits) - 1).alias("slot")), bits)

    used = {needed(size, allowed(n))[0] for _, size, n, _, _ in classes}
    maps = spark.sparkContext.broadcast(({q: packed(f"runs_{q}", RUN_BITS) for q in used}, packed("keys", KEY_BITS)))

    def search(batches):
        runs, keys_known = maps.value
        for batch in pieces(batches, "text", CHUNK):
            flat, first, last = hashed_words([t or "" for t in batch.column("text").to_pylist()])
            ids = batch.column("doc_id").to_pylist()
            owner = np.repeat(np.arange(len(first)), last - first + 1)
            marks = {}
            for q, bits in runs.items():
                at = np.flatnonzero(in_bitmap(bits, rolling(flat, q), RUN_BITS))
                marks[q] = at[at + q <= last[owner[at]]]
            out: list[tuple] = []
            for _, size, n, before, after in classes:
                starts = within_reach(marks, size, allowed(n), first, owner)
                for start, stop, keys in hits(plans[size], flat, starts, last[owner[starts]], keys_known, before + after):
                    doc = owner[start]
                    low, high = max(start - before, first[doc]), min(stop + after, last[doc])
                    out.append((ids[doc], int(low - first[doc]), flat[low:high].tobytes(), keys))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], ["doc_id", "start", "words", "keys"])

    def verify(batches):
        for batch in pieces(batches, "words", CHUNK):
            items, texts = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("hashes", "words"))
            edits, begin = best_places(items, texts)
            good = np.flatnonzero(edits <= np.array([allowed(len(w)) for w in items], np.int64))
            start = batch.column("start").to_numpy()[good] + begin[good]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(good)) for c in ("doc_id", "item_id")), pa.array(edits[good], pa.int32()), pa.array(start, pa.int32())], ["doc_id", "item_id", "edits", "start_word"])

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    regions = stored(read.mapInArrow(search, "doc_id bigint, start bigint, words binary, keys array<bigint>").withColumn("region", F.monotonically_increasing_id()), "regions")
    counts = known.select(F.sum(F.size("keys"))).first()[0], listed.select(F.sum("n")).first()[0]
    sent = F.broadcast if max(counts) <= SENT_KEYS else (lambda df: df)
    met = regions.select("region", F.explode("keys").alias("key")).join(sent(known.select("item_id", F.explode("keys").alias("key"))), "key").select("region", "item_id").distinct()
    pairs = met.join(regions.select("region", "doc_id", "start", "words"), "region").join(sent(listed.select(F.col("item_id").alias("item"), "hashes").distinct()), F.col("item_id").eqNullSafe(F.col("item")))
    sure = pairs.select("doc_id", "item_id", "start", "hashes", "words").mapInArrow(verify, "doc_id bigint, item_id bigint, edits int, start_word int")
    return sure.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start_word")).alias("best")).select("doc_id", "item_id", "best.edits", "best.start_word")


def hits(plan: Plan, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: np.ndarray, reach: int):
    """(first start, last start, keys) for runs of neighbouring windows with known keys; the starts of a run lie within ``reach``."""
    slab = max(SLAB // max(plan.size, plan.walks * SAMPLES), 1)
    at, rows = [], []
    for a in range(0, len(starts), slab):
        keys = plan.keys(flat, starts[a : a + slab], ends[a : a + slab])
        found = in_bitmap(known, keys, KEY_BITS)
        for k in np.flatnonzero(found.any(1)).tolist():
            at.append((int(starts[a + k]), int(ends[a + k])))
            rows.append(keys[k, found[k]])
    a = 0
    while a < len(at):
        b = a + 1
        while b < len(at) and at[b][1] == at[a][1] and at[b][0] - at[a][0] <= reach:
            b += 1
        yield at[a][0], at[b - 1][0], np.unique(np.concatenate(rows[a:b])).view(np.int64).tolist()
        a = b


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
