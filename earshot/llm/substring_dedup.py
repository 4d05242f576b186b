"""Substring dedup: remove repeated passages by exact counting of word windows in super-k-mer buckets.

A window is ``window`` consecutive words of a document. Its minimiser is the smallest hash among its short runs of
words; neighbouring windows mostly share it, so a maximal run of windows with one minimiser travels as one packed
string to the minimiser's bucket, and equal windows meet there. A bucket sorts its windows by a 64-bit hash and
compares the words of equal ones, so nothing depends on the hash being free of collisions.

Order of documents: by id, a null id first, then by a fingerprint of the text. Rows with equal id and text are the
same document; each gets that document's result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, pieces, rolling, word_bounds, word_hashes

WINDOW = 20
#: Words of the runs whose smallest hash is the minimiser: long enough that no common phrase draws many windows.
RUN = 4
#: Bytes of text that a task works on at a time, and bytes of the corpus for each bucket.
CHUNK = 8_000_000
BUCKET = 4_000_000
#: Bytes of text, packed or not, that are taken out of an Arrow batch at a time.
PIECE = 1_000_000
#: Bytes of passages that a bucket's task holds before it settles what it has and goes on with one copy of each window.
SETTLED = 24_000_000
#: Compression of what travels.
LEVEL = 6
NULL_ID = -(2**63)

_ROUTED = "bucket int, packed binary"
_INTERVALS = "id bigint, print bigint, start int, stop int"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if step else out
        have += step
    return out


class Passages:
    """Texts of single-spaced words, one after another in order of (id, print, start); each starts at word ``start`` of its document."""

    def __init__(self, ids, prints, starts, texts: list[bytes], window: int):
        self.ids, self.prints, self.starts, self.window = np.asarray(ids, np.int64), np.asarray(prints, np.int64), np.asarray(starts, np.int64), window
        self.data = b" ".join(texts)
        array = np.frombuffer(self.data, np.uint8)
        self.low, self.high = word_bounds(array)
        length = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(np.r_[0, length[:-1] + 1]) if len(texts) else np.empty(0, np.int64)
        self.hashes = word_hashes(array, self.low, self.high)
        self.owner = np.searchsorted(first, self.low, "right") - 1
        # An empty text has no words, so it owns none.
        self.first_word = np.searchsorted(self.low, first, "left")
        n = len(self.low) - window + 1
        self.at = np.flatnonzero(self.owner[: max(n, 0)] == self.owner[window - 1 :]) if n > 0 else np.empty(0, np.int64)
        self.keys = rolling(self.hashes, window)[self.at] if n > 0 else np.empty(0, np.uint64)

    def place(self, word: np.ndarray) -> np.ndarray:
        """Where in its document a word stands."""
        owner = self.owner[word]
        return self.starts[owner] + word - self.first_word[owner]

    def words(self, a: int, b: int) -> bytes:
        return self.data[self.low[a] : self.high[b - 1]]

    def repeated(self) -> np.ndarray:
        """For each window: does its word sequence start earlier, here?"""
        n = len(self.keys)
        self.first = np.arange(n)
        if not n:
            return np.zeros(0, bool)
        order = np.argsort(self.keys)
        sorted_keys = self.keys[order]
        group = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
        size = np.diff(np.r_[group, n])
        first = np.empty(n, np.int64)
        first[order] = np.repeat(np.minimum.reduceat(order, group), size)
        later = np.flatnonzero(first != np.arange(n))
        if not len(later):
            return np.zeros(n, bool)
        # Compare whole stretches of windows that repeat a stretch of windows, word for word.
        a, b = self.at[later], self.at[first[later]]
        cut = np.flatnonzero(np.r_[True, (np.diff(a) != 1) | (np.diff(b) != 1), True])
        wrong = []
        w = self.window
        a_low, b_low = self.low[a[cut[:-1]]], self.low[b[cut[:-1]]]
        a_high, b_high = self.high[a[cut[1:] - 1] + w - 1], self.high[b[cut[1:] - 1] + w - 1]
        data = self.data
        for k, (p, q, r, s) in enumerate(zip(a_low.tolist(), a_high.tolist(), b_low.tolist(), b_high.tolist())):
            if data[p:q] != data[r:s]:
                wrong.append(k)
        for k in wrong:  # different words with one hash: settle the groups in question by the words themselves
            for key in np.unique(self.keys[later[cut[k] : cut[k + 1]]]):
                seen: dict[bytes, int] = {}
                for i in np.flatnonzero(self.keys == key).tolist():
                    first[i] = seen.setdefault(self.words(self.at[i], self.at[i] + w), i)
        self.first = first
        # The same place of the same document, met twice, is no earlier one.
        mine, other = self.owner[self.at], self.owner[self.at[first]]
        return (self.ids[mine] != self.ids[other]) | (self.prints[mine] != self.prints[other]) | (self.place(self.at) != self.place(self.at[first]))

    def intervals(self, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
        """(id, print, start, stop) of the words that the repeated windows cover, runs of windows together."""
        at = self.at[repeated]
        if not len(at):
            return tuple(np.empty(0, np.int64) for _ in range(4))
        cut = np.r_[True, (np.diff(at) != 1) | (self.owner[at[1:]] != self.owner[at[:-1]])]
        first, last = at[cut], at[np.r_[np.flatnonzero(cut)[1:] - 1, len(at) - 1]]
        owner = self.owner[first]
        return self.ids[owner], self.prints[owner], self.place(first), self.place(last) + self.window

    def route(self, chosen: np.ndarray, buckets: int):
        """The chosen windows as super-k-mers by bucket: (bucket, ids, prints, starts, texts)."""
        at = self.at[chosen]
        if not len(at):
            return
        small = _sliding_min(rolling(self.hashes, RUN), self.window - RUN + 1)[at]
        cut = np.r_[True, (np.diff(at) != 1) | (small[1:] != small[:-1]) | (self.owner[at[1:]] != self.owner[at[:-1]])]
        first, last = at[cut], at[np.r_[np.flatnonzero(cut)[1:] - 1, len(at) - 1]]
        bucket = (mix(small[cut]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first, last, bucket = first[order], last[order], bucket[order]
        owner, place = self.owner[first], self.place(first)
        low, high = self.low[first].tolist(), self.high[last + self.window - 1].tolist()
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]).tolist()
        for a, b in zip(edges, edges[1:]):
            yield int(bucket[a]), self.ids[owner[a:b]], self.prints[owner[a:b]], place[a:b], [self.data[x:y] for x, y in zip(low[a:b], high[a:b])]


def _pack(ids, prints, starts, texts: list[bytes], squeeze) -> bytes:
    n = len(ids)
    return squeeze.compress(b"".join([np.int64(n).tobytes(), ids.tobytes(), prints.tobytes(), np.asarray(starts, np.int32).tobytes(), b"\n".join(texts)]))


def _unpack(blob: bytes, expand):
    raw = expand.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return (np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n), np.frombuffer(raw, np.int32, n, 8 + 16 * n), raw[8 + 20 * n :].split(b"\n") if n else [])


def _chunks(batches):
    """(id, print, single-spaced words) of documents, some megabytes at a time, in order and each document once."""
    rows, size = {}, 0
    for batch in pieces(batches, 2, PIECE):
        for doc, fingerprint, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = b" ".join(text.encode().split())
            rows[doc, fingerprint] = words
            size += len(words)
            if size >= CHUNK:
                yield sorted((*k, v) for k, v in rows.items())
                rows, size = {}, 0
    if rows:
        yield sorted((*k, v) for k, v in rows.items())


def repeated_intervals(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """(id, print, start, stop): stretches of words of ``docs`` (id, print, text) covered by windows that start earlier elsewhere."""
    if window < RUN:
        raise ValueError(f"a window has {RUN} words at least")
    # The number of buckets follows the corpus, so that a bucket fits a task at any size.
    buckets = buckets or int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET) + 1
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches):
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for n, rows in enumerate(_chunks(batches)):
            ids, prints, texts = zip(*rows)
            here = Passages(ids, prints, np.zeros(len(ids), np.int64), list(texts), window)
            again = here.repeated()
            out: list[tuple[int, bytes]] = [(b, _pack(*rest, squeeze)) for b, *rest in here.route(~again, buckets)]
            # What repeats within the chunk is settled here and need not meet its bucket: only its place is sent on.
            found = here.intervals(again)
            if len(found[0]):
                out.append((-1 - (n + int(ids[0])) % buckets, squeeze.compress(np.stack(found).astype(np.int64).tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "packed"])
            del rows, ids, prints, texts, here, again, out, found  # before the next chunk is gathered

    def settle(parts: list):
        """The intervals of the parts' repeated windows, and the other windows, one copy of each, as one part."""
        ids, prints, starts = (np.concatenate([p[k] for p in parts]) for k in range(3))
        texts = [t for p in parts for t in p[3]]
        order = np.lexsort((starts, prints, ids))
        there = Passages(ids[order], prints[order], starts[order], [texts[i] for i in order.tolist()], window)
        found = there.intervals(there.repeated())
        return found, [rest for _, *rest in there.route(there.first == np.arange(len(there.first)), 1)]

    def meet(batches):
        expand = zstandard.ZstdDecompressor()
        bucket, parts, size, most = None, [], 0, SETTLED

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2].astype(np.int32)), pa.array(found[3].astype(np.int32))], ["id", "print", "start", "stop"])

        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                blob = blob.as_py()
                if b < 0:
                    yield out(np.frombuffer(expand.decompress(blob), np.int64).reshape(4, -1))
                    continue
                if b != bucket:
                    if parts:
                        yield out(settle(parts)[0])
                    bucket, parts, size, most = b, [], 0, SETTLED
                parts.append(_unpack(blob, expand))
                size += sum(map(len, parts[-1][3]))
                if size > most:
                    # Copies of a passage that very many documents share shrink to one before more of them come.
                    found, parts = settle(parts)
                    yield out(found)
                    size = sum(map(len, parts[0][3])) if parts else 0
                    most = max(SETTLED, 2 * size)
        if parts:
            yield out(settle(parts)[0])

    routed = docs.select("id", "print", "text").mapInArrow(send, _ROUTED)
    return routed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, _INTERVALS)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of ``docs`` (doc_id, text, any others).

    Words are what lies between spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns; a null
    text has none. A word goes if any window that covers it has its word sequence also starting earlier: in a
    document with a smaller id or earlier in its own. ``kept_text`` is the words that stay, joined by one space.
    Texts shorter than a window stay whole. Equal rows get equal results; an empty table gives an empty one.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id")).withColumn("print", F.xxhash64("text"))
    found = repeated_intervals(keyed, window, buckets).groupBy("id", "print").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def squeeze(batches):
        # Texts cross the shuffle compressed: they are most of what this operator moves.
        small = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, 3, PIECE):
            packed = [small.compress(t.encode()) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(packed, pa.binary())], ["doc_id", "id", "print", "packed"])

    texts = keyed.select("doc_id", "id", "print", "text").mapInArrow(squeeze, f"doc_id {kind}, id bigint, print bigint, packed binary")
    joined = texts.join(found.hint("shuffle_hash"), ["id", "print"], "left").select("doc_id", "packed", F.col("cuts.start").alias("starts"), F.col("cuts.stop").alias("stops"))

    def cut(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in pieces(batches, 1, PIECE):
            docs, texts, starts, stops = (batch.column(i) for i in range(4))
            n_words, n_removed, kept = [], [], []
            for text, a, b in zip(texts, starts.to_pylist(), stops.to_pylist()):
                words = expand.decompress(text.as_py()).split()
                n_words.append(len(words))
                if a:
                    change = np.bincount(a, minlength=len(words) + 1) - np.bincount(b, minlength=len(words) + 1)
                    stay = np.flatnonzero(np.cumsum(change)[: len(words)] == 0).tolist()
                    words = [words[i] for i in stay]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([docs, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM d WHERE len(words) >= 20),
w AS (SELECT doc_id, start, md5(array_to_string(words[start:start + 19], ' ')) AS seq FROM s),
r AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY seq ORDER BY doc_id, start) AS nth FROM w) WHERE nth > 1),
c AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT doc_id, unnest(range(start, start + 20)) AS pos FROM r) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE [words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
