"""BPE encoding and decoding with a public tokenizer file: merge rounds over many words at once in numpy.

A batch's distinct words lie one after another in one flat array of symbols. In each round every word finds its
lowest-ranked adjacent pair by binary search over the sorted pair keys, merges all its occurrences from left to
right, and words without a known pair leave the array. That equals merging the lowest pair one place at a time,
since every merge of the file makes its own token: pairs with a new token rank after the merge that made it.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces

VOCABULARY = "word_bpe_49k.json"
#: Words whose encodings a task keeps at most; beyond that it forgets them all and goes on.
CACHED_WORDS = 100_000
#: Bytes of text that a task works on at a time.
CHUNK = 1_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable letter for each byte: itself if it is printable and no space, else one from U+0100 on, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder of a tokenizers JSON file with a BPE model, byte letters and word ends.

    The file's normaliser must be NFC, white space to spaces, lower case, and its words must be those of one pattern.
    """

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or spec["decoder"] or spec["post_processor"] or spec["truncation"] or spec["padding"]:
            raise ValueError("this tokenizer file has parts that are not supported")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        end = model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        if len(np.unique(made)) < len(made):
            raise ValueError("two merges of this file make one token, so that rounds could not merge all places of a pair at once")
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        # White space as the file's regex engine has it, which is not Python's.
        spaces = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", spaces)
        self.words = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        """Empty the cache: each word's place in the lists of sizes, starts and texts; its ids lie in ``flat``."""
        self.place: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.size, self.start = np.empty(0, np.int64), np.empty(0, np.int64)
        self.shown: list[str] = []

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word after another, and how many each has."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(size)
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), size)
        done_symbols, done_words = [], []
        while len(symbols):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.full(len(symbols), len(self.ranks), np.int64)
            known = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank[:-1][known] = self.ranks[at[known]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(symbols)])
            best = np.repeat(lowest, count)
            going = best < len(self.ranks)
            if not going.all():
                done_symbols.append(symbols[~going])
                done_words.append(word[~going])
            symbols, word, rank, best = symbols[going], word[going], rank[going], best[going]
            hit = rank == best
            # In a run of adjacent hits (the same letter repeated) every second one merges.
            where = np.flatnonzero(hit)
            if len(where):
                starts = np.r_[True, (np.diff(where) > 1) | (word[where[1:]] != word[where[:-1]])]
                offset = where - where[np.maximum.accumulate(np.where(starts, np.arange(len(where)), 0))]
                where = where[offset % 2 == 0]
            symbols[where] = self.made[best[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_words:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def split(self, text: str) -> list[str]:
        """The words of a text; the special tokens' own strings stand for themselves."""
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        out = []
        for k, part in enumerate(self.specials.split(text)):
            out += [part] if k % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        # Capital sigma goes to the plain small one wherever it stands; Python's lower() has a rule for word ends.
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def learn(self, words: set[str]) -> None:
        """Have the words' encodings in the cache."""
        if len(self.place) + len(words) > CACHED_WORDS:
            self.forget()
        new = [w for w in words if w not in self.place and w not in self.special]
        ids, size = self.merge(new)
        for w in self.special.keys() & words - self.place.keys():
            new.append(w)
            ids, size = np.append(ids, self.special[w]), np.append(size, 1)
        self.place.update(zip(new, range(len(self.shown), len(self.shown) + len(new))))
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.size = np.concatenate([self.size, size])
        self.start = np.cumsum(self.size) - self.size
        names, at = [self.tokens[i] for i in ids.tolist()], 0
        for n in size.tolist():
            self.shown.append(names[at] if n == 1 else " ".join(names[at : at + n]))
            at += n

    def encode(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all rows of words, one after another, how many each row has, and each row's decoded text."""
        self.learn(set(chain.from_iterable(rows)))
        at = [list(map(self.place.__getitem__, r)) for r in rows]
        shown = [" ".join(map(self.shown.__getitem__, a)) for a in at]
        flat = np.fromiter(chain.from_iterable(at), np.int64)
        size = self.size[flat]
        before = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.start[flat] - before, size) + np.arange(size.sum())]
        edges = np.cumsum([0, *map(len, rows)])
        sums = np.concatenate([[0], np.cumsum(size)])[edges]
        return ids, np.diff(sums), shown

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by a space, special ones too."""
        return " ".join([self.tokens[i] for i in ids])


def encoded(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` without its text, with n_tokens (long), token_ids (array of int) and decoded (string).

    Whole texts of any length are encoded, a null text as an empty one, which has no tokens. Other columns pass through, but
    columns of the added names are replaced; repeated rows are kept. Nothing is shuffled. The driver reads the
    file once and sends it to the tasks: its size is fixed.
    """
    spark = docs.sparkSession
    with open(vocabulary or vocabulary_path(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    added = ("n_tokens", "token_ids", "decoded")
    kept = [c for c in docs.columns if c not in (*added, text)]
    given = docs.select(*(f"`{c}`" for c in kept), docs[f"`{text}`"].alias("__text"))

    def work(batches):
        codec = Codec(spec.value)
        for batch in pieces(batches, "__text", CHUNK):
            ids, size, shown = codec.encode([codec.split(t) if t else [] for t in batch.column("__text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(size, pa.int64()), lists, pa.array(shown, pa.string())], [*kept, *added])

    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in kept), "n_tokens bigint, token_ids array<int>, decoded string"])
    return given.mapInArrow(work, schema)


def decoded(rows: DataFrame, ids: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``, the text of the array ``ids`` with special tokens kept; null ids give null, unknown ids an error."""
    spark = rows.sparkSession
    with open(vocabulary or vocabulary_path(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kept = [c for c in rows.columns if c != "decoded"]
    given = rows.select(*(f"`{c}`" for c in kept), rows[f"`{ids}`"].alias("__ids"))

    def work(batches):
        codec = Codec(spec.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(texts, pa.string())], [*kept, "decoded"])

    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in kept), "decoded string"])
    return given.mapInArrow(work, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return encoded(docs).select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
