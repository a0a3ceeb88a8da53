"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch, each distinct one once, are a ragged numpy array: symbols of
all of them in a row, and where each begins. A round finds every sequence's lowest rank
among its adjacent pairs and merges that pair at once in all sequences and at all its
places (of overlapping ones every second, from the left); sequences without a pair that
merges are counted and leave. The symbols that survive are the tokens.

A round touches every symbol still there, so a sequence longer than ``LONG`` symbols,
which may need a round for each of its merges, is merged by a heap over a linked list
instead, in the same order and with the same count.

Counts are those of the tokenizers library with its defaults: the normaliser of the file
(NFC, white space, lower case letter by letter), its split, its end-of-word suffix;
special strings inside a text are one token each, and nothing is added or cut.

Defined cases: null text is empty; an empty text has no tokens; other columns are carried
by ``count_tokens`` except ones named like its results; an empty table is empty.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .replay import NONE, PairTable

#: Pre-tokens a worker keeps the counts of; beyond it the store is emptied.
KEPT = 1_000_000
#: Symbols above which a sequence is merged by a heap.
LONG = 2048
#: Tokens of a context window.
LIMIT = 2048
PIECE = 8 << 20

_SPACE = "\t-\r \x85\xa0  -     　"
_WORD = re.compile(f"[^{_SPACE}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts tokens by a tokenizer file: BPE over byte characters with an end-of-word suffix."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, normal = spec["model"], spec["normalizer"]["normalizers"]
        if model["type"] != "BPE" or [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a vocabulary of the kind this counter knows")
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        suffix = model["end_of_word_suffix"] or ""
        self.pairs = PairTable(*zip(*((vocab[a] << 32 | vocab[b], r) for r, (a, b) in dict(((a, b), (r, (a, b))) for r, (a, b) in reversed(list(enumerate(merges)))).values())))
        self.by_pair = {}
        for r, (a, b) in enumerate(merges):
            self.by_pair.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.kept: dict[str, int] = {}

    def pre_tokens(self, word: str) -> list[str]:
        """The pre-tokens of a run without white space."""
        word = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        return self.split.findall(word)

    def count_alone(self, word: bytes) -> int:
        sym = self.inner[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.final[word[-1]])
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def push(i: int) -> None:
            j = right[i]
            if j < n and (found := self.by_pair.get((sym[i], sym[j]))):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n):
            push(i)
        count = n
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], right[i] = made, -1, right[j]
            count -= 1
            if right[i] < n:
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return count

    def count_words(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token (none empty), by rounds over all of them."""
        counts = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(lengths > LONG).tolist():
            counts[k] = self.count_alone(words[k])
        ids = np.flatnonzero((lengths <= LONG) & (lengths > 0))
        if not len(ids):
            return counts
        size = lengths[ids]
        flat = np.frombuffer(b"".join([words[k] for k in ids.tolist()]), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(size)
        sym[ends - 1] = self.final[flat[ends - 1]]
        starts = ends - size
        pair = np.append(self.pairs(sym[:-1], sym[1:]), NONE)
        pair[ends - 1] = NONE
        while True:
            lowest = np.minimum.reduceat(pair, starts)
            on = lowest < NONE
            if not on.all():
                counts[ids[~on]] = size[~on]
                if not on.any():
                    return counts
                stay = np.repeat(on, size)
                sym, pair = sym[stay], pair[stay]
                ids, size, lowest = ids[on], size[on], lowest[on]
                starts = np.cumsum(size) - size
            hit = pair == np.repeat(lowest, size)
            at = np.flatnonzero(hit)
            follows = np.append(False, np.diff(at) == 1)
            if follows.any():
                head = np.flatnonzero(~follows)
                step = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
                at = at[step % 2 == 0]
            sym[at] = self.made[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            owner = np.repeat(np.arange(len(ids)), size)
            size = size - np.bincount(owner[at], minlength=len(ids))
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            before = at[at > 1] - 2  # where the symbol before is itself merged away
            changed[before] = True
            sym, pair, changed = sym[keep], pair[keep], changed[keep]
            starts = np.cumsum(size) - size
            last = starts + size - 1
            again = np.flatnonzero(changed[:-1])
            pair[again] = self.pairs(sym[again], sym[again + 1])
            pair[last] = NONE

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        extra, texts = [0] * len(texts), list(texts)
        if self.special:
            for i, t in enumerate(texts):
                if "<" in t and (n := len(self.special.findall(t))):
                    extra[i], texts[i] = n, self.special.sub(" ", t)
        split = [_WORD.findall(t) for t in texts]
        fresh = list(set().union(*split) - self.kept.keys())
        if fresh:
            parts = [self.pre_tokens(w) for w in fresh]
            words = list(set().union(*parts))
            sizes = dict(zip(words, self.count_words([w.encode() for w in words]).tolist()))
            for w, p in zip(fresh, parts):
                self.kept[w] = sum([sizes[x] for x in p])
        return [sum(map(self.kept.__getitem__, w)) + x for w, x in zip(split, extra)]


_LOADED: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a file, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def count_tokens(df: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """All columns of ``df`` with n_bytes, n_tokens and over_limit."""
    path = path or default_path()
    base = df.drop("n_bytes", "n_tokens", "over_limit")
    schema = common.schema_of(base, "n_bytes long, n_tokens long, over_limit boolean")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        count = counter(path)
        for whole in batches:
            for batch in common.pieces(whole, "text", PIECE):
                _, starts = common.text_bytes(batch.column("text"))
                n = np.array(count.count([t or "" for t in batch.column("text").to_pylist()]), np.int64)
                yield common.carried(batch, arrow, {"n_bytes": pa.array(np.diff(starts)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return base.mapInArrow(run, schema)


def query(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs).drop("text")
