"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a batch of documents are laid out once as a corpus of byte
symbols. An inverted index holds, for each rank, the positions of the adjacent pairs that
merge at it. Ranks are replayed in order over all pre-tokens together; each merge touches
its two neighbours, whose new pairs enter the index. Documents are then spelled out from
their pre-tokens.

The corpus of a replay is a batch of one task and not the whole table: pre-tokens are
encoded independently of one another, so the ids are the same, and neither the texts nor
the pre-tokens (about as many bytes as the texts) are shuffled. A task keeps the ids of
pre-tokens it has met for its later batches; above ``KEPT`` (``ROWS_KEPT``) only those of the last batch,
which are the frequent ones, stay.

A vocabulary may rank a merge below the ranks of the tokens it joins. Where replaying such
a pair could change the order in which a pre-token's pairs merge, that pre-token is
encoded alone, lowest rank first and leftmost first.

Defined cases: null text is empty; an empty text has no ids; a pre-token may be as long as
the text; special tokens are ordinary text; other columns are carried and must not be
named like the results, which replace them; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Pre-tokens that a task keeps.
KEPT = 250_000
#: Bytes of text that are encoded together.
PIECE = 4 << 20
#: The same for ``encode_rows``, which runs after other stages, beside what these left in memory.
ROWS_KEPT = 100_000
ROWS_PIECE = 1 << 20
#: Merges of a rank that are applied one by one; of more, all at once.
FEW = 24

NO_RANK = 1 << 40
NONE = np.int64(NO_RANK)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pairs_of(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank by pair (a << 32 | b): two tokens merge where the bytes of both are a token."""
    found = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                found[a << 32 | b] = rank
    return found


class PairTable:
    """Rank of the pair (a, b) of token ids, for arrays; ``NONE`` where they don't merge."""

    def __init__(self, keys: list[int], values: list[int]):
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # open addressing, a round for all that are still without a slot
            free = self.keys[at] == -1
            first = np.unique(at[free], return_index=True)[1]
            chosen = np.flatnonzero(free)[first]
            self.keys[at[chosen]], self.values[at[chosen]] = keys[todo[chosen]], values[todo[chosen]]
            left = np.ones(len(todo), bool)
            left[chosen] = False
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        at = self._slot(keys)
        result = np.full(len(keys), NONE, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            result[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return result


class _Places:
    """The arrays of a replay, for single places (views are quicker at that than arrays)."""

    def __init__(self, sym, after, before, alive, rank, odd, owner):
        self.sym, self.after, self.before, self.rank = map(memoryview, (sym, after, before, rank))
        self.alive, self.odd, self.owner = memoryview(alive), odd, owner


class Vocabulary:
    """The ranks of a byte-level vocabulary, with what encoding and decoding need."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.pair_ranks = pairs_of(self.ranks)
        self.pairs = PairTable(list(self.pair_ranks), list(self.pair_ranks.values()))
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.decimals = list(map(str, range(len(self.bytes))))
        self.by_decimal = {str(rank): token for token, rank in self.ranks.items()}
        self.kept: dict[str, str] = {}
        self.words: dict[str, str] = {}

    # -- one pre-token alone -------------------------------------------------------------

    def encode_alone(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first, with a heap over a linked list."""
        n = len(word)
        ends, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if j < n and (rank := self.ranks.get(word[i : ends[j]])) is not None:
                heapq.heappush(heap, (rank, i, ends[j]))

        for i in range(n):
            push(i)
        gone = bytearray(n)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = right[i] if not gone[i] else n
            if gone[i] or j >= n or ends[j] != end or right[i] >= n:
                continue
            gone[j] = 1
            ends[i], right[i] = end, right[j]
            if right[i] < n:
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[word[i : ends[i]]])
            i = right[i]
        return ids

    # -- all pre-tokens of a batch -------------------------------------------------------

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each distinct pre-token, merging rank by rank over all of them."""
        counts, ids, odd = self._merged(words)
        result, i = [], 0
        for c in counts:
            result.append(ids[i : i + c])
            i += c
        for k in odd:
            result[k] = self.encode_alone(words[k])
        return result

    def replay_decimal(self, words: list[bytes]) -> list[str]:
        """The same in decimal, joined by one space."""
        counts, ids, odd = self._merged(words)
        shown = list(map(self.decimals.__getitem__, ids))
        result, i = [], 0
        for c in counts:
            result.append(shown[i] if c == 1 else " ".join(shown[i : i + c]))
            i += c
        for k in odd:
            result[k] = " ".join(map(str, self.encode_alone(words[k])))
        return result

    def _merged(self, words: list[bytes]) -> tuple[list[int], list[int], list[int]]:
        """How many symbols each word keeps, all kept symbols, and the words to do alone."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        flat = np.frombuffer(b"".join(words), np.uint8)
        # One empty symbol (-1) on either side of a word ends its chain of neighbours.
        owner = np.repeat(np.arange(len(words)), lengths)
        sym = np.append(self.byte_ids[flat], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        last = ends - 1
        after[last[lengths > 0]] = n
        before[(ends - lengths)[lengths > 0]] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        odd = np.zeros(len(words) + 1, bool)
        rank = np.full(n + 1, NONE, np.int64)  # of the pair that begins at a position
        inside = np.flatnonzero(after[:n] != n)
        rank[inside] = self.pairs(sym[inside], sym[after[inside]])
        begun = inside[rank[inside] < NONE]
        order = begun[np.argsort(rank[begun], kind="stable")]
        levels, starts = np.unique(rank[order], return_index=True)
        # The inverted index: for each rank, places in arrays and places one by one.
        index: dict[int, list[np.ndarray]] = {int(r): [p] for r, p in zip(levels, np.split(order, starts[1:]))}
        single: dict[int, list[int]] = {}
        heap = levels.tolist()
        heapq.heapify(heap)
        one = _Places(sym, after, before, alive, rank, odd, owner)
        while heap:
            r = heapq.heappop(heap)
            arrays, places = index.pop(r, ()), single.pop(r, ())
            if sum(map(len, arrays)) + len(places) <= FEW:
                self._merge_few(r, sorted({*places, *(i for p in arrays for i in p.tolist())}), one, n, index, single, heap)
                continue
            at = np.concatenate([*arrays, np.array(places, np.int64)])
            at = np.sort(at[alive[at] & (rank[at] == r)])
            if not len(at):
                continue
            at = at[np.append(True, at[1:] != at[:-1])]
            other = after[at]
            chained = np.append(False, other[:-1] == at[1:])
            if chained.any():  # aaa: of overlapping pairs every second, from the left
                head = np.flatnonzero(~chained)
                step = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
                at, other = at[step % 2 == 0], other[step % 2 == 0]
            then = after[other]
            sym[at], alive[other] = r, False
            rank[other] = NONE
            after[at] = then
            before[then] = at  # position n, the edge, is written too but never read
            prior = before[at]
            touched = np.concatenate([at, prior[prior != n]])
            nxt = after[touched]
            real = np.flatnonzero(nxt != n)
            fresh = np.full(len(touched), NONE, np.int64)
            fresh[real] = self.pairs(sym[touched[real]], sym[nxt[real]])
            rank[touched] = fresh
            found = np.flatnonzero(fresh < NONE)
            if not len(found):
                continue
            touched, fresh = touched[found], fresh[found]
            low = fresh <= r
            if low.any():
                odd[owner[touched[low]]] = True
            by = np.argsort(fresh, kind="stable")
            touched, fresh = touched[by], fresh[by]
            cuts = [0, *(np.flatnonzero(fresh[1:] != fresh[:-1]) + 1).tolist(), len(fresh)]
            for a, b in zip(cuts, cuts[1:]):
                q = int(fresh[a])
                if q in index:
                    index[q].append(touched[a:b])
                else:
                    index[q] = [touched[a:b]]
                    if q not in single:
                        heapq.heappush(heap, q)
        kept = np.flatnonzero(alive[:n])
        return np.bincount(owner[kept], minlength=len(words)).tolist(), sym[kept].tolist(), np.flatnonzero(odd).tolist()

    def _merge_few(self, r: int, places: list[int], one: _Places, n: int, index: dict, single: dict, heap: list[int]) -> None:
        """Merges at rank ``r``, place after place; as above, without arrays for so few."""
        sym, after, before, alive, rank = one.sym, one.after, one.before, one.alive, one.rank
        find = self.pair_ranks.get
        for i in places:
            if not alive[i] or rank[i] != r:
                continue
            j = after[i]
            k = after[j]
            sym[i], alive[j], rank[j], after[i], before[k] = r, False, NO_RANK, k, i
            rank[i] = NO_RANK
            for x, y in ((i, k), (before[i], i)):
                if x == n or y == n:
                    continue
                q = find(sym[x] << 32 | sym[y], NO_RANK)
                rank[x] = q
                if q < NO_RANK:
                    if q <= r:
                        one.odd[one.owner[x]] = True
                    if q in single:
                        single[q].append(x)
                    else:
                        single[q] = [x]
                        if q not in index:
                            heapq.heappush(heap, q)

    def rest(self) -> None:
        """Nothing is kept beyond a task."""
        self.kept, self.words = {}, {}
        common.relax()

    # -- documents -----------------------------------------------------------------------

    def _units(self, text: str) -> list[str]:
        """Pieces of a text that the pattern never matches across, in order."""
        return _UNIT.findall(text)

    def _parts(self, units: list[str]) -> list[list[str]]:
        """The pre-tokens of each unit. Units that begin with a space are matched as one text."""
        units.sort(key=_alone)
        alone = bisect.bisect_left(units, True, key=_alone)
        found = iter(self.pattern.findall("".join(units[:alone])))
        parts = []
        for unit in units[:alone]:
            part = [next(found)]
            missing = len(unit) - len(part[0])
            while missing:
                part.append(next(found))
                missing -= len(part[-1])
            parts.append(part)
        return parts + list(map(self.pattern.findall, units[alone:]))

    def encode_decimal(self, texts: list[str], most: int = KEPT) -> list[str]:
        """The ids of each text in decimal, joined by one space; above ``most``, only the batch's own are kept."""
        kept, decimal = self.kept, self.words
        split = [self._units(t) for t in texts]
        met = set().union(*split)
        if fresh := list(met - kept.keys()):
            parts = self._parts(fresh)
            used = set().union(*parts)
            if words := list(used - decimal.keys()):
                decimal.update(zip(words, self.replay_decimal([w.encode() for w in words])))
            for u, p in zip(fresh, parts):
                kept[u] = decimal[p[0]] if len(p) == 1 else " ".join([decimal[w] for w in p])
            if len(decimal) > most:
                self.words = {w: decimal[w] for w in used}
        result = [" ".join(map(kept.__getitem__, units)) for units in split]
        if len(kept) > most:
            self.kept = {u: kept[u] for u in met}
        return result

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(map(int, s.split())) for s in self.encode_decimal(texts)]

    def decode_decimal(self, ids: str) -> bytes:
        return b"".join(map(self.by_decimal.__getitem__, ids.split(" "))) if ids else b""

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


#: White space with the word after it. The pattern's matches never cross from a word to the
#: white space that follows it, and what they do with white space depends on the next word.
_UNIT = re.compile(r"\s*\S+|\s+\Z")


def _alone(unit: str) -> bool:
    return unit[0] not in " \n" or unit[-1].isspace()


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a file, loaded once in each worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary(path, pattern)
        common.relax()
    return _LOADED[path, pattern]


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(df: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id with n_tokens and the digests of the ids and of the decoded bytes."""
    path, pattern = path or defaults()[0], pattern or defaults()[1]

    def run(batches):
        vocab = vocabulary(path, pattern)
        for whole in batches:
            for batch in common.pieces(whole, "text", PIECE):
                ids = vocab.encode_decimal([t or "" for t in batch.column("text").to_pylist()])
                columns = [
                    batch.column("doc_id"),
                    pa.array([s.count(" ") + 1 if s else 0 for s in ids], pa.int64()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for s in ids], pa.string()),
                    pa.array([hashlib.sha256(vocab.decode_decimal(s)).hexdigest() for s in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        vocab.rest()

    schema = T.StructType([df.schema["doc_id"], *T._parse_datatype_string(RESULT).fields])
    return df.select("doc_id", "text").mapInArrow(run, schema)


def encode_texts(df: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of ``df`` with ``ids`` (array of int), its length n_tokens and ``decoded``."""
    path, pattern = path or defaults()[0], pattern or defaults()[1]
    base = df.drop("ids", "n_tokens", "decoded")
    schema = common.schema_of(base, "ids array<int>, n_tokens long, decoded string")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        vocab = vocabulary(path, pattern)
        for whole in batches:
            for batch in common.pieces(whole, "text", PIECE):
                ids = vocab.encode([t or "" for t in batch.column("text").to_pylist()])
                decoded = [vocab.decode(x).decode("utf-8", "replace") for x in ids]
                columns = {"ids": pa.array(ids, arrow.field("ids").type), "n_tokens": pa.array(list(map(len, ids)), pa.int64()), "decoded": pa.array(decoded, pa.string())}
                yield common.carried(batch, arrow, columns)
        vocab.rest()

    return base.mapInArrow(run, schema)


def encode_rows(df: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of ``df`` but text, with n_tokens, ids (decimal, joined by one space) and
    round_trip (whether the ids decode to the text)."""
    path, pattern = path or defaults()[0], pattern or defaults()[1]
    base = df.drop("ids", "n_tokens", "round_trip")
    schema = T.StructType([*[f for f in base.schema.fields if f.name != "text"], *T._parse_datatype_string("n_tokens long, ids string, round_trip boolean").fields])
    arrow = common.arrow_schema(schema)

    def run(batches):
        vocab = vocabulary(path, pattern)
        for whole in batches:
            for batch in common.pieces(whole, "text", ROWS_PIECE):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = vocab.encode_decimal(texts, ROWS_KEPT)
                columns = {
                    "n_tokens": pa.array([s.count(" ") + 1 if s else 0 for s in ids], pa.int64()),
                    "ids": pa.array(ids, pa.string()),
                    "round_trip": pa.array([vocab.decode_decimal(s) == t.encode() for s, t in zip(ids, texts)], pa.bool_()),
                }
                yield common.carried(batch, arrow, columns)
        vocab.rest()

    return base.mapInArrow(run, schema)


def query(spark, sf_dir):
    return encode_digests(common.documents(spark, sf_dir))
