"""Removal of repeated 400-byte strings with a sparse, distributed suffix array.

A byte goes if it lies in a string of ``LENGTH`` bytes that starts anywhere else too. Only
suffixes at *anchors* are sorted first: the anchor of a 400-byte string is the place in it
where a hash of ``GRAM`` bytes is least, which depends on the string alone, so equal
strings have equal anchors. An anchor serves a run of neighbouring starts.

A suffix is an array of tokens, each the name of a slice of its bytes: 64 bits of one hash,
then 32 bits of another of a different kind, so nothing goes that merely shares a 64-bit
name. Suffixes are range-partitioned by splitters sampled from their leading tokens. A
bucket sorts its suffixes by multikey quicksort, which goes on to the next token only where
the last one is equal and so gives the number of leading tokens that neighbours share, and
compares neighbours. A task passes on one suffix of each token that it holds many of (they
are decided among themselves), and splitters never separate equal tokens. A bucket that
grows beyond ``CHUNK`` suffixes is sorted and compared part by part; one suffix of each
name that was seen goes on into the next part, so comparison crosses the boundaries and
memory holds the distinct names of a bucket at most.

1. *Runs.* Each anchor gives three suffixes: the whole slice its starts cover, and, followed
   by the name of that slice, the 200 bytes to its right and to its left. If the slice
   repeats, all its starts repeat. If a half repeats before another slice, some starts on
   that side may repeat where their slices do not; one suffix of each slice goes on.
2. *Starts.* What goes on lies around the ends of repeats: there every start is a suffix
   of 400 bytes, and is sorted and compared in the same way.
3. Repeated starts become spans, and texts lose them.

Suffixes travel as packed arrays, one for each task and bucket, not as rows.

Defined cases: null text is empty; strings never cross documents, and overlap counts,
within one document too; texts shorter than 400 bytes lose nothing; a null doc_id is an id
like any other, and rows that repeat an id are rows of their own (their texts are counted
apart by a name of the text, and equal rows share spans); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH = 400
HALF = LENGTH // 2
GRAM = 32
#: Starts whose strings a run of hashes decides: the anchor is the least of so many.
SPAN = LENGTH - GRAM + 1
#: Bytes of text that are looked at together.
PIECE = 2 << 20
#: Suffixes that a task gathers before it passes them on, and that a bucket sorts together.
CHUNK = 1 << 20
#: Documents of each bucket's share of the sample that splitters are taken from.
SAMPLED = 16

_BASE = 0xD6E8FEB86659FD93
_OTHER = 0xC2B2AE3D27D4EB4F
_BYTE = common.mix64(np.arange(1, 257).astype(np.uint64))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse."""
    if base not in _powers or len(_powers[base][0]) < n:
        with np.errstate(over="ignore"):
            _powers[base] = tuple(np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
    return _powers[base]


class _Sums:
    """Hashes of slices of an array of codes, by prefix sums of a polynomial."""

    def __init__(self, codes: np.ndarray, base: int):
        power, self.inverse = _power(base, len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(codes * power[: len(codes)], out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[last] - self.sums[first]) * self.inverse[first]

    def windows(self, size: int) -> np.ndarray:
        """Of each slice of so many codes."""
        with np.errstate(over="ignore"):
            return (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size]


class Slices:
    """Names of slices of an array of bytes: 64 bits, and 32 bits of another hash."""

    def __init__(self, flat: np.ndarray):
        self.bytes = _Sums(_BYTE[flat], _BASE)
        # The other hash mixes words of eight bytes, so that it is no polynomial of bytes.
        words = np.ndarray((max(0, len(flat) - 7),), "<u8", np.ascontiguousarray(flat), strides=(1,))
        self.words = _Sums(common.mix64(words), _OTHER)

    def names(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = common.mix64((last - first).astype(np.uint64))
        low = common.mix64(self.words.of(first, last - 7) + size) >> np.uint64(32)
        return common.mix64(self.bytes.of(first, last) ^ size), low.astype(np.uint32)


def anchors(flat: np.ndarray, starts: np.ndarray, slices: Slices) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor, first start, last start) of each run of starts with one anchor."""
    sizes = np.diff(starts)
    grams = len(flat) - GRAM + 1
    none = np.zeros(0, np.int64)
    if grams < SPAN or not (sizes >= LENGTH).any():
        return none, none, none, none
    # Half of the hash above, the place below: of equal hashes the leftmost is least.
    least = common.mix64(slices.bytes.windows(GRAM))
    least &= np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(grams, dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])  # of the 400 bytes from each start
    where = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(where)]
    begin = np.flatnonzero(np.arange(LENGTH, len(where) + LENGTH) <= starts[1:][owner])
    if not len(begin):
        return none, none, none, none
    anchor, doc = where[begin], owner[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    return doc[first], anchor[first], begin[first], begin[last]


def multikey_order(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: the order of suffixes, given token after token, and how many
    leading tokens each shares with the one before it."""
    n = len(tokens[0])
    order = np.argsort(tokens[0])
    shared = np.zeros(n, np.int8)
    at = np.arange(n)  # places whose suffixes share all tokens so far with a neighbour
    run = np.zeros(n, np.int64)
    for depth, token in enumerate(tokens):
        if depth:
            by = np.lexsort((token[order[at]], run))
            order[at] = order[at][by]
        value = token[order[at]]
        same = np.zeros(len(at), bool)
        same[1:] = (value[1:] == value[:-1]) & (run[1:] == run[:-1])
        shared[at[same]] += 1
        run = np.cumsum(~same)
        many = same.copy()
        many[:-1] |= same[1:]
        at, run = at[many], run[many]
        if not len(at):
            break
    return order, shared


# -- packed suffixes ---------------------------------------------------------------------

_WHOLE, _RIGHT, _LEFT, _SURE = 0, 1, 2, 3
#: key, low, second: the tokens. row_a, row_b: the row's name. place: a run or a start.
#: kind: plus ``_TWICE`` where a task saw the suffix more than once, ``_TOLD`` where its
#: repetition was told before.
_FIELDS = {"key": "<u8", "low": "<u4", "second": "<u8", "row_a": "<u8", "row_b": "<u4", "place": "<u4", "kind": "u1"}
_TWICE, _TOLD = 8, 16
_PACKED = "part int, packed binary"


def _pack(columns: dict[str, np.ndarray], at) -> bytes:
    return b"".join(np.ascontiguousarray(columns[k][at], kind).tobytes() for k, kind in _FIELDS.items())


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for t in _FIELDS.values())
    found: dict[str, list[np.ndarray]] = {k: [] for k in _FIELDS}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for k, kind in _FIELDS.items():
            found[k].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {k: np.concatenate(v) if v else np.zeros(0, _FIELDS[k]) for k, v in found.items()}


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in _FIELDS}


class _Outbox:
    """Gathers suffixes of a task, folds them and packs them by bucket."""

    def __init__(self, splitters: np.ndarray):
        self.splitters, self.held, self.size = splitters, [], 0

    def add(self, key, low, second, rows, place, kind) -> None:
        if len(key):
            second = np.zeros(len(key), np.uint64) if second is None else second
            self.held.append({"key": key, "low": low, "second": second, "row_a": rows[0], "row_b": rows[1], "place": place.astype(np.uint32), "kind": kind})
            self.size += len(key)

    def flush(self, least: int = 0):
        if not self.held or self.size < least:
            return
        one = _joined(self.held)
        self.held, self.size = [], 0
        key, kind = one["key"].copy(), one["kind"].copy()
        order, shared = multikey_order([key, one["low"], one["second"]])
        same = shared == 3
        spare = order[same]
        twice = same.copy()
        twice[:-1] |= same[1:]
        kind[order[twice]] |= _TWICE
        # What is decided here gets a bucket of its own, so that none grows with the copies.
        with np.errstate(over="ignore"):
            key[spare] = common.mix64(key[spare] + (spare.astype(np.uint64) + np.uint64(1)) * _ODD)
        dropped = np.zeros(len(key), bool)
        dropped[spare] = True
        dropped &= (kind & 3 == _RIGHT) | (kind & 3 == _LEFT)
        stay = np.flatnonzero(~dropped)
        one = {k: v[stay] for k, v in (one | {"key": key, "kind": kind}).items()}
        part = np.searchsorted(self.splitters, one["key"], "right").astype(np.int32)
        by = np.argsort(part, kind="stable")
        ids, begin = np.unique(part[by], return_index=True)
        blobs = [_pack(one, x) for x in np.split(by, begin[1:])]
        for k in range(0, len(blobs), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 4096], pa.int32()), pa.array(blobs[k : k + 4096], pa.binary())], ["part", "packed"])


def _by_row(one: dict[str, np.ndarray], at: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """(row, told): the values (int32, any number to a suffix) of each row, packed."""
    a, b = one["row_a"][at], one["row_b"][at]
    order = np.lexsort((b, a))
    a, b, values = a[order], b[order], values[order]
    begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    names = np.zeros(len(begin), [("a", "<u8"), ("b", "<u4")])
    names["a"], names["b"] = a[begin], b[begin]
    wide = values.reshape(len(values), -1).astype("<i4")
    ends = np.append(begin, len(a)).astype(np.int32) * (wide.shape[1] * 4 if len(wide) else 4)
    told = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(wide.tobytes())])
    rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(12), len(begin), [None, pa.py_buffer(names.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([rows, told], ["row", "told"])


def _values(one: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    return np.stack([one["place"][at], one["kind"][at] & 3], 1)


def _compare(batches, values):
    """What repeats of the suffixes of a task's buckets: (row, told).

    Suffixes of kind ``_WHOLE`` repeat when another has the same name. Of halves those
    matter whose name stands before different slices, one for each slice; others are dropped.
    """

    def compared(one: dict[str, np.ndarray], ends: bool):
        kind = one["kind"] & 3
        order, shared = multikey_order([one["key"], one["low"], one["second"]])
        same, equal = shared >= 2, shared == 3
        whole = kind[order] == _WHOLE
        twice = one["kind"][order] & _TWICE > 0
        several = same.copy()
        several[:-1] |= same[1:]
        told = whole & (several | twice) & (one["kind"][order] & _TOLD == 0)
        lead = ~equal  # one suffix of each name and slice goes on
        if ends:
            begin = np.flatnonzero(~same)
            other = same & ~equal
            differs = np.add.reduceat(other.astype(np.int64), begin) > 0 if len(begin) else np.zeros(0, bool)
            half = (kind[order] == _RIGHT) | (kind[order] == _LEFT)
            told |= half & lead & np.repeat(differs, np.diff(np.append(begin, len(order))))
            left = None
        else:
            group = np.cumsum(~same) - 1
            any_told = np.zeros(group[-1] + 1 if len(group) else 0, bool)
            any_told[group[told]] = True
            kept = order[lead]
            left = {k: v[kept] for k, v in one.items()}
            again = (whole & any_told[group])[lead]
            left["kind"] = np.where(again, left["kind"] | _TWICE | _TOLD, left["kind"]).astype(np.uint8)
        at = order[told]
        return (_by_row(one, at, values(one, at)) if len(at) else None), left

    held: list[dict[str, np.ndarray]] = []
    size, most = 0, CHUNK
    for batch in batches:
        one = _unpack(batch.column("packed").to_pylist())
        sure = np.flatnonzero(one["kind"] & 3 == _SURE)
        if len(sure):
            yield _by_row(one, sure, values(one, sure))
            one = {k: v[one["kind"] & 3 != _SURE] for k, v in one.items()}
        held.append(one)
        size += len(one["key"])
        if size > most:
            found, left = compared(_joined(held), False)
            if found is not None:
                yield found
            held, size = [left], len(left["key"])
            most = max(CHUNK, 2 * size)  # what is held is sorted again only when it has doubled
    if held:
        found, _ = compared(_joined(held), True)
        if found is not None:
            yield found


_TOLD_ROWS = "row binary, told binary"


def _repeated(packed: DataFrame, values) -> DataFrame:
    """(row, told): what repeats, once the packed suffixes came to the buckets of their parts."""
    n = common.shuffle_partitions(packed.sparkSession)
    moved = packed.repartitionById(n, F.col("part"))
    found = moved.mapInArrow(lambda it: _compare(it, values), _TOLD_ROWS)
    return found.groupBy("row").agg(F.collect_list("told").alias("told"))


def row_name(doc_id: Column, text: Column) -> Column:
    """12 bytes that name a row: its id and its text."""
    whole = F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("-")), F.lit("\0"), F.coalesce(text, F.lit("")))
    return F.substring(F.unhex(F.md5(whole.cast("binary"))), 1, 12)


def _rows(column: pa.Array, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the rows ``doc``, as two numbers each."""
    raw, _ = common.text_bytes(column)
    names = raw.view(np.dtype([("a", "<u8"), ("b", "<u4")])) if len(raw) else np.zeros(0, [("a", "<u8"), ("b", "<u4")])
    return names["a"][doc], names["b"][doc]


def _run_suffixes(batch: pa.RecordBatch, out: _Outbox) -> None:
    """The suffixes of all anchors."""
    flat, starts = common.text_bytes(batch.column("text"))
    if len(flat) < LENGTH:
        return
    slices = Slices(flat)
    doc, anchor, first, last = anchors(flat, starts, slices)
    if not len(doc):
        return
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    key, low = slices.names(first, last + LENGTH)
    with np.errstate(over="ignore"):  # the place of the anchor in the slice belongs to its name
        key = common.mix64(key + (anchor - first).astype(np.uint64) * _ODD)
        second = common.mix64(key) + low.astype(np.uint64) * _ODD
    row_a, row_b = _rows(batch.column("row"), doc)

    def add(kind: int, who: np.ndarray, key, low) -> None:
        out.add(key, low, second[who] if kind != _WHOLE else None, (row_a[who], row_b[who]), number[who], np.full(len(who), kind, np.uint8))

    add(_WHOLE, np.arange(len(doc)), key, low)
    right = np.flatnonzero(anchor + HALF <= starts[1:][doc])
    add(_RIGHT, right, *slices.names(anchor[right], anchor[right] + HALF))
    left = np.flatnonzero(anchor - HALF >= starts[:-1][doc])
    key, low = slices.names(anchor[left] - HALF, anchor[left])
    add(_LEFT, left, common.mix64(key ^ _ODD), low)


def _told_flags(batch: pa.RecordBatch, base: np.ndarray, runs: int) -> np.ndarray:
    """[kind, run]: what was told of the runs of a batch."""
    told = np.zeros((3, runs), bool)
    lists = batch.column("told")
    parts = lists.flatten()
    raw, ends = common.text_bytes(parts)
    pairs = raw.view("<i4").reshape(-1, 2)
    count = np.diff(ends) // 8  # pairs of each part
    own = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0), np.int64))
    told[pairs[:, 1], base[np.repeat(own, count)] + pairs[:, 0]] = True
    return told


def _open_starts(batch: pa.RecordBatch, out: _Outbox) -> None:
    """Starts that runs leave open, as suffixes; and starts that runs decide, as ``_SURE``
    from place to place + low."""
    flat, starts = common.text_bytes(batch.column("text"))
    if len(flat) < LENGTH:
        return
    slices = Slices(flat)
    doc, anchor, first, last = anchors(flat, starts, slices)
    if not len(doc):
        return
    told = _told_flags(batch, np.searchsorted(doc, np.arange(batch.num_rows)), len(doc))
    row_a, row_b = _rows(batch.column("row"), np.arange(batch.num_rows))
    # Starts at most HALF before the anchor need the right half, others the left.
    turn = np.clip(anchor - HALF, first, last + 1)
    right, left = told[_RIGHT], told[_LEFT]
    begin, end, who = (np.concatenate(x) for x in ((turn[right], first[left]), (last[right] + 1, turn[left]), (doc[right], doc[left])))
    size = np.maximum(end - begin, 0)
    at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    who = np.repeat(who, size)
    for k in range(0, len(at), CHUNK):
        a, w = at[k : k + CHUNK], who[k : k + CHUNK]
        out.add(*slices.names(a, a + LENGTH), None, (row_a[w], row_b[w]), a - starts[w], np.full(len(a), _WHOLE, np.uint8))
    known = np.flatnonzero(told[_WHOLE])
    own = doc[known]
    place = (first[known] - starts[own]).astype(np.uint64)
    out.add(common.mix64(row_a[own] + place), (last[known] - first[known]).astype(np.uint32), place, (row_a[own], row_b[own]), place, np.full(len(known), _SURE, np.uint8))


def _span_values(one: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """First and last of neighbouring starts."""
    place = one["place"][at].astype(np.int64)
    return np.stack([place, place + np.where(one["kind"][at] & 3 == _SURE, one["low"][at].astype(np.int64), 0)], 1)


def _packed(df: DataFrame, give, splitters: np.ndarray) -> DataFrame:
    """The suffixes that ``give`` finds in the texts of ``df``, packed by bucket."""

    def run(batches):
        out = _Outbox(splitters)
        for whole in batches:
            for batch in common.pieces(whole, "text", PIECE):
                give(batch, out)
                yield from out.flush(CHUNK)
        yield from out.flush()

    return df.mapInArrow(run, _PACKED)


def _sampled_splitters(texts: DataFrame, n: int) -> np.ndarray:
    """n - 1 splitters from the leading tokens of a sample of about ``SAMPLED`` * n rows.

    Which rows depends on their names alone. At most 64 distinct tokens a bucket come to
    the driver.
    """
    share = min(1.0, SAMPLED * n / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(max(1, int(share * (1 << 20)))))

    def run(batches):
        out = _Outbox(np.zeros(0, np.uint64))
        for whole in batches:
            for batch in common.pieces(whole, "text", PIECE):
                _run_suffixes(batch, out)
        if out.held:
            keys = np.unique(np.concatenate([h["key"] for h in out.held]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    keys = some.mapInArrow(run, "key long").distinct().orderBy(F.xxhash64("key")).limit(64 * n)
    found = np.sort(np.asarray(keys.toArrow().column("key"), np.int64).view(np.uint64))
    return found[np.arange(1, n) * len(found) // n] if len(found) else found


def spans_of(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Starts from begin to end, both repeated, as maximal spans of bytes that go."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order] + LENGTH)
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1])) if len(begin) else np.zeros(0, np.int64)
    return list(zip(begin[new].tolist(), end[np.append(new[1:], len(begin))[: len(new)] - 1].tolist()))


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, has_repeats boolean"


def repeated_spans(df: DataFrame) -> DataFrame:
    """(row, told): for each row's name, its runs of starts that repeat, as packed pairs of
    int32, first and last."""
    spark = df.sparkSession
    texts = df.select(row_name(F.col("doc_id"), F.col("text")).alias("row"), "text")
    splitters = _sampled_splitters(texts, common.shuffle_partitions(spark))
    flags = common.written(_repeated(_packed(texts, _run_suffixes, splitters), _values), "suffix-flags")
    common.release(spark)  # the plan of what was written is free only now
    spans = common.written(_repeated(_packed(texts.join(flags, "row"), _open_starts, splitters), _span_values), "suffix-spans")
    common.forget(flags)
    common.release(spark)
    return spans


def remove_repeats(df: DataFrame) -> DataFrame:
    """doc_id, kept (binary: the bytes that stay), n_bytes, n_removed, n_spans for each row."""
    return _removed(df, "kept binary, n_bytes long, n_removed long, n_spans long", bytes)


def _removed(df: DataFrame, more: str, digest) -> DataFrame:
    schema = T.StructType([df.schema["doc_id"], *T._parse_datatype_string(more).fields])
    arrow = common.arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "text", PIECE):
                flat, starts = common.text_bytes(batch.column("text"))
                data = memoryview(np.ascontiguousarray(flat))
                sizes = np.diff(starts)
                kept, gone, spans = [], [], []
                for k, told in enumerate(batch.column("told").to_pylist()):
                    a, b = int(starts[k]), int(starts[k + 1])
                    if told:
                        pairs = np.frombuffer(b"".join(told), "<i4").reshape(-1, 2).astype(np.int64)
                        cut = spans_of(pairs[:, 0], pairs[:, 1])
                        inner = [0, *(x for c in cut for x in c), b - a]
                        text = b"".join(data[a + x : a + y] for x, y in zip(inner[::2], inner[1::2]))
                    else:
                        cut, text = [], data[a:b]
                    kept.append(digest(text))
                    gone.append(sum(y - x for x, y in cut))
                    spans.append(len(cut))
                columns = {"doc_id": batch.column("doc_id"), "kept": kept, "kept_sha256": kept, "n_bytes": sizes, "n_removed": gone, "n_spans": spans, "n_kept": sizes - np.array(gone, np.int64), "has_repeats": [n > 0 for n in spans]}
                yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    spans = repeated_spans(df)
    rows = df.select("doc_id", "text", row_name(F.col("doc_id"), F.col("text")).alias("row"))
    return rows.join(spans, "row", "left").select("doc_id", "text", "told").mapInArrow(run, schema)


def query(spark, sf_dir):
    return _removed(common.documents(spark, sf_dir), RESULT, lambda kept: hashlib.sha256(kept).hexdigest())
