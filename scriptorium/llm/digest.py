"""Document fingerprints: digests of statistically improbable byte windows.

Every window of ``WINDOW`` bytes has an entropy; entropies far from those of ordinary text
are rare, and a fixed table ranks them by rarity. In each run of ``WINDOW`` windows the
rarest wins (the leftmost of equals), and a window that wins often enough is a feature. A
feature's hash sets ``HASHES`` bits of a Bloom filter of ``BITS`` bits; after ``FULL``
distinct features a further filter is chained. Two filters are compared by the bits they
share beyond those expected by chance, as a part of the most they could share; two digests
by the mean, over the filters of the shorter chain, of the best match in the other.

The sequence of documents by descending id is needed once, to edit each text with the next
one's beginning. Ids alone give splitters; each document goes to the block between two
splitters, and the document at a splitter goes to the neighbouring block as well, where it
is the last one's next. So the texts move once and no task holds more than a stream.

Defined cases: null text is empty; an empty digest is like an empty one (1) and unlike any
other (0); a text shorter than a window is itself its only feature; a null doc_id comes
after all others; rows with equal ids follow one another by text; a single document is its
own next; an empty table gives an empty result; other columns are ignored by
``edit_fingerprints`` and carried by ``fingerprints``, except the result's.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 64
#: Times that a window must win to be a feature.
WINS = 16
BITS = 2048
HASHES = 5
FULL = 128
#: Entropy of ordinary prose in such windows, in bits; rarity grows with the distance.
TYPICAL = 4.0
PIECE = 2 << 20
#: Documents between splitters, about, and most splitters.
BLOCK_ROWS = 2000
MOST_SPLITTERS = 8192

_SCALE = 1 << 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(WINDOW + 2, dtype=np.float64)
    nlogn = np.round(n * np.log2(np.maximum(n, 1)) * _SCALE).astype(np.int64)
    gain = np.diff(nlogn)  # what one more occurrence adds to the sum of n log n
    cells = np.arange(1025)
    entropy = 6.0 * cells / 1024
    rare = np.round(np.abs(entropy - TYPICAL) * 1000).astype(np.int64)
    rank = rare.max() - rare + 1  # the rarest first
    return gain, rank


_GAIN, _RANK = _tables()
_HASH = common.mix64(np.arange(1, WINDOW + 1).astype(np.uint64)) | np.uint64(1)


def _entropy_cells(flat: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Quantised entropy of the window that begins at each place of ``flat``.

    ``position`` spreads documents so far apart that no window has bytes of two. Windows
    that run over a document's end are not meant to be read.
    """
    n = len(flat)
    order = np.argsort(flat, kind="stable")
    apart = int(position[-1]) + 4 * WINDOW
    kind = np.int32 if 256 * apart < 1 << 31 else np.int64
    key = flat[order].astype(kind) * kind(apart) + position[order].astype(kind)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    lag, active = 1, np.arange(1, n)
    while len(active):  # pairs of equal bytes, by how many equal ones are between them
        active = active[key[active] - key[active - lag] < WINDOW]
        before[active] = lag
        after[active - lag] = lag
        lag += 1
        active = active[active >= lag]
    added, removed = np.empty(n, np.int64), np.empty(n, np.int64)
    added[order] = _GAIN[before]
    removed[order] = _GAIN[after]
    total = np.cumsum(added)
    gone = np.cumsum(removed) - removed
    last = np.minimum(np.arange(n) + WINDOW - 1, n - 1)
    sums = total[last] - gone  # of n log n, but for what earlier documents left: nothing
    bits = 6 * WINDOW * _SCALE - sums
    return np.clip(bits * 1024 // (6 * WINDOW * _SCALE), 0, 1024)


def features(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of documents laid end to end, in order, and their owners."""
    sizes = np.diff(starts)
    owner_of_short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    hashes, owners = [], []
    if len(owner_of_short):
        short = [int.from_bytes(hashlib.blake2b(flat[starts[d] : starts[d + 1]].tobytes(), digest_size=8).digest(), "little") for d in owner_of_short.tolist()]
        hashes.append(np.array(short, np.uint64))
        owners.append(owner_of_short)
    long = np.flatnonzero(sizes >= WINDOW)
    if len(long):
        n = len(flat)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        position = np.arange(n) + doc * (2 * WINDOW)
        rank = _RANK[_entropy_cells(flat, position)]
        windowless = np.arange(n) > np.repeat(starts[1:], sizes) - WINDOW
        key = np.where(windowless, np.int64(1) << 60, rank << 40 | np.arange(n))
        # The first windows of the next document must not win in this one.
        least, width = key.copy(), 1
        edge = np.repeat(starts[1:], sizes)
        place = np.arange(n)
        while width < WINDOW:
            other = np.full(n, np.int64(1) << 60)
            other[: n - width] = np.where(place[: n - width] + width < edge[: n - width], least[width:], np.int64(1) << 60)
            np.minimum(least, other, out=least)
            width *= 2
        winner = least[~windowless] & ((np.int64(1) << 40) - 1)
        at = np.flatnonzero(np.bincount(winner, minlength=n) >= WINS)
        few = np.setdiff1d(long, doc[at])  # texts too short for any window to win that often
        if len(few):
            at = np.union1d(at, least[starts[few]] & ((np.int64(1) << 40) - 1))
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            with np.errstate(over="ignore"):
                value = np.zeros(len(part), np.uint64)
                for j in range(WINDOW):
                    value += flat[part + j].astype(np.uint64) * _HASH[j]
                    value ^= value << np.uint64(7)
            hashes.append(common.mix64(value))
            owners.append(doc[part])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return value[order], owner[order]


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """A [filters, BITS / 8] array for each text; no filter for an empty one."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    value, owner = features(np.frombuffer(b"".join(texts), np.uint8), starts)
    if len(value):  # a feature counts once in a document, where it is first
        order = np.lexsort((np.arange(len(value)), value, owner))
        first = np.ones(len(value), bool)
        first[1:] = (value[order][1:] != value[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        keep = np.sort(order[first])
        value, owner = value[keep], owner[keep]
    begins = np.searchsorted(owner, np.arange(len(texts) + 1))
    inside = np.arange(len(value)) - begins[owner]
    counts = np.diff(begins)
    filters = -(-counts // FULL)
    base = np.cumsum(filters) - filters
    row = base[owner] + inside // FULL
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for k in range(HASHES):
        bits[row, ((value >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return np.split(packed, base[1:]) if len(texts) else []


def spell(digest: np.ndarray) -> str:
    """A digest as text: number of filters, then the filters in base 64."""
    return f"{len(digest)}:{base64.b64encode(digest.tobytes()).decode()}"


def unspell(text: str) -> np.ndarray:
    count, data = text.split(":")
    return np.frombuffer(base64.b64decode(data), np.uint8).reshape(int(count), BITS // 8)


def _overlap(shared, ones_a, ones_b):
    chance = ones_a * ones_b / BITS
    most = np.minimum(ones_a, ones_b)
    return np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0.0, 1.0)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two digests, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    ones_b = np.bitwise_count(b).sum(1, dtype=np.float64)
    wide_b = np.unpackbits(b, axis=1).astype(np.float32) if len(b) > 1 else None
    best = np.zeros(len(a))
    for k in range(0, len(a), 256):
        part = a[k : k + 256]
        ones_a = np.bitwise_count(part).sum(1, dtype=np.float64)
        if wide_b is None:
            shared = np.bitwise_count(part & b).sum(1, dtype=np.float64)[:, None]
        else:
            shared = np.unpackbits(part, axis=1).astype(np.float32) @ wide_b.T
        best[k : k + 256] = _overlap(shared.astype(np.float64), ones_a[:, None], ones_b[None]).max(1)
    return float(best.mean())


def fingerprints(df: DataFrame) -> DataFrame:
    """All columns of ``df`` with fingerprint."""
    base = df.drop("fingerprint")
    schema = common.schema_of(base, "fingerprint string")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "text", PIECE):
                found = digests([(t or "").encode() for t in batch.column("text").to_pylist()])
                yield common.carried(batch, arrow, {"fingerprint": pa.array(list(map(spell, found)), pa.string())})

    return base.mapInArrow(run, schema)


def _in_order(df: DataFrame) -> DataFrame:
    """Rows of (block, doc_id, text, helper): blocks in order, the next block's first as helper."""
    spark = df.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("_sc_key"))
    summary = rows.agg(F.count("*").alias("n"), F.max("_sc_key").alias("last")).first()
    many = min(MOST_SPLITTERS, summary["n"] // BLOCK_ROWS)
    cuts = []
    if many:
        quantiles = rows.agg(F.percentile_approx("_sc_key", F.array(*[F.lit((k + 1) / (many + 1)) for k in range(many)]), 4 * many).alias("q")).first()["q"]
        cuts = sorted(set(quantiles))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    block = F.coalesce(F.array_size(F.filter(bounds, lambda c: c < F.col("_sc_key"))), F.lit(0)) if len(cuts) < 64 else _searched(cuts)
    own = F.struct(block.alias("block"), F.lit(False).alias("helper"))
    places = [own]
    if cuts:
        places.append(F.when(F.array_contains(bounds, F.col("_sc_key")), F.struct((block + 1).alias("block"), F.lit(True).alias("helper"))))
    places.append(F.when(F.col("_sc_key") == F.lit(summary["last"]), F.struct(F.lit(0).alias("block"), F.lit(True).alias("helper"))))
    spread = rows.withColumn("_sc_at", F.explode(F.array_compact(F.array(*places)))).select("_sc_at.block", "_sc_at.helper", "doc_id", "_sc_key", "text")
    n = common.shuffle_partitions(spark)
    return spread.repartition(n, "block").sortWithinPartitions("block", "helper", F.desc("_sc_key"), "text").drop("_sc_key")


def _searched(cuts: list[int]):
    """Number of cuts below the key, by bisection in nested choices."""

    def choose(a: int, b: int):
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(F.col("_sc_key") > F.lit(cuts[m]), choose(m + 1, b)).otherwise(choose(a, m))

    return choose(0, len(cuts))


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_fingerprints(df: DataFrame) -> DataFrame:
    """doc_id with the fingerprints of each text and of its edited text, and their likeness."""
    schema = T.StructType([df.schema["doc_id"], *T._parse_datatype_string(RESULT).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        held = None  # the last row so far: block, helper, doc_id, text, digest
        for whole in batches:
            for batch in common.pieces(whole, "text", PIECE):
                rows = list(zip(*(batch.column(k).to_pylist() for k in ("block", "helper", "doc_id", "text"))))
                found = digests([r[3].encode() for r in rows])
                line = ([held] if held else []) + [(*r, d) for r, d in zip(rows, found)]
                pairs = [(a, b) for a, b in zip(line, line[1:]) if not a[1] and a[0] == b[0]]
                held = line[-1]
                edited = []
                for a, b in pairs:
                    half = len(a[3]) // 2
                    edited.append((a[3][: len(a[3]) - half] + b[3][:half]).encode())
                made = digests(edited)
                columns = [
                    [a[2] for a, _ in pairs],
                    [len(a[3]) for a, _ in pairs],
                    [hashlib.sha256(e).hexdigest() for e in edited],
                    [spell(a[4]) for a, _ in pairs],
                    list(map(spell, made)),
                    [likeness(a[4], d) for (a, _), d in zip(pairs, made)],
                    [likeness(a[4], b[4]) for a, b in pairs],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return _in_order(df).mapInArrow(run, schema)


def query(spark, sf_dir):
    return edit_fingerprints(common.documents(spark, sf_dir))
