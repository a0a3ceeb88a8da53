"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is a weighted set: its runs of five words (white space separates words; fewer
than five words are one run) weighted by how often they occur. Each shingle sends arrivals
of a Poisson process whose rate is its weight, each to a random register; a register
keeps the shingle that arrives first. Arrivals are generated in order of time, and a
shingle stops as soon as its next one comes after the last register of the document was
reached. Two documents agree in a register with their probability Jaccard similarity.
Weights grow with the logarithm of the count: without repeats this is the plain Jaccard
similarity of the sets, in which the threshold is stated and candidates are verified.
A text with repeats is sketched a second time with weight 1, into the same bands, so that
every pair at the threshold has the chance of the plain similarity to become a candidate.

Texts that are equal up to white space share words and so are one text here; only distinct
texts go further. ``BANDS`` bands of ``ROWS`` registers give buckets; in each bucket every
text is linked to the smallest one, the pairs are verified by the exact similarity of
their shingles, and components are formed. Texts of buckets that are still in different
components are then joined exactly by prefixes: each orders its shingles from the rarest
of these texts to the commonest, and two texts at the threshold share one of the first
fifth, at places that leave enough shingles after them. Texts that share a passage but not
enough of it differ in rare shingles, which come first, so they do not meet at all. Each
such shingle first links its texts to the one that holds it earliest; after components
are formed again, every pair of different components that its places allow is verified.
Before texts are compared, their first fifths are: up to where the shorter of these ends in
the order, what both texts hold is known, and only the rest can be in common beyond that.
So no pair of a bucket that could change a component is left out, while groups of copies,
and texts with a passage in common, cost about one pair per text.

Scale: texts are scanned once for signatures. Verification moves the texts that have a
candidate, once for each distinct candidate pair; the joins by prefix move hashes. Buckets,
links and shingles are aggregated with partial sums; keys that are hot are split by
adaptive skew joins.

Defined cases: texts without a word are one class; null text is empty; a null doc_id takes
part and orders last; rows that repeat an id or a text are in one class; ties go to the
smaller id; an empty table gives an empty result; other columns are ignored by ``classes``
and carried by ``dedup``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
REGISTERS = BANDS * ROWS
PIECE = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = common.mix64(np.arange(1, 257).astype(np.uint64))
#: Powers of an odd base and of its inverse, for hashes of slices by prefix sums.
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWER, _INVERSE
    if len(_POWER) < n:
        with np.errstate(over="ignore"):
            _POWER = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            _INVERSE = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, inverse, np.uint64))])
    return _POWER, _INVERSE


_POWER = _INVERSE = np.ones(0, np.uint64)


def word_hashes(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the document of each word."""
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = _BLANK[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[starts] = True
    begin, stop = ~blank, ~blank
    begin[1:] &= blank[:-1] | edge[1:-1]
    stop[:-1] &= blank[1:] | edge[1:-1]
    first, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    power, inverse = _powers(len(flat))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(_BYTE[flat] * power[: len(flat)], out=sums[1:])
        found = common.mix64((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    return found, np.searchsorted(starts, first, "right") - 1


def shingles(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of five words, and its document; with repeats."""
    word, owner = word_hashes(flat, starts)
    docs = len(starts) - 1
    counts = np.bincount(owner, minlength=docs)
    with np.errstate(over="ignore"):
        total = word.copy()
        for k in range(1, min(WORDS, len(word))):
            total[:-k] = common.mix64(total[:-k] + _ODD) + word[k:]
    ends = np.cumsum(counts)
    within = np.arange(len(word)) - np.repeat(ends - counts, counts)
    full = within + WORDS <= np.repeat(counts, counts)
    found, of = total[full], owner[full]
    few = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(few):
        short = []
        for d in few.tolist():
            part = word[ends[d] - counts[d] : ends[d]]
            short.append(int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8).digest(), "little"))
        found, of = np.concatenate([found, np.array(short, np.uint64)]), np.concatenate([of, few])
    return found, of


def weighted(found: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with their weights, sorted by document and shingle."""
    if not len(found):
        return found, of, np.zeros(0)
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return found[at], of[at], 1.0 + np.log2(np.diff(np.append(at, len(found))))


def signatures(found: np.ndarray, of: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """[docs, REGISTERS]: the shingle that arrives first at each register (0: none)."""
    signs = np.zeros((docs, REGISTERS), np.uint64)
    first = np.full((docs, REGISTERS), np.inf)
    alone = np.flatnonzero(np.bincount(of, minlength=docs)[of] == 1) if len(of) else np.zeros(0, np.int64)
    signs[of[alone]] = found[alone][:, None]  # a single shingle is first everywhere
    active = np.setdiff1d(np.arange(len(found)), alone, assume_unique=True)
    state, time = found[active], np.zeros(len(active))
    while len(active):
        with np.errstate(over="ignore"):
            draw = common.mix64(state + _ODD)
            state = draw + _ODD
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight[active]
        register = common.mix64(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(REGISTERS)
        cell = of[active] * REGISTERS + register.astype(np.int64)
        flat, kept = first.reshape(-1), signs.reshape(-1)
        better = np.flatnonzero(time < flat[cell])
        by = better[np.lexsort((time[better], cell[better]))]
        lead = np.ones(len(by), bool)
        lead[1:] = cell[by][1:] != cell[by][:-1]
        by = by[lead]
        flat[cell[by]], kept[cell[by]] = time[by], found[active[by]]
        own = of[active]
        new = np.append(True, own[1:] != own[:-1])
        last = first[own[new]].max(1)
        on = time < last[np.cumsum(new) - 1]  # early termination
        active, state, time = active[on], state[on], time[on]
    return signs


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles, sorted arrays."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def text_name(text: Column) -> Column:
    """16 bytes that name a text's sequence of words."""
    return F.unhex(F.md5(F.trim(common.normalised(text)).cast("binary")))


def _band_keys(signs: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signs), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = common.mix64(keys + signs[:, k::ROWS] + _ODD)
        return keys + np.arange(BANDS, dtype=np.uint64) * _ODD


def _bands(found: np.ndarray, of: np.ndarray, weight: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """[docs, 2 * BANDS]: the keys by weight and by weight 1, and which to keep (no key twice).

    Without repeats both are the same, so only texts with repeats are sketched again.
    """
    keys = np.tile(_band_keys(signatures(found, of, weight, docs)), 2)
    repeats = np.unique(of[weight > 1.0])
    if len(repeats):
        chosen = np.isin(of, repeats)
        place = np.searchsorted(repeats, of[chosen])
        keys[repeats, BANDS:] = _band_keys(signatures(found[chosen], place, np.ones(len(place)), len(repeats)))
    kept = np.ones(keys.shape, bool)
    kept[:, BANDS:] = keys[:, BANDS:] != keys[:, :BANDS]
    return keys, kept


def _sketch(df: DataFrame) -> DataFrame:
    """doc_id, id (the text's name) and band keys of every row."""
    rows = df.select("doc_id", text_name(F.col("text")).alias("id"), "text")
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("id binary, bands array<long>").fields])
    arrow = common.arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "text", PIECE):
                flat, starts = common.text_bytes(batch.column("text"))
                docs = batch.num_rows
                keys, kept = _bands(*weighted(*shingles(flat, starts)), docs)
                ends = np.append(0, np.cumsum(kept.sum(1))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[kept].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), bands], schema=arrow)
        common.relax()

    return rows.mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of text numbers whose texts are similar enough."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    schema = T._parse_datatype_string("a binary, b binary")
    arrow = common.arrow_schema(schema)

    def run(batches):
        held, held_shingles = None, None
        for whole in batches:
            for batch in common.pieces(whole, "text_a", PIECE):
                b = batch.column("b").to_pylist()
                flat, starts = common.text_bytes(batch.column("text_a"))
                found, of, _ = weighted(*shingles(flat, starts))
                cut = np.searchsorted(of, np.arange(batch.num_rows + 1))
                keep = []
                for k in range(batch.num_rows):
                    if b[k] != held:
                        one_flat, one_starts = common.text_bytes(batch.column("text_b").slice(k, 1))
                        held, held_shingles = b[k], weighted(*shingles(one_flat, one_starts))[0]
                    keep.append(similarity(found[cut[k] : cut[k + 1]], held_shingles) >= SIMILARITY)
                rows = batch.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], schema=arrow)
        common.relax()

    return both.mapInArrow(run, schema)


def _rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the root of each id's component, itself if it has no link."""
    return rows.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _postings(texts: DataFrame) -> DataFrame:
    """(shingle, id, size, at, n) of the shingles that a text shares with a similar one first.

    A text's ``size`` distinct shingles stand from the rarest of these texts to the commonest
    (``n`` texts hold it; ties by hash). Of two similar texts the first one in common comes so early in both that
    enough follow, within a fifth of them at the most. What only one text has is counted, but
    not given.
    """
    schema = T._parse_datatype_string("id binary, size long, shingle long")
    arrow = common.arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "text", PIECE):
                found, of, _ = weighted(*shingles(*common.text_bytes(batch.column("text"))))
                sizes = np.bincount(of, minlength=batch.num_rows)[of]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of)), pa.array(sizes), pa.array(found.view(np.int64))], schema=arrow)
        common.relax()

    rows = common.written(texts.select("id", "text").mapInArrow(run, schema), "neardup-shingles")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("id")
    shared = rows.join(counts, "shingle").withColumn("place", F.row_number().over(own.orderBy("n", "shingle")) - 1)
    shared = shared.withColumn("at", F.col("size") - F.count("*").over(own) + F.col("place"))
    return shared.where(_enough(F.col("size") - F.col("at"), F.col("size"))).select("shingle", "id", "size", "at", "n")


def _enough(both: Column, either: Column) -> Column:
    """Whether so many shingles in common, of so many in either, reach ``SIMILARITY``; as in ``similarity``."""
    return both / either >= SIMILARITY


def _possible() -> Column:
    """Whether places a.at and b.at of the first shingle in common leave enough after them."""
    both = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    return (F.col("a.root") != F.col("b.root")) & _enough(both, F.col("a.size") + F.col("b.size") - both)


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.where(_possible()).select(F.greatest("a.id", "b.id").alias("a"), F.least("a.id", "b.id").alias("b")).distinct()


def _first_fifths(postings: DataFrame) -> DataFrame:
    """(id, size, rare, end): each text's shingles of ``postings``, and the last of them in the order with its place."""
    end = F.max(F.struct("n", "shingle", "at")).alias("end")
    return postings.groupBy("id").agg(F.first("size").alias("size"), F.collect_list("shingle").alias("rare"), end)


def _promising(pairs: DataFrame, fifths: DataFrame) -> DataFrame:
    """The pairs (a, b) that can be similar by all of their first fifths.

    Of the text whose fifth ends first in the order, what stands up to there is in the other
    text only if it is in its fifth too; all that stands after may be.
    """
    sides = [fifths.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "rare", "end")]) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    after = F.when(F.col("end_a") < F.col("end_b"), F.col("size_a") - F.col("end_a.at")).otherwise(F.col("size_b") - F.col("end_b.at")) - 1
    most = F.least(F.size(F.array_intersect("rare_a", "rare_b")) + after, F.col("size_a"), F.col("size_b"))
    return both.where(_enough(most, F.col("size_a") + F.col("size_b") - most)).select("a", "b")


def _earliest(postings: DataFrame) -> DataFrame:
    """Pairs of each text and the one that has a shingle earliest, of another component."""
    least = postings.groupBy("shingle").agg(F.min(F.struct("at", "size", "id", "root")).alias("b")).select("shingle", "b.*")
    return _pairs(postings.alias("a").join(least.alias("b"), "shingle"))


def _allowed(postings: DataFrame) -> DataFrame:
    """All pairs of different components that can be similar by the places of a shingle."""
    sizes = postings.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    split = sizes.groupBy("shingle").agg(F.max(F.struct("n", F.col("root").alias("r")))["r"].alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    rows = common.written(postings.join(split, "shingle"), "neardup-split")
    return _pairs(rows.where("root <> largest").alias("a").join(rows.alias("b"), "shingle"))


def _text_classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, id) of every row, and (node, root): components of linked texts."""
    sketch = common.written(_sketch(df), "neardup-sketch")
    names = sketch.groupBy("id").agg(F.first("bands").alias("bands"))
    rows = common.written(names.select("id", F.explode("bands").alias("key")), "neardup-bands")
    full = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    members = common.written(rows.join(full, "key").select("key", "id", "least"), "neardup-buckets")
    common.forget(rows)
    pairs = members.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    inside = members.select("id").distinct()
    texts = df.select(text_name(F.col("text")).alias("id"), "text").join(inside, "id", "left_semi").dropDuplicates(["id"])
    texts = common.written(texts, "neardup-chosen")
    links = common.written(_verified(pairs, texts), "neardup-links")
    found = components(links)
    labelled = common.written(_rooted(members.select("key", "id"), found), "neardup-labels")
    split = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    unsettled = common.written(labelled.join(split, "key", "left_semi").select("id").distinct(), "neardup-open")
    postings = common.written(_postings(texts.join(unsettled, "id")), "neardup-postings")
    fifths = common.written(_first_fifths(postings), "neardup-fifths")
    first = _promising(_earliest(_rooted(postings, found)), fifths)
    links = links.union(common.written(_verified(first, texts), "neardup-links"))
    rest = _promising(_allowed(_rooted(postings, components(links))), fifths)
    more = common.written(_verified(rest, texts), "neardup-links")
    common.forget(texts, members, labelled, unsettled, postings, fifths)
    return sketch.select("doc_id", "id"), components(links.union(more))


def classes(df: DataFrame) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): doc_id and class_id, its class's smallest id."""
    return _classes(df).select("doc_id", "class_id")


def _classes(df: DataFrame) -> DataFrame:
    ids, found = _text_classes(df)
    rooted = ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("doc_id", "id", F.coalesce("root", "id").alias("root"))
    rooted = common.written(rooted, "neardup-classes")
    return rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root")


def dedup(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (all its columns) that stay: one document of each class."""
    stay = _classes(df).where("doc_id <=> class_id").groupBy("root").agg(F.min("id").alias("_sc_name"), F.first("doc_id").alias("_sc_id")).drop("root")
    inner = common.numbered(df, "doc_id", "text")
    named = inner.withColumn("_sc_name", text_name(F.col("text")))
    kept = named.join(stay, "_sc_name").where(F.col("doc_id").eqNullSafe(F.col("_sc_id"))).dropDuplicates(["_sc_name"])
    return kept.select(*inner.columns).toDF(*df.columns)


def query(spark, sf_dir):
    return classes(common.documents(spark, sf_dir))
