"""Language identification as inference of a multilingual mixture.

A document's words come from a few languages in unknown proportions. Each language has a
model of byte n-grams, smoothed; a word's likelihood under a language is that of its
n-grams. Expectation-maximisation estimates the proportions of a document, for nested
sets of languages (the likeliest one, two, ...); the set is chosen by likelihood with a
penalty per language (half the logarithm of the number of words, times ``PENALTY``). The
answer is the largest language of the set, the score its proportion.

Sets grow as long as a document's penalised likelihood does, up to all languages.

Models are fitted on a bounded sample of labelled rows, the ``SAMPLE`` different texts of
each language that a hash puts first, whole texts, however often they are repeated;
prediction covers every row and looks at text only. The models are one table of languages
by n-gram cells that travels with the closure. It holds ``TABLE`` numbers at most: with
very many languages each gets fewer cells, and none is left out.

Defined cases: null text, or one without any letter, is ``und`` with score 0; rows with
null lang, null text or a held-out id teach nothing; a language whose texts have no letters
is not learned; with no labelled rows everything is ``und``; ties go to the language first
in code point order; repeated rows are predicted alike, and teach once; an empty table
gives an empty result; other columns are carried by ``identify`` except those named like
its results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Most labelled rows of each language that teach.
SAMPLE = 2000
#: Cells that n-grams of each order are hashed into, and numbers in the table of models.
CELLS = 1 << 16
TABLE = 48 << 20
ORDERS = (2, 3, 4)
#: Steps of expectation-maximisation, and the factor on the penalty.
STEPS = 12
PENALTY = 4.0
PIECE = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = _lower_table()
_SPLIT = np.zeros(256, bool)
_SPLIT[:65] = _SPLIT[91:97] = _SPLIT[123:128] = True  # all of ASCII but its letters


def _grams(flat: np.ndarray, order: int, cells: int) -> np.ndarray:
    """Hashed cell of the n-gram that ends at each byte."""
    cell = flat.astype(np.uint32)
    for k in range(1, order):
        part = np.zeros(len(flat), np.uint32)
        part[k:] = flat[:-k]
        cell = cell + part * np.uint32(pow(0x9E3779B1, k, 1 << 32))
    cell *= np.uint32(0x85EBCA6B)
    cell ^= cell >> np.uint32(15)
    return cell & np.uint32(cells - 1)


def words_of(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with all but letters as spaces, word starts and ends, word owner."""
    text = _LOWER[flat]
    blank = _SPLIT[flat]
    text = np.where(blank, np.uint8(32), text)
    edge = np.zeros(len(flat), bool)
    inner = starts[1:-1]
    edge[inner[inner < len(flat)]] = True
    letter = ~blank
    begin = letter.copy()
    begin[1:] &= blank[:-1] | edge[1:]
    stop = letter.copy()
    stop[:-1] &= blank[1:] | edge[1:]
    first, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    owner = np.searchsorted(starts, first, "right") - 1
    return text, first, last, owner


def cells_of(languages: int) -> int:
    """Cells of each order, a power of two, so that the table stays within ``TABLE``."""
    room = max(256, TABLE // (len(ORDERS) * max(1, languages)))
    return min(CELLS, 1 << (room.bit_length() - 1))


def fit(df: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities, [orders * cells, languages], from labelled rows."""
    teach = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("text").alias("_sc_h"))
    share = {r["lang"]: r["n"] for r in teach.groupBy("lang").agg(F.approx_count_distinct("_sc_h", 0.02).alias("n")).collect()}
    if not share:
        return [], np.zeros((0, 0), np.float32)
    langs, cells = sorted(share), cells_of(len(share))
    # The hash bound keeps about twice the sample of different texts before any is ranked.
    bound = F.create_map(*[x for k, n in share.items() for x in (F.lit(k), F.lit(min(1.0, (2.0 * sample + 50) / max(1, n))))])
    near = teach.where(F.pmod("_sc_h", F.lit(1 << 30)) <= F.try_element_at(bound, F.col("lang")) * float(1 << 30))
    once = near.groupBy("lang", "_sc_h").agg(F.min("text").alias("text"))
    ranked = once.withColumn("_sc_r", F.row_number().over(W.partitionBy("lang").orderBy("_sc_h"))).where(F.col("_sc_r") <= sample)
    place = {lang: i for i, lang in enumerate(langs)}
    schema = pa.schema([("lang", pa.int32()), ("cell", pa.int32()), ("n", pa.int64())])

    def count(batches):
        counts: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in common.pieces(whole, "text", PIECE):
                names = batch.column("lang").to_pylist()
                flat, starts = common.text_bytes(batch.column("text"))
                text, first, last, owner = words_of(flat, starts)
                if not len(first):
                    continue
                own = np.repeat(np.array([place[n] for n in names], np.int64), np.diff(starts))
                spell, at = _spelled(text, first, last)
                for k, order in enumerate(ORDERS):
                    found = _grams(spell, order, cells)[at]
                    for i in set(names):
                        held = counts.setdefault(place[i], np.zeros(len(ORDERS) * cells, np.int64))
                        chosen = own[_source(first, last)] == place[i]
                        held[k * cells : (k + 1) * cells] += np.bincount(found[chosen], minlength=cells)
        for i, held in counts.items():
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), pa.array(held[some])], schema=schema)

    rows = ranked.select("lang", "text").mapInArrow(count, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = rows.toArrow()
    counts = np.zeros((len(langs), len(ORDERS) * cells), np.float32)
    counts[table.column("lang").to_numpy(), table.column("cell").to_numpy()] = table.column("n").to_numpy()
    taught = np.flatnonzero(counts.any(1))  # one without a letter to its name would fit gibberish best
    counts, langs = counts[taught], [langs[i] for i in taught]
    logs = np.zeros((len(ORDERS) * cells, len(langs)), np.float32)
    for k in range(len(ORDERS)):
        block = counts[:, k * cells : (k + 1) * cells]
        logs[k * cells : (k + 1) * cells] = np.log((block + 0.1) / (block.sum(1, keepdims=True) + 0.1 * cells)).T
    return langs, logs


def _spelled(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with a space before each, and the places of their letters in that array."""
    size = last - first
    ends = np.cumsum(size + 1)
    spell = np.full(int(ends[-1]) + 1, 32, np.uint8)
    at = np.arange(int(size.sum())) + np.repeat(np.arange(1, len(size) + 1), size)
    spell[at] = text[_source(first, last)]
    return spell, at


def _source(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    size = last - first
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def word_scores(flat: np.ndarray, starts: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word under each language, and the document of each word."""
    text, first, last, owner = words_of(flat, starts)
    n = logs.shape[1]
    if not len(first):
        return np.zeros((0, n)), owner
    spell, at = _spelled(text, first, last)
    size = last - first
    word_starts = np.cumsum(size) - size
    scores = np.zeros((len(first), n))
    size_of = len(logs) // len(ORDERS)
    cells = [_grams(spell, order, size_of)[at] + np.uint32(k * size_of) for k, order in enumerate(ORDERS)]
    for j in range(n):
        column = np.ascontiguousarray(logs[:, j])
        total = column[cells[0]]
        for c in cells[1:]:
            total += column[c]
        scores[:, j] = np.add.reduceat(total, word_starts) / len(ORDERS)
    return scores, owner


def mixtures(scores: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """[documents, languages]: the proportions of the chosen set (0 outside it, and all 0 for
    a document without words)."""
    n = scores.shape[1]
    result = np.zeros((n_docs, n))
    if not len(scores):
        return result
    docs, begins, counts = np.unique(owner, return_index=True, return_counts=True)
    top = scores.max(1, keepdims=True)
    like = np.exp(np.maximum(scores - top, -60.0))
    single = np.add.reduceat(scores, begins, axis=0)
    base = np.add.reduceat(top[:, 0], begins)

    def em(weights: np.ndarray, like: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(counts)), counts)
        for _ in range(STEPS):
            part = like * weights[row]
            part /= part.sum(1, keepdims=True)
            weights = np.add.reduceat(part, begins, axis=0) / counts[:, None]
            weights = np.where(weights < 1e-12, 0.0, weights)
        return weights, np.add.reduceat(np.log(np.maximum((like * weights[row]).sum(1), 1e-300)), begins)

    everything, _ = em(np.full((len(docs), n), 1.0 / n), like, counts)
    penalty = PENALTY * 0.5 * np.log(np.maximum(counts, 2))
    value = single.max(1)
    chosen = np.zeros((len(docs), n))
    chosen[np.arange(len(docs)), single.argmax(1)] = 1.0
    order = np.argsort(-everything, axis=1, kind="stable")
    active = np.arange(len(docs))  # documents whose set may still grow
    for size in range(2, n + 1):
        rows = slice(None) if len(active) == len(docs) else np.isin(np.repeat(np.arange(len(docs)), counts), active)
        allowed = np.zeros((len(active), n))
        np.put_along_axis(allowed, order[active, :size], 1.0 / size, axis=1)
        weights, found = em(allowed, like[rows], counts[active])
        found = base[active] + found - penalty[active] * (size - 1)
        better = found > value[active]
        value[active[better]] = found[better]
        chosen[active[better]] = weights[better]
        if size > 2:  # sets of two and of three are tried for all
            active = active[better]
        if not len(active):
            break
    result[docs] = chosen
    return result


def has_letters(texts: list) -> np.ndarray:
    return np.array([any(map(str.isalpha, t or "")) for t in texts], bool)


def identify(df: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """All columns of ``df`` with lang_pred, score and mixture: the languages of a document
    with their shares, the largest first."""
    langs, logs = model
    base = df.drop("lang_pred", "score", "mixture")
    schema = common.schema_of(base, "lang_pred string, score double, mixture array<struct<lang: string, share: double>>")
    arrow = common.arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for batch in common.pieces(whole, "text", PIECE):
                flat, starts = common.text_bytes(batch.column("text"))
                found = mixtures(*word_scores(flat, starts, logs), batch.num_rows) if langs else np.zeros((batch.num_rows, 0))
                found[~has_letters(batch.column("text").to_pylist())] = 0.0
                own, which = np.nonzero(found)
                by = np.lexsort((which, -found[own, which], own))
                own, which = own[by], which[by]
                ends = np.searchsorted(own, np.arange(batch.num_rows + 1))
                names = np.array([*langs, "und"], object)
                share = np.clip(found[own, which], 0.0, 1.0)
                some = np.diff(ends) > 0
                best, score = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
                best[some], score[some] = which[ends[:-1][some]], share[ends[:-1][some]]
                parts = pa.StructArray.from_arrays([pa.array(names[which].tolist(), pa.string()), pa.array(share)], fields=list(arrow.field("mixture").type.value_type))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), parts, type=arrow.field("mixture").type)
                yield common.carried(batch, arrow, {"lang_pred": pa.array(names[best].tolist(), pa.string()), "score": pa.array(score), "mixture": lists})
        common.relax()

    return base.mapInArrow(run, schema)


def query(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    model = fit(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
