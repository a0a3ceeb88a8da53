"""The operators against brute force, libraries and planted cases on small tables."""

import collections
import hashlib
import html
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import common, counting, digest, exact, language, layouts, mincut, mixing, neardup, replay, suffix, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, `_sc` string"
rnd = random.Random(7)
WORDS = ["".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(300, 1)
SHARED = prose(90, 2)
TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    BASE,
    BASE.replace(" ", "\n", 3),
    BASE + " tail",
    prose(40, 3) + " " + SHARED + " " + prose(60, 4),
    prose(20, 5) + " " + SHARED + " " + prose(10, 6),
    prose(20, 5) + " " + SHARED + " " + prose(10, 6),
    "é日本" * 400 + prose(5, 8),
    "a" * 5000,
    prose(4000, 9),
    *[prose(200, k) for k in range(20, 40)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 11 else None if k == 22 else k, t, ["en", None, "fr"][k % 3], [None, "a", "b", "a"][k % 4], 0, "x", "y", "z") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[5], rows[7]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def removed(data: bytes, counts) -> tuple:
    kept, spans, at, upto = [], 0, 0, -1
    for i in range(len(data) - 399):
        if counts[data[i : i + 400]] > 1:
            if i > upto:
                kept.append(data[at:i])
                spans += 1
            upto = at = i + 400
    kept = b"".join([*kept, data[at:]])
    return len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def repeats(rows) -> list[tuple]:
    """Brute force: rows of (id, bytes)."""
    counts = {}
    for _, b in rows:
        for i in range(len(b) - 399):
            counts[b[i : i + 400]] = counts.get(b[i : i + 400], 0) + 1
    return sorted(((i, *removed(b, counts)) for i, b in rows), key=repr)


def suffix_rows(df) -> list[tuple]:
    found = suffix._removed(df, suffix.RESULT, lambda kept: hashlib.sha256(kept).hexdigest()).collect()
    assert all(r["n_kept"] == r["n_bytes"] - r["n_removed"] and r["has_repeats"] == (r["n_removed"] > 0) for r in found)
    return sorted((tuple(r)[:5] for r in found), key=repr)


def mosaics(seed) -> list[tuple]:
    r = random.Random(seed)
    parts = [bytes(r.choice(b"abcd ") for _ in range(r.choice([150, 260, 399, 400, 401, 700]))).decode() for _ in range(12)]
    return [(k, "".join(r.choice(parts) for _ in range(r.randint(1, 9)))) for k in range(40)]


def test_suffix_dedup_is_brute_force(docs, empty, spark):
    want = repeats([(i, t.encode()) for i, t in texts_of(docs)])
    assert suffix_rows(docs) == want
    assert any(w[2] > 0 and w[2] < w[1] for w in want)
    assert suffix_rows(empty) == []


@pytest.mark.parametrize("seed", range(2))
def test_suffix_dedup_of_mosaics(spark, seed):
    rows = mosaics(seed)
    assert suffix_rows(spark.createDataFrame(rows, "doc_id long, text string")) == repeats([(k, t.encode()) for k, t in rows])


def test_suffix_dedup_of_a_long_text(spark):
    part = prose(100_000, 50)
    rows = [(1, part + " " + prose(500_000, 51) + " " + part), (2, prose(50, 52)), (3, part[:3000])]
    assert len(rows[0][1]) > 2 * suffix.PIECE / 2 and suffix_rows(spark.createDataFrame(rows, "doc_id long, text string")) == repeats([(k, t.encode()) for k, t in rows])


def in_process(rows) -> list[tuple]:
    """The same steps without Spark, so that parts of the module can be replaced."""
    table = pa.table({"row": pa.array([hashlib.md5(str(k).encode()).digest()[:12] for k, _ in rows], pa.binary()), "text": [t for _, t in rows]})

    def step(table, give, values):
        parts = {}
        for batch in table.combine_chunks().to_batches(max_chunksize=3):
            out = suffix._Outbox(np.array([1 << 62, 1 << 63], np.uint64))
            give(batch, out)
            for packed in out.flush():
                for part, blob in zip(*(c.to_pylist() for c in packed.columns)):
                    parts.setdefault(part, []).append(pa.RecordBatch.from_pydict({"packed": pa.array([blob], pa.binary())}))
        told = {}
        for blobs in parts.values():
            for batch in suffix._compare(blobs, values):
                for row, x in zip(*(c.to_pylist() for c in batch.columns)):
                    told.setdefault(row, []).append(x)
        return told

    flags = step(table, suffix._run_suffixes, suffix._values)
    some = table.append_column("told", pa.array([flags.get(r) for r in table["row"].to_pylist()], pa.list_(pa.binary())))
    spans = step(some.filter(pa.compute.is_valid(some["told"])), suffix._open_starts, suffix._span_values)
    result = []
    for (k, text), row in zip(rows, table["row"].to_pylist()):
        pairs = np.frombuffer(b"".join(spans.get(row, [])), "<i4").reshape(-1, 2).astype(np.int64)
        data, cut = text.encode(), suffix.spans_of(pairs[:, 0], pairs[:, 1])
        kept = b"".join(data[a:b] for a, b in zip([0, *(y for _, y in cut)], [*(x for x, _ in cut), len(data)]))
        result.append((k, len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=repr)


@pytest.mark.parametrize("chunk", [1 << 20, 40])
@pytest.mark.parametrize("collide", [False, True])
def test_suffixes_in_parts_and_with_equal_names(monkeypatch, chunk, collide):
    """Buckets beyond a chunk; and 64-bit names of which every seven strings share one."""
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    names = suffix.Slices.names
    if collide:
        monkeypatch.setattr(suffix.Slices, "names", lambda self, a, b: (lambda key, low: (key % np.uint64(3), low))(*names(self, a, b)))
    for seed in range(4):
        rows = mosaics(seed)
        assert in_process(rows) == repeats([(k, t.encode()) for k, t in rows])


def test_multikey_quicksort():
    r = np.random.default_rng(1)
    for _ in range(20):
        tokens = [r.integers(0, 4, 300).astype(np.uint64) for _ in range(3)]
        order, shared = suffix.multikey_order(tokens)
        rows = list(zip(*(t[order].tolist() for t in tokens)))
        assert rows == sorted(zip(*(t.tolist() for t in tokens)))
        want = [0] + [next((k for k in range(3) if a[k] != b[k]), 3) for a, b in zip(rows, rows[1:])]
        assert shared.tolist() == want


def test_exact_dedup(docs, empty, monkeypatch):
    def check():
        groups = {}
        for i, t in texts_of(docs):
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
        found = exact.exact_classes(docs).collect()
        assert sum(r["kept"] for r in found) == len(groups)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
        for r in found:
            group = by_sha[r["text_sha256"]]
            assert r["group_size"] == len(group) and r["keep_id"] == min([g for g in group if g is not None], default=None)
        left = exact.exact_dedup(docs)
        assert left.columns == docs.columns and left.count() == len(groups)

    check()
    monkeypatch.setattr(exact, "HOT_LEAST", 1)  # now every text is hot and salted
    check()
    monkeypatch.setattr(exact, "_text_hash", lambda text: F.lit(5).cast("long"))  # naming alone tells texts apart
    check()
    monkeypatch.setattr(exact, "HOT_LEAST", 10**9)
    check()
    assert exact.exact_classes(empty).collect() == [] and exact.exact_dedup(empty).collect() == []


def test_exact_dedup_carries_any_column(spark):
    names = ["doc_id", "text", "norm", "bucket", "salt", "parts", "h", "local", "lead", "_sc_words", "c1"]
    rows = [(k, t, *range(9)) for k, t in [(3, "a b"), (1, "a  b"), (1, "a\tb"), (None, "a b"), (2, None), (None, "")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in names[2:]))
    assert mixing.mixed_rows(df.withColumn("source", F.lit("a"))).columns == [*names, "source"]
    near = neardup.dedup(df.withColumn("_sc_name", F.lit("x")))
    assert near.columns == [*names, "_sc_name"] and near.count() == 2
    left = exact.exact_dedup(df)
    assert left.columns == names and sorted(r["doc_id"] for r in left.collect()) == [1, 2]


def test_exact_dedup_of_very_long_texts(spark):
    long = prose(1_600_000, 60)
    assert len(long) > exact.PIECE
    rows = [(1, long), (2, long[:-1] + "!"), (3, long.replace(" ", "  ", 1)), (4, "x" + long)]
    found = exact.exact_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()) == [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 1, True)]


def test_block_names_are_collision_free():
    r = random.Random(3)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 60))) for _ in range(3000)] + [b"", b"\0", b"\0\0", bytes(8), bytes(9), b"ab" * 4000, b"ab" * 4000 + b"a"]
    names = exact.block_names(texts + texts[:50]).tolist()
    assert len(set(zip(names, texts + texts[:50]))) == len(set(names)) == len(set(texts))


def test_language_on_held_out_rows(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    found = language.identify(docs.withColumn("held", language.held_out(F.col("doc_id"))), model).where("held")
    assert found.where("lang = lang_pred").count() / found.count() > 0.97
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "12 !", 5), (4, "the and of", 5), (4, "the and of", 5)], "doc_id long, text string, score long")
    got = [tuple(r) for r in language.identify(odd, model).orderBy("doc_id").collect()]
    assert [g[2:] for g in got[:3]] == [("und", 0.0, [])] * 3 and got[3][2] != "und" and got[3] == got[4]
    assert language.identify(odd, language.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert language.identify(empty, model).collect() == []
    long = " ".join(r["text"] for r in docs.where("lang = 'fr'").limit(400).collect()) * 4
    assert len(long) > language.PIECE and language.identify(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first()["lang_pred"] == "fr"


def test_language_learns_from_repeated_texts(spark):
    """Copies share a hash: however many there are, their text teaches once, and always."""
    rows = [(k, "xaba yeti zoru wimo " * 5, "zz") for k in range(400)] + [(1000 + k, prose(30, k), "en") for k in range(400)] + [(2000, "...", "none")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=3)
    assert model[0] == ["en", "zz"]
    found = language.identify(spark.createDataFrame([(1, "wimo zoru"), (2, prose(40, 9000))], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in found] == ["zz", "en"]


def test_language_mixtures():
    """Four languages of one document come out with their shares; cells shrink with languages."""
    sure = np.log(np.full((100, 6), 0.001))
    for i, (a, b) in enumerate([(0, 45), (45, 65), (65, 85), (85, 100)]):
        sure[a:b, i] = 0.0
    found = language.mixtures(sure, np.repeat([1], 100), 3)
    assert np.abs(found[1] - [0.45, 0.2, 0.2, 0.15, 0, 0]).max() < 0.02 and not found[0].any() and not found[2].any()
    assert language.cells_of(4) == language.CELLS and language.cells_of(5000) * 5000 * 3 <= language.TABLE


PAGE = (
    '<body class="no-sidebar"><header><div>Site</div></header><div class="content has-sidebar"><h2>T &amp; U</h2><p>Hello <b>big</b> world.<p>Two&nbsp;three.</div>'
    '<div id="sidebar"><p>Some long sidebar text that goes on.</p></div><div id="comments"><div class="comment-body"><p>Great article, thanks for it.</p></div></div>'
    '<form><label>Name</label><input></form><div class="cookie-notice">We use cookies.</div><script>x<</script></body>'
)


def test_html_extraction(spark):
    assert mincut.main_text(PAGE) == "T & U Hello big world. Two three."
    long = "<nav><a>Home</a></nav><article>" + "".join(f"<p>{prose(200, k)}.</p>" for k in range(4000)) + "</article>"
    assert len(long) > mincut.PIECE
    rows = [(1, "u", PAGE, 7), (2, None, None, 7), (3, "u", "", 7), (4, "u", "<p>", 7), (1, "u", PAGE, 7), (5, "u", long, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    found = mincut.extract(df).select("page_id", "text", "n_chars").collect()
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in found}
    want = " ".join(prose(200, k) + "." for k in range(4000))
    assert len(found) == 6 and got == {1: ("T & U Hello big world. Two three.", 33), 2: ("", 0), 3: ("", 0), 4: ("", 0), 5: (want, len(want))}
    assert mincut.extract(df.limit(0)).collect() == []


def word_f1(got: str, want: str) -> float:
    a, b = collections.Counter(got.split()), collections.Counter(want.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_extraction_of_labelled_pages():
    """Pages of the generator that the classifier was not fitted on."""
    scores = []
    for seed in range(50_000, 50_400):
        page, labels = layouts.page(seed)
        assert [b.text for b in mincut.blocks_of(page)] == [t for t, _ in labels]
        scores.append(word_f1(mincut.main_text(page), " ".join(t for t, content in labels if content)))
    assert sum(scores) / len(scores) > 0.98 and sum(s > 0.9 for s in scores) > 0.97 * len(scores)


def test_weights_are_the_fit():
    assert np.abs(np.array(layouts.fit()) - mincut.WEIGHTS).max() < 0.02


def test_extraction_of_the_pages_table(spark):
    """These pages keep their text in one article."""
    rows = mincut.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)
        if inner:
            text = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", inner[1]))).strip()
            assert re.sub(r"\s", "", r["text"]) == re.sub(r"\s", "", text)


TWO = "<p>" + prose(20, 70) + ".</p><p>" + prose(20, 71) + ".</p>"


@pytest.mark.parametrize("opening", ['div class="review-body"', 'div class="legal-story"', 'div class="site has_sidebar with-ads ad-free"', "div", 'section id="notice"'])
def test_articles_under_odd_names(opening):
    page = f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><div>Home News Sport</div><{opening}>{TWO}</{opening.split()[0]}><div>Copyright 2024 Some Site</div></body>"
    assert mincut.main_text(page) == f"{prose(20, 70)}. {prose(20, 71)}."


@pytest.mark.parametrize("part", ['<a "', '<a ">"', "</i>", "<b></i>", "<div></i>x<p>", "<li>", "<body>", "<p><b>"])
def test_hostile_pages_take_linear_time(part):
    def seconds(n):
        began = time.process_time()
        mincut.main_text("<b>" * n + part * n)
        return time.process_time() - began

    assert seconds(8000) < 10 * max(0.1, seconds(2000))


@pytest.mark.parametrize("inside", ["<body>", "", "<body class=x>", "<link rel=a><style>p{}</style><body>", "<noscript><body>", "<head>"])
def test_head_without_end_tag(inside):
    page = f"<html><head><title>T</title>{inside}<p>Hello there, this is the page.</p>"
    assert mincut.main_text(page) == "Hello there, this is the page."
    assert mincut.main_text("<html><head><title>T</title>Hello there, this is the page.") == "Hello there, this is the page."
    assert mincut.main_text("<head><title>T</title><script>x</script><noscript><p>No.</p></noscript></head><p>Hello.</p>") == "Hello."


def test_min_cut_is_least():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 7)
        good, bad = [r.random() * 3 for _ in range(n)], [r.random() * 3 for _ in range(n)]
        joined = [(i, j, r.random()) for i in range(n) for j in range(i) if r.random() < 0.5]

        def cost(side):
            return sum(bad[i] if side[i] else good[i] for i in range(n)) + sum(w for i, j, w in joined if side[i] != side[j])

        least = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
        assert cost(mincut.min_cut(good, bad, joined)) == pytest.approx(least)


def test_mixing(docs, empty):
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    assert len(rows) == docs.count() and all(0 <= r["copies"] <= 3 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for group in by.values():
        assert abs(sum(r["size"] * r["copies"] for r in group) - group[0]["target"]) <= 2 * max(r["size"] for r in group)
        assert group[0]["target"] <= 3 * group[0]["source_size"] + 1e-6
    assert sum(g[0]["target"] for g in by.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert sorted(map(repr, mixing.mix(docs).collect())) == sorted(map(repr, rows))
    assert mixing.mixed_rows(docs).count() == sum(r["copies"] for r in rows) and mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix(empty).collect() == []


def test_mixing_is_its_sql_with_many_cells(spark, monkeypatch):
    """As if sizes of a source were cut from 20 rows on."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(mixing, "CELL_ROWS", 20)
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.oracle()})").fetchall()
    found = mixing.query(spark, "/root/testdata/sf0.01").select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_fingerprints(docs, empty, spark):
    rows = sorted(texts_of(docs), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    want = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    for block in (digest.BLOCK_ROWS, 5):
        digest.BLOCK_ROWS, held = block, digest.BLOCK_ROWS
        found = digest.edit_fingerprints(docs).collect()
        digest.BLOCK_ROWS = held
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=repr) == sorted(want, key=repr)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    one = digest.digests([BASE.encode()])[0]
    assert digest.likeness(one, one) == 1.0 and digest.likeness(one, digest.digests([prose(300, 77).encode()])[0]) < 0.2
    assert (digest.unspell(digest.spell(one)) == one).all()
    assert digest.edit_fingerprints(empty).collect() == []


def test_entropy_cells_are_brute_force():
    import math
    from collections import Counter

    texts = [BASE.encode(), b"a" * 200, bytes(range(256)) * 2]
    starts = np.cumsum([0, *map(len, texts)])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    cells = digest._entropy_cells(flat, np.arange(len(flat)) + np.repeat(np.arange(3), np.diff(starts)) * 128)
    for d, t in enumerate(texts):
        for i in range(0, len(t) - 63, 17):
            total = sum(round(n * math.log2(n) * 65536) for n in Counter(t[i : i + 64]).values())
            assert cells[starts[d] + i] == (6 * 64 * 65536 - total) * 1024 // (6 * 64 * 65536)


def brute_classes(texts) -> dict:
    """Smallest id of each class of texts (id: text) linked by similarity, all pairs looked at."""
    sets, root = {}, {k: k for k in texts}
    for k, t in texts.items():
        w = t.split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return root


def test_near_duplicates_are_brute_force(spark, docs, empty):
    r = random.Random(11)
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    for k in range(30):
        words = BASE.split()
        for _ in range(r.choice([1, 3, 5, 9])):
            words[r.randrange(len(words))] = "changed"
        rows.append((1000 + k, " ".join(words)))
    sets = {}
    for k, t in rows:
        w = (t or "").split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            union = len(sets[a] | sets[b])
            if a < b and ((union and len(sets[a] & sets[b]) / union >= 0.8) or not union):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {k: find(k) for k in sets}
    left = neardup.dedup(docs)
    assert left.columns == docs.columns and left.count() == neardup.classes(docs).select("class_id").distinct().count()
    assert neardup.classes(empty).collect() == [] and neardup.dedup(empty).collect() == []


def test_texts_with_a_passage_in_common_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Half of a text and more is one passage, the rest is its own: few are similar, and almost all share a bucket."""
    r, passage = random.Random(12), prose(100, 700)
    rows = [(k, " ".join([prose(n := r.randint(0, 70), 800 + k), passage, prose(70 - n if k % 40 else 3, 1400 + k)])) for k in range(500)]
    asked, verified = [], neardup._verified

    def counted(pairs, texts):
        asked.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(neardup, "_verified", counted)
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == brute_classes(dict(rows))
    assert len({r["class_id"] for r in found}) < len(rows) and sum(asked) < 6 * len(rows)


def test_first_fifths_spare_pairs_and_lose_none(spark):
    """Texts of the same blocks, each without some: all pairs are possible by a place, some are similar."""
    r, blocks = random.Random(13), [prose(12, 700 + k) for k in range(40)]
    texts = [" ".join(b for b in blocks if r.random() < share) for share in [0.7, 0.8, 0.97] for _ in range(20)]
    df = spark.createDataFrame([(bytes([k]), t) for k, t in enumerate(texts)], "id binary, text string")
    postings = neardup._postings(df)
    pairs = neardup._allowed(postings.withColumn("root", F.col("id")))
    possible = {(a[0], b[0]) for a, b in pairs.collect()}
    kept = {(a[0], b[0]) for a, b in neardup._promising(pairs, neardup._first_fifths(postings)).collect()}
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    near = {(a, b) for a in range(60) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near <= kept <= possible and near
    assert len(kept) - len(near) < (len(possible) - len(near)) / 2, (len(near), len(kept), len(possible))


HARD = "ab c\n\t\r\x0b\x1c\x85\xa0　​'sé日123½ⅷ_-!😀́ΣİßAB"


def hard_texts(n):
    r = random.Random(1)
    return ["", "aaaa" * 30, "  x  \n\n y ", " ", "x \n", "it's I'll", "a<|endoftext|>b", *["".join(r.choice(HARD) for _ in range(r.randint(1, 60))) for _ in range(n)], "".join(r.choice("abcde") for _ in range(3000))]


def test_near_duplicates_with_uneven_repeats(spark):
    rows = []
    for k in range(20):
        shared = prose(124, 500 + k)
        for side in (0, 1):
            line = prose(10, 600 + 2 * k + side)
            rows.append((2 * k + side, shared + (" " + line) * 1000))
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [[set(zip(*[t.split()[i:] for i in range(5)])) for _, t in rows[2 * k : 2 * k + 2]] for k in range(20)]
    near = [k for k, (a, b) in enumerate(pairs) if len(a & b) >= 0.8 * len(a | b)]
    assert [k for k in range(20) if found[2 * k + 1] == 2 * k] == near and near


def test_bpe_is_the_library(spark, docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = replay.defaults()
    vocab = replay.vocabulary(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocab.ranks, special_tokens={})
    texts = hard_texts(1500) + [t for t in TEXTS if t]
    got = vocab.encode(texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert all(vocab.decode(g) == t.encode() for g, t in zip(got, texts))
    assert all(vocab.encode_alone(t.encode()) == vocab.replay([t.encode()])[0] for t in texts if t)
    rows = replay.encode_rows(docs)
    assert rows.where("not round_trip").count() == 0 and rows.count() == docs.count()
    assert replay.encode_digests(empty).collect() == [] and replay.encode_texts(docs).where("decoded <> coalesce(text, '')").count() == 0


def test_token_counts_are_the_library(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(counting.default_path())
    texts = hard_texts(1500) + [t for t in TEXTS if t]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counting.counter(counting.default_path()).count(list(texts)) == want
    found = counting.count_tokens(docs).collect()
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) and r["n_bytes"] == len((r["text"] or "").encode()) for r in found)
    assert counting.count_tokens(empty).collect() == []


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b", "same"), (2, None, "same"), (3, "u", "x" * 3_000_000), (4, "u", None), (5, "u", ""), (6, "ü\n", "é日"), (7, "u", "same"), (None, "u", "same"), (None, "u", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(df, f"file://{tmp_path}/w")
    got = {(r["page_id"], r["payload_digest"]): r for r in warc.read_archives(index).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        r = got[i, warc.digest32(payload)]
        alike = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        last = max(alike, default=None)
        assert r["payload_bytes"] == len(payload)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == last else ("revisit", last))
        if r["record_type"] == "response":
            assert r["html"] == (html or "")
    for row in index.collect():
        headers, _ = warc.read_record(row)
        assert headers["WARC-Record-ID"] == row["record_id"]
    limited = warc.read_archives(warc.write_archives(df, f"file://{tmp_path}/v", least=5))
    assert limited.where("record_type = 'revisit'").count() == 0
    none = warc.write_archives(df.limit(0), f"file://{tmp_path}/n")
    assert warc.read_archives(none).collect() == []


def test_rows_are_encoded_in_less_memory():
    """As in a task of encode_rows and one of encode_digests, on the same texts of many words."""
    r = random.Random(14)
    texts = [" ".join("".join(r.choices("abcdefghij", k=r.randint(3, 7))) for _ in range(400)) for _ in range(1500)]
    batch, results, peaks = pa.RecordBatch.from_pydict({"text": texts}), [], []
    for piece, kept in ((replay.PIECE, replay.KEPT), (replay.ROWS_PIECE, replay.ROWS_KEPT)):
        vocab = replay.vocabulary(*replay.defaults())
        tracemalloc.start()
        results.append([s for b in common.pieces(batch, "text", piece) for s in vocab.encode_decimal(b.column("text").to_pylist(), kept)])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        vocab.rest()
    assert results[0] == results[1] and peaks[1] < 0.7 * peaks[0], peaks
