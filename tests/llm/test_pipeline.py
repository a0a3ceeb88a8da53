"""The pipeline against a brute-force version of its stages, and on an empty table."""

import duckdb
import pytest

import corpus_pipeline
from scriptorium.llm import common, language, mixing, neardup, replay
from pyspark.sql import functions as F


def classes(texts) -> dict[int, int]:
    """Smallest id of each class of texts (id: text) linked by similarity, all pairs looked at."""
    sets, root = {}, {k: k for k in texts}
    for k, t in texts.items():
        w = t.split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            union = len(sets[a] | sets[b])
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * union:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def test_pipeline_is_brute_force(spark, tmp_path):
    docs = common.documents(spark, "/root/testdata/sf0.001")
    docs = docs.union(docs.limit(3)).union(docs.limit(2).withColumn("doc_id", F.col("doc_id") + 10_000))
    names = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(common.written(stage(spark, seen[-1], "/root/testdata/sf0.001"), name))
    raw, spoken, exact, near, mixed, encoded = (df.toPandas() for df in seen)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mixing", "encoding"]
    assert all(df.columns == names for df in seen[1:5])
    # Language: the test texts are of one language each, so all with a letter stay.
    letters = raw[[any(c.isalpha() for c in t or "") for t in raw.text]]
    assert len(spoken) >= 0.98 * len(letters) and set(spoken.doc_id) <= set(letters.doc_id)
    told = dict(zip(raw.doc_id, raw.lang))
    assert sum(told[i] == x for i, x in zip(spoken.doc_id, spoken.lang)) >= 0.98 * len(spoken)
    # Exact: the smallest id of each text.
    first = {}
    for i, t in sorted(zip(spoken.doc_id, spoken.text)):
        first.setdefault(" ".join(t.split()) if t.strip() == t else t, i)
    assert sorted(exact.doc_id) == sorted(set(first.values()))
    # Near: the smallest id of each class.
    assert sorted(near.doc_id) == sorted(set(classes(dict(zip(exact.doc_id, exact.text))).values()))
    # Mixing: the copies that its SQL gives.
    con = duckdb.connect()
    documents = near  # noqa: F841
    con.register("documents", documents)
    want = con.execute(f"SELECT doc_id, taken // greatest(size, 1) FROM ({mixing.ORACLE})").fetchall()
    assert sorted(mixed.doc_id) == sorted(i for i, n in want for _ in range(n))
    # Encoding: the library's ids.
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = replay.defaults()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=replay.load_ranks(path), special_tokens={})
    texts = dict(zip(mixed.doc_id, mixed.text))
    assert sorted(encoded.doc_id) == sorted(mixed.doc_id) and encoded.round_trip.all()
    for i, ids, n in zip(encoded.doc_id, encoded.ids, encoded.n_tokens):
        assert list(map(int, ids.split())) == library.encode_ordinary(texts[i]) and n == len(ids.split())


def test_language_stage_keeps_columns_of_its_results(spark):
    docs = common.documents(spark, "/root/testdata/sf0.001").withColumn("score", F.lit("s")).withColumn("mixture", F.lit(1))
    kept = corpus_pipeline.language_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("score <> 's' or mixture <> 1").count() == 0
    assert language.fit(docs)[0]


def test_near_stage_does_not_compare_a_passage_pair_by_pair(spark, monkeypatch):
    """Texts of which a passage is the greater part, but not enough to be similar."""
    passage = " ".join(f"p{i}" for i in range(100))
    docs = spark.createDataFrame([(k, passage + "".join(f" w{k}x{i}" for i in range(35)), "en") for k in range(300)], "doc_id long, text string, lang string")
    asked, verified = [], neardup._verified

    def counted(pairs, texts):
        asked.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(neardup, "_verified", counted)
    assert corpus_pipeline.near_stage(spark, docs, "").count() == 300
    assert sum(asked) < 30 * 300  # a pair for each text and band at the most; all pairs are 44,850


def test_empty_table(spark):
    docs = common.documents(spark, "/root/testdata/sf0.001").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, ""), name)
        assert docs.count() == 0
