"""Every stage of the corpus pipeline against brute force on its own input, with nulls, ties, repeated rows and clashing columns."""

from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from test_llm import brute_dedup, words

from sunloom.llm import quality

DATA = "/root/testdata/sf0.001"


def bag(text, n=5):
    w = words(text)
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def brute_classes(texts):
    """The smallest place of each text's near-duplicate class; null texts are alone."""
    bags, up = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for k, b in enumerate(bags):
        for g in b:
            where.setdefault(g, []).append(k)
    pairs = {(i, j) for x in where.values() for i in x for j in x if i < j} | {(i, j) for j in range(len(texts)) for i in range(j) if texts[i] is not None and texts[i] == texts[j]}
    for i, j in sorted(pairs):
        both = sum((bags[i] & bags[j]).values())
        if texts[i] == texts[j] or both >= 0.8 * sum((bags[i] | bags[j]).values()):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(texts))]


def brute_leak(text, items):
    """Whether a window of an item's length is as similar to it as 0.8."""
    w = words(text)
    for item in items:
        m = words(item)
        q = min(5, len(m))
        if not m or len(w) < q:
            continue
        theirs = bag(item, q)
        for a in range(max(len(w) - q + 1, 1)):
            mine = bag(" ".join(w[a : a + len(m)]), q)
            both = sum((mine & theirs).values())
            if both >= 0.8 * sum((mine | theirs).values()):
                return True
    return False


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DATA}/documents.parquet' ORDER BY doc_id LIMIT 45").fetchall()
    items = duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet' ORDER BY item_id LIMIT 12").fetchall()
    long = "a long text of its own " + " ".join(f"word{k}" for k in range(4000))
    shared = " ".join(f"passage{k % 37}x{k}" for k in range(60))
    extra = [None, "", "!?", "one", rows[3][1], rows[3][1], long, "before " * 9 + items[0][0] + " after" * 9, shared + " tail of one " + rows[5][1][:300], rows[7][1][:400] + " head of two " + shared]
    docs = [(i, t, lang, s, len(t)) for i, t, lang, s in rows] + [(5000 + k, t, None if k % 2 else "en", None if k % 3 else "src0", None if t is None else len(t)) for k, t in enumerate(extra)]
    docs += [(None, rows[11][1], "en", "src1", len(rows[11][1])), docs[20], docs[20]]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(*d, "x", 1, "y") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, _text string, key int, grp string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, t[0]) for k, t in enumerate(items)] + [(0, "another text of the same id"), (None, None), (99, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_every_stage(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, step = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        step[name] = before, docs.collect()
    key = lambda r: tuple("~" if x is None else str(x) for x in r)

    before, after = step["quality_classifier"]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    keep = {r["doc_id"] for r in quality.classify(frame, spark.read.parquet(f"{folder}/labels.parquet")).where("keep").collect()}
    assert sorted(map(key, after)) == sorted(key(r) for r in before if r["doc_id"] in keep)

    before, after = step["minhash_near_dedup"]
    ordered = sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    classes = brute_classes([r["text"] for r in ordered])
    want = [r for k, r in enumerate(ordered) if r["text"] is None or classes[k] == k]
    assert sorted(map(key, after)) == sorted(map(key, want))

    before, after = step["suffix_array_dedup"]
    texts = [r["text"] for r in before]
    gone = [r[2] for r in brute_dedup(list(enumerate(texts)), corpus_pipeline.PASSAGE_BYTES)]
    now = {r["doc_id"]: r for r in after}
    assert len(after) == len(before) and any(gone) and not all(gone)
    for r, n in zip(before, gone, strict=True):
        left = now[r["doc_id"]]
        assert (left["text"] is None) == (r["text"] is None) and left["lang"] == r["lang"]
        if r["text"] is not None:
            # A character that lost some of its bytes goes as a whole.
            assert 0 <= len(r["text"].encode()) - n - len(left["text"].encode()) <= 3 * n and (n or left["text"] == r["text"])
            assert r["n_chars"] is None or left["n_chars"] == len(left["text"])

    before, after = step["benchmark_decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = [r for r in before if not brute_leak(r["text"], items)]
    assert len(want) < len(before) and sorted(map(key, after)) == sorted(map(key, want))

    before, after = step["source_mixing"]
    copies = Counter(map(key, after))
    assert set(copies) <= set(map(key, before)) and max(copies.values()) <= 2
    size = lambda rows: Counter({s: sum(len((r["text"] or "").split()) for r in rows if r["source"] == s) for s in {r["source"] for r in before}})
    mine, theirs = size(after), size(before)
    assert all(mine[s] <= 2 * theirs[s] for s in mine) and sum(mine.values()) == pytest.approx(1.5 * sum(theirs.values()), rel=0.25)


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
