"""The operators of sunloom.llm against brute force, and their edge cases."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from sunloom.llm import decontaminate, html_extract, langid, license_scan, lm_scoring, mixing, near_dup, quality, suffix_dedup, topk
from sunloom.llm import queries as Q
from sunloom.llm.suffix_sort import suffix_arrays

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _id int, key string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def frame(spark, texts, ids=None):
    """Documents with null and empty texts, repeated rows and columns whose names clash with inner ones."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 4 else None, None, "x", 1, "y") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    got = duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' ORDER BY doc_id LIMIT 120").fetchall()
    return [r[0] for r in got] + [None, "", "!!!", "one", "one two", "Ünï x", got[3][0], got[3][0], "ab " * 600, "long " * 3000 + got[5][0]]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_scoring(spark, texts, order):
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in lm_scoring.stupid_backoff(df, chunk_mb=0.001, order=order).collect()}
    seen = Counter()
    for t in texts:
        w = words(t)
        seen.update(tuple(w[i : i + m]) for m in range(1, order + 1) for i in range(len(w) - m + 1))
    n = sum(c for g, c in seen.items() if len(g) == 1)
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        w, total, back = words(t), 0.0, 0
        for i in range(len(w)):
            most = min(order, i + 1)
            m = next((m for m in range(most, 1, -1) if seen[tuple(w[i - m + 1 : i + 1])] >= 2), 1)
            total += (most - m) * math.log(0.4) + math.log(seen[tuple(w[i - m + 1 : i + 1])] / (seen[tuple(w[i - m + 1 : i])] if m > 1 else n))
            back += m < most
        assert got[k]["n_tokens"] == len(w) and got[k]["n_backoff"] == back and got[k]["log_score"] == pytest.approx(total, abs=1e-6)
        assert (got[k]["score"] is None) == (not w)
    assert lm_scoring.stupid_backoff(df.limit(0)).count() == 0


def test_lm_scoring_memory(spark, monkeypatch):
    """What a task of a chunk holds at once, in bytes a byte of text: the chunk's n-grams are never all spread out at the same time."""
    kept, plain, joined = {}, GroupedData.applyInArrow, PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda g, f, schema: plain(g, kept.setdefault(f.__name__, f), schema))
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda g, f, schema: joined(g, kept.setdefault(f.__name__, f), schema))
    lm_scoring.stupid_backoff(frame(spark, ["a b"]), order=3)
    rng, many = random.Random(5), [f"w{k}" for k in range(9000)]
    texts = [" ".join(rng.choices(many, k=400)) for _ in range(4000)]
    size = sum(map(len, texts))
    left = pa.table({"_chunk": pa.array([0] * len(texts), pa.int32()), "_id": list(range(len(texts))), "_text": texts})

    def most(run):
        tracemalloc.start()
        out = run()
        peak = tracemalloc.get_traced_memory()[1] / size
        tracemalloc.stop()
        return out, peak

    asked, peak = most(lambda: pa.Table.from_batches(list(kept["ask"]((pa.scalar(0),), iter(left.to_batches())))))
    assert peak < 10
    told = [kept["answer"](asked.filter(pc.equal(asked["part"], k))) for k in asked["part"].unique()]
    scored, peak = most(lambda: kept["score"](left, pa.concat_tables(told)))
    assert peak < 14
    assert sum(scored["n_tokens"].to_pylist()) == 400 * len(texts)


def test_license_scan(spark, texts):
    more = ["All rights reserved. CC BY-NC 4.0", "Licensed under the Apache License, Version 2.0.", "x GNU General Public License y all rights reserved", "cc", "by"]
    df = frame(spark, [*texts, *more])
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    for k, t in enumerate([*texts, *more]):
        w, found = words(t), []
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            found += [(i, i + len(p) - 1, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        r = got[k]
        assert (r["n_words"], r["n_base"]) == (len(w), len(found))
        assert r["first_word"] == min((f[0] for f in found), default=None) and r["last_word"] == max((f[0] for f in found), default=None)
        assert r["base_labels"] == ",".join(sorted({f[2] for f in found})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert "apache-2.0" in got[len(texts) + 1]["labels"]


def test_suffix_automaton_matches():
    rng = random.Random(3)
    lists = [[rng.randint(1, 4) for _ in range(rng.randint(3, 25))] for _ in range(6)]
    sam = license_scan.SuffixAutomaton(lists)
    for _ in range(200):
        t = [rng.randint(1, 5) for _ in range(30)]
        want = {}
        for k, x in enumerate(lists):
            ends: dict = {}
            for i in range(len(x)):
                for j in range(i + 3, len(x) + 1):
                    ends.setdefault(tuple(x[i:j]), []).append(j - 1)
            spans = {(i, j) for i in range(30) for j in range(i + 3, 31) if tuple(t[i:j]) in ends}
            want |= {(k, i, j - 1): ends[tuple(t[i:j])] for i, j in spans if not any((a <= i and b > j) or (a < i and b >= j) for a, b in spans)}
        assert {(k, a, b): pos for k, a, b, pos in sam.matches(t, 3)} == want


def test_license_chains():
    """Chains of a template with a repeated phrase, a gap, and words of another template in between."""
    a = "one two three four five six seven eight one two three four nine ten eleven twelve thirteen fourteen"
    b = "five six seven eight one two three four other words of its own here"
    scanner = license_scan.Scanner({"a": a, "b": b}, {"two three": "x"})

    def spans(text):
        got = scanner.scan(pa.chunked_array([[text]]))
        return [(s["template"], s["first"], s["last"], s["covered"]) for s in got["spans"][0]], got["labels"][0], got["score"][0]

    assert spans(a) == ([("a", 0, 17, 18)], "a,x", 1.0)
    assert spans(b.upper()) == ([("b", 0, 13, 14)], "b,x", 1.0)
    words_ = a.split()
    # Three words are missing in the middle, three others are put in: two matches, one chain.
    assert spans(" ".join(words_[:8] + ["x", "y", "z"] + words_[10:]))[0] == [("a", 0, 18, 16)]
    # The end of the licence before its beginning is no chain.
    assert spans(" ".join(words_[12:] + words_[:6]))[0] == []
    assert spans(" ".join(words_[:8] + ["x"] * 30 + words_[8:]))[0] == []


def test_decontamination(spark, texts):
    items = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " + " ".join(f"w{k}" for k in range(40)), "only three words", "", None]
    near = items[0].replace("w20", "changed")
    docs = [*texts, "head " * 7 + items[0].upper() + " tail", near, "so only three words here", items[0][:150]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(frame(spark, docs), bench).collect()}

    def shingles(w, q):
        return Counter(tuple(w[i : i + q]) for i in range(len(w) - q + 1))

    want = {}
    for k, t in enumerate(docs):
        for i, item in enumerate(items):
            w, m = words(t), words(item)
            if not m:
                continue
            q = min(5, len(m))
            b = shingles(m, q)
            best = max(((s := sum((x := shingles(w[a : a + len(m)], q) & b).values())) / max(sum((shingles(w[a : a + len(m)], q) | b).values()), 1), -a) for a in range(max(len(w), 1))) if w else (0, 0)
            if best[0] >= 0.8:
                want[k, i] = best
    assert set(got) == set(want) and {(len(texts), 0), (len(texts) + 1, 0), (len(texts) + 2, 1)} == set(got)
    assert all(got[x]["similarity"] == pytest.approx(want[x][0]) and got[x]["start"] == -want[x][1] for x in want)
    assert decontaminate.drop_contaminated(frame(spark, docs), bench).count() == len(docs) - 3
    assert decontaminate.matches(frame(spark, docs), bench.limit(0)).count() == 0


def test_decontamination_keeps_items_with_repeated_and_null_ids(spark):
    passage = [" ".join(f"{x}{k}" for k in range(30)) for x in "abc"]
    bench = spark.createDataFrame([(1, passage[0]), (1, passage[1]), (1, passage[1]), (2, passage[1]), (None, passage[2])], "item_id long, text string")
    df = frame(spark, [*passage, "something else"])
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, bench).collect()), key=str)
    assert got == [(0, 1), (1, 1), (1, 2), (2, None)]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()] == [3]


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] / 4 + rng.normal(size=16) * (0.01 if k % 3 else 0.2)).tolist()) for k in range(1500)]
    rows += [(1500, None), (1550, [1.0, None] * 8), (1600, [float("nan")] * 16), (None, [0.5] * 16), (1650, [0.25] * 3), (1651, [0.5] * 3), (7, rows[7][1]), (1700, rows[0][1]), (1701, rows[0][1])]
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 200)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "PIVOTS", 6)
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    seen = {i: np.floor(np.float32(v).astype(float) * 256).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in seen if i % 50 == 0):
        best = sorted((-int(seen[q] @ v), i) for i, v in seen.items() if i != q and len(v) == len(seen[q]))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_language_id(spark):
    out = Q.op5_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    held = out.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    train = spark.createDataFrame([("the cat sat on the mat with another cat", "en"), ("le chat est sur la table avec un autre", "fr"), ("кот сидит на столе", "ru")] * 5, "text string, lang string")
    model = langid.fit(train)
    mixed = "the cat sat on the mat with another cat " * 4 + "le chat est sur la table avec un autre " * 3
    got = langid.identify(frame(spark, [None, "", "123 !!", "на столе", mixed]), model, spans=True).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "ru", "en"] and got[0]["score"] == 0
    assert [s["lang"] for s in got[4]["spans"]] == ["en", "fr"]
    assert langid.identify(frame(spark, ["abc"]), langid.fit(train.limit(0))).first()["lang_pred"] == "und"


def test_language_shortcut_is_viterbi():
    def viterbi(scores):
        value, paths = scores[0].astype(float), [[k] for k in range(scores.shape[1])]
        for row in scores[1:]:
            move = value[:, None] - langid.PENALTY * (1 - np.eye(len(row)))
            of = move.argmax(0)
            value, paths = move.max(0) + row, [paths[of[k]] + [k] for k in range(len(row))]
        return value.max(), paths[int(value.argmax())]

    model = langid.Model(["a", "b", "c"], [], np.ones((1, 3), bool))
    two = np.array([[0, -8, -1]] * 10 + [[-8, 0, -1]] * 10, np.float32)
    assert model.label(two).tolist() == [0] * 10 + [1] * 10
    rng = np.random.default_rng(4)
    for _ in range(400):
        scores = -rng.random((rng.integers(1, 30), 3)) * rng.choice([0.5, 2, 6])
        scores = (scores + np.repeat(-rng.random((6, 3)) * 2, 5, 0)[: len(scores)]).astype(np.float32)
        got = model.label(scores)
        total = scores[np.arange(len(got)), got].astype(float).sum() - langid.PENALTY * (np.diff(got) != 0).sum()
        assert total == pytest.approx(viterbi(scores)[0], abs=1e-4)


def test_every_language_is_learned(spark):
    # 65 languages with two texts each, and one more with a single text: each has words of its own letters only.
    pairs = [(a, b) for a in "bcdfghjklm" for b in "npqrstv"][:66]
    rows = [(f"{a}a{b}o {b}e{a}i {a}{b}u{b}{a}", f"l{k:02}") for k, (a, b) in enumerate(pairs) for _ in range(2 if k < 65 else 1)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(2))
    assert model.langs == [f"l{k:02}" for k in range(66)]
    got = langid.identify(frame(spark, [t for t, _ in rows]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == [x for _, x in rows]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("plain &amp; text", "plain & text"),
        ("<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Head</h1><p><b>One<br><p>Two &lt;3 <i>in</i>line</p><aside>side</aside><form>f</form></article><footer>foot</footer></body></html>", "Head\nOne\nTwo <3 inline"),
        ("<body><header>Site</header><div class='ad-banner'>buy</div><main><p>Text<script>var a='</p>';</script></p><div id=comments><p>reader</p></div></main></body>", "Text"),
        ("<article><ul><li>a<li>b</ul><!-- <p>no</p> --><p>x\n\t y&nbsp;z</p></article>", "a\nb\nx y z"),
        ("<article><p>open <b>never closed", "open never closed"), ("<div class='cookie-notice'>c</div><div><p>body</p></div>", "body"), ("<p>1 < 2 and <unclosed", "1 < 2 and <unclosed"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_template_deduction(spark):
    pages = [(k, f"http://h.example/{k}", f"<body><div class=x><p>Welcome to our site</p></div><div class=y><p>story {k} text</p></div></body>") for k in range(30)]
    pages += [(100, None, None), (None, "http://h.example/z", ""), (101, "no url", "<p>lone</p>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == 33 and got[4] == "story 4 text" and got[100] == "" and got[None] == "" and got[101] == "lone"



def _texts(spark, pages):
    frame_ = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.extract(frame_).orderBy("page_id").collect()]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_template_needs_a_class_not_a_host_size(spark, rows, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", rows)
    pages = [("http://small.example/", f"<body><div class=x><p>Welcome to our site</p></div><div class=y><p>story {k} of the day</p></div></body>") for k in range(5)]
    # A passage that most pages share, in no element of its own, is no template text; nor is what near copies share.
    shared = [("http://big.example/", f"<body><p>opening {k}</p>{'<p>a famous quotation</p>' if k % 4 else ''}<p>closing words {k}</p></body>") for k in range(24)]
    near = [("http://near.example/", f"<body><h1>One title</h1><div><p>a long text that both near copies share</p></div><p>edit {k}</p></body>") for k in range(2)]
    got = _texts(spark, pages + shared + near)
    assert got[:5] == [f"story {k} of the day" for k in range(5)]
    assert got[5:29] == [f"opening {k}\n" + ("a famous quotation\n" if k % 4 else "") + f"closing words {k}" for k in range(24)]
    assert got[29:] == [f"One title\na long text that both near copies share\nedit {k}" for k in range(2)]


def test_copies_and_frequent_passages_are_no_template(spark):
    copy = "<body><article><h1>Copied</h1><p>one article</p></article></body>"
    bare = "<body><h1>Copied too</h1><div class=t><p>without an article element</p></div></body>"
    pages = [(f"http://a.example/{k}", copy if k < 27 else f"<body><article><h1>T {k}</h1><p>text {k}</p></article></body>") for k in range(30)]
    pages += [(f"http://b.example/{k}", bare if k < 27 else f"<body><h2>T {k}</h2><p>text {k}</p></body>") for k in range(30)]
    pages += [(f"http://c.example/{k}", f"<body><article><p>text {k}</p><p class=q>the same passage</p></article></body>") for k in range(30)]
    got = _texts(spark, pages)
    assert got[:27] == ["Copied\none article"] * 27 and got[27] == "T 27\ntext 27"
    assert got[30:57] == ["Copied too\nwithout an article element"] * 27 and got[59] == "T 29\ntext 29"
    assert got[60:] == [f"text {k}\nthe same passage" for k in range(30)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body>x<main><h1>Title</h1><p>lead</p><article>body text</article><p>end</p></main></body>", "Title\nlead\nbody text\nend"),
        ("<article><p>the longer of two</p></article><p>between</p><article><p>short</p></article>", "the longer of two\nshort"),
        ("<main><article>one<section class=comments><article>reader</article></section></article><article>two</article></main>", "one\ntwo"),
    ],
)
def test_all_main_groups(page, text):
    assert html_extract.main_text(page) == text


def brute_dedup(rows, n=400):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        yield d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("most", "window"), [(40_000, 400), (4, 400), (40_000, 200), (4, 200)])
def test_suffix_dedup(spark, texts, most, window, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(450))
    more = ["".join(rng.choice("ijkl") for _ in range(200 + k)) + passage + "".join(rng.choice("mno") for _ in range(300)) for k in range(20)]
    more += ["x" * 1000, "q" + "ab" * 300 + "é" * 50, texts[5][100:1400] + texts[6][:700] + "zz" + texts[5][50:800]]
    rows = list(enumerate([*texts[:60], *texts[-10:], *more])) + [(None, more[0])]
    df = frame(spark, [t for _, t in rows], [d for d, _ in rows]).repartition(5)
    got = suffix_dedup.dedup_digest(df, window=window).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(brute_dedup(rows, window), key=str)
    cut = suffix_dedup.remove_repeats(df, window=window)
    assert cut.columns == df.columns and cut.count() == len(rows)
    if most > 4 and window == 400:
        # Passages of 51 words that another row has all count; without one of 32 words nothing does.
        tokens = [(d, [m.group().encode() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x60\x7B-\x7F]*", t or "")]) for d, t in rows]

        def shared(n):
            where = {}
            for k, (_, w) in enumerate(tokens):
                for i in range(len(w) - n + 1):
                    where.setdefault(tuple(w[i : i + n]), set()).add(k)
            return [any(len(where[tuple(w[i : i + n])]) > 1 for i in range(len(w) - n + 1)) for _, w in tokens]

        number = {r["doc_id"]: r["n_shared"] for r in got}
        long, short = shared(52), shared(30)
        assert any(long) and not all(short)
        for (d, _), x, y in zip(rows, long, short, strict=True):
            assert number[d] > 0 if x else (number[d] == 0 or y)


def test_suffix_dedup_sends_texts_once(spark):
    """Of texts that hardly compress and all have something repeated: what the query's exchanges write, in bytes a byte of text."""
    rng, letters = random.Random(3), "".join(map(chr, range(33, 127)))
    passages = ["".join(rng.choices(letters, k=450)) for _ in range(150)]
    rows = ["".join(rng.choices(letters, k=3000)) + passages[k % 150] + "".join(rng.choices(letters, k=3000)) for k in range(300)]
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def written():
        bus.waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    old, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = suffix_dedup.dedup_digest(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(got) == len(rows) and all(r["n_removed"] >= 450 and r["n_spans"] == 1 for r in got)
    sent = sum(n for k, n in written().items() if k not in before) / sum(map(len, rows))
    assert 1 < sent < 2.6


def test_suffix_sort_memory():
    """What sorting holds at once, in bytes a byte of text."""
    rng = random.Random(7)
    passage = rng.randbytes(400)
    slices = [rng.randbytes(11) + bytes([k % 20]) + passage + bytes([k % 20]) + rng.randbytes(11) for k in range(1000)]
    places = [(b"%d" % k, 0) for k in range(len(slices))]
    tracemalloc.start()
    got = suffix_dedup.repeated_starts(slices, np.arange(len(slices)) // 20, places, np.zeros(len(slices), bool))
    peak = tracemalloc.get_traced_memory()[1] / sum(map(len, slices))
    tracemalloc.stop()
    assert [x.tolist() for x in got] == [[12]] * len(slices)
    assert peak < 60


HELD = """
import random, sys
import pyarrow as pa
from sunloom.llm import near_dup, suffix_dedup
rng = random.Random(3)
texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(150)) for _ in range(6000)]
b = pa.RecordBatch.from_arrays([pa.array([b"%d" % k for k in range(len(texts))], pa.binary()), pa.array(texts)], names=["key", "text"])
near_dup._text.powers(1 << 20)
held = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:")) / 1024
before = held()
for _ in near_dup._sign(iter([b])) if sys.argv[1] == "sign" else suffix_dedup._find(iter([b]), 200):
    pass
del _
print(held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
@pytest.mark.parametrize("step", ["sign", "find"])
def test_workers_give_memory_back(step):
    """MB that a worker holds after a part, besides what it held before."""
    out = subprocess.run([sys.executable, "-c", HELD, step], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert float(out.stdout) < 10


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(60):
        strings = [[rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.choice([0, 1, 5, 60]))] + [0] for _ in range(rng.randint(1, 6))]
        offs = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        got = suffix_arrays(np.array(sum(strings, []), np.int64), offs)
        for k, s in enumerate(strings):
            assert (got[offs[k] : offs[k + 1]] - offs[k]).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_mixing(spark, texts):
    df = frame(spark, texts)
    rows = mixing.mix_sources(df).collect()
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    totals = Counter()
    for k, s in size.items():
        totals[source[k]] += s
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight, left, target, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values()), {}, list(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * totals[s]]
        target |= {s: 2 * totals[s] for s in over} if over else share
        left -= sum(2 * totals[s] for s in over)
        open_ = [s for s in open_ if s not in over] if over else []
    taken = Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(target[source[r["doc_id"]]])
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(rows) == len(texts) and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(df.repartition(3)).collect()))
    assert mixing.emit_copies(df).count() == sum(r["copies"] for r in rows)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    docs = docs.withColumn("keep", F.lit("clash")).union(spark.createDataFrame([(9999, None, None, None, None, "x"), (None, "", "en", "s", 0, "x")], "doc_id long, text string, lang string, source string, n_chars long, keep string"))
    out = quality.classify(docs, labels)
    assert out.count() == docs.count() and out.schema["keep"].dataType.simpleString() == "boolean"
    known = out.join(labels, "doc_id").where("toxic = 0")
    assert known.where("keep = (quality = 1)").count() >= 0.9 * known.count()
    assert quality.classify(docs, labels.limit(0)).where("NOT keep").count() == 0


def test_near_duplicates(spark, texts):
    rng = random.Random(2)
    base = words(texts[8])[:300]
    more = []
    for k in range(12):
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        more.append(" ".join(w))
    every = [*texts, *more]
    bags = []
    for t in every:
        w = words(t)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    up = list(range(len(every)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(every)):
        for j in range(i):
            same = every[i] is not None and every[i] == every[j]
            both = sum((bags[i] & bags[j]).values())
            if same or both and both >= 0.8 * sum((bags[i] | bags[j]).values()):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    df = frame(spark, every)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    assert got == {k: find(k) for k in range(len(every))}
    kept = sorted(r["doc_id"] for r in near_dup.keep_representatives(df).collect())
    assert kept == sorted({find(k) for k in range(len(every))})
    assert near_dup.keep_representatives(df.union(df)).where("text IS NOT NULL").count() == len([k for k in kept if every[k] is not None])


@pytest.mark.parametrize("block", [2000, 9])
def test_near_duplicates_count_all_links(spark, block, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", block)
    monkeypatch.setattr(near_dup, "BUCKET_TEXTS", block)
    base = [f"w{k}" for k in range(400)]
    df = frame(spark, [" ".join([*base, f"own{k}"]) for k in range(30)] + [" ".join([*base, "own0"]), "far away", None])
    rows = near_dup.near_duplicates(df).orderBy("doc_id").collect()
    assert [r["links"] for r in rows] == [30, *[29] * 29, 30, 0, 0] and [r["class_id"] for r in rows] == [0] * 31 + [31, 32]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    g = np.sort(rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64))
    a, b = g[:360], g[40:]
    sig = near_dup.signatures(np.concatenate((a, b)), np.ones(720, np.int64) * 2, np.array([0, 360, 720]))
    assert abs((sig[0] == sig[1]).mean() - 320 / 400) < 0.17 and (sig != 0).all()


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "source_mixing"]
    out = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert out.columns == docs.columns and 0 < out.count() <= 2 * docs.count()

