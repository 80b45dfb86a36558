"""Near-duplicate classes by DartMinHash signatures and a banded join.

A document is its weighted set of five-word shingles (weight: how often it
holds one).  Each shingle's weight axis is cut into regions [0, 1), [1, 2),
[2, 4), ...; a Poisson process of hashed darts fills region x rank, a dart
counts if its height is under the weight, and each of K coordinates keeps its
earliest dart.  Equal coordinates estimate the weighted Jaccard similarity.

Documents with the same words in the same order are one text from the start.
Texts that share a band bucket and agree in enough coordinates form candidate
groups; inside a group every pair that agrees in enough coordinates is verified
by the exact weighted similarity.  A group too large for one task is cut into
blocks and each pair of blocks is verified by its own task, so nothing is
dropped; each task counts every text's verified links and gives a forest of
them to a distributed connected-components pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import components, loose, partitions, saved

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
K = BANDS * ROWS
#: Agreement of coordinates from which two texts of one bucket are candidates (0.8 less 4.4 standard errors).
LEAST_AGREEMENT = 0.62
#: Texts that one task verifies together.
BLOCK_TEXTS = 2000
#: Texts of one bucket that one task compares; larger buckets are compared block by block.
BUCKET_TEXTS = 4000
_HEIGHT, _RANK, _SLOT, _COPY = (np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def weighted(h: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (sorted by hash in each row), their counts, and the rows' offsets."""
    g, go = _text.grams(h, offs, n)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(go))
    order = np.argsort(g)
    order = order[np.argsort(row[order], kind="stable")]
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return g[at], np.diff(np.append(at, len(g))), np.concatenate(([0], np.cumsum(np.bincount(row[at], minlength=len(offs) - 1))))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(g: np.ndarray, weight: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows by K: the id of the earliest dart of each coordinate; all 0 for a row without shingles."""
    rows = len(offs) - 1
    out, full = np.zeros((rows, K), np.uint64), np.zeros(rows, bool)
    total = np.add.reduceat(np.append(weight, 0), np.minimum(offs[:-1], len(weight))).astype(float)
    total[np.diff(offs) == 0] = 0
    full[total == 0] = True
    expect = K * (np.log(K) + 2.0)
    bound = np.where(total > 0, expect / np.maximum(total, 1), 0.0)
    row_of = np.repeat(np.arange(rows), np.diff(offs))
    while not full.all():
        active = ~full[row_of]
        sub = np.flatnonzero(active)
        # Regions [0, 1), [1, 2), [2, 4), ... of each shingle, as far as its weight reaches.
        region = np.zeros(len(sub), np.int64)
        parts, regions = [sub], [region]
        level = 1
        more = sub[weight[sub] > 1]
        while len(more):
            parts.append(more)
            regions.append(np.full(len(more), level))
            more = more[weight[more] > 2**level]
            level += 1
        el, reg = np.concatenate(parts), np.concatenate(regions)
        low = np.where(reg == 0, 0.0, 2.0 ** (reg - 1))
        width = np.where(reg == 0, 1.0, low)
        seed = _text.mix(g[el] + reg.astype(np.uint64) * _COPY)
        rank = np.zeros(len(el))
        ids, ranks, docs = [], [], []
        step = 0
        while len(el):
            step += 1
            seed = _text.mix(seed + _RANK)
            rank = rank - np.log(_unit(seed)) / width
            ok = rank <= bound[row_of[el]]
            el, low, width, seed, rank = el[ok], low[ok], width[ok], seed[ok], rank[ok]
            hit = low + width * _unit(_text.mix(seed ^ _HEIGHT)) <= weight[el]
            ids.append(seed[hit])
            ranks.append(rank[hit])
            docs.append(row_of[el[hit]])
        ids, ranks, docs = np.concatenate(ids), np.concatenate(ranks), np.concatenate(docs)
        slot = (_text.mix(ids ^ _SLOT) % np.uint64(K)).astype(np.int64)
        order = np.argsort(ranks)[::-1]  # the earliest is written last
        got = np.zeros((rows, K), np.uint64)
        got[docs[order], slot[order]] = ids[order] | np.uint64(1)
        done = ~full & (got != 0).all(1)
        out[done] = got[done]
        full |= done
        bound *= 2
    return out


def text_key(text_col: str) -> Column:
    """A text's identity, 16 bytes; null for null."""
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


@_text.lean
def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key of this task: a group of copies is reduced to a row per task before any shuffle."""
    seen: set[bytes] = set()
    for b in batches:
        fresh = []
        for k, key in enumerate(b.column(0).to_pylist()):
            if key not in seen:
                seen.add(key)
                fresh.append(k)
        yield b if len(fresh) == b.num_rows else b.take(pa.array(fresh, pa.int64()))


def _digits(sig: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate."""
    return ((sig >> np.uint64(7)) & np.uint64(15)).astype(np.uint8)


@_text.lean
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, bucket of each band, four bits of each coordinate); none for a text without words."""
    for b in _once(batches):
        raw, offs = _text.utf8(b.column(1))
        for first, _, r, o in _text.blocks(raw, offs):
            _, _, h, wo = _text.words(r, o)
            some = np.flatnonzero(np.diff(wo))
            sig = signatures(*weighted(h, wo))[some]
            d = _digits(sig)
            packed = d[:, ::2] | (d[:, 1::2] << 4)
            bands = sig.reshape(-1, BANDS, ROWS)
            bucket = np.zeros(bands.shape[:2], np.uint64)
            for k in range(ROWS):
                bucket = _text.mix(bucket * _COPY + bands[:, :, k])
            bucket = _text.mix(bucket + np.arange(BANDS, dtype=np.uint64))
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(bucket.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + some)), buckets, pa.array([x.tobytes() for x in packed], pa.binary())], names=["key", "buckets", "sig"])


def _links(sig: np.ndarray, left: range, right: range, similar: Callable[[int, np.ndarray], np.ndarray] | None = None, number: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (one of left, one of right) that agree in enough coordinates and are similar.

    With number, all pairs are looked at and added up in it for both ends; without it, not those already connected.
    """
    tree, out = np.arange(len(sig)), []
    for x in left:
        ys = np.arange(x + 1 if left == right else right.start, right.stop)
        if number is None:
            ys = ys[tree[ys] != tree[x]]
        ys = ys[(sig[ys] == sig[x]).mean(1) >= LEAST_AGREEMENT] if len(ys) else ys
        if len(ys) and similar:
            ys = ys[similar(x, ys)]
        if number is not None:
            number[x] += len(ys)
            number[ys] += 1
            ys = ys[tree[ys] != tree[x]]
        if len(ys):
            _, first = np.unique(tree[ys], return_index=True)
            out += [(x, int(y)) for y in ys[first]]
            tree[np.isin(tree, np.append(tree[ys[first]], tree[x]))] = tree[x]
    return out


@_text.lean
def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows (bucket, key, sig) of a part -> links between agreeing texts of one bucket, a forest per bucket.

    A part holds whole buckets.  Only the signatures are held, and a bucket is looked at in blocks.
    """
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    bucket = t["bucket"].to_numpy()
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    big = np.flatnonzero(np.diff(cut) > 1)
    keep = np.concatenate([order[cut[k] : cut[k + 1]] for k in big]) if len(big) else np.zeros(0, np.int64)
    keys, sigs = t["key"].take(pa.array(keep)).to_pylist(), t["sig"].take(pa.array(keep)).to_pylist()
    a, b, at = [], [], 0
    for m in np.diff(cut)[big].tolist():
        texts = dict(zip(keys[at : at + m], sigs[at : at + m], strict=True))  # a text may come from several tasks
        at += m
        if len(texts) > 1:
            names = sorted(texts)
            packed = np.frombuffer(b"".join(texts[k] for k in names), np.uint8).reshape(len(names), K // 2)
            for x, y in _links(np.hstack((packed & 15, packed >> 4)), range(len(names)), range(len(names))):
                a.append(names[x])
                b.append(names[y])
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _compare(t: pa.Table) -> pa.Table:
    """The rows (side, key, sig) of one block of a large bucket, or of two -> links between agreeing texts, a forest."""
    side = np.array(t["side"].to_pylist())
    t, side = t.take(pa.array(np.argsort(side, kind="stable"))), np.sort(side)
    n0 = int((side == 0).sum())
    left, right = range(n0), range(n0, len(side)) if n0 < len(side) else range(n0)
    keys, packed = t["key"].to_pylist(), np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(side), K // 2)
    found = _links(np.hstack((packed & 15, packed >> 4)), left, right)
    return pa.table({"a": pa.array([keys[x] for x, _ in found], pa.binary()), "b": pa.array([keys[y] for _, y in found], pa.binary())})


def _paired(rows: DataFrame, blocks: Column, *carry: str) -> DataFrame:
    """rows (key, carry) dealt to the pairs i <= j of so many blocks: adds i, j and side (0: of block i); a row goes to each pair that its block is in."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.select("key", *carry, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select("key", *carry, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))


def _verify(t: pa.Table) -> pa.Table:
    """The texts of one group, or of two blocks of it -> verified links: a forest (a, b), and each text's number (a, null, n)."""
    side = np.array(t["side"].to_pylist())
    order = np.argsort(side, kind="stable")
    t, side = t.take(pa.array(order)), side[order]
    raw, offs = _text.utf8(t["text"])
    g, c, go, sig = [], [], [np.zeros(1, np.int64)], []
    for _, _, r, o in _text.blocks(raw, offs):
        _, _, h, wo = _text.words(r, o)
        one = weighted(h, wo)
        sig.append(_digits(signatures(*one)))
        g.append(one[0])
        c.append(one[1])
        go.append(go[-1][-1] + one[2][1:])
    g, c, go, sig = np.concatenate(g), np.concatenate(c), np.concatenate(go), np.vstack(sig)
    ids = np.argsort(g)
    new = np.ones(len(g), np.int64)
    new[1:] = g[ids[1:]] != g[ids[:-1]]
    shingle = np.empty(len(g), np.int64)
    shingle[ids] = np.cumsum(new) - 1
    total = np.add.reduceat(c, go[:-1])
    mine = np.zeros(int(new.sum()), np.int64)

    def similar(x: int, ys: np.ndarray) -> np.ndarray:
        n, m = total[x], total[ys]
        out = np.minimum(n, m) >= THRESHOLD * np.maximum(n, m)
        ys, m = ys[out], m[out]
        if len(ys):
            own = shingle[go[x] : go[x + 1]]
            mine[own] = c[go[x] : go[x + 1]]
            size = go[ys + 1] - go[ys]
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            at = np.repeat(go[ys] - start, size) + np.arange(size.sum())
            both = np.add.reduceat(np.minimum(mine[shingle[at]], c[at]), start)
            mine[own] = 0
            out[out] = both >= THRESHOLD * (n + m - both)
        return out

    n0 = int((side == 0).sum())
    left, right = range(n0), range(n0, len(side)) if n0 < len(side) else range(n0)
    keys = t["key"].to_pylist()
    number = np.zeros(len(side), np.int64)
    found = _links(sig, left, right, similar, number)
    some = np.flatnonzero(number).tolist()
    return pa.table({"a": pa.array([keys[x] for x, _ in found] + [keys[x] for x in some], pa.binary()), "b": pa.array([keys[y] for _, y in found] + [None] * len(some), pa.binary()), "n": pa.array([0] * len(found) + number[some].tolist(), pa.int64())})


def text_links(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, n): keys of texts whose weighted similarity is THRESHOLD or more; texts of one class are connected by them.

    Rows without b give numbers n of the links of a text; its numbers add up to all its links.
    """
    source = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("key", text_key("text")).where("key IS NOT NULL").select("key", "text")
    parts = max(partitions(source, 16.0), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Signed once; copies are one row.
    signed = saved(source.mapInArrow(_sign, "key binary, buckets array<long>, sig binary").dropDuplicates(["key"]))
    rows = signed.select(F.explode("buckets").alias("bucket"), "key", "sig")
    large = saved(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_TEXTS))
    pair = "a binary, b binary"
    if large.isEmpty():
        near = rows.repartition(parts, "bucket").mapInArrow(_candidates, pair)
    else:
        near = rows.join(loose(large, "bucket"), "bucket", "left_anti").repartition(parts, "bucket").mapInArrow(_candidates, pair)
        split = _paired(rows.join(loose(large, "bucket"), "bucket"), F.ceil(F.col("n") / F.lit(BUCKET_TEXTS)), "bucket", "sig")
        near = near.unionByName(split.groupBy("bucket", "i", "j").applyInArrow(_compare, pair))
    groups = saved(components(near).withColumnsRenamed({"node": "key", "root": "grp"}))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    dealt = _paired(groups.join(loose(sizes, "grp"), "grp"), F.ceil(F.col("n") / F.lit(BLOCK_TEXTS)), "grp")
    texts = source.mapInArrow(_once, "key binary, text string").join(groups.select("key"), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    return dealt.join(texts, "key").select("grp", "i", "j", "side", "key", "text").groupBy("grp", "i", "j").applyInArrow(_verify, "a binary, b binary, n long")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(_id, _key) of every row, and per text: _key, _class, _links (to other texts), _n (copies), _least (their smallest id)."""
    links = saved(text_links(docs, text_col))
    ends = links.where("b IS NULL").groupBy(F.col("a").alias("_key")).agg(F.sum("n").alias("_links"))
    member = components(links).withColumnsRenamed({"node": "_key", "root": "_root"}).join(ends, "_key")
    keyed = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_key"))
    texts = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    return keyed, texts.join(member, "_key", "left").select("_key", "_n", "_least", F.coalesce("_root", "_key").alias("_class"), F.coalesce("_links", F.lit(0)).alias("_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, class_id (the smallest id of its class), class_size, links.

    A class is a connected component of the pairs of texts whose weighted Jaccard similarity over five-word shingles is
    0.8 or more, with all copies of a text.  links counts the other texts that the row's text is so similar to, plus its
    other copies.  A text of one to four words is one shingle; texts without words (the
    empty one too) are only like their exact copies; a null text is like nothing and its row is a class of its own.
    Null ids come after all others, so class_id is null only if all ids of the class are.
    """
    keyed, texts = _classes(docs, id_col, text_col)
    per = texts.groupBy("_class").agg(F.min("_least").alias("class_id"), F.sum("_n").alias("class_size"))
    texts = texts.join(per, "_class").select("_key", "class_id", "class_size", (F.col("_links") + F.col("_n") - 1).alias("links"))
    out = keyed.join(texts, "_key", "left")
    alone = F.col("_key").isNull()
    return out.select(F.col("_id").alias(id_col), F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near_duplicates: that with the smallest id (nulls last), one of those with equal ids.

    All columns stay.  Rows of null text all stay.
    """
    _, texts = _classes(docs, id_col, text_col)
    digest = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), text_key(text_col).alias("_key"), digest.alias("_row"))
    slim = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_key"), digest.alias("_row")).where("_key IS NOT NULL")
    best = F.min(F.struct(F.col("_id").isNull().alias("_none"), F.col("_id"), F.col("_row")))
    # Per text first, then per class: a group of copies is one row per task in the shuffle.
    first = slim.groupBy("_key").agg(best.alias("_best")).join(texts.select("_key", "_class"), "_key")
    first = first.groupBy("_class").agg(F.min(F.struct("_best._none", "_best._id", "_best._row", "_key")).alias("_b")).select("_b._key", "_b._row")
    once = rows.where("_key IS NOT NULL").join(first, ["_key", "_row"], "left_semi")
    same = Window.partitionBy("_key", "_row").orderBy("_row")
    once = once.withColumn("_nth", F.row_number().over(same)).where("_nth = 1")
    return once.select("_doc.*").union(rows.where("_key IS NULL").select("_doc.*"))
