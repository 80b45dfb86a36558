"""Stupid-backoff language-model scores from corpus-wide n-gram tables.

The corpus is dealt into chunks by a hash of the row.  Each chunk sends every
distinct n-gram it holds (of one word up to `order` words) once, with its count,
to the part of the count table that owns the n-gram's hash range; that part adds
up the counts of all chunks and answers each chunk in the order asked.  A chunk
then joins its exploded n-grams with the answers and sums the scores per
document.  Rows of one chunk and one table part travel as one packed blob
(sorted hashes as differences, byte by byte, which compress), so a common word
pair costs one entry per chunk however often it occurs.  There are never more
blobs than n-grams: a part of which a chunk has nothing gets nothing from it.
A chunk's n-grams are dealt by hash into a few ranges, of which one at a time is
sorted and counted, and are scored block by block of text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import partitions, saved

_UNI, _NEXT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Counts from here on are answered apart from the one-byte ones.
_BIG = 255
#: Pieces of the hashes in which a chunk's n-grams are counted.
_RANGES = 32


def _instances(columns: Iterable[pa.Array], order: int) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Block by block of rows: its first row and the one after its last; for n = 1 ... order the hash of the n words that end at each word; how many of them are more than one word (n - 1 at most, fewer at a row's start); and the row of each word, from 0 in each block."""
    start = 0
    for column in columns:
        raw, offs = _text.utf8(column)
        for first, last, r, o in _text.blocks(raw, offs):
            _, _, h, wo = _text.words(r, o)
            row = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(wo))
            depth = np.minimum(np.arange(len(h)) - wo[row], order - 1).astype(np.int8)
            g, hashes = h, [_text.mix(h ^ _UNI)]
            for k in range(1, order):
                longer = g.copy()
                longer[1:] = _text.mix(g[:-1] * _NEXT + h[1:] + np.uint64(k - 1))
                g = longer
                hashes.append(g)
            yield start + first, start + last, hashes, depth, row
        start += len(column)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def _cuts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts (equal ranges of hashes) that sorted hashes fall into, and where each one's begin."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    return part[at].astype(np.int32), np.append(at, len(keys))


def _ranges(columns: Iterable[pa.Array], order: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct n-grams of all rows and their counts, sorted, in at most _RANGES pieces of whole parts: only one piece at a time is sorted or counted."""
    ends = np.array([-(-((k * parts // _RANGES) << 32) // parts) << 32 for k in range(1, _RANGES)], np.uint64)
    dealt: list[list[np.ndarray]] = [[] for _ in range(_RANGES)]
    for _, _, hashes, depth, _ in _instances(columns, order):
        x = np.sort(np.concatenate([h if not k else h[depth >= k] for k, h in enumerate(hashes)]))
        for to, piece in zip(dealt, np.split(x, np.searchsorted(x, ends)), strict=True):
            to.append(piece.copy())  # a view would keep the whole block
    for k, pieces in enumerate(dealt):
        dealt[k] = []
        if sum(map(len, pieces)):
            yield _distinct(np.concatenate(pieces))


def _pack(x: np.ndarray) -> bytes:
    """The bytes of whole numbers, first all lowest bytes, then all next ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unpack(x: bytes | pa.Buffer, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, len(x) // width).T).view(kind).ravel()


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.4, min_count: int = 2, chunk_mb: float = 6.0, order: int = 2) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, n_backoff, log_score (natural log, summed), score (log_score per token).

    The score of a word after its n - 1 predecessors is c(n words) / c(n - 1 predecessors) for the largest n up to
    `order` (up to its place in the document) whose n words occur min_count times, times alpha for each n left out; for
    n = 1 it is c(w) / N.  n_backoff counts the words for which an n was left out.  Counts are over all documents, the
    scored one included; min_count 2 makes words seen only here back off.  Null and empty texts, and those without a
    word, have n_tokens 0, log_score 0 and a null score.  Repeated rows each count and each get a row; null ids stay
    null; other columns are ignored; an empty table gives none.  chunk_mb (of stored input) sets how much text one task
    holds, and does not change results.
    """
    chunks = partitions(docs.select(id_col, text_col), chunk_mb)
    table_parts = 3 * chunks  # parts of the table: each holds what all chunks ask of it, so they are smaller than chunks
    id_type = docs.schema[id_col].dataType.simpleString()
    dealt = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_chunk", F.pmod(F.xxhash64("_text", "_id"), F.lit(chunks)).cast("int"))

    def ask(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _ranges((t.column("_text") for t in batches), order, table_parts):
            parts, cut = _cuts(keys, table_parts)
            ranges = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.record_batch({
                "part": pa.array(parts, pa.int32()), "_chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()),
                "keys": pa.array([_pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in ranges], pa.binary()),
                "counts": pa.array([_pack(counts[a:b].astype(np.uint32)) for a, b in ranges], pa.binary()),
            })

    def answer(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(x.as_buffer(), np.uint64), dtype=np.uint64) for x in t["keys"]]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        every = np.concatenate(keys)
        del keys
        by = np.argsort(every)
        every = every[by]
        new = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        times = np.diff(np.append(new, len(every)))
        del every
        counts = np.concatenate([_unpack(x.as_buffer(), np.uint32) for x in t["counts"]])
        total = np.add.reduceat(counts[by], new, dtype=np.int64)
        out = np.empty(len(by), np.int64)
        out[by] = np.repeat(total, times)
        pieces = np.split(out, cuts)
        return pa.table({
            "part": t["part"], "_chunk": t["_chunk"], "small": pa.array([np.minimum(x, _BIG).astype(np.uint8).tobytes() for x in pieces], pa.binary()),
            "big": pa.array([_pack(x[x >= _BIG]) for x in pieces], pa.binary()),
        })

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        tokens, back, unseen, logs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        parts = sorted(zip(right["part"].to_pylist(), right["small"], right["big"], strict=True), key=lambda x: x[0])
        small = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_buffer(), np.uint8) for _, x, _ in parts)])
        big = np.concatenate([np.zeros(0, np.int64), *(_unpack(x.as_buffer(), np.int64) for _, _, x in parts)])
        big_at = np.flatnonzero(small == _BIG)
        keys, known = np.empty(len(small), np.uint64), 0
        for x, _ in _ranges(left["_text"].chunks, order, table_parts):
            assert known + len(x) <= len(keys), "a part's answer is missing"
            keys[known : known + len(x)] = x
            known += len(x)
        assert known == len(keys), "a part's answer is missing"
        for first, last, hashes, depth, row in _instances(left["_text"].chunks, order):
            counts = []
            for k, h in enumerate(hashes):
                some = np.flatnonzero(depth >= k)
                some = some[np.argsort(h[some])]
                at = np.searchsorted(keys, h[some])
                found = small[at].astype(np.int64)
                more = np.flatnonzero(found == _BIG)
                found[more] = big[np.searchsorted(big_at, at[more])]
                c = np.zeros(len(h), np.int64)
                c[some] = found
                counts.append(c)
            used = np.zeros(len(row), np.int8)
            term = np.log(counts[0])
            for k in range(1, order):
                ok = np.flatnonzero((depth >= k) & (counts[k] >= min_count))
                used[ok] = k
                term[ok] = np.log(counts[k][ok]) - np.log(counts[k - 1][ok - 1])
            term += (depth - used) * math.log(alpha)
            tokens[first:last] = np.bincount(row, minlength=last - first)
            back[first:last] = np.bincount(row, weights=used < depth, minlength=last - first)
            unseen[first:last] = np.bincount(row, weights=used == 0, minlength=last - first)
            logs[first:last] = np.bincount(row, weights=term, minlength=last - first)
        return pa.table({"_id": left["_id"], "n_tokens": pa.array(tokens, pa.int64()), "n_backoff": pa.array(back, pa.int64()), "unseen": pa.array(unseen, pa.int64()), "logs": pa.array(logs, pa.float64())})

    asked = dealt.select("_chunk", "_id", "_text").groupBy("_chunk").applyInArrow(ask, "part int, _chunk int, keys binary, counts binary")
    told = asked.groupBy("part").applyInArrow(answer, "part int, _chunk int, small binary, big binary")
    summed = dealt.select("_chunk", "_id", "_text").groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(score, f"_id {id_type}, n_tokens long, n_backoff long, unseen long, logs double")
    summed = saved(summed)
    n = summed.agg(F.sum("n_tokens")).first()[0] or 1
    log_score = F.col("logs") - F.col("unseen") * F.lit(math.log(n))
    return summed.select(F.col("_id").alias(id_col), "n_tokens", "n_backoff", log_score.alias("log_score"), F.when(F.col("n_tokens") > 0, log_score / F.col("n_tokens")).alias("score"))
