"""Removal of every byte that a repeated 400-byte string covers.

Anchors: in every 400-byte string the leftmost smallest hash among its 128-byte
substrings marks an anchor; an anchor's context is what the strings that choose
it cover.  Equal strings have equal anchors at equal places, so two equal strings
lie in the contexts of two anchors with the same hash.  Anchors with a hash of
their own are done; equal contexts are one context from there on.

The strings of the different contexts of one hash are looked at in cells of
neighbouring starts.  Where the bytes that all strings of a cell share are unique,
none is repeated; where a whole cell is found twice, all are.  The different
cells that are left are suffix-sorted together (suffix_sort), and neighbours in
the suffix array that agree in 400 bytes are repeated strings.  Too many
different cells for one sort are halved, down to single strings; a hash with more
contexts than one task should hold is halved in the same way by a shuffle.

Joins on a hash have a plain exchange on either side, so that adaptive execution can split a hash that very many
places share.  The texts are dealt by their keys once: contexts are cut from, and digests made of, the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import loose, partitions, saved
from .suffix_sort import suffix_arrays

#: Bytes of a string that may not occur twice.
WINDOW = 400
#: Words of a passage that counts as shared if another document has it too, and of the strings by which it is found.
PASSAGE, PASSAGE_GRAM = 51, 32
#: Contexts of one hash that one task holds; more are split by a shuffle.
MOST_CONTEXTS = 40_000
#: Different cells that are sorted together; more are halved.
MOST_SORTED = 256
#: Bytes that a task sorts at once.
SORT_BYTES = 2 << 20
#: Neighbouring starts that are looked at together.
CELL = 32
_PIECE = 1 << 23


def text_key(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


@_text.lean
def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key of this task."""
    seen: set[bytes] = set()
    for b in batches:
        fresh = []
        for k, key in enumerate(b.column(0).to_pylist()):
            if key not in seen:
                seen.add(key)
                fresh.append(k)
        yield b if len(fresh) == b.num_rows else b.take(pa.array(fresh, pa.int64()))


def _by_key(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, text), each text once a task.  Joins on key that read both columns share one exchange of it: the null test is
    what the planner would add to some of them only."""
    source = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(_once, "key binary, text string").where("key IS NOT NULL")


def gram_of(window: int) -> int:
    """Bytes of the substrings whose hashes choose a window's anchor."""
    return window * 8 // 25


def _smallest(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for every i with a full window."""
    n = len(x)
    rows = -(-n // w)
    full = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    grid = full.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(raw: np.ndarray, offs: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of a block of texts of 2**24 bytes at most, the anchors: row, byte position in the row, hash, context's hash, the
    context's first byte relative to the position, and its number of bytes."""
    n, gram = len(raw), gram_of(window)
    if n < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    power, inverse = _text.powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = _text.mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    order = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    least = _smallest(order, window - gram + 1)
    whole = np.zeros(n + 1, np.int32)
    whole[offs[:-1][np.diff(offs) >= window]] += 1
    whole[(offs[1:] - window + 1)[np.diff(offs) >= window]] -= 1
    start = np.flatnonzero(np.cumsum(whole)[: len(least)] > 0)
    at = (least[start] & np.uint64(0xFFFFFF)).astype(np.int64)
    # The strings that choose an anchor start side by side; its context is what they cover.
    run = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    begin, end = start[run], start[np.append(run[1:], len(at))[: len(run)] - 1] + window
    at = at[run]
    row = np.searchsorted(offs, at, "right") - 1
    context = _text.mix((total[end] - total[begin]) * inverse[begin] + _text.mix(((at - begin) * 1024 + (end - at)).astype(np.uint64)))
    return row, at - offs[row], h[at], context, begin - at, end - begin


@_text.lean
def _find(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (hash, context, key, pos, low, size) of every anchor."""
    for b in _once(batches):
        raw, offs = _text.utf8(b.column(1))
        for first, _, r, o in _text.blocks(raw, offs):
            if len(r) <= 2 * _PIECE:
                got = [(*anchors(r, o, window), 0)]
            else:  # one very long text: overlapping pieces, each string of window bytes is whole in one
                got = [(*anchors(r[k : k + _PIECE + window - 1], np.array([0, min(_PIECE + window - 1, len(r) - k)]), window), k) for k in range(0, len(r), _PIECE)]
            for row, pos, h, context, low, size, shift in got:
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), b.column(0).take(pa.array(first + row)), pa.array(pos + shift, pa.int64()), pa.array(low, pa.int32()), pa.array(size, pa.int32())], names=["hash", "context", "key", "pos", "low", "size"])


@_text.lean
def _passages(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (hash, key): hashes of PASSAGE_GRAM words of a text, so dealt that every PASSAGE of words has one."""
    for b in _once(batches) if once else batches:
        raw, offs = _text.utf8(b.column(1))
        for first, _, r, o in _text.blocks(raw, offs):
            s, e, _, wo = _text.words(r, o)
            n = len(s) - PASSAGE_GRAM + 1
            row = np.repeat(np.arange(len(o) - 1), np.diff(wo))
            # Where a passage starts: it ends in the same text.
            start = np.flatnonzero(row[: len(row) - PASSAGE + 1] == row[PASSAGE - 1 :]) if len(row) >= PASSAGE else np.zeros(0, np.int64)
            if not len(start):
                continue
            power, inverse = _text.powers(len(r) + 1)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((r.astype(np.uint64) + np.uint64(1)) * power[: len(r)], dtype=np.uint64)))
            begin, end = s[:n], e[PASSAGE_GRAM - 1 :]
            h = _text.mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
            mask = np.uint64((1 << n.bit_length()) - 1)
            least = _smallest((h & ~mask) | np.arange(n, dtype=np.uint64), PASSAGE - PASSAGE_GRAM + 1)
            at = np.unique((least[start] & mask).astype(np.int64))
            order = np.lexsort((h[at], row[at]))
            at = at[order]
            at = at[np.concatenate(([True], (h[at[1:]] != h[at[:-1]]) | (row[at[1:]] != row[at[:-1]])))]  # within a text once
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), b.column(0).take(pa.array(first + row[at]))], names=["hash", "key"])


def shared_passages(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n): how many strings of PASSAGE_GRAM words, chosen by winnowing, a text (by its key) has in common with another row.

    A passage of PASSAGE words or more that another row has too, byte by byte, counts at least once; texts without n
    have none.  Copies of a text are other rows.
    """
    source = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = "hash long, key binary"
    often = source.mapInArrow(lambda it: _passages(it, False), kind).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    met = source.mapInArrow(lambda it: _passages(it, True), kind).join(loose(often, "hash"), "hash", "left_semi")
    return met.distinct().groupBy("key").agg(F.count("*").alias("n"))


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Which pairs of window bytes are equal, eight bytes at a time."""
    words = np.lib.stride_tricks.as_strided(np.append(text, np.zeros(8, np.uint8)), (len(text), 8), (1, 1))
    live = np.arange(len(a))
    for k in (0, window - 8, window // 2, *range(8, window - 8, 8)):
        x = words[a[live] + k].view(np.uint64).ravel() == words[b[live] + k].view(np.uint64).ravel()
        live = live[x]
        if not len(live):
            break
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def repeated_starts(slices: list[bytes], groups: np.ndarray, places: list[tuple[bytes, int]], multi: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each slice, the starts of its window-byte strings that occur at another place, in any slice of its group.

    places: (key, position) of a slice's first byte; a string found again at its own place, in an overlapping slice,
    isn't repeated.  multi: the slice itself stands at several places.  Slices of a group are adjacent.
    """
    cut = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    parts, offs, starts, at = [], [0], [], 0
    for a, b in zip(cut, np.append(cut[1:], len(slices)), strict=True):
        for k in range(a, b):
            starts.append(at)
            parts.append(slices[k])
            parts.append(b"\x00" if k < b - 1 else b"")
            at += len(slices[k]) + (k < b - 1)
        parts.append(b"\x00")
        at += 1
        offs.append(at)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    starts, lengths, offs = np.array(starts), np.array([len(x) for x in slices]), np.array(offs)
    text = raw.astype(np.int16) + np.int16(2)
    text[(starts + lengths)[:-1]] = 1  # between the slices of a group
    text[offs[1:] - 1] = 0
    order = suffix_arrays(text, offs)
    of = np.full(len(raw), -1, np.int32)
    windows = np.maximum(lengths - window + 1, 0)
    for k in range(len(slices)):
        of[starts[k] : starts[k] + windows[k]] = k
    # Only starts of whole strings matter, and equal ones are neighbours among these too.
    order = order[of[order] >= 0]
    whose = of[order]
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        near = np.flatnonzero(groups[whose[1:]] == groups[whose[:-1]])
        same[near + 1] = _equal(raw, order[near], order[near + 1], window)
    run = np.flatnonzero(~same)
    ids = {k: i for i, k in enumerate(dict.fromkeys(k for k, _ in places))}
    key = np.array([ids[k] for k, _ in places])[whose]
    pos = np.array([p for _, p in places])[whose] + order - starts[whose]
    place = key * (1 << 40) + pos
    hit = np.zeros(len(order), bool)
    if len(order):
        some = np.logical_or.reduceat(multi[whose], run) | (np.minimum.reduceat(place, run) != np.maximum.reduceat(place, run))
        hit = np.repeat(some, np.diff(np.append(run, len(order))))
    found, owner = order[hit] - starts[whose[hit]], whose[hit]
    by = np.lexsort((found, owner))
    return np.split(found[by], np.searchsorted(owner[by], np.arange(1, len(slices))))


def _spans(starts: np.ndarray, window: int) -> np.ndarray:
    """Merged [begin, end) of the window-byte strings at sorted starts, flat."""
    if not len(starts):
        return np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(starts) > window)
    return np.column_stack((starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))] + window)).ravel()


@_text.lean
def _sort_groups(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (core, sub, slice, key, start, multi, low), those of a core adjacent -> (core, sub, spans) with a repeated string."""
    left = window - gram_of(window)

    def solve(held: list[tuple]) -> pa.RecordBatch:
        starts: list[list[np.ndarray]] = [[] for _ in held]
        owner: list[list[int]] = []  # of each piece to sort: the rows that have it
        pieces, groups, places, multi = [], [], [], []

        def look(rows: list[int], a: int, z: int) -> None:
            """Starts a to z, counted from the first possible one, of rows with one hash."""
            shared: dict[bytes, dict[tuple[int, bytes], list[int]]] = {}
            for k in rows:
                data, low = held[k][2], held[k][6] + left
                lo, hi = max(a, low), min(z, low + len(data) - window)
                if lo <= hi:
                    whole = (lo, data[lo - low : hi - low + window])
                    shared.setdefault(data[z - low : a - low + window], {}).setdefault(whole, []).append(k)
            for contents in shared.values():
                for (lo, whole), own in contents.items():
                    if len(own) > 1 or held[own[0]][5]:
                        for k in own:
                            at = lo - held[k][6] - left
                            starts[k].append(np.arange(at, at + len(whole) - window + 1))
                if 1 < len(contents) <= MOST_SORTED or len(contents) > 1 and a == z:
                    for (lo, whole), own in contents.items():
                        k = own[0]
                        owner.append(own)
                        pieces.append((lo, whole))
                        groups.append(look.group)
                        places.append((held[k][3], held[k][4] + lo - held[k][6] - left))
                        multi.append(len(own) > 1 or bool(held[k][5]))
                    look.group += 1
                elif len(contents) > 1:
                    more = [k for own in contents.values() for k in own]
                    look(more, a, (a + z) // 2)
                    look(more, (a + z) // 2 + 1, z)

        look.group = 0
        first = 0
        for k in range(1, len(held) + 1):
            if k == len(held) or held[k][0] != held[first][0]:
                for a in range(0, left + 1, CELL):
                    look(list(range(first, k)), a, min(a + CELL - 1, left))
                first = k
        at = 0
        while at < len(pieces):  # as many whole groups at once as SORT_BYTES allow
            end, size = at, 0
            while end < len(pieces) and (size < SORT_BYTES or groups[end] == groups[end - 1]):
                size += len(pieces[end][1])
                end += 1
            got = repeated_starts([whole for _, whole in pieces[at:end]], np.array(groups[at:end]), places[at:end], np.array(multi[at:end], bool), window)
            for (lo, _), own, x in zip(pieces[at:end], owner[at:end], got, strict=True):
                for k in own if len(x) else ():
                    starts[k].append(x + (lo - held[k][6] - left))
            at = end
        rows = [(x[0], x[1], _spans(np.unique(np.concatenate(y)), window).tolist()) for x, y in zip(held, starts, strict=True) if y]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["core", "sub", "spans"])

    held: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if size > SORT_BYTES and row[0] != held[-1][0]:
                yield solve(held)
                held, size = [], 0
                _text.given_back()
            held.append(row)
            size += len(row[2])
    if held:
        yield solve(held)


@_text.lean
def _split(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (hash, context, slice, key, start, multi, low, core) -> the same, and sub, for both halves of their strings.

    Equal strings with one anchor start at the same place relative to it, so the places are cut at fixed points; low is
    the first start of a slice relative to its anchor.  A half's core is what all its possible strings share.
    """
    left = window - gram_of(window)
    names = ["hash", "context", "slice", "key", "start", "multi", "low", "core", "sub"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]
    for b in batches:
        out = []
        for h, context, data, key, start, multi, low, core in zip(*(c.to_pylist() for c in b.columns), strict=True):
            depth = core[0] + 1
            width = (1 << left.bit_length()) >> depth
            at, end = low, low + len(data) - window
            while at <= end:
                cell = (at + left) // width
                a, z = cell * width - left, (cell + 1) * width - 1 - left  # the cell's starts, relative to the anchor
                to = min(z, end)
                part = data[at - low : to - low + window]
                share = hashlib.blake2b(data[z - low : a - low + window] + bytes([cell & 255, cell >> 8]), digest_size=16).digest()
                sub = hashlib.blake2b(part + (at + left).to_bytes(2, "little"), digest_size=16).digest()
                out.append((h, context, part, key, start + at - low, multi, at, bytes([depth]) + share, sub))
                at = to + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)


def repeated_spans(docs: DataFrame, text_col: str = "text", window: int = WINDOW, texts: DataFrame | None = None) -> DataFrame:
    """(key, begin, end): bytes of each text (by its key) that a repeated string of `window` bytes covers; spans may overlap.

    Copies of a text are one text here: what stands in a single text, once, isn't reported.  texts: _by_key of docs, if
    the caller joins it too.
    """
    spark = docs.sparkSession
    source = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = source.mapInArrow(lambda it: _find(it, window), "hash long, context long, key binary, pos long, low int, size int")
    parts = max(partitions(source, 24.0), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Hashes that occur once are most; they are found by counting, which is partly done before the shuffle.
    often = found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    many = loose(saved(found.join(loose(often, "hash"), "hash", "left_semi")), "hash")
    place = F.struct("key", "pos")
    contexts = many.groupBy("hash", "context").agg(F.min(F.struct("key", "pos", "low", "size")).alias("one"), F.max(place).alias("last"))
    contexts = contexts.select("hash", "context", "one.*", ((F.col("one.key") != F.col("last.key")) | (F.col("one.pos") != F.col("last.pos"))).alias("multi"))
    counted = contexts.groupBy("hash").agg(F.count("*").alias("c"))
    contexts = saved(loose(contexts, "hash").join(loose(counted, "hash"), "hash").where("c > 1 OR multi"))
    spans = [contexts.where("c = 1").select("hash", "context", F.array(F.col("low").cast("long"), (F.col("low") + F.col("size")).cast("long")).alias("spans"))]
    # The different contexts of a hash get their bytes from the texts.
    texts = _by_key(docs, text_col) if texts is None else texts
    wanted = contexts.where("c > 1").select("hash", "context", "key", "multi", "low", "size", "pos", "c")
    texts = texts.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    start = F.col("pos") + F.col("low")
    data = F.expr("substring(cast(text AS binary), cast(pos + low + 1 AS int), size)")
    core = F.concat(F.lit(bytearray(b"\0")), F.unhex(F.lpad(F.hex("hash"), 16, "0")))
    level = wanted.join(texts, "key").select("hash", "context", data.alias("slice"), "key", start.alias("start"), "multi", "low", core.alias("core"), F.unhex(F.lpad(F.hex("context"), 16, "0")).alias("sub"), "c")
    if wanted.where(F.col("c") > MOST_CONTEXTS).isEmpty():
        hot = None
    else:
        level = saved(level)
        hot = level.where(F.col("c") > MOST_CONTEXTS).drop("c", "sub")
        level = level.where(F.col("c") <= MOST_CONTEXTS)
    one = ["core", "sub", "slice", "key", "start", "multi", "low"]
    spread = lambda df: df.select(*one).repartition(parts, "core").sortWithinPartitions("core").mapInArrow(lambda it: _sort_groups(it, window), "core binary, sub binary, spans array<long>")
    shifted = F.transform("spans", lambda x: x + F.col("low"))
    solved = spread(level).withColumn("hash", F.conv(F.hex(F.expr("substring(core, 2, 8)")), 16, -10).cast("long")).withColumn("context", F.conv(F.hex("sub"), 16, -10).cast("long"))
    spans.append(solved.join(contexts.select("hash", "context", "low"), ["hash", "context"]).select("hash", "context", shifted.alias("spans")))
    while hot is not None:
        halves = saved(hot.mapInArrow(lambda it: _split(it, window), "hash long, context long, slice binary, key binary, start long, multi boolean, low int, core binary, sub binary"))
        once = halves.groupBy("core", "sub").agg(F.min(F.struct("key", "start", "slice", "low")).alias("m"), F.max(F.struct("key", "start")).alias("x"), F.max("multi").alias("multi"))
        once = once.select("core", "sub", "m.slice", "m.key", "m.start", "m.low", (F.col("multi") | (F.col("m.key") != F.col("x.key")) | (F.col("m.start") != F.col("x.start"))).alias("multi"))
        sizes = once.groupBy("core").agg(F.count("*").alias("c"), F.max("multi").alias("any")).where("c > 1 OR any")
        rows = halves.select("hash", "context", "low", "core", "sub", F.length("slice").cast("long").alias("len"))
        once = once.join(sizes.select("core", "c"), "core")
        alone = once.where("c = 1 AND multi").select("core", "sub")
        spans.append(rows.join(alone, ["core", "sub"]).select("hash", "context", F.array(F.col("low").cast("long"), F.col("low") + F.col("len")).alias("spans")))
        spans.append(spread(once.where((F.col("c") > 1) & (F.col("c") <= MOST_CONTEXTS))).join(rows, ["core", "sub"]).select("hash", "context", shifted.alias("spans")))
        large = sizes.where(F.col("c") > MOST_CONTEXTS).select("core")
        hot = None if large.isEmpty() else halves.join(large, "core", "left_semi").select("hash", "context", "slice", "key", "start", "multi", "low", "core")
    every = spans[0]
    for x in spans[1:]:
        every = every.unionByName(x)
    flat = many.select("hash", "context", "key", "pos").join(loose(every, "hash"), ["hash", "context"])
    pair = F.explode(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)))
    return flat.where(F.size("spans") > 0).select("key", "pos", "spans", pair.alias("k")).select("key", (F.col("pos") + F.get("spans", F.col("k"))).alias("begin"), (F.col("pos") + F.get("spans", F.col("k") + 1)).alias("end"))


def _info(docs: DataFrame, text_col: str, window: int, texts: DataFrame | None = None) -> DataFrame:
    """(key, _spans, _copied): the flat spans of a text (null: none), and whether the whole text has a copy (null: no)."""
    spans = repeated_spans(docs, text_col, window, texts).groupBy("key").agg(F.flatten(F.array_sort(F.collect_set(F.array("begin", "end")))).alias("_spans"))
    copied = docs.select(text_key(text_col).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("_copied"))
    return spans.join(copied, "key", "full_outer")


def _kept(raw: np.ndarray, spans: list[int] | None, copied: bool, window: int) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal removed runs of one text, and what is left of it."""
    n = len(raw)
    if copied and n >= window:
        return [(0, n)], b""
    runs: list[list[int]] = []
    for a, b in sorted(zip((spans or [])[::2], (spans or [])[1::2], strict=True)):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    keep, at = [], 0
    for a, b in runs:
        keep.append(raw[at:a].tobytes())
        at = b
    keep.append(raw[at:].tobytes())
    return [(a, b) for a, b in runs], b"".join(keep)


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, n_shared, as of the UTF-8 bytes of whole texts.

    Removed is each byte that a string of `window` bytes covers which also starts anywhere else, in this or another row;
    a repeated row is another row.  Null is the empty text; texts under `window` bytes lose nothing.  n_shared tells
    passages of over 50 words that other rows have too, whatever their bytes: the number of strings that shared_passages
    finds, 0 for none.  Other columns are ignored, null and repeated ids keep their rows, an empty table gives none.
    """

    @_text.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _once(batches):
            raw, offs = _text.utf8(b.column(1))
            removed, count, sha = [], [], []
            for k, (spans, copied) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                runs, left = _kept(raw[offs[k] : offs[k + 1]], spans, bool(copied), window)
                removed.append(sum(y - x for x, y in runs))
                count.append(len(runs))
                sha.append(hashlib.sha256(left).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs), pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.binary()), b.column(4)], names=["key", "n_bytes", "n_removed", "n_spans", "sha", "n_shared"])

    texts = _by_key(docs, text_col)
    info = _info(docs, text_col, window, texts).join(shared_passages(docs, text_col).withColumnRenamed("n", "_shared"), "key", "full_outer")
    marked = texts.join(info, "key", "left").select("key", "text", "_spans", "_copied", F.coalesce("_shared", F.lit(0)).cast("long").alias("_shared"))
    # A text comes once from each task that read it, and so may its digest.
    digests = marked.mapInArrow(run, "key binary, n_bytes long, n_removed long, n_spans long, sha binary, n_shared long").dropDuplicates(["key"])
    rows = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("key"))
    out = rows.join(loose(digests, "key"), "key")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.lower(F.hex("sha")).alias("kept_sha256"), "n_shared")


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the bytes that repeated strings of `window` bytes cover taken out of text_col, all other columns as they are.

    A character that lost some of its bytes goes as a whole.  Null texts stay null.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text_col)

    @_text.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.column(0).flatten()
            raw, offs = _text.utf8(b.column(1))
            text = []
            for k, (null, spans, copied) in enumerate(zip(columns[at].is_null().to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                text.append(None if null else _kept(raw[offs[k] : offs[k + 1]], spans, bool(copied), window)[1].decode("utf-8", "ignore"))
            columns[at] = pa.array(text, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")
    rows = docs.select(row, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), text_key(text_col).alias("key"))
    return rows.join(_info(docs, text_col, window), "key", "left").select("_row", "_text", "_spans", "_copied").mapInArrow(run, kinds)
