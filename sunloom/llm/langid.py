"""Language identification of mixed-language text: script ranges, per-word scores, Viterbi spans.

Letters' script ranges say which of the learned languages a word may belong to.
A word's score for each is its naive-Bayes log-likelihood over hashed character
trigrams.  Viterbi with a switching penalty labels every word; the language with
most letters is the document's.  A text in which no stretch of words gains as
much as its switches cost has one span, and is told so without the word-by-word
search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed character trigrams; the model holds those that a language has.
CELLS = 1 << 16
PENALTY = 12.0
#: Languages whose dense sums a task of the fit holds at once; before another one it emits them and starts anew.
HELD_LANGS = 64
_RANGES = [(0x41, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0x590, 0x5FF), (0x600, 0x77F), (0x900, 0x97F), (0xE00, 0xE7F), (0x1100, 0x11FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0x1E00, 0x1EFF)]
_SAME = {12: 0, 8: 11}
SCRIPTS = len(_RANGES) + 1
_CHUNK = 1 << 18
_POINTS = 0x110000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter, and its script (the last number: any other)."""
    letter = np.array([chr(c).isalpha() for c in range(_POINTS)])
    script = np.full(_POINTS, SCRIPTS - 1, np.int8)
    for k, (a, b) in enumerate(_RANGES):
        script[a : b + 1] = _SAME.get(k, k)
    return letter, script


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.lower() for t in texts]
    raw = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return raw, np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))


class Words:
    """The words (runs of letters) of a block of texts, with the trigram cells of each: ' ab', 'abc', 'bc '."""

    letter: np.ndarray | None = None
    script: np.ndarray

    def __init__(self, texts: list[str]):
        if Words.letter is None:
            Words.letter, Words.script = _tables()
        codes, offs = _codes(texts)
        inside = Words.letter[codes]
        n = len(codes)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offs[:-1][offs[:-1] < n]] = False
        after[offs[1:][offs[1:] > 0] - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.offs = np.searchsorted(self.starts, offs)
        self.size = self.ends - self.starts
        c = codes.astype(np.uint64)
        left, right = np.where(before, np.roll(c, 1), 0), np.where(after, np.roll(c, -1), 0)
        key = (left * np.uint64(0x9E3779B97F4A7C15) + c) * np.uint64(0xBF58476D1CE4E5B9) + right
        key ^= key >> np.uint64(31)
        key *= np.uint64(0x94D049BB133111EB)
        self.cells = (key >> np.uint64(48)).astype(np.int32)[inside]
        self.cuts = np.concatenate(([0], np.cumsum(self.size)))
        self.scripts = Words.script[codes[self.starts]] if n else np.zeros(0, np.int8)


def _blocks(column: pa.Array, most: int = _CHUNK) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for k, x in enumerate(column):
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


class Model:
    """Languages, their trigrams' log-likelihoods and the scripts' languages, SCRIPTS by languages.

    logs: for each language the value of the cells that it lacks, its cells and their values.
    """

    def __init__(self, langs: list[str], logs: list[tuple[np.float32, np.ndarray, np.ndarray]], allowed: np.ndarray):
        self.langs, self.logs, self.allowed = langs, logs, allowed

    def scores(self, w: Words) -> np.ndarray:
        """Words by languages: mean-free log-likelihoods; a language outside the word's script is far behind."""
        out = np.empty((len(w.size), len(self.langs)), np.float32)
        if not self.langs:
            return out
        dense = np.empty(CELLS, np.float32)
        for k, (lacking, cells, values) in enumerate(self.logs):
            dense[:] = lacking
            dense[cells] = values
            total = np.concatenate(([0.0], np.cumsum(dense[w.cells], dtype=np.float64)))
            out[:, k] = total[w.cuts[1:]] - total[w.cuts[:-1]]
        narrowed = self.allowed[w.scripts]
        known = narrowed.any(1)
        out -= out.max(1, keepdims=True)
        # No word says more than this, so that one odd word does not outweigh its neighbours.
        np.maximum(out, -8.0, out=out)
        out[~narrowed & known[:, None]] = -8.0
        out[~known] = 0.0
        return out

    def label(self, scores: np.ndarray) -> np.ndarray:
        """The language of each word of one text.

        Each switch is paid half by the stretch before it and half by the one after it, so a stretch at either end of the
        text pays half a penalty and one between others a whole one.  If none gains that much over the language that is
        best overall, no labelling with switches is as good as that language alone, whether or not it uses it.
        """
        best = int(np.argmax(scores.sum(0)))
        gain = scores - scores[:, best : best + 1]
        run = np.concatenate((np.zeros((1, gain.shape[1])), np.cumsum(gain, 0, dtype=np.float64)))
        ends = np.maximum(run.max(0), (run[-1] - run).max(0))
        if (ends < PENALTY / 2).all() and ((run - np.minimum.accumulate(run, 0)).max(0) < PENALTY).all():
            return np.full(len(scores), best)
        value, back = scores[0].astype(np.float64), np.empty(scores.shape, np.int32)
        here = np.arange(scores.shape[1])
        for t in range(1, len(scores)):
            top = int(np.argmax(value))
            stay = value >= value[top] - PENALTY
            back[t] = np.where(stay, here, top)
            value = np.where(stay, value, value[top] - PENALTY) + scores[t]
        out = np.empty(len(scores), np.int64)
        out[-1] = np.argmax(value)
        for t in range(len(scores) - 1, 0, -1):
            out[t - 1] = back[t][out[t]]
        return out

    def predict(self, texts: list[str], spans: bool = False) -> list[tuple[str, float, list | None]]:
        """(language, score, spans as (language, first word, last word)) of each text."""
        w = Words(texts)
        scores, out = self.scores(w), []
        for a, b in zip(w.offs[:-1], w.offs[1:], strict=True):
            if a == b or not self.langs:
                out.append(("und", 0.0, [] if spans else None))
                continue
            labels = self.label(scores[a:b])
            weight = np.bincount(labels, weights=w.size[a:b], minlength=len(self.langs))
            k = int(np.argmax(weight))
            margin = scores[a:b].sum(0, dtype=np.float64)
            others = np.exp(np.clip(margin - margin[k], -50, 50)).sum()
            runs = None
            if spans:
                cut = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]))
                runs = [(self.langs[labels[x]], int(x), int(y) - 1) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            out.append((self.langs[k], float(min(weight[k] / weight.sum(), 1.0) * min(1.0, max(1 / others, 1e-6))), runs))
        return out


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A Model from every row of train with a text and a language.

    Every language is learned.  Each task adds up its trigram cells per language, HELD_LANGS at a time; the table of
    sums has the cells that a language holds, CELLS and SCRIPTS at most.
    """
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    width = CELLS + SCRIPTS

    def emit(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([x] * (len(at) + 1), pa.string()), pa.array(np.append(at, width)), pa.array(np.append(own[at], 0.0))], names=["lang", "cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            lang = b.column(1).to_pylist()
            for first, texts in _blocks(b.column(0)):
                w = Words(texts)
                mine = lang[first : first + len(texts)]
                names = sorted(set(mine))
                place = {x: k for k, x in enumerate(names)}
                word_lang = np.repeat(np.array([place[x] for x in mine]), np.diff(w.offs))
                cell_lang = np.repeat(word_lang, w.size)
                # The words and cells of a language side by side, so that many languages take one pass.
                by_word, by_cell = np.argsort(word_lang, kind="stable"), np.argsort(cell_lang, kind="stable")
                word_cut, cell_cut = (np.searchsorted(x, np.arange(len(names) + 1), sorter=y) for x, y in ((word_lang, by_word), (cell_lang, by_cell)))
                for k, x in enumerate(names):
                    if x not in sums:
                        if len(sums) >= HELD_LANGS:
                            yield from emit(sums)
                            sums.clear()
                        sums[x] = np.zeros(width)
                    sums[x][:CELLS] += np.bincount(w.cells[by_cell[cell_cut[k] : cell_cut[k + 1]]], minlength=CELLS)
                    sums[x][CELLS:] += np.bincount(w.scripts[by_word[word_cut[k] : word_cut[k + 1]]], minlength=SCRIPTS)
        yield from emit(sums)

    # (A language's row of cell `width` stands for itself, also if its texts have no word.)
    got = rows.mapInArrow(run, "lang string, cell long, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    name, cell, n = got["lang"].combine_chunks().dictionary_encode(), got["cell"].to_numpy(), got["n"].to_numpy()
    if isinstance(name, pa.ChunkedArray):
        name = name.combine_chunks()
    code, found = name.indices.to_numpy(zero_copy_only=False), name.dictionary.to_pylist()
    order = np.argsort(code, kind="stable")
    cut = np.searchsorted(code, np.arange(len(found) + 1), sorter=order)
    ranked = sorted(range(len(found)), key=lambda k: found[k])
    logs, allowed = [], np.zeros((SCRIPTS, len(found)), bool)
    for j, k in enumerate(ranked):
        at = order[cut[k] : cut[k + 1]]
        at = at[cell[at] < width]
        own = np.zeros(width)
        own[cell[at]] = n[at]
        smooth = own[:CELLS] + 0.05
        values = np.log(smooth / smooth.sum()).astype(np.float32)
        cells = np.flatnonzero(own[:CELLS])
        logs.append((np.float32(np.log(0.05 / smooth.sum())), cells.astype(np.uint16), values[cells]))
        scripts = own[CELLS:]
        allowed[:, j] = scripts / max(scripts.sum(), 1) >= 0.01
    return Model([found[k] for k in ranked], logs, allowed)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score and, on request, spans (lang, first word, last word).

    A text that is null, empty or without a letter, and any text when nothing was learned, is `und` with score 0 and no
    spans.  score is the share of the letters in the language times its posterior.  Other columns are not looked at;
    null and repeated ids keep their rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the cells that each language holds
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Scores are words by languages: beyond 64 languages fewer words at once.
        most = min(_CHUNK, _CHUNK * 64 // max(len(shared.value.langs), 1))
        for b in batches:
            got = [x for _, texts in _blocks(b.column(1), most) for x in shared.value.predict(texts, spans)]
            columns = [b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            if spans:
                columns.append(pa.array([[{"lang": a, "first": f, "last": l} for a, f, l in x[2]] for x in got], span_type))
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "lang_pred", "score", *(["spans"] if spans else [])])

    schema = f"_id {kind}, lang_pred string, score double" + ", spans array<struct<lang: string, first: long, last: long>>" * spans
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
