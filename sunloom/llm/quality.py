"""Quality and toxicity classifier with hierarchical empirical-Bayes site evidence.

Document level: significant word log-odds (naive Bayes over hashed words) and
style figures feed one logistic head per target, fitted on a bounded sample of
labelled rows.  Site level: the heads' probabilities are summed per host and per
path under it; a path's mean is shrunk to its host's posterior and the host's to
the global prior, each by a variance of its own that the method of moments
estimates from the same grouped sums.  The two are combined on the logit scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import saved

BUCKETS = 1 << 20
#: Bytes of a longer word that are a feature too, so that inflected forms share evidence.
PREFIX = 5
TARGETS = ("quality", "toxic")
_STYLE = 9
#: Labelled rows that a fit looks at, in expectation; more than this are thinned by a hash of their id.
MAX_FIT_ROWS = 20_000


def _features(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows: (first, last, style matrix, row of each distinct word bucket, the buckets)."""
    raw, offs = _text.utf8(column)
    for first, last, r, o in _text.blocks(raw, offs):
        n = last - first
        s, e, h, wo = _text.words(r, o)
        cuts = o[:-1]
        length = np.maximum(np.diff(o), 1)

        def share(mask: np.ndarray, cuts=cuts, o=o, n=n) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return (total[o[1:]] - total[o[:-1]]).astype(float)

        upper, lower = share((r >= 65) & (r <= 90)), share((r >= 97) & (r <= 122))
        space = share((r == 32) | (r == 10))
        odd = share(((r >= 33) & (r <= 47) & (r != 44) & (r != 46) & (r != 39) & (r != 45)) | (r == 94) | (r == 126) | (r == 64))
        pipe, digit, bang = share(r == 124), share((r >= 48) & (r <= 57)), share(r == 33)
        count = np.diff(wo)
        row = np.repeat(np.arange(n), count)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        repeated = np.bincount(row, weights=same, minlength=n)
        long = np.flatnonzero(e - s > PREFIX)
        stem = np.zeros(len(long), np.uint64)
        for k in range(PREFIX):
            stem = (stem << np.uint64(8)) | _text.LOWER[r[s[long] + k]].astype(np.uint64)
        bucket = (np.concatenate((h, _text.mix(stem))) % np.uint64(BUCKETS)).astype(np.int64)
        key = np.sort(np.concatenate((row, row[long])) * BUCKETS + bucket)
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        distinct = np.bincount(key // BUCKETS, minlength=n)
        some = np.maximum(count, 1)
        style = np.column_stack((
            upper / np.maximum(upper + lower, 1), 10 * np.minimum(odd / some, 2), 10 * np.minimum(pipe / some, 1), np.minimum(digit / length, 1), np.minimum(bang / some, 2),
            repeated / some, distinct / some / (1 + some) ** -0.25 / 4, np.minimum(np.log1p(count), 9) / 5, space / length,
        ))
        yield first, last, style, key // BUCKETS, key % BUCKETS


class Model:
    """A fitted classifier: two tables of word weights with BUCKETS cells at most and two small heads, whatever the corpus."""

    def __init__(self, words: list[tuple[np.ndarray, np.ndarray]], mean: np.ndarray, scale: np.ndarray, heads: np.ndarray):
        self.words, self.mean, self.scale, self.heads = words, mean, scale, heads
        self._dense: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    @property
    def dense(self) -> list[np.ndarray]:
        """The word weights by bucket, made where they are used."""
        if self._dense is None:
            self._dense = [np.zeros(BUCKETS, np.float32) for _ in self.words]
            for table, (cells, values) in zip(self._dense, self.words, strict=True):
                table[cells] = values
        return self._dense

    @staticmethod
    def design(style: np.ndarray, evidence: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        z = np.clip((style - mean) / scale, -6, 6)
        return np.column_stack((z, z**2 / 4, np.clip(evidence, -12, 12) / 2, np.ones(len(z))))

    def predict(self, column: pa.Array) -> np.ndarray:
        """P(quality = 1), P(toxic = 1) per row."""
        out = np.empty((len(column), 2))
        for first, last, style, row, bucket in _features(column):
            for k in range(2):
                evidence = np.bincount(row, weights=self.dense[k][bucket], minlength=last - first)
                out[first:last, k] = 1 / (1 + np.exp(-np.clip(self.design(style, evidence, self.mean, self.scale) @ self.heads[k], -30, 30)))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + l2 * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS, min_support: int = 5, min_odds: float = 2.0) -> Model | None:
    """A Model from about max_rows labelled rows (all, if there are fewer), or None without both classes of a target.

    Labels with a null id or target are left out, ids labelled twice count once (largest values).
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("_quality"), F.max("toxic").cast("int").alias("_toxic"))
    n = known.count()
    if not n:
        return None
    keep = min(1.0, max_rows / n)
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.lit(round(keep * 1_000_000)))
    # Bounded by max_rows, so it can be sent to every task.  Copies of a text with the same labels are one example.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(known), "_id").select("_text", "_quality", "_toxic").distinct()

    @_text.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            style, starts, buckets = np.zeros((n, _STYLE)), [np.zeros(1, np.int64)], []
            for first, last, s, row, bucket in _features(b.column(0)):
                style[first:last] = s
                starts.append(starts[-1][-1] + np.cumsum(np.bincount(row, minlength=last - first)))
                buckets.append(bucket.astype(np.int32))
            offs, flat = np.concatenate(starts), np.concatenate(buckets) if buckets else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array([x.tobytes() for x in style], pa.binary()), pa.array([flat[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary()), b.column(1), b.column(2),
            ], names=["style", "buckets", "quality", "toxic"])

    # The sample is bounded, so one task fits it; only the model comes to the driver.
    features = rows.mapInArrow(run, "style binary, buckets binary, quality int, toxic int")
    solved = features.groupBy(F.lit("sample")).applyInArrow(lambda t: _solve(t, min_support, min_odds), "part string, cells binary, numbers binary").collect()
    got = {r["part"]: r for r in solved}
    if not got:
        return None
    number = lambda k: np.frombuffer(bytes(got[k]["numbers"]), np.float64)
    words = [(np.frombuffer(bytes(got[k]["cells"]), np.int32), number(k).astype(np.float32)) for k in TARGETS]
    return Model(words, number("mean"), number("scale"), number("heads").reshape(len(TARGETS), -1))


def _solve(t: pa.Table, min_support: int, min_odds: float) -> pa.Table:
    """The parts of a Model, of the features and labels of all sampled rows; none without both classes of a target."""
    keys = list(zip(t["style"].to_pylist(), t["buckets"].to_pylist(), strict=True))
    t = t.take(pa.array(sorted(range(len(keys)), key=keys.__getitem__)))  # in one order, however the rows were dealt
    y = np.column_stack([t[k].to_numpy() for k in TARGETS])
    out: list[tuple[str, bytes, bytes]] = []
    if len(y) >= 10 and all(len(np.unique(y[:, k])) == 2 for k in range(2)):
        style = np.vstack([np.frombuffer(x.as_buffer(), np.float64) for x in t["style"]])
        lists = [np.frombuffer(x.as_buffer(), np.int32) for x in t["buckets"]]
        step = 500  # rows at a time, so that little is held besides the rows themselves
        mean, scale = style.mean(0), style.std(0) + 1e-6
        heads = []
        for k, name in enumerate(TARGETS):
            both = np.zeros((2, BUCKETS), np.int32)
            for c in range(2):
                mine = [x for x, z in zip(lists, y[:, k], strict=True) if z == c]
                for at in range(0, len(mine), step):
                    both[c] += np.bincount(np.concatenate(mine[at : at + step]), minlength=BUCKETS).astype(np.int32)
            n0, n1 = (y[:, k] == 0).sum(), (y[:, k] == 1).sum()
            often = np.flatnonzero(both.sum(0) >= min_support)
            neg, pos = both[0][often] + 0.5, both[1][often] + 0.5
            odds = np.log(pos / (n1 + 1)) - np.log(neg / (n0 + 1))
            # What is left of the log-odds two standard errors nearer to 0; small ones only mirror lengths and topics.
            sure = np.abs(odds) - 2 * np.sqrt(1 / pos + 1 / neg)
            words = np.zeros(BUCKETS, np.float32)
            words[often] = np.where(sure >= min_odds, np.sign(odds) * sure, 0)
            evidence = np.array([words[x].sum(dtype=np.float64) for x in lists])
            heads.append(_logistic(Model.design(style, evidence, mean, scale), y[:, k].astype(float)))
            some = np.flatnonzero(words).astype(np.int32)
            out.append((name, some.tobytes(), words[some].astype(np.float64).tobytes()))
        out += [("mean", b"", mean.tobytes()), ("scale", b"", scale.tobytes()), ("heads", b"", np.array(heads).tobytes())]
    return pa.table({"part": pa.array([x[0] for x in out], pa.string()), "cells": pa.array([x[1] for x in out], pa.binary()), "numbers": pa.array([x[2] for x in out], pa.binary())})


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p) - F.log(1 - p)


def _posterior(paths: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(host, path, q_path, t_path) of the grouped sums (host, path, n, and for q and t the sum and the sum of squares), and the global means.

    Nested random effects by the method of moments: the variance within paths, that of paths within hosts and that of
    hosts each come from their own sum of squares.  A host's mean is shrunk to the global one by its own variance, a
    path's to its host's posterior by the paths'.
    """
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum(F.col("n") * F.col("n")).alias("h2"), *(F.sum(f"{k}1").alias(f"h{k}") for k in "qt"))
    one = lambda k, n: F.sum(F.col(k) * F.col(k) / F.col(n))
    low = paths.agg(F.sum("n").cast("double").alias("N"), F.count("*").alias("G"), F.sum(F.col("n") * F.col("n")).cast("double").alias("n2"), *(F.sum(f"{k}{i}").alias(f"{k}{i}") for k in "qt" for i in (1, 2)), *(one(f"{k}1", "n").alias(f"{k}b") for k in "qt")).first()
    high = hosts.agg(F.count("*").alias("H"), F.sum(F.col("h2") / F.col("hn")).alias("mixed"), F.sum(F.col("hn") * F.col("hn")).cast("double").alias("hn2"), *(one(f"h{k}", "hn").alias(f"{k}h") for k in "qt")).first()
    n = low["N"] or 1.0
    post, mid = paths.alias("p").join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))), {}
    for k in "qt":
        mean = (low[f"{k}1"] or 0.0) / n
        within = max(((low[f"{k}2"] or 0.0) - (low[f"{k}b"] or 0.0)) / max(n - low["G"], 1), 1e-9)
        of_paths = max(((low[f"{k}b"] or 0.0) - (high[f"{k}h"] or 0.0) - (low["G"] - high["H"]) * within) / max(n - (high["mixed"] or 0.0), 1), 0.0)
        of_hosts = max(((high[f"{k}h"] or 0.0) - n * mean * mean - (high["H"] - 1) * within - of_paths * ((high["mixed"] or 0.0) - (low["n2"] or 0.0) / n)) / max(n - (high["hn2"] or 0.0) / n, 1), 0.0)
        # The priors' weights in documents.
        path_weight, host_weight = (float(min(max(within / max(v, 1e-9), 10.0), 1e6)) for v in (of_paths, of_hosts))
        mid[k] = mean
        # A host's mean tells as much as this many independent documents: its paths differ by themselves.
        tells = F.col("hn") / (1 + of_paths / within * F.col("h2") / F.col("hn"))
        of_host = (tells * F.col(f"h{k}") / F.col("hn") + host_weight * mean) / (tells + host_weight)
        post = post.withColumn(f"{k}_path", (F.col(f"{k}1") + path_weight * of_host) / (F.col("n") + path_weight))
    return post.select("host", "path", "q_path", "t_path"), mid


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", min_quality: float = 0.5, max_toxic: float = 0.5, max_rows: int = MAX_FIT_ROWS, with_text: bool = True) -> DataFrame:
    """docs with all its columns and, per row, q_doc, q_path, q_score (quality), t_doc, t_path, t_score (toxicity), keep.

    *_doc is the document classifier's probability, *_path the posterior of its (host, path), *_score both combined:
    logit(doc) + logit(path) - logit(global).  keep: q_score >= min_quality and t_score <= max_toxic.  A null host or
    path is a value of its own.  Null and empty texts have no evidence of their own, so only their style (that of an
    empty text) counts.  Without labels of both classes of both targets nothing is known: q_* are 1, t_* 0, all are
    kept.  Columns of docs that have the names of ours are replaced by ours; others may have any name.  Repeated rows
    get equal results, an empty table an empty one.  without text (with_text=False: text_col is left out) the texts are
    gone through once and the scores written; with it they are scored again when the rows are read.
    """
    ours = ["q_doc", "q_path", "q_score", "t_doc", "t_path", "t_score", "keep"]
    old = [c for c in docs.columns if c.lower() not in ours and (with_text or c != text_col)]
    model = fit(docs, labels, id_col, text_col, max_rows)
    if model is None:
        one, zero = F.lit(1.0), F.lit(0.0)
        return docs.select(*(F.col(f"`{c}`") for c in old), *(one.alias(c) for c in ours[:3]), *(zero.alias(c) for c in ours[3:6]), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a bounded size: 2 * BUCKETS cells at most

    @_text.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.predict(b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(p[:, 0]), pa.array(p[:, 1])], names=[*b.schema.names[1:], "q_doc", "t_doc"])

    # The caller's columns travel in a structure, so that their names are apart from ours.
    text, host, path = (F.col(f"`{c}`").cast("string") for c in (text_col, host_col, path_col))
    site = [host.alias("host"), path.alias("path")]
    whole = F.struct(*(F.col(f"`{c}`") for c in old)).alias("doc")
    kept = docs.select(whole)
    rows = docs.select(text.alias("text"), *site, whole).mapInArrow(run, f"host string, path string, {kept.schema[0].simpleString().replace(':', ' ', 1)}, q_doc double, t_doc double")
    if with_text:
        slim = docs.select(text.alias("text"), *site).mapInArrow(run, "host string, path string, q_doc double, t_doc double")
    else:
        slim = rows = saved(rows)
    sums = [F.count("*").alias("n")] + [f(k).alias(f"{k[0]}{i}") for k in ("q_doc", "t_doc") for i, f in ((1, F.sum), (2, lambda c: F.sum(F.col(c) * F.col(c))))]
    post, mid = _posterior(saved(slim.groupBy("host", "path").agg(*sums)))
    post = post.withColumnsRenamed({"host": "_host", "path": "_path"})
    joined = rows.join(post, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left")

    def combined(k: str) -> Column:
        if not 0 < mid[k] < 1:
            return F.col(f"{k}_doc")
        logit = _logit(F.col(f"{k}_doc")) + _logit(F.col(f"{k}_path")) - _logit(F.lit(float(mid[k])))
        return 1 / (1 + F.exp(-logit))

    out = joined.withColumn("q_score", combined("q")).withColumn("t_score", combined("t"))
    out = out.withColumn("keep", (F.col("q_score") >= min_quality) & (F.col("t_score") <= max_toxic))
    return out.select(*(F.col("doc")[c].alias(c) for c in old), *ours)
