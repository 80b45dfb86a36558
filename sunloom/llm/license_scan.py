"""Licence scanning with a generalised suffix automaton of licence tokens.

The automaton of all templates is built once per task (its size is that of the
templates).  Every whole text is streamed through it: each word's matching
statistic is the longest template substring that ends there, for each template
that has one.  Maximal matches of at least MIN_MATCH words are chained, per
template, into covered spans.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-grant": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-notice": "licensed under the mit license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4.0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 8, 0.6


def _tokens(text: str) -> list[str]:
    raw = np.frombuffer(text.encode(), np.uint8)
    s, e, _, _ = _text.words(raw, np.array([0, len(raw)]))
    low = _text.LOWER[raw].tobytes()
    return [low[a:b].decode() for a, b in zip(s, e, strict=True)]


class SuffixAutomaton:
    """Generalised suffix automaton over token ids; states know all their end places in every template."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, list[int]]] = [{}]  # template -> its end positions, ascending
        for k, tokens in enumerate(templates):
            last = 0
            for pos, c in enumerate(tokens):
                last = self._extend(last, c)
                self.places[last].setdefault(k, []).append(pos)
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            up = self.places[self.link[s]]
            for k, pos in self.places[s].items():
                up[k] = sorted({*pos, *up.get(k, ())})

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.places.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int, list[int]]]:
        """(template, first, last, its end positions) of each template's matches of `least` tokens or more that are longest on both sides.

        The state after a token gives the longest match of any template; the states on its chain of suffix links give
        the shorter ones of the others, so a longer match of one template hides none of another.
        """
        out, state, length = [], 0, 0
        open_: dict[int, tuple[int, list[int]]] = {}  # template -> its match that ends at the token before
        for i, c in enumerate([*tokens, -1]):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            else:
                length = 0
            now: dict[int, tuple[int, list[int]]] = {}
            s, size = state, length
            while s > 0 and size >= least:
                for k, pos in self.places[s].items():
                    now.setdefault(k, (size, pos))
                s = self.link[s]
                size = self.length[s]
            out += [(k, i - size, i - 1, pos) for k, (size, pos) in open_.items() if now.get(k, (0,))[0] != size + 1]
            open_ = now
        return out


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None):
        templates, phrases = templates or TEMPLATES, phrases or PHRASES
        self.names = sorted(templates)
        lists = [_tokens(templates[k]) for k in self.names]
        self.sizes = [len(x) for x in lists]
        split = {p: _tokens(p) for p in phrases}
        vocabulary = sorted({w for x in [*lists, *split.values()] for w in x})
        self.ids = {w: k + 1 for k, w in enumerate(vocabulary)}
        blob = "\n".join(vocabulary).encode()
        h = _text.words(np.frombuffer(blob, np.uint8), np.array([0, len(blob)]))[2]
        order = np.argsort(h)
        self.hashes, self.of = h[order], (order + 1).astype(np.int32)
        self.automaton = SuffixAutomaton([[self.ids[w] for w in x] for x in lists])
        self.phrases = [(phrases[p], [self.ids[w] for w in x]) for p, x in split.items()]

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, words covered) of each chain of matches."""
        hit = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
        begin, end = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
        chains: dict[int, list[list[int]]] = {}
        for b, e in zip(begin, end, strict=True):
            if e - b < MIN_MATCH:
                continue
            for k, first, last, places in self.automaton.matches(ids[b:e].tolist(), MIN_MATCH):
                first, last = first + int(b), last + int(b)
                of = chains.setdefault(k, [])
                # The next place in the template at which the match can go on; a repeated phrase has several.
                at = bisect_right(places, of[-1][3]) if of else len(places)
                if at < len(places) and first - of[-1][1] <= MAX_GAP + 1:
                    of[-1][2] += max(0, last - max(first - 1, of[-1][1]))
                    of[-1][1], of[-1][3] = max(last, of[-1][1]), places[at]
                else:
                    of.append([first, last, last - first + 1, places[0]])
        return [(k, c[0], c[1], min(c[2], self.sizes[k])) for k, cs in sorted(chains.items()) for c in cs]

    def scan(self, column: pa.ChunkedArray) -> dict[str, list]:
        raw, offs = _text.utf8(column)
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for _, _, r, o in _text.blocks(raw, offs):
            _, _, h, wo = _text.words(r, o)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ids = np.where(self.hashes[at] == h, self.of[at], 0).astype(np.int32)
            doc = np.repeat(np.arange(len(o) - 1), np.diff(wo))
            found: dict[int, list[tuple[int, int, str]]] = {}
            for label, phrase in self.phrases:
                m = len(phrase)
                if len(ids) < m:
                    continue
                ok = doc[: len(doc) - m + 1] == doc[m - 1 :]
                for k, c in enumerate(phrase):
                    ok &= ids[k : len(ids) - m + 1 + k] == c
                for p in np.flatnonzero(ok):
                    d = int(doc[p])
                    found.setdefault(d, []).append((int(p - wo[d]), int(p - wo[d]) + m - 1, label))
            hits = np.concatenate(([0], np.cumsum(ids > 0)))
            dense = hits[wo[1:]] - hits[wo[:-1]]
            for d in range(len(o) - 1):
                base = found.get(d, [])
                spans = [s for s in self.spans(ids[wo[d] : wo[d + 1]]) if s[3] >= MIN_COVER * min(self.sizes[s[0]], 20)] if dense[d] >= MIN_MATCH else []
                labels = {x[2] for x in base}
                out["n_words"].append(int(wo[d + 1] - wo[d]))
                out["n_base"].append(len(base))
                out["first_word"].append(min((x[0] for x in base), default=None))
                out["last_word"].append(max((x[0] for x in base), default=None))
                out["base_labels"].append(",".join(sorted(labels)))
                out["labels"].append(",".join(sorted(labels | {self.names[s[0]] for s in spans})))
                out["score"].append(max([0.5 * bool(base), *(s[3] / self.sizes[s[0]] for s in spans)]))
                out["spans"].append([{"template": self.names[k], "first": a, "last": b, "covered": c} for k, a, b, c in spans])
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of the base phrases, first_word and last_word are their smallest and largest start
    (null without one).  spans holds the chains of template matches that cover 60 % of the template, or 12 words of a
    long one; their templates join the base labels in `labels`.  score: the largest covered share of a template, at
    least 0.5 with a base phrase, else 0.  Null is the empty text, which has no words, labels or spans.  Repeated rows
    and null ids each get their row, an empty table gives none; other columns are ignored.  No shuffle; one block of text is held at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    long = pa.int64()
    types = {"n_words": long, "n_base": long, "first_word": long, "last_word": long, "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("template", pa.string()), ("first", long), ("last", long), ("covered", long)]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for b in batches:
            got = scanner.scan(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[k], t) for k, t in types.items())], names=["_id", *types])

    out = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).mapInArrow(run, f"_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template: string, first: long, last: long, covered: long>>")
    return out.withColumnRenamed("_id", id_col)
