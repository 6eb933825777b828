"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A block matches a template if it holds at least `threshold` of the template's different words. Blocks
are lines, and for templates of LONG or more different words paragraphs (runs of lines up to a blank
one) too. With `wrapped`, templates of fewer words are sought in paragraphs as well, in every run of as many
successive words as the template has, so that line breaks inside a notice don't hide it. Template words are ordered by document frequency over the whole corpus, rarest first. Of a
template of n words that needs k, any match has one of the first n-k+1 in its block (prefix filter),
at least k different words (length filter), and at its first common word, the i-th, n-i+1 >= k
(positional filter). What passes is counted exactly, so no match is lost.

Null and empty texts have no words, places or labels and score 0. Repeated rows give repeated rows. An
empty table gives no rows. Very long texts are read whole. Only id and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import map_steps, texts_of, utf8

THRESHOLD, LONG = 0.8, 16
#: A-Z to a-z; other ASCII that isn't a letter or digit, newlines too, to a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, notice or grant text), the opening words of public licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def frequencies(docs: DataFrame, vocabulary: set[bytes], id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each word of a (template-sized) vocabulary occurs."""

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in utf8(batch.column("text")):
                total.update(vocabulary.intersection(words_of(text)))
        yield pa.record_batch([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    found = texts_of(docs, id_col, text_col).select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in found}


class Join:
    """The templates' side of the join, indexed by their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        self.templates, self.lengths, self.index = [], [], defaultdict(list)
        for label, text in templates:
            words = sorted(set(words_of(text.encode())), key=lambda w: (frequency.get(w, 0), w))
            need = max(1, math.ceil(threshold * len(words) - 1e-9))
            for i, word in enumerate(words[: len(words) - need + 1]):
                self.index[word].append((len(self.templates), i))
            self.templates.append((label, words, need))
            self.lengths.append(len(words_of(text.encode())))
        self.prefixes = frozenset(self.index)

    def matches(self, words: set[bytes], short: bool) -> list[tuple[int, float]]:
        """(template, containment) of those that the block's words meet; short: of fewer than LONG words too."""
        first: dict[int, int] = {}
        for word in self.prefixes.intersection(words):
            for t, i in self.index[word]:
                first[t] = min(i, first.get(t, i))
        out = []
        for t, i in first.items():
            _, mine, need = self.templates[t]
            if (short or len(mine) >= LONG) and len(words) >= need and len(mine) - i >= need:
                n = len(words.intersection(mine[i:]))
                if n >= need:
                    out.append((t, n / len(mine)))
        return out

    def wrapped(self, words: list[bytes], have: set[bytes]):
        """(template, containment) of those of fewer than LONG words that a run of a paragraph's words meets, at its best."""
        for t in {t for word in self.prefixes.intersection(have) for t, _ in self.index[word]}:
            _, mine, need = self.templates[t]
            if len(mine) >= LONG or len(have.intersection(mine)) < need:
                continue
            wanted, length, held, best = frozenset(mine), self.lengths[t], Counter(), 0
            for i, word in enumerate(words):
                if word in wanted:
                    held[word] += 1
                if i >= length and words[i - length] in wanted:
                    held[words[i - length]] -= 1
                    if not held[words[i - length]]:
                        del held[words[i - length]]
                best = max(best, len(held))
            if best >= need:
                yield t, best / len(mine)


_BLANK = re.compile(rb"\n[ \t\r\x0b\x0c]*\n")


def blocks(text: bytes):
    """(different words, all words in order, whether it is a line) of every line and paragraph."""
    for part in _BLANK.split(text):
        lines = [words_of(line) for line in part.split(b"\n")]
        for line in lines:
            yield set(line), line, True
        if len(lines) > 1:
            words = [word for line in lines for word in line]
            yield set(words), words, False


def places(words: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase stands."""
    out = []
    for last in {p[-1] for p in phrases}:
        at = -1
        while True:
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            for phrase, label in phrases.items():
                start = at - len(phrase) + 1
                if start >= 0 and phrase[-1] == last and tuple(words[start : at + 1]) == phrase:
                    out.append((start, label))
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", wrapped: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, templates.

    score: 1 with a phrase, else the largest containment of a match, else 0. templates: the places in
    the template list of those met, in order.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    vocabulary = {w for _, t in templates for w in words_of(t.encode())}
    join = Join(templates, frequencies(docs, vocabulary, id_col, text_col), threshold)
    sought = {tuple(p.encode().split()): label for p, label in phrases.items()}
    ends = {p[-1] for p in sought}

    def one(text: bytes) -> tuple:
        words = words_of(text)
        there = join.prefixes.union(ends).intersection(words)
        found = places(words, sought) if not ends.isdisjoint(there) else []
        best: dict[int, float] = {}
        if not join.prefixes.isdisjoint(there):
            for block, run, line in blocks(text):
                for t, share in join.matches(block, line):
                    best[t] = max(share, best.get(t, 0.0))
                if wrapped and not line:
                    for t, share in join.wrapped(run, block):
                        best[t] = max(share, best.get(t, 0.0))
        base = {label for _, label in found}
        labels = base | {join.templates[t][0] for t in best}
        at = [i for i, _ in found]
        score = 1.0 if base else max(best.values(), default=0.0)
        return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(best)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int32())]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*map(one, utf8(batch.column("text"))), strict=True)
        return pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *names])

    df = texts_of(docs, id_col, text_col)
    return map_steps(df, step, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, templates array<int>")
