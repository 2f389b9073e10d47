"""License scans: headers and licence files against templates, then inheritance by directory.

Passages of every whole file become sparse TF-IDF vectors and are compared with the
templates by cosine: its lines, windows of about the length of a template that slide
over its words whatever the lines, and all of a file named as licence file. Document
frequencies of all words come from all files. Passages that would not match even if
every other word stood in all files are left out; the others take the weights of their
words by a join. A file
without a licence of its own takes that of the nearest directory above it (or its own)
that holds a recognised licence file.

Defined results: a null text is empty; a null path is scanned but inherits nothing;
blank lines match nothing; ties go to the licence that sorts first; of several licence
files in a directory the best match counts; repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import staged
from .text import slices

MIN_COSINE = 0.7
# Words that a task counts before it hands them on.
HELD_WORDS = 500_000
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_LICENCE_FILE = r"^(?i)(licen[cs]e|copying|unlicense)([.-].*)?$"

# Short forms in which public licences name themselves.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def words(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


class Matcher:
    """Template vectors over their own words; ``rare`` are words of which a match holds at least one."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], n: int, least: float) -> None:
        self.least = least
        self.idf = {w: math.log((n + 1) / (frequency.get(w, 0) + 1)) + 1 for _, t in templates for w in words(t)}
        self.n = n
        self.templates = []
        for name, text in templates:
            v = {w: c * self.idf[w] for w, c in words(text).items()}
            size = math.sqrt(sum(x * x for x in v.values()))
            self.templates.append((name, {w: x / size for w, x in v.items()}))
        # per word of the templates, and last for any other: its part of the product with each template, and of the size
        self.code = {w: i for i, w in enumerate(sorted(self.idf))}
        weight = np.array([*(self.idf[w] for w in self.code), 1.0])
        self.part = np.array([[t.get(w, 0.0) for w in [*self.code, ""]] for _, t in self.templates]) * weight
        self.square = weight * weight
        lengths = [sum(words(t).values()) for _, t in templates]
        self.lengths = [sorted({max(1, n * 3 // 4), n, (n * 5 + 3) // 4}) for n in lengths]
        # common words alone cannot reach the least cosine: their part of each template is shorter than it
        order, common = sorted(self.idf, key=lambda w: (self.idf[w], w)), set()
        for w in order:
            trial = common | {w}
            if any(math.sqrt(sum(x * x for k, x in v.items() if k in trial)) >= least for _, v in self.templates):
                break
            common = trial
        self.rare = sorted(set(self.idf) - common)

    def best(self, passage: list[str], frequency: dict[str, int]) -> tuple[float, str | None]:
        v = {w: c * (self.idf.get(w) or math.log((self.n + 1) / (frequency.get(w, 0) + 1)) + 1) for w, c in Counter(passage).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        if not size:
            return 0.0, None
        scored = ((sum(x * t[w] for w, x in v.items() if w in t) / size, name) for name, t in self.templates)
        score, name = min(scored, key=lambda s: (-s[0], s[1]))
        return (min(score, 1.0), name) if score >= self.least else (0.0, None)

    def passages(self, text: str | None, whole: bool) -> list[str]:
        """Distinct passages, as words joined by blanks, that match if their other words weigh as little as can be."""
        low = (text or "").lower()
        if not any(w in low for w in self.rare):
            return []
        lines = [_WORD.findall(line) for line in low.split("\n")]
        all_words = [w for line in lines for w in line]
        total = len(all_words)
        if not total:
            return []
        code = np.array([self.code.get(w, len(self.code)) for w in all_words])
        square = np.concatenate([[0.0], np.cumsum(self.square[code])])
        parts = [np.concatenate([[0.0], np.cumsum(p[code])]) for p in self.part]
        stops = np.cumsum([len(line) for line in lines])
        starts = stops - [len(line) for line in lines]
        solid = stops > starts
        fixed = [starts[solid], stops[solid]]
        if whole:
            fixed = [np.append(fixed[0], 0), np.append(fixed[1], total)]
        found = set()
        for part, lengths in zip(parts, self.lengths):
            at = [np.arange(max(1, total - n + 1)) for n in lengths]
            begin = np.concatenate([fixed[0], *at])
            end = np.concatenate([fixed[1], *(np.minimum(b + n, total) for b, n in zip(at, lengths))])
            # a word that stands twice counts more in the size, so this is not less than the cosine
            reach = part[end] - part[begin] >= (self.least - 1e-9) * np.sqrt(square[end] - square[begin])
            found.update(zip(begin[reach].tolist(), end[reach].tolist()))
        return sorted({" ".join(all_words[a:b]) for a, b in found})


def document_frequency(files: DataFrame) -> DataFrame:
    """word and the number n of files in which it stands; the number of files stands at the empty word."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                seen.update(set(_WORD.findall((text or "").lower())))
            n += batch.num_rows
            if len(seen) > HELD_WORDS:
                yield pa.record_batch({"word": pa.array([*seen]), "n": pa.array([*seen.values()], pa.int64())})
                seen.clear()
        yield pa.record_batch({"word": pa.array([*seen, ""]), "n": pa.array([*seen.values(), n], pa.int64())})
    return files.select("text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = MIN_COSINE) -> DataFrame:
    """``files`` (key, path, text) with own_license, own_score, license, and the directory it is inherited_from."""
    vocabulary = {w for _, t in templates for w in words(t)}
    frequency = staged(document_frequency(files), "frequency")
    own_words = {r.word: r.n for r in frequency.filter(F.col("word").isin("", *vocabulary)).collect()}  # a row per template word
    matcher = Matcher(templates, own_words, own_words.pop("", 0), least)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [matcher.passages(t, bool(w)) for t, w in zip(batch.column("text").to_pylist(), batch.column("whole").to_pylist())]
            others = [sorted({w for p in g for w in p.split(" ")}.difference(vocabulary)) for g in got]
            yield pa.record_batch([*(batch.column(c) for c in ("key", "path", "whole")), *(pa.array(c, pa.list_(pa.string())) for c in (got, others))],
                                  ["key", "path", "whole", "passages", "others"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for passages, known in zip(batch.column("passages").to_pylist(), batch.column("known").to_pylist()):
                counts = {k["word"]: k["n"] for k in known or []}
                got.append(min((matcher.best(p.split(" "), counts) for p in passages), key=lambda s: (-s[0], s[1] or "~"), default=(0.0, None)))
            yield pa.record_batch([*(batch.column(c) for c in ("key", "path", "whole")), pa.array([g[1] for g in got], pa.string()), pa.array([g[0] for g in got], pa.float64())],
                                  ["key", "path", "whole", "own_license", "own_score"])
    kind = files.schema["key"].dataType.simpleString()
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = staged(files.select("key", "path", F.coalesce(name.rlike(_LICENCE_FILE), F.lit(False)).alias("whole"), "text")
                   .mapInArrow(select, f"key {kind}, path string, whole boolean, passages array<string>, others array<string>")
                   .withColumn("row", F.monotonically_increasing_id()), "passages")
    wanted = found.select("row", F.explode("others").alias("word"))
    needed = frequency.join(wanted.select("word").distinct(), "word", "left_semi")
    known = wanted.join(needed, "word").groupBy("row").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    own = (found.join(known, "row", "left").select("key", "path", "whole", "passages", "known")
           .mapInArrow(judge, f"key {kind}, path string, whole boolean, own_license string, own_score double")
           .withColumn("dir", directory(F.col("path"))))
    return inherit(staged(own, "scanned"))


def inherit(own: DataFrame) -> DataFrame:
    """Nearest recognised licence file in the file's directory or above it, by joins over directories."""
    declared = (own.filter("whole and own_license is not null and path is not null").groupBy("dir")
                .agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("l"))).alias("d"))
                .select(F.col("dir").alias("above"), F.col("d.l").alias("declared")))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    places = own.filter("path is not null").select("dir").distinct().select("dir", F.posexplode(above).alias("depth", "above"))
    nearest = (places.join(declared, "above").groupBy("dir")
               .agg(F.max(F.struct("depth", "above", "declared")).alias("n"))
               .select(F.col("dir").alias("at"), F.col("n.above").alias("from_dir"), "n.declared"))
    joined = own.join(nearest, (own["dir"] == nearest["at"]) & own["path"].isNotNull(), "left")
    inherits = F.col("own_license").isNull() & F.col("declared").isNotNull()
    return joined.select("key", "path", "own_license", "own_score", F.coalesce("own_license", "declared").alias("license"),
                         F.when(inherits, F.col("from_dir")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files, since the table has no paths: by source and number; every tenth is its directory's licence file."""
    n = F.col("doc_id")
    thousand, hundred = F.floor(n / 1000).cast("string"), F.floor(n / 100 % 10).cast("string")
    top = F.coalesce("source", F.lit("none"))
    path = (F.when(n % 10 == 0, F.concat_ws("/", top, thousand, hundred, F.lit("LICENSE")))
            .when(n % 10 == 1, F.concat_ws("/", top, thousand, F.lit("LICENSE.txt")))
            .when(n.isNotNull(), F.concat_ws("/", top, thousand, hundred, F.concat(n.cast("string"), F.lit(".txt")))))
    return docs.select(n.alias("key"), path.alias("path"), "text")
