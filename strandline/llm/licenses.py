"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment confirms them.

Only DataFrame functions. A template's shingles are five words each (a shorter template is one shingle). Templates of about
one length form a class; with L the longest length of the class, windows start at every (L / 4)-th word and are that much
longer than L, so that any span of L words lies in one. A band is one minimum; a window and a template of Jaccard
similarity j collide in some band with probability 1 - (1 - j) ** bands. A window that holds 0.8 of a template's shingles
has j of 0.4 at least by these lengths, so 30 bands miss one with a chance of 0.6 ** 30, 2e-7; below 12 words, where a
class has one length, j is 0.5 or more.

Texts and windows without any anchor of any template are put aside first, without loss: the anchors of a template are
words so placed that a text without all of them lacks more than a fifth of its shingles.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINED = 5, 0.8
BANDS = 30
#: Lengths of a class of long templates differ by this factor at most.
RATIO = 1.2
#: Shingles of a class up to which its template table is broadcast.
BROADCAST_SHINGLES = 50_000

#: License notices as they are commonly written.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "all-rights-reserved": "All rights reserved.",
}


def plain_words(text: str) -> list[str]:
    """As _words does on the JVM: lower-case words of letters and digits."""
    out, word = [], ""
    for c in text.lower():
        if c.isascii() and c.isalnum() or not c.isascii():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


def _words(text: F.Column) -> F.Column:
    cleaned = F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def _shingles(ws: list[str]) -> set[str]:
    return {" ".join(ws[k : k + SHINGLE]) for k in range(max(1, len(ws) - SHINGLE + 1))}


def anchors(ws: list[str], common: dict[str, int]) -> list[str]:
    """Words that together touch over a fifth of the shingles, rarest among the templates first."""
    n, chosen = len(_shingles(ws)), []
    for w in sorted(set(ws), key=lambda w: (common[w] if len(w) > 2 else 1000, -len(w), w)):
        chosen.append(w)
        if sum(not any(c in s.split(" ") for c in chosen) for s in _shingles(ws)) < CONTAINED * n - 1e-9:
            return chosen
    return chosen


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word): a row for every template of which a window of the text holds 0.8 of the
    shingles or more; the best window, the first of equal ones.

    Null and empty texts match nothing. Repeated rows come out once for each doc_id. No templates or no documents give no
    rows. Whole texts are read; other columns are not."""
    wanted = {k: plain_words(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    wanted = {k: w for k, w in wanted.items() if w}
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]
    empty = f"doc_id {kind}, license string, containment double, first_word int"
    if not wanted:
        return spark.createDataFrame([], empty)
    common: dict[str, int] = {}
    for ws in wanted.values():
        for w in set(ws):
            common[w] = common.get(w, 0) + 1
    d = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text"))
    any_anchor = sorted({a for ws in wanted.values() for a in anchors(ws, common)})
    d = d.where(reduce(lambda x, y: x | y, [F.col("text").contains(a) for a in any_anchor])).select("doc_id", _words(F.col("text")).alias("w"))
    classes: dict[tuple[int, int], dict[str, list[str]]] = {}
    for name, ws in wanted.items():
        n = len(ws)
        classes.setdefault((min(n, SHINGLE), n if n < 12 else math.ceil(12 * RATIO ** math.ceil(math.log(n / 12, RATIO) - 1e-9))), {})[name] = ws
    kinds = [_Class(members, size, sorted({a for ws in members.values() for a in anchors(ws, common)})) for (size, _), members in sorted(classes.items())]
    # one pass for all classes: the places of the windows with an anchor first, so that only their words are carried along
    marks = F.array(*[F.array(*[F.lit(m) for m in k.marks]) for k in kinds])
    places = F.concat(*[F.when(F.arrays_overlap("w", marks[n]) & (F.size("w") >= k.size), k.places(n)).otherwise(F.array().cast(_PLACE)) for n, k in enumerate(kinds)])
    words = lambda p: F.slice("w", p["start"] + 1, p["span"])
    kept = F.filter(places, lambda p: F.arrays_overlap(words(p), marks[p["kind"]]))
    windows = F.transform(kept, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["size"].alias("size"), words(p).alias("w")))
    w = d.select("doc_id", F.explode(windows).alias("x")).select("doc_id", "x.*").where(F.size("w") >= F.col("size"))
    shingles = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda k: F.xxhash64(F.array_join(F.slice("w", k, F.col("size")), " ")))
    w = w.select("doc_id", "kind", "start", F.array_distinct(shingles).alias("h"))
    keyed = w.select("doc_id", "kind", "start", "h", F.explode(_minima(F.col("h"))).alias("key")).select("doc_id", "kind", "start", "h", "key.band", "key.low")
    t = spark.createDataFrame([(n, name, sh) for n, k in enumerate(kinds) for name, sh in sorted(k.shingles.items())], "kind int, license string, ts array<string>").withColumn("th", F.transform("ts", lambda s: F.xxhash64(s)))
    t = t.withColumn("key", F.explode(_minima(F.col("th")))).select("kind", "license", "th", "key.band", "key.low")
    small = sum(len(sh) for k in kinds for sh in k.shingles.values()) < BROADCAST_SHINGLES
    hit = keyed.join(F.broadcast(t) if small else t, ["kind", "band", "low"])
    inside = F.size(F.array_intersect("h", "th")) / F.size("th")
    found = hit.select("doc_id", "license", inside.alias("containment"), (-F.col("start")).alias("back")).where(F.col("containment") >= CONTAINED - 1e-9)
    best = F.max(F.struct("containment", "back")).alias("best")
    return found.groupBy("doc_id", "license").agg(best).select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).cast("int").alias("first_word"))


_PLACE = "array<struct<kind:int,start:int,span:int,size:int>>"


class _Class:
    """Templates of about one length, with shingles of `size` words and the anchors of all."""

    def __init__(self, members: dict[str, list[str]], size: int, marks: list[str]):
        self.size, self.marks = size, marks
        long = max(map(len, members.values()))
        self.step = max(1, long // 4)
        self.span = long + self.step - 1
        self.shingles = {k: sorted({" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)}) for k, ws in members.items()}

    def places(self, n: int) -> F.Column:
        """Starts of the windows over the words w."""
        last = F.ceil(F.greatest(F.lit(0), F.size("w") - self.span) / self.step).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.lit(n).alias("kind"), (k * self.step).alias("start"), F.lit(self.span).alias("span"), F.lit(self.size).alias("size"))).cast(_PLACE)


def _minima(hashes: F.Column) -> F.Column:
    """A (band, low) for each band: the least value of the band's hash function over the shingles."""

    def band(k: int):
        return lambda x: F.xxhash64(x, F.lit(k))

    return F.array(*[F.struct(F.lit(k).alias("band"), F.array_min(F.transform(hashes, band(k))).alias("low")) for k in range(BANDS)])
