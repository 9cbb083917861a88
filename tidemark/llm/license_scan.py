"""License scans by a positional index of rare tokens.

Templates are sentences of licence notices; each has a mandatory key phrase. Postings hold, for every licence word, the
templates and positions where it stands. A file's licence words are ranked by inverse document frequency over all files,
and its rarest ones are looked up, as many of them as give every template that the file could hold two words of its key
phrase. Each place of such a word proposes a start for each of its postings; starts that two words agree on are the
intersection of the postings by relative position. A start counts if the key phrase stands there word by word and the
template's words, weighed by inverse document frequency, cover enough of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, passing, row_of, written

#: Runs of what is not a word: words are [0-9a-z] and everything beyond ASCII, after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A sentence of a notice; its key phrase stands in it and has two different words or more."""

    label: str
    notice: str
    key: str
    base: bool = False

    @property
    def ahead(self) -> int:
        """Words of the notice before its key phrase."""
        words, key = self.notice.split(), self.key.split()
        return next(k for k in range(len(words)) if words[k : k + len(key)] == key)


#: Sentences of public licences, in lower case and without marks.
TEMPLATES = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    Template("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    Template("warranty-disclaimer", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "provided as is without warranty of any kind"),
    Template("apache-2.0", "apache license version 2 0", "apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless required by applicable law"),
    Template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute it and or modify it under the terms"),
    Template("gpl-notice", "this program is distributed in the hope that it will be useful but without any warranty", "in the hope that it will be useful"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    Template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "nor the names of its contributors may be used"),
    Template("mpl", "mozilla public license version 2 0", "mozilla public license"),
    Template("epl", "eclipse public license version 2 0", "eclipse public license"),
    Template("cc-by-nc", "cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "cc by sa 4 0", "cc by sa"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "use copy modify and or distribute this software"),
    Template("zlib", "this software is provided as is without any express or implied warranty", "without any express or implied warranty"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying of this file"),
)


def _depth(ranked: Column, key: list[str]) -> Column:
    """How many of the ranked words must be looked up to have two words of the key; 0 if the file lacks one of its words."""
    at = [F.array_position(ranked, w).cast("int") for w in sorted(set(key))]
    if len(at) < 2:
        raise ValueError("a key phrase needs two different words")
    return F.when(F.least(*at) == 0, 0).otherwise(F.element_at(F.array_sort(F.array(*at)), 2))


def scan_licenses(
    docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, cover: float = 0.6, keep: list[str] | None = None
) -> DataFrame:
    """docs (or its columns in keep) with a struct column _l: n_words, places (label, base, start, cover), score.

    A place is where a template's key phrase stands, with the words before it in the template counted into its start for
    templates beyond the base ones; base ones are places of the phrase itself, all of them. Others need a weighed cover of
    at least cover. score is the largest cover, 0 without a place. Null and empty texts have no words and no places;
    repeated rows get equal results and an empty table none. A column _l of docs is replaced, all others pass through.
    Document frequencies of all licence words are counted over all documents; there are as many as templates have words.
    """
    keep = passing(docs.columns if keep is None else keep, ["_l"])
    known = sorted({w for t in templates for w in t.notice.split()})
    words = F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), GAP)
    cut = docs.select(row_of(keep), words.alias("w"))
    cut = cut.select("r", F.slice("w", F.when(F.get("w", F.lit(0)) == "", 2).otherwise(1), F.size("w")).alias("w"))
    cut = cut.select("r", F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - F.when(F.get("w", F.size("w") - 1) == "", 1).otherwise(0))).alias("w"))
    among = lambda words: F.array(*map(F.lit, words))
    whole = cut.select("r", F.size("w").cast("long").alias("n_words"), F.array_intersect(among(known), F.col("w")).alias("known"), "w")
    keys = sorted({tuple(sorted(set(t.key.split()))) for t in templates})
    could = F.lit(False)
    for k in keys:
        could = could | (F.size(F.array_intersect(among(k), F.col("known"))) == len(k))
    looked = written(whole.select("r", "n_words", "known", F.when(F.when(F.size("known") > 1, could), F.col("w")).alias("w")), "licenses")
    df = dict(looked.select(F.explode("known").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per licence word at most
    total = looked.count()
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) for w in known}
    rarest = sorted(known, key=lambda w: (-idf[w], w))
    at: dict[str, list[tuple[int, int]]] = {}
    for t, x in enumerate(templates):
        for p, w in enumerate(x.notice.split()):
            at.setdefault(w, []).append((t, p))
    postings = F.create_map(*[x for w in rarest for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in at[w]]))])
    weigh = F.create_map(*[F.lit(x) for w in known for x in (w, idf[w] + 1e-9)])
    rows = [
        F.struct(F.lit(x.label).alias("label"), F.lit(x.base).alias("base"), F.lit(x.ahead).alias("ahead"), among(x.key.split()).alias("key"), among(x.notice.split()).alias("notice"),
                 F.lit(float(sum(idf[w] + 1e-9 for w in x.notice.split()))).alias("weight"))
        for x in templates
    ]
    index = F.array(*rows)
    ranked = looked.withColumn("ranked", F.when(F.col("w").isNotNull(), F.array_intersect(among(rarest), F.col("known"))))
    depth = F.greatest(*[_depth(F.col("ranked"), list(k)) for k in keys])
    asked = ranked.withColumn("asked", F.when(F.col("w").isNotNull(), F.slice("ranked", F.lit(1), depth)))
    w = F.col("w")
    spotted = lambda a: F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda s: F.array_contains(a, s["w"]))
    spots = F.get(F.transform(F.array("asked"), spotted), F.lit(0))  # asked is made once a text, not once a word
    starts = F.flatten(F.transform(spots, lambda s: F.transform(F.element_at(postings, s["w"]), lambda p: F.struct(p["t"].alias("t"), (s["i"] - p["p"]).alias("start")))))
    # Sorted, a start that two words propose is followed by itself; only the first of its run stays.
    run = lambda x, i: (x == F.get("starts", i + 1)) & ~F.coalesce(x == F.get("starts", i - 1), F.lit(False))
    met = asked.withColumn("starts", F.array_sort(starts)).withColumn("starts", F.filter("starts", lambda x, i: F.coalesce(run(x, i), F.lit(False))))

    def placed(x: Column) -> Column:
        t = F.get(index, x["t"])
        first = x["start"] + t["ahead"]
        stands = (first >= 0) & (F.slice(w, F.greatest(first, F.lit(0)) + 1, F.size(t["key"])) == t["key"])
        here = F.transform(t["notice"], lambda y, k: F.when(F.get(w, x["start"] + k) == y, F.element_at(weigh, y)).otherwise(0.0))
        share = F.when(stands, F.least(F.lit(1.0), F.aggregate(here, F.lit(0.0), lambda a, v: a + v) / t["weight"]))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), x["start"].cast("long").alias("start"), share.alias("cover"))

    good = F.filter(F.transform("starts", placed), lambda p: p["cover"].isNotNull() & (p["base"] | (p["cover"] >= cover)))
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,cover:double>>")
    found = met.select("r", "n_words", F.coalesce(good, none).alias("places"))
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["cover"])), F.lit(0.0))
    return found.select("r.*", F.struct("n_words", "places", score.alias("score")).alias("_l"))


def license_digest(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no word, no place (first_word and last_word are null), empty labels and score 0. Long texts are
    scanned whole, repeated rows get equal results, an empty table gives none, and other columns play no part.
    """
    found = scan_licenses(docs, text_col, keep=list(keep))
    base = F.filter("_l.places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select(
        *keep, "_l.n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("_l.places")).alias("labels"), "_l.score",
    )
