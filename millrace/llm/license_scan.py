"""License scans: base phrases, and a positional index of rare licence words.

The templates below are the opening words of well-known licences and notices; their words form a positional index (word -> template,
position). The inverse document frequency of each indexed word is counted over the whole corpus (one aggregation whose result has at most a
row for each indexed word). Of each template the ``RARE`` words of highest IDF are looked up in a file; their postings, intersected by relative
position, vote for the template's start in the file. The template's label is given if the best start has at least ``MIN_SHARE`` of *all the template's
postings* of these words, found in the file or not, and the template's mandatory key phrases stand in the file. So a licence's name alone, or a
key phrase without its notice, gives no label of the method's.

All of it is column expressions inside one row. Defined results: null text is empty text; an empty text has no words, no
labels and score 0; an empty table gives an empty result; repeated rows each get their result; very long texts are scanned whole; other columns
are kept, but those named like the result's are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import ascii_lower, let

SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: phrase -> label: the base
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: label, notice, mandatory key phrases
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("gnu general public license as published by the free software foundation",)),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("gnu lesser general public license",)),
    ("agpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("you may not use this file except in compliance with the license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted free of charge", "without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "this work is licensed under the creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    ("cc-by-4.0", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0", ("creative commons attribution 4 0 international license",)),
    ("cc0-1.0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("free and unencumbered software released into the public domain",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("alter it and redistribute it freely",)),
)
#: words of the notices that are too common anywhere to be looked up
COMMON = frozenset("a all and any are as at be by can do for from has if in is it its not of on or so that the this to use was who will with without you your 0 1 2 3 4 v".split())
#: how many words of each template are looked up, those of highest IDF
RARE = 12
MIN_SHARE = 0.6


def _postings() -> dict[str, list[tuple[int, int]]]:
    index = defaultdict(list)
    for t, (_, notice, _) in enumerate(TEMPLATES):
        for i, w in enumerate(notice.split()):
            if w not in COMMON:
                index[w].append((t, i))
    return dict(index)


def _split(text: Column) -> Column:
    """A text, lowered, split between its words; the first and last parts may be empty."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEP + "+")


def _phrase(phrase: str) -> str:
    """Pattern for a phrase in words joined by blanks."""
    return f"(?:^| ){phrase}(?: |$)"


def corpus_idf(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """IDF of each indexed word over all documents; the result has one number for each indexed word."""
    vocabulary = sorted(_postings())
    held = F.array_intersect(_split(F.col(text)), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row for each indexed word
    n, df = docs.count(), {r.w: r.n for r in rows}
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in vocabulary}


def rare_postings(idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Word -> postings, of the ``RARE`` words of highest IDF of each template."""
    index, out = _postings(), defaultdict(list)
    for t, (_, notice, _) in enumerate(TEMPLATES):
        own = sorted({w for w in notice.split() if w in index}, key=lambda w: (-round(idf.get(w, 0.0), 9), w))[:RARE]
        for w in own:
            out[w] += [(u, p) for u, p in index[w] if u == t]
    return dict(out)


def scan(docs: DataFrame, text: str = "text", idf: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and ``matches`` (label, start, share)."""
    idf = idf if idf is not None else corpus_idf(docs, text)
    looked_up = rare_postings(idf)
    n_postings = [sum(t == u for ps in looked_up.values() for u, _ in ps) for t in range(len(TEMPLATES))]
    post_type = "array<struct<t:int,p:int>>"
    table = F.create_map(*[x for w, ps in sorted(looked_up.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]).cast(post_type))])

    def base_starts(w: Column) -> Column:
        def of(phrase: str) -> Column:
            ps = phrase.split()
            cond = lambda i: F.get(w, i) == ps[0]
            rest = lambda i, c: c if len(ps) == 1 else F.when(c, F.coalesce(_all([F.get(w, i + j) == p for j, p in enumerate(ps[1:], 1)]), F.lit(False))).otherwise(False)
            at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: rest(i, F.coalesce(cond(i), F.lit(False))))
            return F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(PHRASES[phrase]).alias("label")))

        return F.concat(*map(of, PHRASES))

    def votes(w: Column, joined: Column) -> Column:
        """Matches of the templates: postings of the file's looked-up words, intersected by relative position."""
        own = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*looked_up))
        # (template, start) of every posting, sorted: the votes for one start stand together
        cast = lambda o: F.transform(F.element_at(table, o["w"]), lambda p: F.struct(p["t"].alias("t"), (o["i"] - p["p"]).alias("at")))
        ballots = F.sort_array(F.flatten(F.transform(own, cast)))
        return let(ballots, lambda bs: F.filter(F.array(*[one(t, bs, joined) for t in range(len(TEMPLATES))]), lambda m: m["share"] > 0))

    def one(t: int, ballots: Column, joined: Column) -> Column:
        label, _, keys = TEMPLATES[t]
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("best_at"), F.lit(0).alias("best"))

        def step(a: Column, x: Column) -> Column:
            n = F.when((x["at"] == a["at"]) & (a["n"] > 0), a["n"] + 1).otherwise(1)
            return F.struct(x["at"].alias("at"), n.alias("n"), F.when(n > a["best"], x["at"]).otherwise(a["best_at"]).alias("best_at"), F.greatest(n, a["best"]).alias("best"))

        mine = F.filter(ballots, lambda b: b["t"] == t)
        share = lambda b: b["best"] / F.lit(float(n_postings[t]))
        verified = _all([joined.rlike(_phrase(k)) for k in keys])
        enough = lambda b: F.when(share(b) >= MIN_SHARE, verified).otherwise(False)  # noqa: E731  phrases are looked for where the votes are in
        return let(F.aggregate(mine, zero, step), lambda b: F.struct(F.lit(label).alias("label"), b["best_at"].cast("long").alias("start"), F.when(enough(b), share(b)).otherwise(0.0).alias("share")))

    names = docs.columns
    kinds = "struct<base:array<struct<at:bigint,label:string>>,found:array<struct<label:string,start:bigint,share:double>>>"
    nothing = F.struct(F.array().alias("base"), F.array().alias("found")).cast(kinds)
    anchors = F.array(*[F.lit(x) for x in sorted({*looked_up, *(p.split()[0] for p in PHRASES)})])

    def of_parts(parts: Column) -> Column:
        blank = lambda x: F.when(x == "", 1).otherwise(0)
        n = F.size(parts) - blank(F.get(parts, F.lit(0))) - F.when(F.size(parts) > 1, blank(F.get(parts, F.size(parts) - 1))).otherwise(0)
        both = let(F.filter(parts, lambda w: w != ""), lambda w: F.struct(base_starts(w).alias("base"), votes(w, F.array_join(w, " ")).alias("found")).cast(kinds))
        return F.struct(n.cast("long").alias("n_words"), F.when(F.arrays_overlap(parts, anchors), both).otherwise(nothing).alias("r"))

    df = docs.select(F.struct(*names).alias("row"), let(_split(F.col(text)), of_parts).alias("s")).select("row", "s.n_words", "s.r")
    at = F.transform("r.base", lambda b: b["at"])
    base_labels = F.array_sort(F.array_distinct(F.transform("r.base", lambda b: b["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("r.base", lambda b: b["label"]), F.transform("r.found", lambda m: m["label"]))))
    score = F.greatest(F.coalesce(F.array_max(F.transform("r.found", lambda m: m["share"])), F.lit(0.0)), F.when(F.size("r.base") > 0, 0.5).otherwise(0.0))
    own = {"n_words": F.col("n_words"), "n_base": F.size("r.base").cast("long"), "first_word": F.array_min(at), "last_word": F.array_max(at), "base_labels": F.array_join(base_labels, ","), "labels": F.array_join(labels, ","), "score": score, "matches": F.col("r.found")}
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in names if c not in own], *[c.alias(k) for k, c in own.items()])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
