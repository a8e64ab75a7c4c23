"""Licence scans over a positional rare-token index, in DataFrame functions alone.

The index is built from template passages (constants of this module): for each of a template's
words with the highest inverse document frequency among the documents to be scanned, its positions in the template. A file's words are looked up in it; each
place of such a word, less the word's place in the template, votes for where the template would start. Votes
for neighbouring starts are what intersecting the postings by relative position gives. Starts with enough votes are
verified: the template's key phrases must stand in the file word by word. Base phrases are templates of their own
whose one key phrase is all of them, so that each verified start is an occurrence.

Templates are the notices by which licences are applied to files, and openings or clauses of the licences' own texts. A
licence without a template is not seen.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import new_columns

# Words, phrases and labels.
# What stands between words, A-Z being lower-cased: [\x00-\x2F\x3A-\x60\x7B-\x7F]+, each character listed, as Java's patterns look those up in one table and try ranges one by one.
GAP = "[" + "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isdigit() and not chr(i).islower()) + "]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


# Passages by which a licence is known, in lower case and without punctuation.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "publish distribute sublicense and or sell")),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2", "except in compliance with the license")),
    Template("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice", ("redistribution and use in source and binary forms", "must retain the above copyright notice")),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ("gnu general public license as published by the free software foundation",)),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2 0",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain",)),
    Template("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by", "this work is licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works the licenses for most software and other practical works are designed to take away your freedom to share and change the works", ("gnu general public license is a free copyleft license",)),
    Template("lgpl", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below", ("gnu lesser general public license incorporates the terms and conditions",)),
    Template("agpl", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software", ("gnu affero general public license is a free copyleft license",)),
    Template("apache-2", "apache license version 2 0 january 2004 terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document", ("terms and conditions for use reproduction and distribution",)),
    Template("mpl-2", "mozilla public license version 2 0 1 definitions contributor means each individual or legal entity that creates contributes to the creation of or owns covered software", ("contributes to the creation of or owns covered software",)),
    Template("epl-2", "the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", ("eclipse public license",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("in no event will the authors be held liable", "alter it and redistribute it freely")),
    Template("bsl-1", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("boost software license",)),
    Template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at", ("sil open font license",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
)


@dataclass(frozen=True)
class Index:
    """What lookups need. words: each index word's posting numbers. postings: (template, place in it, weight)."""

    words: dict[str, list[int]]
    postings: list[tuple[int, int, float]]
    weight: list[float]


def index(df: dict[str, int], templates: tuple[Template, ...] = TEMPLATES, rare: int = 8) -> Index:
    """The ``rare`` words of each template with the highest inverse document frequency; of equals, the longest, then the first.

    df: how many documents have a word. Words that none has can't be looked up; they are taken only where a template has too few others.
    """
    docs = max([1, *df.values()])
    postings, words, weight = [], defaultdict(list), []
    for k, template in enumerate(templates):
        t = template.text.split()
        best = sorted(set(t), key=lambda w: (not df.get(w), df.get(w, 0), -len(w), t.index(w)))[:rare]
        total = 0.0
        for place, w in enumerate(t):
            if w in best:
                idf = math.log(1 + docs / max(1, df.get(w, 0)))
                words[w].append(len(postings))
                postings.append((k, place, idf))
                total += idf
        weight.append(total)
    return Index(dict(words), postings, weight)


def frequencies(words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """Of each template word, how many documents (rows of an array ``words``) have it."""
    wanted = F.array(*map(F.lit, sorted({w for t in templates for w in t.text.split()})))
    seen = words.select(F.explode(F.array_intersect("words", wanted)).alias("w"))
    return {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def at_phrase(words: Column, place: Column, phrase: str) -> Column:
    """Whether the phrase's words stand from ``place`` (from 0) on."""
    out = place >= 0
    for i, w in enumerate(phrase.split()):
        out = out & F.coalesce(F.get(words, place + i) == w, F.lit(False))
    return out


def anchor(phrase: str, df: Counter) -> int:
    """The place in a phrase of its rarest word among the templates."""
    parts = phrase.split()
    return min(range(len(parts)), key=lambda i: (df[parts[i]], -len(parts[i]), i))


def words_of(text: Column) -> Column:
    """Words of a text, cut where other characters stand: regexp_extract_all makes a matcher's result for each word and takes several times as long.

    lower() is faster than a table of letters. It changes letters beyond ASCII too, which leaves them word characters that no phrase or template has;
    the Kelvin sign alone would become an ASCII letter, so another letter takes its place.
    """
    lowered = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(lowered, GAP), "")


def keys_of(t: Template) -> list[dict]:
    """A template's key phrases: their words and the place of the first."""
    parts, keys = t.text.split(), [k.split() for k in t.keys]
    return [{"p": next(i for i in range(len(parts)) if parts[i : i + len(k)] == k), "w": k} for k in keys]


SPREAD = 4  # votes for starts that are so many words apart still go together


def least_votes(weights: list[float], share: float) -> int:
    """How many votes a start needs at least to get a share of all weights."""
    total, n = sum(weights), 0
    for w in sorted(weights, reverse=True):
        if total and sum(sorted(weights, reverse=True)[:n]) >= share * total:
            break
        n += 1
    return max(1, n)


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.6, rare: int = 8) -> DataFrame:
    """Licences of every whole text.

    Columns: those in ``keep``, n_words, n_base (places where a base phrase stands), first_word and last_word (their
    least and greatest start, words from 0; null if there is none), base_labels and labels (distinct, sorted,
    comma-joined; labels has those of the templates too) and score (1 if there is a base phrase, else the greatest share, up to 1, of a
    template's index weight that votes for verified starts at most SPREAD words apart).

    Null and empty texts have no words, no labels and score 0. Rows are independent but for the words' frequencies, which are counted
    over all rows in a pass before (a template with a key word that no row has is not looked for): repeated rows and null ids stay as they are. Columns not in ``keep`` are dropped; names in it that are
    made here raise. Needs no shuffle but for the frequencies of some hundred words. A text of any length is held as an array of its words, and its time grows with its length.
    """
    new_columns(keep, ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    words_only = df.select(words_of(df[text]).alias("words"))
    seen = frequencies(words_only)
    ix = index(seen, rare=rare)
    # A template of which some key word stands in no document can't be verified anywhere, so its other words aren't looked up.
    possible = {k for k, t in enumerate(TEMPLATES) if all(seen.get(w) for key in t.keys for w in key.split())}
    looked_up = {w: own for w, places in ix.words.items() if (own := [ix.postings[i] for i in places if ix.postings[i][0] in possible])}
    phrase_df = Counter(w for t in (*(x.text for x in TEMPLATES), *PHRASES) for w in set(t.split()))
    phrases = [(p, label, anchor(p, phrase_df)) for p, label in PHRASES.items()]
    wanted = sorted({*looked_up, *(p.split()[a] for p, _, a in phrases)})

    def look(words: Column) -> Column:
        """Places of index words, as (place, word)."""
        found = F.transform(words, lambda w, i: F.when(w.isin(wanted), F.struct(i.alias("i"), w.alias("w"))))
        return let(F.filter(found, lambda x: x.isNotNull()), lambda hits: judge(words, hits))

    def standing(words: Column, hits: Column, phrase: str, label: str, a: int) -> Column:
        """Verified starts of a base phrase, from the places of its rarest word."""
        word = phrase.split()[a]
        found = F.filter(hits, lambda h: (h["w"] == word) & at_phrase(words, h["i"] - a, phrase))
        return F.transform(found, lambda h: F.struct((h["i"] - a).alias("i"), F.lit(label).alias("label")))

    def constant(value: object, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), kind)

    # The index and the templates as data: what an expression does doesn't depend on how many there are.
    postings = constant({w: [{"k": k, "p": p, "v": v} for k, p, v in own] for w, own in looked_up.items()}, "map<string,array<struct<k:int,p:int,v:double>>>")
    own_weights = [[v for k, _, v in ix.postings if k == i] for i in range(len(TEMPLATES))]
    bounds = [{"label": t.label, "need": least_votes(w, threshold), "most": (SPREAD + 1) * len(w), "weight": total, "keys": keys_of(t)} for t, w, total in zip(TEMPLATES, own_weights, ix.weight, strict=True)]
    templates = constant(bounds, "array<struct<label:string,need:int,most:int,weight:double,keys:array<struct<p:int,w:array<string>>>>>")

    def judge(words: Column, hits: Column) -> Column:
        base = F.concat(*(standing(words, hits, *p) for p in phrases))
        cast = F.transform(hits, lambda h: F.transform(F.try_element_at(postings, h["w"]), lambda x: F.struct(x["k"].alias("k"), (h["i"] - x["p"]).cast("int").alias("s"), x["v"].alias("v"))))
        votes = F.array_sort(F.flatten(F.filter(cast, lambda x: x.isNotNull())))
        found = F.when(F.size(hits) > 0, let(votes, lambda v: verified(words, v)))
        return F.struct(F.size(words).cast("long").alias("n_words"), base.alias("base"), F.coalesce(found, F.array().cast("array<struct<label:string,score:double>>")).alias("found"))

    def verified(words: Column, votes: Column) -> Column:
        """Labels and scores of verified starts. Votes are in order of templates and starts; of each that has enough others within SPREAD behind it, at most ``most`` neighbours can be so near."""

        def near(x: Column, j: Column) -> Column:
            last = F.get(votes, j + F.get(templates, x["k"])["need"] - 1)
            return F.when((last["k"] == x["k"]) & (last["s"] - x["s"] <= SPREAD), F.struct(x["k"].alias("k"), x["s"].alias("s"), j.alias("j")))

        def window(x: Column) -> Column:
            own = F.slice(votes, x["j"] + 1, F.get(templates, x["k"])["most"])
            total = F.aggregate(own, F.lit(0.0), lambda sum_, y: sum_ + F.when((y["k"] == x["k"]) & (y["s"] - x["s"] <= SPREAD), y["v"]).otherwise(0.0))
            return F.struct(F.get(templates, x["k"]).alias("t"), x["s"].alias("s"), (total / F.get(templates, x["k"])["weight"]).alias("score"))

        starts = F.transform(F.filter(F.transform(votes, near), lambda x: x.isNotNull()), window)
        good = F.filter(starts, lambda x: (x["score"] >= threshold) & F.forall(x["t"]["keys"], lambda key: there(words, x["s"] + SPREAD // 2 + key["p"], key["w"])))
        return F.transform(good, lambda x: F.struct(x["t"]["label"].alias("label"), F.least(x["score"], F.lit(1.0)).alias("score")))

    def there(words: Column, place: Column, key: Column) -> Column:
        """Whether a key phrase stands at a place or up to four words off: the template's start may be off by a few words."""
        off = F.sequence(F.lit(-4), F.lit(4))
        return F.exists(off, lambda d: F.when(place + d >= 0, F.slice(words, F.greatest(place + d, F.lit(0)) + 1, F.size(key)) == key).otherwise(F.lit(False)))

    found = df.select(*keep, let(words_of(df[text]), look).alias("__found"))
    f = F.col("__found")
    starts, base, more = f["base"]["i"], f["base"]["label"], f["found"]["label"]

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    by_template = F.coalesce(F.array_max(f["found"]["score"]), F.lit(0.0))
    return found.select(
        *keep,
        f["n_words"].alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, more)).alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(by_template).alias("score"),
    )
