"""License scan: a positional rare-token index over license phrases and notices.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Document frequencies of all license words are
counted over the whole corpus. Each template is indexed under its rarest words (highest IDF) with their positions; a
file's own rare license words are looked up, the postings are intersected by relative position (file position less
template position gives where the template would start), and a start is verified: mandatory key phrases must stand
there word for word, and a notice's words must agree, in order and with few words in between, up to `LEAST_AGREEMENT` of
their IDF weight.

A base phrase is a template of its own that must agree wholly; its rarest word stands in each of its occurrences, so
every place is found. Score: 0 without a match, 0.5 for phrases alone, 0.5 + agreement / 2 for a notice.

Defined cases: null, empty and wordless texts have no words and no matches; overlapping and repeated places all count;
an empty corpus gives equal document frequencies; repeated rows get equal rows; other columns pass through if kept.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, scan_texts


@dataclass(frozen=True)
class Template:
    """Words of a phrase or notice in order; each key phrase is a run of them that must stand word for word."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False


#: The base phrases and labels (fixed values).
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
_PERMITS = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
_FREE = "this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1}general public license as published by the free software foundation either version {2} of the license or at your option any later version"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
#: Notices as their licenses word them, lower-cased without punctuation, and the one-line forms by which files refer to them.
NOTICES = (
    *(Template(f"{kind}gpl-{n}.0", _FREE.format(noun, name, n), ("free software", f"gnu {name}general public license", f"version {n}")) for kind, noun, name, n in (
        ("", "program", "", 2), ("", "program", "", 3), ("l", "library", "lesser ", 2), ("l", "library", "lesser ", 3), ("a", "program", "affero ", 3))),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("apache license version 2 0", "as is basis")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("mit", _PERMITS + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("permission is hereby granted free of charge", "without restriction")),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd-2-clause", _BSD, ("redistribution and use in source and binary forms", "redistributions in binary form")),
    Template("bsd-3-clause", _BSD + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistribution and use in source and binary forms", "endorse or promote products")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("alter it and redistribute it freely",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("verbatim or modified copies",)),
)
LEAST_AGREEMENT = 0.8
#: Rare words a notice is indexed under; two of them must agree on its start, within SLACK words. A phrase has one.
ANCHORS = 6
#: Words that may be put in between two words of a notice.
SLACK = 6


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(WORD_TABLE).split() if data else []


class Index:
    """Postings of the templates' rarest words, by the corpus's document frequencies."""

    def __init__(self, templates: tuple[Template, ...], frequencies: dict[bytes, int], documents: int):
        self.templates = templates
        self.words = [words_of(t.text.encode()) for t in templates]
        idf = {w: log((1 + documents) / (1 + frequencies.get(w, 0))) + 1 for ws in self.words for w in ws}
        self.weights = [[idf[w] for w in ws] for ws in self.words]
        self.keys, self.needed = [], []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (template, words) in enumerate(zip(templates, self.words, strict=True)):
            keys = [words_of(x.encode()) for x in template.keys] or [words]
            self.keys.append([(self._place(words, key), key) for key in keys])
            rare = sorted(dict.fromkeys(words), key=lambda w: (-idf[w], w))[: 1 if template.base else ANCHORS]
            self.needed.append(min(2, len(rare)))
            for at, word in enumerate(words):
                if word in rare:
                    self.postings[word].append((k, at))
        self.postings = dict(self.postings)

    @staticmethod
    def _place(words: list[bytes], key: list[bytes]) -> int:
        return next(p for p in range(len(words)) if words[p : p + len(key)] == key)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(start word, template, agreement) of every verified place, in that order."""
        if self.postings.keys().isdisjoint(words):
            return []
        votes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, word in enumerate(words):
            for k, place in self.postings.get(word, ()):
                votes[k].append((at - place, place))
        found = []
        for k, each in votes.items():
            if self.templates[k].base:
                found += [(s, k, 1.0) for s in {s for s, _ in each} if s >= 0 and words[s : s + len(self.words[k])] == self.words[k]]
            else:
                found += self._notices(words, k, sorted(each))
        return sorted(found)

    def _notices(self, words: list[bytes], k: int, votes: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
        """Places of a notice: enough of its anchors agree on a start within SLACK words, and the words there prove it."""
        found, end, low = [], 0, -1
        for at, (start, _) in enumerate(votes):
            while end < len(votes) and votes[end][0] <= start + SLACK:
                end += 1
            if start > low and len({place for _, place in votes[at:end]}) >= self.needed[k] and (proof := self._agreement(words, start, k)):
                first, last, share = proof
                if not found or first != found[-1][0]:
                    found.append((first, k, share))
                low = max(start + SLACK, last - len(self.words[k]))
        return found

    def _agreement(self, words: list[bytes], start: int, k: int) -> tuple[int, int, float] | None:
        """First and last word and weight of what agrees, in order and with up to SLACK words in between.

        Every key phrase must stand word for word in it, and enough of the weight agree; a notice may be cut at the text's edges.
        """
        at, first, total, agreed = max(0, start - SLACK), None, 0.0, 0.0
        reach = 2 * SLACK + 1
        for word, weight in zip(self.words[k], self.weights[k], strict=True):
            total += weight
            near = words[at : at + reach]
            if word in near:
                at += near.index(word) + 1
                first, reach = at - 1 if first is None else first, SLACK + 1
                agreed += weight
        if first is None or agreed / total < LEAST_AGREEMENT:
            return None
        span = words[first:at]
        if any(all(span[p : p + len(key)] != key for p in range(len(span) - len(key) + 1)) for _, key in self.keys[k]):
            return None
        return first, at, agreed / total


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...], *, text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each license word stands, over all documents, and how many documents there are.

    Each task sends one row a license word and batch at most; the result has as many rows as the templates have words.
    """
    vocabulary = frozenset(w for t in templates for w in words_of(t.text.encode()))
    fields = [T.StructField("words", T.ArrayType(T.StringType()))]

    def make():
        def work(texts):
            return [[[w.decode() for w in vocabulary.intersection(words_of(x))] for x in texts]]

        return work

    found = scan_texts(docs, text, [], fields, make)
    rows = found.select(F.explode("words").alias("word")).groupBy("word").count().collect()
    return {r["word"].encode(): r["count"] for r in rows}, docs.count()


MATCH = T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("start", T.LongType()), T.StructField("agreement", T.DoubleType())])


def license_matches(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns), n_words and licenses: (label, base, start word, agreement) by start.

    Two passes over the texts (document frequencies, scan), no shuffle of documents.
    """
    index = Index(templates, *document_frequencies(docs, templates, text=text))
    held = docs.sparkSession.sparkContext.broadcast(index)  # as large as the templates

    def make():
        own = held.value

        def work(texts):
            counts, found = [], []
            for data in texts:
                words = words_of(data)
                counts.append(len(words))
                found.append([{"label": own.templates[k].label, "base": own.templates[k].base, "start": s, "agreement": a} for s, k, a in own.matches(words)])
            return [counts, found]

        return work

    fields = [T.StructField("n_words", T.LongType()), T.StructField("licenses", T.ArrayType(MATCH))]
    return scan_texts(docs, text, docs.columns if keep is None else keep, fields, make)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = license_matches(docs, keep=["doc_id"])
    base = F.filter("licenses", lambda m: m["base"])

    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    def score(m):
        return F.when(m["base"], F.lit(0.5)).otherwise(0.5 + m["agreement"] / 2)

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("licenses")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", score)), F.lit(0.0)).alias("score"),
    )
