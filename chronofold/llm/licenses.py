"""Operator 7: license scans by fuzzy search for short notices.

Base labels are exact phrases of words. The method adds labels: each notice of a small list may occur with a bounded
number of edits. With k edits allowed, one of k + 1 parts of the notice must occur unchanged (pigeonhole), so an
Aho-Corasick automaton over all parts finds candidate places, and the regex library's bounded-error matching of the
whole notice near the place verifies the edits and reports the span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import ALNUM_FOLD, batch

#: Phrases of words and their base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices (folded words) and the labels that the method gives.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd-3-clause"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
)


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int


def notices(edit_share: float = 0.05) -> list[Notice]:
    """The list with the edits that each notice may have: a share of its length, 2 at least."""
    return [Notice(t, label, max(2, int(len(t) * edit_share))) for t, label in NOTICES]


def parts(notice: Notice) -> list[tuple[int, str]]:
    """edits + 2 parts of almost equal length, with their places."""
    n = notice.edits + 2
    cuts = [len(notice.text) * i // n for i in range(n + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds base phrases and fuzzy notices in a text that is folded to words with single spaces between."""

    def __init__(self, known: list[Notice]):
        import ahocorasick
        import regex

        self.known = known
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in known]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(known):
            for at, part in parts(n):
                seeds.setdefault(part, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for part, places in seeds.items():
            self.seeds.add_word(part, (len(part), tuple(places)))
        self.seeds.make_automaton()
        self.phrases = [(f" {p} ".encode(), label) for p, label in PHRASES.items()]

    def base(self, joined: bytes) -> list[tuple[int, str]]:
        """(first word, label) of each place of a base phrase; `joined` has a space before, between and after words."""
        out = []
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                out.append((joined.count(b" ", 0, at), label))
                at = joined.find(phrase, at + 1)
        return sorted(out)

    def fuzzy(self, joined: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of the verified notices, in code points of the folded text; the best of overlaps."""
        hits: dict[int, list[tuple[int, int]]] = {}  # by notice: (where it would begin, place of the part in it)
        for end, (size, places) in self.seeds.iter(joined):
            for i, at in places:
                hits.setdefault(i, []).append((end + 1 - size - at, at))
        found = []
        for i, near in hits.items():
            n = self.known[i]
            near.sort()
            k = 0
            while k < len(near):
                begin, together = k, {near[k][1]}
                while k + 1 < len(near) and near[k + 1][0] - near[k][0] <= n.edits:
                    k += 1
                    together.add(near[k][1])
                low, high = max(0, near[begin][0] - n.edits), min(len(joined), near[k][0] + len(n.text) + n.edits)
                k += 1
                if len(together) < 2:
                    continue
                at = joined.find(n.text, low, high)
                if at >= 0:
                    found.append((at, at + len(n.text), n.label, 0))
                    low = at + len(n.text)
                if high - low >= len(n.text) - n.edits:
                    for m in self.patterns[i].finditer(joined, low, high):
                        found.append((m.start(), m.end(), n.label, sum(m.fuzzy_counts)))
        best: list[tuple[int, int, str, int]] = []
        for x in sorted(found, key=lambda x: (x[3] / (x[1] - x[0] + 1), x[0], x[2])):
            if all(x[1] <= y[0] or x[0] >= y[1] for y in best):
                best.append(x)
        return sorted(best)


COLUMNS = (
    "doc_id long, n_words long, base array<struct<word: long, label: string>>, "
    "notices array<struct<start: long, end: long, label: string, edits: int>>"
)
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
        ("notices", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))),
    ]
)


def scan(docs: DataFrame, edit_share: float = 0.05) -> DataFrame:
    """Scans docs(doc_id, text): per row n_words, base places (word, label) and notices (start, end, label, edits).

    Words are runs of letters, digits and non-ASCII characters, A-Z folded; spans count code points of the words joined
    by single spaces. Null and empty texts have no words and no places; repeated rows are scanned each; very long texts
    are scanned whole, in linear time but for the verification near seeds.
    """
    known = notices(edit_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or "").encode().translate(ALNUM_FOLD).split()
                joined = b" " + b" ".join(words) + b" "
                base = scanner.base(joined)
                fuzzy = scanner.fuzzy(joined[1:-1].decode())
                out[0].append(doc)
                out[1].append(len(words))
                out[2].append([{"word": w, "label": label} for w, label in base])
                out[3].append([dict(zip(("start", "end", "label", "edits"), x, strict=True)) for x in fuzzy])
            yield batch(out, ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COLUMNS)


def labelled(scanned: DataFrame) -> DataFrame:
    """scan()'s rows as counts, first and last places, label lists and a score.

    The score is 1 for a base phrase or an unedited notice, less by the share of edited characters for others, 0 for none.
    """
    words = F.col("base.word")
    labels = F.array_union(F.col("base.label"), F.col("notices.label"))
    kept = F.transform("notices", lambda n: 1 - n["edits"] / (n["end"] - n["start"]))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.col("base.label"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.array_max(kept)), F.lit(0.0))).alias("score"),
        "notices",
    )
