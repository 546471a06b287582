"""License notices by fuzzy short-notice search.

A notice may hold k edits, so it is split into k + 1 pieces: any text within k edits contains one of them unchanged. An automaton finds these exact
seeds in the text's words; only around a seed does the regex library's bounded-error matching verify the notice and report its span.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from txrisk.llm.common import text_of

# Phrases and labels of the base search.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices of the method, by label.
NOTICES = {
    "apache-2.0": ("licensed under the apache license version 2 0",),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",
            "redistributions of source code must retain the above copyright notice"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international"),
    "gpl-3.0": ("licensed under the gnu general public license version 3", "gnu general public license as published by the free software foundation"),
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy"),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0",),
    "proprietary": ("all rights reserved no part of this", "may not be reproduced without written permission"),
}
# One edit (character inserted, left out or changed) per so many characters of a notice.
CHARS_PER_EDIT = 12

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = ("id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label: string, first_word: long, last_word: long, edits: int, score: double>>")


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII."""
    return text.encode().translate(_FOLD).split()


@dataclass
class Notice:
    label: str
    text: str
    edits: int
    verify: regex.Pattern


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, tuple[str, ...]], chars_per_edit: int = CHARS_PER_EDIT):
        self.base = base
        self.phrases = {label: [re.compile(f"(?<![^ ]){re.escape(p)}(?![^ ])") for p, b in base.items() if b == label] for label in set(base.values())}
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for label, texts in notices.items():
            for text in texts:
                k = len(text) // chars_per_edit
                n = len(self.notices)
                # the word ends around a notice are not part of it: edits are counted inside
                self.notices.append(Notice(label, text, k, regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}")))
                for i in range(k + 1):
                    a, b = i * len(text) // (k + 1), (i + 1) * len(text) // (k + 1)
                    seeds.setdefault(text[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def base_places(self, joined: str) -> list[tuple[int, str]]:
        return [(m.start(), label) for label, ps in self.phrases.items() for p in ps for m in p.finditer(joined)]

    def near_places(self, joined: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, score) of verified notices in text order; of overlapping ones the best stays."""
        windows = set()
        for end, (length, places) in self.seeds.iter(joined):
            for n, offset in places:
                notice = self.notices[n]
                start = end - length + 1 - offset - notice.edits
                windows.add((n, max(0, start), min(len(joined), start + len(notice.text) + 2 * notice.edits)))
        queue: list[tuple] = []

        def search(n: int, start: int, stop: int) -> None:
            notice = self.notices[n]
            if stop - start >= len(notice.text) - notice.edits and (m := notice.verify.search(joined, start, stop)):
                edits = sum(m.fuzzy_counts)
                heappush(queue, (edits / len(notice.text) - 1, m.start(), notice.label, m.end(), edits, n, start, stop))
        for w in sorted(windows):
            search(*w)
        # accepted spans by start; they do not overlap
        best: list[tuple[int, int, str, int, float]] = []
        while queue:
            loss, a, label, b, edits, n, start, stop = heappop(queue)
            at = bisect_left(best, (b,))
            if at == 0 or best[at - 1][1] <= a:
                best.insert(at, (a, b, label, edits, 1 - edits / len(self.notices[n].text)))
            # what the accepted spans leave of the window may hold another match
            i = max(0, bisect_left(best, (start,)) - 1)
            while i < len(best) and best[i][0] < stop:
                if best[i][1] > start:
                    search(n, start, best[i][0])
                    start = best[i][1]
                i += 1
            search(n, start, stop)
        return [(label, a, b, edits, score) for a, b, label, edits, score in best]

    def scan(self, text: str) -> dict:
        words = words_of(text)
        joined = b" ".join(words).decode()
        base, near = self.base_places(joined), self.near_places(joined)
        starts: list[int] = []
        if base or near:
            at = 0
            for w in joined.split(" "):
                starts.append(at)
                at += len(w) + 1
        word = lambda at: bisect_right(starts, at) - 1
        at = sorted(word(p) for p, _ in base)
        labels = {label for _, label in base}
        return {"n_words": len(words), "n_base": len(base), "first_word": at[0] if at else None, "last_word": at[-1] if at else None,
                "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {f[0] for f in near})),
                "score": 1.0 if base else max((f[4] for f in near), default=0.0),
                "spans": [{"label": f[0], "first_word": word(f[1]), "last_word": word(f[2] - 1), "edits": f[3], "score": f[4]} for f in near]}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None,
                 notices: dict[str, tuple[str, ...]] | None = None, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row per input row.

    Base places are exact runs of a phrase's words; spans are notices within their edit bound, given by words. Labels are distinct, sorted and joined
    by commas, empty where none is found. Null text counts as empty: no words, no places, score 0. The score is 1 with a base place, else that of the best
    span. Rows that repeat are scanned each; an empty table gives no rows.
    """
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, chars_per_edit)
        for batch in batches:
            rows = [{"id": i} | scanner.scan(t.as_py()) for i, t in zip(batch["id"].to_pylist(), batch["text"])]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())])
ARROW = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                   ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])
