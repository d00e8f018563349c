"""Fuzzy search for short license notices: exact seeds, then bounded-error matching.

A text becomes its words (A-Z lower-cased, runs of digits, letters and characters beyond
ASCII) joined by single spaces.  A notice may differ in up to ``len // CHARS_PER_EDIT``
characters.  Cut into one part more than that, a notice always has one part unchanged in any
match, so all parts of all notices go into one automaton; each hit gives a window of the
text, and the regex library's bounded-error matching searches the window, then what is left on
both sides of the best place, and counts the edits.  Notices without a hit in a text cannot match there.

The exact phrases (the base) are found on whole words and are always part of the result.
Null and empty texts have no words and no labels.  Rows are independent of each other, so
repeated rows and equal ids need no care.  Overlapping places of a phrase all count.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from phasewise.llm.common import column, portions, quoted, tidy

#: Base phrases and labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Notices as words, with the label they give.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu general public license version 3", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10
#: No match is longer than this many characters.
LONGEST = 2 * max(len(text) for text, _ in NOTICES)
#: A-Z in lower case, word characters as they are, all else to a space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Search:
    def __init__(self, notices: tuple[tuple[str, str], ...], chars_per_edit: int):
        import ahocorasick
        import regex

        parts: dict[str, list[tuple[int, int]]] = {}
        self.notices = []
        for n, (text, label) in enumerate(notices):
            edits = len(text) // chars_per_edit
            pattern = regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}")
            self.notices.append((label, pattern, edits, len(text)))
            cuts = [len(text) * k // (edits + 1) for k in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                parts.setdefault(text[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for part, places in parts.items():
            self.seeds.add_word(part, (len(part), places))
        self.seeds.make_automaton()

    def matches(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of the matches in a text of joined words."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.seeds.iter(text):
            for n, place in places:
                _, _, edits, length = self.notices[n]
                begin = end + 1 - size - place
                low, high = max(0, begin - edits), begin + length + edits
                own = windows.setdefault(n, [])
                if own and low <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], low), max(own[-1][1], high)
                else:
                    own.append([low, high])
        found = []
        for n, own in windows.items():
            label, pattern, _, _ = self.notices[n]
            for low, high in own:
                found += [(label, *m) for m in searched(pattern, text, low, min(high, len(text)))]
        found = sorted(set(found))
        # of overlapping matches of different labels, those with the fewest edits
        return [m for m in found
                if not any(o[1] < m[2] and m[1] < o[2] and o[0] != m[0] and o[3] < m[3] for o in _near(found, m))]


def searched(pattern, text: str, low: int, high: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of matches that do not overlap: the best one, and those on both sides of it."""
    found, todo = [], [(low, high)]
    while todo:
        low, high = todo.pop()
        m = pattern.search(text, low, high)
        if m:
            found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            todo += [(low, m.start()), (m.end(), high)]
    return found


def _near(found: list[tuple[str, int, int, int]], match: tuple[str, int, int, int]) -> list[tuple[str, int, int, int]]:
    """Matches that may overlap ``match``, of every label, from lists sorted by label and start."""
    near = []
    for label in {m[0] for m in found}:
        low = bisect.bisect_left(found, (label, match[1] - LONGEST))
        near += found[low:bisect.bisect_left(found, (label, match[2]))]
    return near


@cache
def search(notices: tuple, chars_per_edit: int) -> Search:
    return Search(notices, chars_per_edit)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLDED).split()


def base_places(joined: str, phrases: tuple[tuple[str, str], ...]) -> list[tuple[int, str]]:
    """(word index, label) of every place of a phrase; ``joined`` has a space at both ends."""
    found = []
    for phrase, label in phrases:
        needle = f" {phrase} "
        at, counted, spaces = joined.find(needle), 0, 0
        while at >= 0:
            spaces += joined.count(" ", counted, at + 1)  # on from the last place
            counted = at + 1
            found.append((spaces - 1, label))
            at = joined.find(needle, at + 1)
    return sorted(found)


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         phrases: tuple = PHRASES, notices: tuple = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Per row: id, word count, base places and labels, all labels, score and matched spans.

    score is 1 if a base phrase stands in the text, else the best 1 - edits / length over the
    matched notices, else 0.  Spans give first and last word of each matched notice.
    """
    kind = dict(docs.dtypes)[id_column]
    schema = (f"{quoted(id_column)} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, edits: int>>")

    def judged(text: str) -> tuple:
        own = search(notices, chars_per_edit)
        words = words_of(text)
        joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
        base = base_places(joined, phrases)
        spans = []
        counted = spaces = 0
        for label, start, end, edits in sorted(own.matches(joined), key=lambda m: m[1]):
            while start < end and joined[start] == " ":
                start += 1
            while end > start and joined[end - 1] == " ":
                end -= 1
            if start < counted:  # a match that began with the space behind the last one's first word
                spaces -= joined.count(" ", start, counted)
            else:
                spaces += joined.count(" ", counted, start)
            counted = start
            first = spaces - 1
            spans.append({"label": label, "first_word": first, "last_word": first + joined.count(" ", start, end),
                          "edits": edits, "score": 1 - edits / max(end - start, edits, 1)})
        spans.sort(key=lambda s: (s["label"], s["first_word"], s["last_word"], s["edits"]))
        base_labels = {label for _, label in base}
        labels = base_labels | {s["label"] for s in spans}
        score = 1.0 if base else max([0.0, *(s.pop("score") for s in spans)])
        return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
                [{k: v for k, v in s.items() if k != "score"} for s in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPANS]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = [judged(t) for texts in portions(batch.column(1)) for t in texts]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_column, *names])

    return docs.select(column(id_column), column(text_column).cast("string")).mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
