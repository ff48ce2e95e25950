"""License scans: places where a text holds a template's words, with optional and replaceable regions.

Template markup. Words stand for themselves; `<<beginOptional>>` ... `<<endOptional>>` encloses words that may be absent and
may nest; `<<var;words=2-5>>` stands for 2 to 5 words of any kind (other fields of the tag, as name, are ignored). All
templates are compiled into one automaton over words, whose sets of states are made into single states as texts meet them.
A place is accepted only if every mandatory word stands there, in order, with nothing between but the regions.

A batch's words are found and looked up at once: bytes are mapped to classes, words of the templates' vocabulary are told by
their bytes (no hash decides), and only pairs of words that begin a template start the automaton. A text may be of any
length; words are looked up in blocks that end between words.

Defined results: null and empty texts have no words and no places. A place is the longest from its first word; of one
template, places inside an earlier one are not reported. Repeated rows and ids are scanned each. Input columns beyond those
named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, flat

ANY, OTHER, END = "<any>", -1, -2


@dataclass(frozen=True)
class Template:
    """A template with the label it gives."""

    name: str
    label: str
    text: str


_WARRANTY = (
    "in no event shall <<var;words=1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
    "arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<beginOptional>> 1 <<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<beginOptional>> 2 <<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution"
)
_BSD_TAIL = (
    "this software is provided by <<var;words=1-14>> as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;words=1-14>> be liable for any direct indirect incidental special "
    "exemplary or consequential damages"
)

# The phrases of the query's contract, then public licenses and their usual notices.
BASE = (
    Template("mit phrase", "mit", "under the mit license"),
    Template("apache phrase", "apache-2", "apache license version 2"),
    Template("cc phrase", "cc-by-nc", "cc by nc"),
)
TEMPLATES = (
    *BASE,
    Template(
        "mit text",
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "<<beginOptional>> including the next paragraph <<endOptional>> shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement " + _WARRANTY,
    ),
    Template("mit notice", "mit", "under the <<beginOptional>> terms of the <<endOptional>> mit <<beginOptional>> open source <<endOptional>> license"),
    Template("apache notice", "apache-2", "under the <<beginOptional>> terms of the <<endOptional>> apache license <<beginOptional>> version <<endOptional>> 2 <<beginOptional>> 0 <<endOptional>>"),
    Template("bsd 2", "bsd-2-clause", _BSD_HEAD + " " + _BSD_TAIL),
    Template(
        "bsd 3",
        "bsd-3-clause",
        _BSD_HEAD + " <<beginOptional>> 3 <<endOptional>> neither the name of <<var;words=1-14>> may be used to endorse or promote products derived from this software "
        "without specific prior written permission " + _BSD_TAIL,
    ),
    Template(
        "isc text",
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
        "this permission notice appear in all copies",
    ),
    Template("gpl notice", "gpl", "gnu general public license <<beginOptional>> <<var;words=0-12>> either <<endOptional>> version <<var;words=1-1>>"),
    Template("gpl 3", "gpl-3", "gnu general public license <<beginOptional>> <<var;words=0-12>> either <<endOptional>> version 3"),
    Template("lgpl notice", "lgpl", "gnu <<beginOptional>> lesser <<endOptional>> <<beginOptional>> library <<endOptional>> general public license <<var;words=0-14>> lesser"),
    Template("lesser gpl", "lgpl", "gnu lesser general public license"),
    Template("affero gpl", "agpl", "gnu affero general public license"),
    Template("cc nc 4", "cc-by-nc-4", "licensed under <<var;words=0-6>> cc by nc <<beginOptional>> sa <<endOptional>> <<beginOptional>> nd <<endOptional>> 4 <<beginOptional>> 0 <<endOptional>>"),
    Template("cc nc name", "cc-by-nc", "creative commons attribution <<beginOptional>> non <<endOptional>> noncommercial"),
    Template("reserved", "all-rights-reserved", "all rights <<beginOptional>> are <<endOptional>> reserved"),
    Template("held", "copyright-notice", "copyright <<beginOptional>> c <<endOptional>> <<var;words=1-10>> all rights reserved"),
)

Part = str | tuple[int, int] | list


def parse(text: str) -> list[Part]:
    """Words, (least, most) of a replaceable region, and lists of optional parts."""
    stack: list[list[Part]] = [[]]
    for tag, word in re.findall(r"<<([^>]*)>>|([^\s<>]+)", text):
        if word:
            stack[-1].append(word)
        elif tag == "beginOptional":
            stack.append([])
        elif tag == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(inner)
        elif tag.split(";")[0] == "var":
            words = re.search(r";\s*words=(\d+)-(\d+)", tag)
            if not words or int(words[1]) > int(words[2]):
                raise ValueError(f"a replaceable region states its words as words=least-most: {tag}")
            stack[-1].append((int(words[1]), int(words[2])))
        else:
            raise ValueError(f"unknown tag {tag}")
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


def mandatory(parts: list[Part]) -> int:
    return sum(isinstance(p, str) for p in parts)


def weight(t: Template) -> float:
    """What a place of the template counts for: m / (m + 2), with m its mandatory words."""
    m = mandatory(parse(t.text))
    return m / (m + 2)


def regex(t: Template) -> str:
    """The template as a regular expression over a text whose words each stand between blanks of their own."""

    def of(parts: list[Part]) -> str:
        return "".join(
            f" {re.escape(p)} " if isinstance(p, str) else f"(?:{of(p)})?" if isinstance(p, list) else f"(?: [^ ]+ ){{{p[0]},{p[1]}}}" for p in parts
        )

    return of(parse(t.text))


class Automaton:
    """All templates as one automaton over words; deterministic states are made when a text first meets them."""

    def __init__(self, templates: Sequence[Template]) -> None:
        self.templates = tuple(templates)
        self.moves: list[dict[str, set[int]]] = []
        self.skips: list[set[int]] = []
        self.accepts: dict[int, int] = {}
        starts = set()
        for number, t in enumerate(self.templates):
            first = self._state()
            starts.add(first)
            last = self._add(first, parse(t.text))
            if last in self._closure({first}):
                raise ValueError(f"{t.name}: a template needs a mandatory word")
            if any(ANY in self.moves[s] for s in self._closure({first})):
                raise ValueError(f"{t.name}: a template can't begin with a replaceable region")
            self.accepts[last] = number
        vocabulary = sorted({w for m in self.moves for w in m if w != ANY}, key=lambda w: w.encode())
        self.word_ids = {w: i for i, w in enumerate(vocabulary)}
        self.known: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.table: list[dict[int, int]] = []
        self.found: list[tuple[int, ...]] = []
        self.dead, self.start = self._known(frozenset()), self._known(frozenset(self._closure(starts)))
        self.pairs = self._pairs()
        self.words = Vocabulary(vocabulary)

    def _state(self) -> int:
        self.moves.append({})
        self.skips.append(set())
        return len(self.moves) - 1

    def _add(self, at: int, parts: list[Part]) -> int:
        """Adds parts after a state; returns the state behind them."""
        for p in parts:
            if isinstance(p, list):
                end = self._add(at, p)
                self.skips[at].add(end)
                at = end
                continue
            steps = [(p, False)] if isinstance(p, str) else [(ANY, i >= p[0]) for i in range(p[1])]
            ends = []
            for word, may_end in steps:
                if may_end:
                    ends.append(at)
                to = self._state()
                self.moves[at].setdefault(word, set()).add(to)
                at = to
            for e in ends:
                self.skips[e].add(at)
            # an optional part that follows must not share the state that was skipped to
            fresh = self._state()
            self.skips[at].add(fresh)
            at = fresh
        return at

    def _closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return out

    def _known(self, states: frozenset[int]) -> int:
        if states not in self.known:
            self.known[states] = len(self.sets)
            self.sets.append(states)
            self.table.append({})
            self.found.append(tuple(sorted(self.accepts[s] for s in states if s in self.accepts)))
        return self.known[states]

    def step(self, state: int, word: int) -> int:
        """The state after a word: an id of the vocabulary, OTHER or END."""
        row = self.table[state]
        if word not in row:
            to: set[int] = set()
            if word != END:
                for s in self.sets[state]:
                    for w, targets in self.moves[s].items():
                        if w == ANY or self.word_ids[w] == word:
                            to |= targets
            row[word] = self._known(frozenset(self._closure(to)))
        return row[word]

    def _pairs(self) -> np.ndarray:
        """Which two words can begin a template; END and OTHER stand at the last two places."""
        n = len(self.word_ids)
        ok = np.zeros((n + 2, n + 2), bool)
        for a in range(n):
            one = self.step(self.start, a)
            if one != self.dead:
                for b in (*range(n), END, OTHER):
                    ok[a, b] = bool(self.found[one]) or self.step(one, b) != self.dead
        return ok

    def places(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first, end) in the order of first, over ids that end in END."""
        at = np.flatnonzero(self.pairs[ids[:-1], ids[1:]])
        out, inside = [], {}
        for i in at.tolist():
            j, state, ends = i, self.start, {}
            while state != self.dead:
                state = self.step(state, int(ids[j]))
                j += 1
                for t in self.found[state]:
                    ends[t] = j
            for t in sorted(ends):
                if ends[t] > inside.get(t, -1):
                    inside[t] = ends[t]
                    out.append((t, i, ends[t]))
        return out


#: Bytes of words to their lower-case form, all others to 0.
CLASS = np.zeros(256, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    CLASS[_c] = _c
CLASS[65:91] = CLASS[97:123]

BLOCK = 1 << 22


class Vocabulary:
    """Looks words up by their bytes: a table of the first two bytes and the lengths lets few through, the rest are compared in full."""

    def __init__(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        self.lanes = max((len(w) for w in raw), default=1) // 8 + 1
        self.width = 8 * self.lanes
        self.lengths = np.zeros(1 << 16, np.uint64)
        for w in raw:
            self.lengths[w[0] | (w[1] << 8 if len(w) > 1 else 0)] |= np.uint64(1 << min(len(w), 63))
        full = np.frombuffer(b"".join(w.ljust(self.width, b"\0") for w in raw), "<u8").reshape(len(raw), self.lanes)
        self.key = self._key(full)
        if len(np.unique(self.key)) < len(raw):
            raise ValueError("two words have one key")
        self.order = np.argsort(self.key)
        self.full, self.key = full[self.order], self.key[self.order]

    def _key(self, full: np.ndarray) -> np.ndarray:
        return (full * (np.arange(1, self.lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(1, dtype=np.uint64)

    def ids(self, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """An id or OTHER of each word; low has the bytes' classes."""
        out = np.full(len(starts), OTHER, np.int32)
        low = np.concatenate((low, np.zeros(self.width, np.uint8)))
        second = np.where(sizes > 1, low[starts + 1], 0).astype(np.int64) << 8
        maybe = np.flatnonzero((self.lengths[low[starts] | second] >> np.minimum(sizes, 63).astype(np.uint64)) & np.uint64(1))
        if len(maybe):
            place = np.arange(self.width)
            text = np.where(place < sizes[maybe][:, None], low[starts[maybe][:, None] + place], 0).astype(np.uint8)
            full = np.ascontiguousarray(text).view("<u8")
            at = np.minimum(np.searchsorted(self.key, self._key(full)), len(self.key) - 1)
            same = (self.full[at] == full).all(1) & (sizes[maybe] <= self.width)
            out[maybe[same]] = self.order[at[same]]
        return out


def words(raw: np.ndarray, offs: np.ndarray, look: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words with END behind each row's, and where each row's ids begin (n + 1 places)."""
    n, total = len(offs) - 1, len(raw)
    counts, ids, a = np.zeros(n + 1, np.int64), [], 0
    while a < total:
        b = min(a + BLOCK, total)
        while b < total and CLASS[raw[b]]:
            b += 1
        low = CLASS[raw[a:b]]
        heads = offs[(offs > a) & (offs < b)] - a
        is_word = low > 0
        first, last = is_word.copy(), is_word.copy()
        first[1:] &= ~is_word[:-1]
        last[:-1] &= ~is_word[1:]
        first[heads], last[heads - 1] = is_word[heads], is_word[heads - 1]
        starts = np.flatnonzero(first)
        sizes = np.flatnonzero(last) + 1 - starts
        np.add.at(counts, np.searchsorted(offs, starts + a, "right"), 1)
        ids.append(look.ids(low, starts, sizes))
        a = b
    begin = np.cumsum(counts) + np.arange(n + 1)
    out = np.full(begin[-1], END, np.int32)
    own = np.ones(begin[-1], bool)
    own[begin[1:] - 1] = False
    out[own] = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return out, begin


@lru_cache(maxsize=4)
def compiled(templates: tuple[Template, ...]) -> Automaton:
    return Automaton(templates)


PLACES = pa.list_(pa.struct([("template", pa.string()), ("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))


def scan(rows: DataFrame, id_col: str, text_col: str, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """id, n_words, places: each place's template, label, first word and the word after its last, words counted from 0."""
    templates = tuple(templates)
    compiled(templates)  # refuses bad templates before a job starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = compiled(templates)
        for whole in batches:
            for batch in by_bytes(whole, "text", BLOCK):
                ids, begin = words(*flat(batch.column("text")), auto.words)
                found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                hits = auto.places(ids) if len(ids) > 1 else []
                of = (np.searchsorted(begin, [h[1] for h in hits], "right") - 1).tolist()
                for (t, i, j), row in zip(hits, of, strict=True):
                    start = int(begin[row])
                    found[row].append({"template": templates[t].name, "label": templates[t].label, "first": i - start, "end": j - start})
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(begin) - 1), pa.array(found, PLACES)], ["id", "n_words", "places"])

    kind = rows.select(rows[id_col].alias("id")).dtypes[0][1]
    t = rows.select(rows[id_col].alias("id"), F.coalesce(rows[text_col].cast("string"), F.lit("")).alias("text"))
    return t.mapInArrow(run, f"id {kind}, n_words long, places array<struct<template: string, label: string, first: bigint, end: bigint>>")


def summary(found: DataFrame, base: Sequence[Template] = BASE, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of scanned rows, on the JVM.

    score: the greatest weight of a template found, 0 without any."""
    place = F.filter("places", lambda p: p["template"].isin(*[t.name for t in base]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    weights = F.create_map(*[F.lit(x) for t in templates for x in (t.name, weight(t))])
    return found.withColumn("_base", place).select(
        "id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda p: p["first"])).alias("last_word"),
        joined(F.col("_base")).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: weights[p["template"]])), F.lit(0.0)).alias("score"),
    )
