"""Licence notices and texts in documents, found by a suffix automaton of licence words.

The automaton holds every run of words of every template. Streaming a text through it gives, word by
word, the longest run that ends there and stands in a template (matching statistics). Runs that
cannot be extended are matches; matches that follow each other both in the text and in a template
chain into a span, which covers a share of the template's words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pii_spark.llm.common import text_bytes, word_pieces

# Phrases whose every place counts, and their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# Notices and texts as their authors publish them, under the names of the licences.
TEMPLATES = (
    ("mit", "released under the MIT license"),
    ("mit", "licensed under the MIT license"),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
        "for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    (
        "gpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation",
    ),
    (
        "agpl-3.0",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
)

#: Shortest match that takes part in chains, most words between two matches of a chain, and the share
#: of a template that a chain must cover to give its label.
MIN_MATCH, MAX_GAP, MIN_SHARE = 4, 16, 0.8

SPAN = "struct<label:string,template:int,first_word:bigint,last_word:bigint,covered:int,share:double>"

# Words are runs of digits, letters and characters beyond ASCII; A to Z count as a to z.
_SEPARATOR = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class Automaton:
    """Generalised suffix automaton over the words of templates and phrases.

    A state stands for runs of words that end at the same places. ``ends`` are these places (template,
    words before the end) for states with runs of ``min_match`` words, and ``onward`` is the word that
    follows at all places of a state and of its shorter ends, -1 if they differ. ``phrases`` are the
    phrases (words, label) that end every run of a state, its suffixes included.
    """

    min_match: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    ends: list[tuple[tuple[int, int], ...]] = field(default_factory=list)
    onward: list[int] = field(default_factory=list)
    phrases: list[tuple[tuple[int, str], ...]] = field(default_factory=list)
    templates: list[list[int]] = field(default_factory=list)

    def _state(self, longest: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.step) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """Part the runs of ``q`` that extend ``p`` from its longer ones."""
        part = self._state(self.longest[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = part
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = part
            p = self.link[p]
        return part

    def extended(self, p: int, word: int) -> int:
        """The state of the prefix that ``p`` stands for and ``word``; added if it is new."""
        q = self.step[p].get(word)
        if q is not None:
            return q if self.longest[q] == self.longest[p] + 1 else self._split(p, word, q)
        new = self._state(self.longest[p] + 1, {}, 0)
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, word, q)
        return new

    def walk(self, ids: Sequence[int]) -> list[int]:
        states, at = [], 0
        for word in ids:
            at = self.step[at][word]
            states.append(at)
        return states

    def following(self, template: int, place: int) -> int | None:
        words = self.templates[template]
        return words[place] if place < len(words) else None

    def up(self, state: int) -> Iterator[int]:
        while state > 0:
            yield state
            state = self.link[state]


def build(
    templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], min_match: int = MIN_MATCH
) -> Automaton:
    """The automaton of ``templates`` and ``phrases`` (label, text); its size is bounded by theirs."""
    out = Automaton(min_match)
    lists = [
        [out.vocabulary.setdefault(w, len(out.vocabulary)) for w in words_of(text.encode())]
        for _, text in [*templates, *phrases]
    ]
    for ids in lists:
        at = 0
        for word in ids:
            at = out.extended(at, word)
    ends: list[list] = [[] for _ in out.step]
    for k, ids in enumerate(lists[: len(templates)]):
        for i, state in enumerate(out.walk(ids)):
            for s in out.up(state):
                if out.longest[s] >= min_match:
                    ends[s].append((k, i + 1))
    out.ends = [tuple(e) for e in ends]
    out.templates = lists[: len(templates)]
    for state in range(len(out.step)):
        # The shortest end that counts stands at all places of the longer ones.
        shortest = min((s for s in out.up(state) if out.ends[s]), key=lambda s: out.longest[s], default=0)
        after = {out.following(*place) for place in out.ends[shortest]}
        out.onward.append(-1 if len(after) != 1 or after == {None} else after.pop())
    whole = {}
    for (label, _), ids in zip(phrases, lists[len(templates) :], strict=True):
        if ids:
            whole.setdefault(out.walk(ids)[-1], []).append((len(ids), label))
    out.phrases = [tuple(p for s in out.up(state) for p in whole.get(s, ())) for state in range(len(out.step))]
    return out


def matched(automaton: Automaton, words: Iterator[list[bytes]]) -> tuple[int, list, list]:
    """Number of words, places (first word, label) of phrases, and matches (end, words, state, next word).

    ``words`` comes in pieces. A match is a run that the next word does not extend, in one of its
    places at least; state and length are all that is kept between words.
    """
    step, link, longest, phrases = automaton.step, automaton.link, automaton.longest, automaton.phrases
    onward = automaton.onward
    known, least = automaton.vocabulary.get, automaton.min_match
    places, matches = [], []
    at = length = n = 0
    for piece in words:
        for n, word in enumerate(piece, n + 1):
            word = known(word)
            if word is None:
                if length >= least:
                    matches.append((n - 1, length, at, word))
                at = length = 0
                continue
            if length >= least and onward[at] != word:
                matches.append((n - 1, length, at, word))
            if word not in step[at]:
                while at and word not in step[at]:
                    at = link[at]
                length = longest[at]
            if word in step[at]:
                at, length = step[at][word], length + 1
                for size, label in phrases[at]:
                    if size <= length:
                        places.append((n - size, label))
            else:
                length = 0
    if length >= least:
        matches.append((n, length, at, None))
    return n, places, matches


def segments(automaton: Automaton, matches: list) -> dict[int, list]:
    """Matches by template as (text start, text end, template start, template end), by text end.

    A match also stands for its shorter ends, which may be in other templates; the places where the
    next word goes on are left to the match that ends later.
    """
    found: dict[int, list] = {}
    for end, length, state, word in matches:
        seen = set()
        for s in automaton.up(state):
            size = min(length, automaton.longest[s])
            if size < automaton.min_match:
                break
            for template, place in automaton.ends[s]:
                if (template, place) in seen:
                    continue
                seen.add((template, place))
                if word is None or automaton.following(template, place) != word:
                    found.setdefault(template, []).append((end - size, end, place - size, place))
    for runs in found.values():
        runs.sort(key=lambda r: (r[1], r[0], r[2]))
    return found


def chained(runs: list, max_gap: int) -> list[tuple[int, int, int]]:
    """Spans (covered words, first word, end) of one template; of overlapping ones the best stays.

    A chain moves on in text and template alike; at most ``max_gap`` words lie between its runs in
    either. Only runs that end within reach of another one's start are looked at for it.
    """
    best: list[tuple[int, int]] = []
    for j, (start, end, low, high) in enumerate(runs):
        covered, first = end - start, start
        for i in range(j - 1, -1, -1):
            _, before, _, below = runs[i]
            if before < start - max_gap:
                break
            if before < end and below < high and low - below <= max_gap:
                total = best[i][0] + min(end - max(start, before), high - max(low, below))
                if total > covered:
                    covered, first = total, best[i][1]
        best.append((covered, first))
    spans: list[tuple[int, int, int]] = []
    order = sorted(range(len(runs)), key=lambda j: (-best[j][0], runs[j][1]))
    for j in order:
        covered, first = best[j]
        end = runs[j][1]
        at = bisect_left(spans, (first, 0, 0))
        if (at == 0 or spans[at - 1][1] <= first) and (at == len(spans) or spans[at][0] >= end):
            insort(spans, (first, end, covered))
    return [(covered, first, end) for first, end, covered in spans]


def scan(
    automaton: Automaton, templates: Sequence[tuple[str, str]], lengths: Sequence[int], text: bytes,
    max_gap: int = MAX_GAP, min_share: float = MIN_SHARE,
) -> dict:
    """What one text gives: counts, labels and spans, and the largest share of a template it covers."""
    n, places, matches = matched(automaton, (words_of(p) for p in word_pieces(text, _SEPARATOR)))
    spans, score = [], 1.0 if places else 0.0
    for template, runs in segments(automaton, matches).items():
        for covered, first, end in chained(runs, max_gap):
            share = covered / lengths[template]
            score = max(score, share)
            if share >= min_share:
                spans.append({
                    "label": templates[template][0], "template": template, "first_word": first, "last_word": end - 1,
                    "covered": covered, "share": share,
                })
    spans.sort(key=lambda s: (s["first_word"], s["last_word"], s["template"]))
    base = {label for _, label in places}
    starts = [start for start, _ in places]
    return {
        "n_words": n, "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s["label"] for s in spans})),
        "score": score, "spans": spans,
    }


MADE = (
    f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    f"score double, spans array<{SPAN}>"
)


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    min_match: int = MIN_MATCH,
    max_gap: int = MAX_GAP,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Replace ``text`` by what it holds of licences.

    ``n_words``; ``n_base``, ``first_word`` and ``last_word``: number, smallest and largest start of
    the places of ``phrases``; ``base_labels`` of these; ``spans``, the parts of the text that cover at
    least ``min_share`` of the words of a template; ``labels`` of phrases and spans; ``score``, the
    largest share that the text covers of a template, 1 where a phrase stands. Lists of labels are
    distinct, sorted and joined by commas.

    Null and empty texts have no words, null first and last words, empty labels and score 0. All other
    columns pass through, those named like a made one are replaced; equal rows give equal rows; an
    empty table gives an empty result. A text is read in pieces, so that memory beside the text itself
    depends on its matches only. Every row is on its own: no shuffle, and hot keys do not matter.
    """
    automaton = build(templates, phrases, min_match)
    lengths = [len(words_of(t.encode())) for _, t in templates]
    made = StructType.fromDDL(MADE)
    kept = [c for c in docs.columns if c != text and c not in made.fieldNames()]
    rows = docs.select(F.struct(*kept, F.lit(0).alias("_none")).alias("_row"), F.col(text).cast("string").alias("_text"))
    schema = StructType([rows.schema["_row"], *made.fields])
    numbers, reals = pa.int64(), pa.float64()
    span = pa.struct([
        ("label", pa.string()), ("template", pa.int32()), ("first_word", numbers), ("last_word", numbers),
        ("covered", pa.int32()), ("share", reals),
    ])
    types = [numbers] * 4 + [pa.string()] * 2 + [reals, pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(automaton, templates, lengths, t, max_gap, min_share) for t in text_bytes(batch.column("_text"))]
            columns = [pa.array([f[n] for f in found], t) for n, t in zip(made.fieldNames(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *columns], names=["_row", *made.fieldNames()])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in kept], *made.fieldNames())
