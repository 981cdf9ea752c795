"""Licence scans by sentence rules.

A text is cut into sentences, each sentence is normalised and mapped to the identifier of
a known licence sentence, and the sequence of identifiers is matched against licence rules
in their order: at each place the first rule whose identifiers stand there wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.llm.licence_index import index

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "apache2-notice": "Licensed under the Apache License, Version 2.0.",
    "apache2-header": 'Licensed under the Apache License, Version 2.0 (the "License").',
    "apache2-comply": "You may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    "apache2-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3-only-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-notice": "Licensed under CC BY 4.0.",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "later-version": "You may use any later version of this license.",
}
# Licence rules, the most specific first.
RULES = (
    ("MIT", ("mit-grant", "mit-keep", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-header", "apache2-comply", "apache2-copy", "apache2-warranty", "apache2-see")),
    ("Apache-2.0", ("apache2-header", "apache2-comply")),
    ("Apache-2.0", ("apache2-notice",)),
    ("GPL-3.0-or-later", ("gpl-terms", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-terms",)),
    ("GPL-3.0-or-later", ("gpl3-notice", "later-version")),
    ("GPL-3.0-only", ("gpl3-only-terms",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC0-1.0", ("cc0-notice",)),
)
SENTENCE_END = re.compile(r"[.!?;:]+(?=\s|$)|\n")
NOT_WORD = re.compile(r"[\W_]+")
WORD = re.compile(r"[^\W_]+")


def normalise(sentence: str) -> str:
    """Lower case, letters and digits only, one blank between, American spelling."""
    return NOT_WORD.sub(" ", sentence).strip().lower().replace("licence", "license")


def _joined(text: str) -> str:
    """A sentence as it is known: its pieces normalised and put together."""
    return " ".join(p for p in map(normalise, SENTENCE_END.split(text)) if p)


#: The sentences and rules above with those of all families of licences.
ALL_SENTENCES, ALL_RULES = index(SENTENCES, RULES, _joined)
#: Words of pieces that speak of a licence.
SPEAKS = re.compile(r"\b(?:licen[sc]e[ds]?|licensing|copyright|warrant(?:y|ies)|redistribut\w+|public domain)\b", re.IGNORECASE)


@dataclass
class Recogniser:
    """Known sentences by their normalised form, and rules; ``gap`` unknown sentences (or lines of one) may stand between two known ones of a rule."""

    sentences: dict[str, str] = field(default_factory=lambda: ALL_SENTENCES)
    rules: tuple[tuple[str, tuple[str, ...]], ...] = ALL_RULES
    gap: int = 3

    def __post_init__(self) -> None:
        self.known: dict[str, str] = {}
        self.starts: set[str] = set()
        for name, text in self.sentences.items():
            parts = [normalise(p) for p in SENTENCE_END.split(text)]
            words = " ".join(p for p in parts if p).split(" ")
            self.known[" ".join(words)] = name
            self.starts.update(" ".join(words[:k]) for k in range(1, len(words)))
        self.heads = {k.split(" ")[0] for k in self.known}
        self.by_first: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
        for rule in self.rules:
            self.by_first.setdefault(rule[1][0], []).append(rule)

    def identify(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(identifier, first piece, last piece, start, end) of known sentences in order; pieces without words aren't numbered.

        A sentence may go on over line breaks and inner stops: pieces are joined while
        they begin a known sentence, and the longest known sentence from a piece is taken.
        """
        pieces, at = [], 0
        for stop in SENTENCE_END.finditer(text):
            if WORD.search(text, at, stop.end()):
                pieces.append((at, stop.end()))
            at = stop.end()
        if WORD.search(text, at):
            pieces.append((at, len(text)))
        out, i = [], 0
        while i < len(pieces):
            best, j, joined = None, i, ""
            head = WORD.search(text, *pieces[i])[0].lower()
            while head.replace("licence", "license") in self.heads and j < len(pieces):
                joined = f"{joined} {normalise(text[slice(*pieces[j])])}".strip()
                if joined in self.known:
                    best = (self.known[joined], i, j, pieces[i][0], pieces[j][1])
                if joined not in self.starts:
                    break
                j += 1
            if best:
                out.append(best)
                i = best[2]
            i += 1
        return out

    def unknown(self, text: str, found: list[tuple[str, int, int, int, int]]) -> list[str]:
        """The pieces that speak of a licence and belong to no known sentence, without white space around them."""
        if not SPEAKS.search(text):
            return []
        out, at, spans = [], 0, [(f[3], f[4]) for f in found]
        for end in [*(stop.end() for stop in SENTENCE_END.finditer(text)), len(text)]:
            piece = text[at:end].strip()
            if SPEAKS.search(piece) and not any(a <= at and end <= b or a < end and at < b for a, b in spans):
                out.append(piece)
            at = end
        return out

    def match(self, found: list[tuple[str, int, int, int, int]]) -> list[tuple[str, str, int, int]]:
        """(licence, identifiers, start, end) of the rules that stand in the sequence, from left to right."""
        out, i = [], 0
        while i < len(found):
            for licence, wanted in self.by_first.get(found[i][0], ()):
                own = found[i : i + len(wanted)]
                near = all(b[1] - a[2] <= self.gap + 1 for a, b in zip(own, own[1:], strict=False))
                if tuple(x[0] for x in own) == wanted and near:
                    out.append((licence, " ".join(wanted), own[0][3], own[-1][4]))
                    i += len(wanted) - 1
                    break
            i += 1
        return out


def scan(docs: DataFrame, recogniser: Recogniser | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, sentences array<string>, matches array<struct<licence, rule, start, end>>, unknown array<string>)`` for each row.

    Starts and ends are code points; ``unknown`` lists pieces that speak of a licence in words that aren't known. Null and empty texts have no sentences; texts are read
    whole; the other columns are not read; an empty table gives no rows.
    """
    made = recogniser or Recogniser()
    entry = pa.struct([("licence", pa.string()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, matches, unknown = [], [], []
            for x in batch.column(1):
                found = made.identify(x.as_py() or "")
                names.append([f[0] for f in found])
                unknown.append(made.unknown(x.as_py() or "", found))
                matches.append([dict(zip(("licence", "rule", "start", "end"), m, strict=True)) for m in made.match(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(matches, pa.list_(entry)), pa.array(unknown, pa.list_(pa.string()))], names=["id", "sentences", "matches", "unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, sentences array<string>, matches array<struct<licence: string, rule: string, start: int, end: int>>, unknown array<string>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def licence_table(docs: DataFrame, recogniser: Recogniser | None = None) -> DataFrame:
    """``(doc_id, n_sentences, sentence_ids, n_matches, licences, n_unknown)`` for each row of ``docs``, nulls and all else as in ``scan``."""
    return scan(docs, recogniser).select(
        "doc_id",
        F.size("sentences").cast("bigint").alias("n_sentences"),
        F.array_join("sentences", " ").alias("sentence_ids"),
        F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("matches.licence"))), ",").alias("licences"),
        F.size("unknown").cast("bigint").alias("n_unknown"),
    )
