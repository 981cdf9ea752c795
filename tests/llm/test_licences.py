"""Licence texts as they stand in files: wrapped, and behind comment signs."""

import textwrap

import pytest

from cairnwork.llm import licences

MADE = licences.Recogniser()
LONG = [r for r in licences.RULES if len(r[1]) > 1]


def found(text):
    return [m[:2] for m in MADE.match(MADE.identify(text))]


@pytest.mark.parametrize("sign", ["", "# ", "// ", " * "])
@pytest.mark.parametrize("rule", LONG, ids=lambda r: "+".join(r[1]))
def test_wrapped(rule, sign):
    paragraphs = [textwrap.wrap(licences.SENTENCES[k], 78 - len(sign)) for k in rule[1]]
    text = f"\n{sign}\n".join("\n".join(sign + line for line in p) for p in paragraphs)
    assert found(text) == [(rule[0], " ".join(rule[1]))]


def test_gap_counts_unknown_pieces():
    grant, keep = ("\n".join(textwrap.wrap(licences.SENTENCES[k], 40)) for k in ("mit-grant", "mit-keep"))
    assert found(f"{grant}\n{'Other words. ' * 3}\n{keep}") == [("MIT", "mit-grant mit-keep")]
    assert found(f"{grant}\n{'Other words. ' * 4}\n{keep}") == []


@pytest.mark.parametrize("before", ["<!-- ", "> ", "| ", "% ", "[", "• ", "“", " ", " " * 80, "_" * 80, "; \t—"])
def test_signs_before(before):
    assert found(f"{before}Licensed under the MIT License.") == [("MIT", "mit-licensed")]
    assert found(f"Some words.\n{before}Licensed under the MIT Licence.\n") == [("MIT", "mit-licensed")]


def test_the_index_covers_families_and_each_rule_is_found():
    licences_there = {licence for licence, _ in licences.ALL_RULES}
    assert len(licences_there) > 60 and {"LGPL-2.1-or-later", "AGPL-3.0-only", "GPL-2.0-or-later", "MPL-2.0", "EPL-2.0", "ISC", "Zlib", "Unlicense", "BSL-1.0", "CC-BY-NC-SA-3.0"} <= licences_there
    for licence, ids in licences.ALL_RULES:
        text = "\n\n".join(licences.ALL_SENTENCES[k] for k in ids)
        assert found(text) == [(licence, " ".join(ids))], (licence, ids)


@pytest.mark.parametrize(
    ("text", "licence"),
    [
        ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
        ("# SPDX-License-Identifier: MPL-2.0\n", "MPL-2.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"),
        ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", "MPL-2.0"),
        ("This project is licensed under the GNU Affero General Public License v3.0 or later.", "AGPL-3.0-or-later"),
    ],
)
def test_published_wordings(text, licence):
    assert [m[0] for m in found(text)] == [licence]


def test_unknown_wording_is_listed():
    text = "Some prose. This thing comes under a licence of our own making.\nLicensed under the MIT License. All warranties are void; nothing else.\nThe end"
    assert MADE.unknown(text, MADE.identify(text)) == ["This thing comes under a licence of our own making.", "All warranties are void;"]
    assert MADE.unknown("no such words", []) == [] and MADE.unknown("", []) == []
