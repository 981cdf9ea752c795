"""An index of licences: their sentences by identifier, and rules over them, made from families of wordings.

Names, versions and sentences are those of the published licences; the families below say how
they are put together, so that a licence of a family has every wording that its sisters have.
"""

from __future__ import annotations

from itertools import product

Sentences = dict[str, str]
Rules = tuple[tuple[str, tuple[str, ...]], ...]

# Sentences of permissive licences, in their order in the licence.
PERMISSION = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
TEXTS: dict[str, dict[str, str]] = {
    "MIT-0": {"mit0-grant": f"{PERMISSION}."},
    "ISC": {
        "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    },
    "0BSD": {"0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."},
    "Zlib": {
        "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
        "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
        "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "zlib-credit": "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "zlib-notice": "This notice may not be removed or altered from any source distribution.",
    },
    "Unlicense": {
        "unlicense-free": "This is free and unencumbered software released into the public domain.",
        "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    },
    "BSL-1.0": {
        "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    },
    "PostgreSQL": {
        "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    },
    "WTFPL": {"wtfpl-copy": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."},
    "MPL-2.0": {
        "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "mpl2-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    },
    "MPL-1.1": {"mpl11-subject": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'},
    "EPL-2.0": {"epl2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/."},
    "EPL-1.0": {"epl1-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html."},
    "CDDL-1.0": {"cddl-subject": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").'},
    "OFL-1.1": {"ofl-licensed": "This Font Software is licensed under the SIL Open Font License, Version 1.1."},
}
# The disclaimer that two and three clauses of BSD end with, and the clause that makes four.
BSD = {
    "bsd-asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
}
# The names of licences, by their SPDX identifier.
NAMES = {
    "MIT": ("MIT License",), "MIT-0": ("MIT No Attribution License",), "ISC": ("ISC License",), "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License"), "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"), "BSD-4-Clause": ("BSD 4-Clause License", "Original BSD License"), "Zlib": ("zlib License",), "Unlicense": ("Unlicense",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"), "PostgreSQL": ("PostgreSQL License",), "WTFPL": ("WTFPL",), "Apache-1.1": ("Apache License, Version 1.1", "Apache License 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"), "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License, Version 1.0"), "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0",), "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL, Version 1.2"), "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "Artistic-2.0": ("Artistic License 2.0",), "CC0-1.0": ("Creative Commons Zero 1.0", "CC0 1.0 Universal"), "Python-2.0": ("Python Software Foundation License Version 2",), "AFL-3.0": ("Academic Free License version 3.0",),
    "MS-PL": ("Microsoft Public License",), "NCSA": ("University of Illinois/NCSA Open Source License",),
}
NOTICES = {"licensed": "Licensed under the {}.", "released": "Released under the {}.", "distributed": "Distributed under the {}.", "work": "This work is licensed under the {}.", "project": "This project is licensed under the {}.", "software": "This software is licensed under the {}."}
# The GNU licences with their versions, and the Creative Commons licences with theirs.
GNU = {"GPL": ("General", ("1.0", "2.0", "3.0")), "LGPL": ("Lesser General", ("2.1", "3.0")), "AGPL": ("Affero General", ("3.0",))}
COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
PORTS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _permissive() -> tuple[Sentences, list]:
    sentences, rules = dict(BSD), []
    for licence, texts in TEXTS.items():
        sentences |= texts
        rules += [(licence, tuple(texts)), (licence, tuple(texts)[:1])]
    clauses = ("bsd-grant", "bsd-source", "bsd-binary")
    for licence, more in (("BSD-4-Clause", ("bsd-advertising", "bsd-endorse")), ("BSD-3-Clause", ("bsd-endorse",)), ("BSD-2-Clause", ())):
        rules += [(licence, (*clauses, *more, "bsd-asis", "bsd-liability")), (licence, (*clauses, *more))]
    rules += [("ISC", ("isc-grant", "mit-asis")), ("0BSD", ("0bsd-grant", "isc-warranty", "isc-liability")), ("MIT-0", ("mit0-grant", "mit-asis", "mit-liability"))]
    zlib = tuple(TEXTS["Zlib"])
    rules.append(("Zlib", (*zlib[:4], *zlib[5:])))  # the sentence on credit is left out by some
    return sentences, rules


def _notices() -> tuple[Sentences, list]:
    sentences, rules = {}, []
    names = dict(NAMES)
    for family, (kind, versions) in GNU.items():
        for v in versions:
            short = v.removesuffix(".0")
            names[f"{family}-{v}-only"] = tuple(f"GNU {kind} Public License{mark}" for mark in (f", version {short}", f" v{v}", f" version {short}"))
            names[f"{family}-{v}-or-later"] = tuple(f"GNU {kind} Public License{mark} or later" for mark in (f", version {short}", f" v{v}", f" version {short}"))
    for licence, own in names.items():
        for (key, form), (i, name) in product(NOTICES.items(), enumerate(own)):
            sentences[f"{licence.lower()}-{key}-{i}"] = form.format(name)
            rules.append((licence, (f"{licence.lower()}-{key}-{i}",)))
        sentences[f"{licence.lower()}-spdx"] = f"SPDX-License-Identifier: {licence}"
        rules.append((licence, (f"{licence.lower()}-spdx",)))
    return sentences, rules


def _gnu() -> tuple[Sentences, list]:
    sentences, rules = {}, []
    for thing in ("program", "library"):
        for family, (kind, versions) in GNU.items():
            free = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation"
            warranty = f"gnu-{thing}-warranty"
            sentences[warranty] = f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
            see = f"{family.lower()}-see"
            sentences[see] = f"See the GNU {kind} Public License for more details."
            for v in versions:
                short = v.removesuffix(".0")
                key = f"{family.lower()}-{v}-{thing}"
                ends = {"or-later": (f", either version {short} of the License, or (at your option) any later version.",), "only": (f", version {short}.", f", version {short} of the License.")}
                for mode, wordings in ends.items():
                    for i, end in enumerate(wordings):
                        name = f"{key}-{mode}-{i}"
                        sentences[name] = free + end
                        rules += [(f"{family}-{v}-{mode}", (name, warranty, see)), (f"{family}-{v}-{mode}", (name, warranty)), (f"{family}-{v}-{mode}", (name,))]
    return sentences, rules


def _commons() -> tuple[Sentences, list]:
    sentences, rules = {}, []
    for (short, long), (v, port) in product(COMMONS.items(), PORTS.items()):
        licence = f"CC-{short}-{v}"
        forms = [f"This work is licensed under a Creative Commons {long} {v} {port} License.", f"Licensed under a Creative Commons {long} {v} {port} License.", f"Licensed under CC {short} {v}.", f"This work is licensed under CC {short} {v}.", f"SPDX-License-Identifier: {licence}"]
        for i, form in enumerate(forms):
            sentences[f"{licence.lower()}-{i}"] = form
            rules.append((licence, (f"{licence.lower()}-{i}",)))
    return sentences, rules


def index(sentences: Sentences, rules: Rules, normal) -> tuple[Sentences, Rules]:
    """``sentences`` and ``rules`` with those of all families; a sentence that is there keeps its identifier. Longer rules come first, of equal length the given ones."""
    by_text = {normal(text): name for name, text in sentences.items()}
    every, made, names = dict(sentences), [], {}
    for own, rules_of in (_permissive(), _gnu(), _commons(), _notices()):
        for name, text in own.items():
            names[name] = by_text.setdefault(normal(text), name)
            if names[name] == name:
                every[name] = text
        made += [(licence, tuple(names.get(x, x) for x in ids)) for licence, ids in rules_of]
    first: dict[tuple[str, ...], str] = {}
    for licence, ids in (*rules, *made):
        first.setdefault(ids, licence)
    return every, tuple(sorted(((licence, ids) for ids, licence in first.items()), key=lambda r: -len(r[1])))
