"""License scans: Dice coefficient over word bigrams between stretches of a text and licence templates."""

from __future__ import annotations

import re
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame

from quire.llm.common import map_texts

#: Least Dice coefficient of a match.
LEAST = 0.8

# Notices and texts of public licences, by licence name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": "This work is licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "This work is licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

# The other common licences by name: notices, the same in other words, and standard headers.
_NAMED = {
    "AGPL-3.0": ("GNU Affero General Public License", "version 3"),
    "GPL-1.0": ("GNU General Public License", "version 1"),
    "GPL-2.0": ("GNU General Public License", "version 2"),
    "LGPL-2.0": ("GNU Library General Public License", "version 2"),
    "LGPL-2.1": ("GNU Lesser General Public License", "version 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License", "version 3"),
}
for _name, (_title, _version) in _NAMED.items():
    TEMPLATES[_name] = f"This work is licensed under the {_title}, {_version}."
    TEMPLATES[f"{_name}-header"] = TEMPLATES["GPL-3.0-header"].replace("version 3", _version).replace("GNU General Public License", _title)
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _kind, _title in _CC.items():
    for _version, _port in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        for _name, _text in ((f"CC-{_kind}-{_version}", f"Licensed under CC {_kind} {_version}."), (f"CC-{_kind}-{_version}-notice", f"This work is licensed under a Creative Commons {_title} {_version} {_port} License.")):
            if _text not in TEMPLATES.values():
                TEMPLATES[_name if _name not in TEMPLATES else f"{_name}-short"] = _text
TEMPLATES |= {
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "ISC-notice": "Released under the ISC License.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "ISC-text": TEMPLATES["ISC"] + (
        " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}

_WORD = re.compile(r"[^\W_]+")


@cache
def all_templates() -> dict[str, str]:
    """TEMPLATES and the whole texts in licence_texts/, these under the licence's name and -text."""
    found = resources.files("quire.llm") / "licence_texts"
    texts = {f"{f.name.removesuffix('.txt')}-text": f.read_text("utf-8") for f in sorted(found.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
    return TEMPLATES | texts


def words_of(text: str | None) -> list[str]:
    """Normalised words: lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower()) if text else []


class Scanner:
    """Finds in a text the stretches most like each template.

    `where` maps each bigram of a template to the templates that hold it, so a text is read once for all templates.
    """

    def __init__(self, templates: dict[str, str], least: float = LEAST):
        from collections import Counter

        self.least = least
        self.bigrams: dict[str, Counter] = {}
        self.where: dict[tuple[str, str], list[str]] = {}
        for name in sorted(templates):
            words = words_of(templates[name])
            pairs = Counter(zip(words, words[1:], strict=False))
            if not pairs:
                raise ValueError(f"template {name} has fewer than two words")
            self.bigrams[name] = pairs
            for pair in pairs:
                self.where.setdefault(pair, []).append(name)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, Dice, first word, word after the last) of each template that the text has a stretch of at least `least` for, best first.

        A stretch has as many words as the template, or is the whole text if that is shorter. Of equally
        good stretches the first that begins with a bigram of the template counts.
        """
        words = words_of(text)
        pairs = list(zip(words, words[1:], strict=False))
        where = self.where
        hits = [i for i, p in enumerate(pairs) if p in where]
        if not hits:
            return []
        by_name: dict[str, list[int]] = {}
        for i in hits:
            for name in where[pairs[i]]:
                by_name.setdefault(name, []).append(i)
        out = []
        for name, at in by_name.items():
            own = self.bigrams[name]
            size = sum(own.values())
            wide = min(size, len(pairs))
            need = self.least * (size + wide) / 2
            # The size bound: so short a text can't reach the least coefficient; nor can so few hits.
            if wide < need or len(at) < need:
                continue
            best, begin = self._slide(own, pairs, at, wide)
            dice = 2 * best / (size + wide)
            if dice >= self.least:
                out.append((name, dice, begin, begin + wide + 1))
        return sorted(out, key=lambda x: (-x[1], x[0]))

    @staticmethod
    def _slide(own, pairs, at, wide: int):
        """(most bigrams in common, start) over windows of `wide` bigrams that begin at a hit, or at the last full window."""
        from collections import Counter

        last = len(pairs) - wide
        held: Counter = Counter()
        best, begin, common, tail = -1, 0, 0, 0
        for head, first in enumerate(at):
            start = min(first, last)
            while tail < len(at) and at[tail] < start + wide:
                p = pairs[at[tail]]
                held[p] += 1
                common += held[p] <= own[p]
                tail += 1
            if common > best:
                best, begin = common, start
            if first >= last:
                break  # later windows would all be the last one
            p = pairs[first]
            common -= held[p] <= own[p]
            held[p] -= 1
        return best, begin


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add `license` string, `dice` double, `first_word`, `end_word` int, `matches` array<struct<license,dice,first_word,end_word>>.

    The first four describe the best match (ties: the first name); null and an empty array if there is none. Null and empty texts, and texts of one word, have none.
    `templates`: name to text (default: all_templates()), a list of fixed size that goes to every task. `carry`: the
    input columns to keep (default: all); columns named as outputs are replaced. No shuffle.
    """
    scanner = Scanner(all_templates() if templates is None else templates, least)

    def work():
        def do(texts):
            found = [scanner.scan(t) for t in texts]
            best = [f[0] if f else (None,) * 4 for f in found]
            names = ("license", "dice", "first_word", "end_word")
            return {n: [b[i] for b in best] for i, n in enumerate(names)} | {"matches": [[dict(zip(names, m, strict=True)) for m in f] for f in found]}

        return do

    kinds = {"license": "string", "dice": "double", "first_word": "int", "end_word": "int", "matches": "array<struct<license:string,dice:double,first_word:int,end_word:int>>"}
    return map_texts(docs, work, kinds, text_col, carry)
