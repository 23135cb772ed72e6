"""License scans by patience alignment.

Words are runs of ASCII letters, digits and bytes from 0x80 on, in lower case. A
template of n words is looked for in windows of n words and a fifth more: the
window's words that the template has (with multiplicity) bound what an alignment
can match, so windows under ``MIN_COVERAGE`` can't hold it. The others are aligned
from the highest bound down; when a copy is found, the words before and after it are
searched in the same way. Alignment: common ends match first; then words that stand once in both pieces are anchors, a
longest increasing subsequence of them is kept, and the gaps between are aligned
in the same way. Coverage is the share of the template's words that match.

A template's telling phrases (name, version, "nc", "lesser") must match whole, word beside word, so what is left
unmatched is never what tells licenses apart. Templates compete: of copies that overlap the one stays whose
matched words exceed its template's unmatched ones by most (then the shortest). A license's full text, its header and its notice don't
compete with each other, since one may hold the other.

Texts are filtered first: a text that lacks a telling phrase, or so many of a template's words that the rest can't reach
the coverage, doesn't hold it. That test drops no match.

Null and empty texts have no license. Texts of any length are scanned whole,
and each copy of a license gives a row. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from shopweave.llm.common import pieces, to_bytes

MIN_COVERAGE = 0.8
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")

#: Names that notices give to licenses; what stands between bars must match whole.
NAMES = {
    "MIT": ("MIT", "Expat"),
    "MIT-0": ("MIT No Attribution",),
    "ISC": ("ISC",),
    "0BSD": ("0BSD", "BSD Zero Clause"),
    "BSD": ("BSD",),
    "BSD-2-Clause": ("BSD 2-Clause", "2-Clause BSD", "Simplified BSD"),
    "BSD-3-Clause": ("BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD", "Revised BSD"),
    "BSD-4-Clause": ("BSD 4-Clause", "4-Clause BSD", "Original BSD"),
    "Apache-1.1": ("Apache License, Version 1.1", "Apache Software License, Version 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"),
    "MPL-1.1": ("Mozilla Public License|, version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("Mozilla Public License|, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-1.0": ("Eclipse Public License|, version 1.0", "Eclipse Public License 1.0"),
    "EPL-2.0": ("Eclipse Public License|, version 2.0", "Eclipse Public License 2.0"),
    "CDDL-1.0": ("Common Development and Distribution License",),
    "BSL-1.0": ("Boost Software License",),
    "Zlib": ("zlib",),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0"),
}
for _id, _kind in (("GPL", ""), ("LGPL", "Lesser "), ("LGPL", "Library "), ("AGPL", "Affero ")):
    for _v in {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("3.0",)}[_id]:
        _short = _v.removesuffix(".0")
        NAMES[f"{_id}-{_v}"] = (*NAMES.get(f"{_id}-{_v}", ()), f"GNU {_kind}General Public License|, version {_short}", f"GNU {_kind}General Public License| v{_short}", f"GNU {_id} version {_short}", f"GNU {_id} v{_short}", f"{_id} v{_short}")
for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
    for _id in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        _long = _id.replace("BY", "Attribution").replace("NC", "NonCommercial").replace("SA", "ShareAlike").replace("ND", "NoDerivatives")
        NAMES[f"CC-{_id}-{_v}"] = (f"CC {_id} {_v}", f"Creative Commons {_long} {_v}", f"Creative Commons {_long.replace('NonC', 'Non-C').replace('ShareA', 'Share-A').replace('NoD', 'No-D')} {_v}")

#: Short notices, headers and the wording of common public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
        OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. {disclaimer}""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the
        copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission. {disclaimer}""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
        ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
        marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
        source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
}
_disclaimer = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
    HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
    LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
    ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
    USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
for _id in ("BSD-2-Clause", "BSD-3-Clause"):
    TEMPLATES[_id] = TEMPLATES[_id].replace("{disclaimer}", _disclaimer)
#: Phrases that a copy must have whole, by template.
TELLING = {
    "MIT-notice": ("mit",),
    "Apache-2.0-notice": ("apache license version 2 0",),
    "CC-BY-NC-4.0-notice": ("cc by nc 4 0",),
    "GPL-3.0-notice": ("gnu general public license", "version 3"),
    "MIT": ("shall be included in all copies",),
    "ISC": ("notice appear in all copies",),
    "Apache-2.0-header": ("apache license version 2 0",),
    "MPL-2.0-header": ("mozilla public license v 2 0",),
    "BSD-2-Clause": ("redistributions in binary form must reproduce",),
    "BSD-3-Clause": ("neither the name", "endorse or promote"),
    "0BSD": ("is hereby granted the software is provided",),
    "Zlib": ("must not be misrepresented", "plainly marked as such"),
    "Unlicense": ("free and unencumbered software",),
    "Apache-2.0": ("apache license version 2 0 january 2004",),
    "CC0-1.0": ("cc0 1 0 universal",),
    "GPL-2.0": ("gnu general public license version 2 june 1991",),
    "GPL-3.0": ("gnu general public license version 3 29 june 2007",),
    "LGPL-2.1": ("gnu lesser general public license version 2 1 february 1999",),
    "LGPL-3.0": ("gnu lesser general public license version 3 29 june 2007",),
    "MPL-2.0": ("mozilla public license version 2 0",),
}
for _file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    TEMPLATES[_file.stem] = _file.read_text()
for _id, _v in (("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")):
    _kind = {"GPL": "", "LGPL": "Lesser ", "AGPL": "Affero "}[_id]
    _name = f"{_id}-{_v}" if "." in _v else f"{_id}-{_v}.0"
    TEMPLATES[f"{_name}-header"] = f"""This program is free software; you can redistribute it and/or modify it under the terms of the GNU {_kind}General Public
        License as published by the Free Software Foundation; either version {_v} of the License, or (at your option) any later version."""
    TELLING[f"{_name}-header"] = (f"gnu {_kind.lower()}general public license", "version " + _v.replace(".", " ") + " of")


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def add_notices() -> None:
    """Notices of all the names, in the usual wordings."""
    for name, called in NAMES.items():
        forms = [(f"SPDX-License-Identifier: {name}", (name,))] if name != "BSD" else []
        for c in called:
            the = "" if c.startswith(("CC", "Creative")) else "the "
            forms += [(f"{how} under {the}{c.replace('|', '')}{'' if 'icense' in c else ' License'}.", tuple(c.split("|"))) for how in ("Licensed", "Released", "This work is licensed")]
        held = {tuple(words_of(t.encode())) for t in TEMPLATES.values()}
        for k, (text, phrases) in enumerate(forms):
            if tuple(words_of(text.encode())) not in held:
                key = f"{name}-notice" + (f"-{k + 1}" if f"{name}-notice" in TEMPLATES else "")
                TEMPLATES[key] = text
                TELLING[key] = tuple(b" ".join(words_of(x.encode())).decode() for x in phrases)


add_notices()
FORM = re.compile(r"-(notice|header)(-\d+)?$")


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
        before[i] = at[k - 1] if k else -1
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matching positions of a and b, rising in both, by patience alignment."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 == in_b[w]}
        shared = [(where[w], j) for j, w in enumerate(b[b0:b1], b0) if w in where]
        anchors = [shared[i] for i in increasing([i for i, _ in shared])]
        out += anchors
        if anchors:
            for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
                if k - i > 1 and m - j > 1:
                    gaps.append((i + 1, k, j + 1, m))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, min_coverage: float, telling: tuple[str, ...] = ()):
        self.name, self.words = name, words_of(text.encode())
        form = FORM.search(name)
        self.license, self.form = (name[: form.start()], form[1]) if form else (name, "full")
        phrases = [words_of(p.encode()) for p in telling]
        self.telling = [(k, len(p)) for p in phrases for k in [next(k for k in range(len(self.words)) if self.words[k : k + len(p)] == p)]]
        self.phrases = [b" " + b" ".join(p) + b" " for p in phrases]
        self.key = max((w for p in phrases for w in p), key=lambda w: (len(w), w), default=None)
        self.count = Counter(self.words)
        self.needed = min_coverage * len(self.words)

    def tells(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether every telling phrase matches whole."""
        place = {j: i for i, j in pairs}
        return all(k in place and all(place.get(k + x) == place[k] + x for x in range(n)) for k, n in self.telling)

    def bounds(self, words: list[bytes], size: int) -> list[int]:
        """For each window of ``size`` words: how many of its words the template can match."""
        held: Counter = Counter()
        now, out = 0, []
        for i, w in enumerate(words):
            if w in self.count:
                held[w] += 1
                now += held[w] <= self.count[w]
            if i >= size and (gone := words[i - size]) in self.count:
                now -= held[gone] <= self.count[gone]
                held[gone] -= 1
            out.append(now)
        return out[size - 1 :] if len(words) > size else out[-1:]

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, word after the last, words matched) of each copy found, in order."""
        size = len(self.words) + max(2, len(self.words) // 5)
        ranges, found = [(0, len(words))], []
        while ranges:  # a copy splits its range in two
            low, high = ranges.pop()
            part = words[low:high]
            bounds = self.bounds(part, size)
            for i in sorted((i for i, n in enumerate(bounds) if n >= self.needed), key=lambda i: (-bounds[i], i)):
                pairs = align(part[i : i + size], self.words)
                if len(pairs) >= self.needed and self.tells(pairs):
                    start, end = low + i + pairs[0][0], low + i + pairs[-1][0] + 1
                    found.append((start, end, len(pairs)))
                    ranges += [(low, start), (end, high)]
                    break
        return sorted(found)


def best(copies: list[tuple[Template, int, int, int]]) -> list[tuple[Template, int, int, int]]:
    """The copies (template, first word, word after the last, words matched) that win where they overlap."""
    kept: list[tuple[Template, int, int, int]] = []
    for t, start, end, n in sorted(copies, key=lambda c: (len(c[0].words) - 2 * c[3], c[2] - c[1], c[1], c[0].name)):
        if not any(start < e and s < end and (t.license != u.license or t.form == u.form) for u, s, e, _ in kept):
            kept.append((t, start, end, n))
    return sorted(kept, key=lambda c: (c[1], c[2], c[0].name))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE, telling: dict[str, tuple[str, ...]] = TELLING) -> DataFrame:
    """(doc_id, license, n_matched, coverage, start_word, end_word): a row per copy of a license in a text."""
    schema = "doc_id long, license string, n_matched long, coverage double, start_word long, end_word long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(name, text, min_coverage, telling.get(name, ())) for name, text in templates.items()]
        by_key: dict[bytes | None, list[Template]] = {}
        for t in known:
            by_key.setdefault(t.key, []).append(t)
        for batch in pieces(batches, "text", 8 << 20):
            ids, rows = batch.column("doc_id").to_pylist(), []
            for i, text in enumerate(to_bytes(batch.column("text"))):
                words = words_of(text)
                have = {*words, None}
                may = [t for key in by_key.keys() & have for t in by_key[key]]
                joined = b" %b " % b" ".join(words) if may else b""
                found = []
                for t in may:
                    if all(p in joined for p in t.phrases) and sum(n for w, n in t.count.items() if w in have) >= t.needed:
                        found += [(t, *span) for span in t.spans(words)]
                rows += [(ids[i], t.name, n, n / len(t.words), start, end) for t, start, end, n in best(found)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], arrow)

    names = [f.split()[0] for f in schema.split(", ")]
    arrow = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("n_matched", pa.int64()), ("coverage", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)
