"""Licence scans by sentences: known sentences get identifiers, sequences of them are matched against ordered rules."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of licence texts and notices, by identifier.
SENTENCES = {
    "mit-ref": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-disclaimer": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "apache-ref": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "This project is licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "apache-use": ["you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-redistribute": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-details": ["See the GNU General Public License for more details."],
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "cc-by-nc-4-ref": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-4-ref": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-4-ref": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0-ref": ["Licensed under CC0 1.0.", "This work has been dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "apache-name": ["Apache License"],
    "apache-date": ["Version 2.0, January 2004"],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "gpl2-ref": ["Licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"],
    "gpl2-plus-ref": ["SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl3-plus-ref": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl2-redistribute": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl2-only-redistribute": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."],
    "gpl-name": ["GNU GENERAL PUBLIC LICENSE"],
    "gpl2-date": ["Version 2, June 1991"],
    "gpl3-date": ["Version 3, 29 June 2007"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-redistribute": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-redistribute": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl-details": ["See the GNU Lesser General Public License for more details."],
    "lgpl21-ref": ["SPDX-License-Identifier: LGPL-2.1-or-later"],
    "lgpl3-ref": ["SPDX-License-Identifier: LGPL-3.0-or-later"],
    "agpl3-redistribute": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-details": ["See the GNU Affero General Public License for more details."],
    "agpl3-ref": ["SPDX-License-Identifier: AGPL-3.0-or-later"],
    "agpl3-only-ref": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0"],
    "mpl2-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "mpl2-obtain": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "mpl2-ref": ["SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0."],
    "epl2-made": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."],
    "epl2-ref": ["SPDX-License-Identifier: EPL-2.0"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-ref": ["SPDX-License-Identifier: ISC", "Licensed under the ISC License.", "Released under the ISC License."],
    "unlicense-released": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "unlicense-ref": ["SPDX-License-Identifier: Unlicense"],
    "boost-distributed": ["Distributed under the Boost Software License, Version 1.0."],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "boost-ref": ["SPDX-License-Identifier: BSL-1.0"],
    "zlib-provided": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-granted": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "zlib-ref": ["SPDX-License-Identifier: Zlib"],
    "bsd-style-ref": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "mit-style-ref": ["Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."],
    "bsd3-ref": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
    "bsd2-ref": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License."],
    "rights-reserved": ["All rights reserved."],
}
#: Rules: licence, and the sentences that state it in this order. A rule of more sentences goes before its parts.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-disclaimer", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-disclaimer")),
    ("Apache-2.0", ("apache-ref", "apache-use", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-use", "apache-copy", "apache-as-is")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-warranty", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-warranty")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-title", "apache-terms")),
    ("Apache-2.0", ("apache-name", "apache-date")),
    ("GPL-2.0-only", ("gpl-name", "gpl2-date")),
    ("GPL-3.0-only", ("gpl-name", "gpl3-date")),
    ("GPL-2.0-or-later", ("gpl2-redistribute", "gpl-warranty", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-redistribute", "gpl-warranty")),
    ("GPL-2.0-only", ("gpl2-only-redistribute", "gpl-warranty", "gpl-details")),
    ("GPL-2.0-only", ("gpl2-only-redistribute", "gpl-warranty")),
    ("LGPL-2.1-or-later", ("lgpl21-redistribute", "lgpl-warranty", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl21-redistribute", "lgpl-warranty")),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute", "gpl-warranty", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute", "lgpl-warranty", "lgpl-details")),
    ("AGPL-3.0-or-later", ("agpl3-redistribute", "gpl-warranty", "agpl-details")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-obtain")),
    ("Unlicense", ("unlicense-released", "unlicense-anyone")),
    ("Zlib", ("zlib-provided", "zlib-granted")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("GPL-2.0-or-later", ("gpl2-redistribute",)),
    ("GPL-2.0-only", ("gpl2-only-redistribute",)),
    ("GPL-2.0-only", ("gpl2-title",)),
    ("GPL-3.0-only", ("gpl3-title",)),
    ("LGPL-2.1-or-later", ("lgpl21-redistribute",)),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute",)),
    ("AGPL-3.0-or-later", ("agpl3-redistribute",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("EPL-2.0", ("epl2-made",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense-released",)),
    ("BSL-1.0", ("boost-distributed",)),
    ("BSL-1.0", ("boost-grant",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("GPL-2.0-or-later", ("gpl2-plus-ref",)),
    ("GPL-3.0-or-later", ("gpl3-plus-ref",)),
    ("LGPL-2.1-or-later", ("lgpl21-ref",)),
    ("LGPL-3.0-or-later", ("lgpl3-ref",)),
    ("AGPL-3.0-or-later", ("agpl3-ref",)),
    ("AGPL-3.0-only", ("agpl3-only-ref",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("EPL-2.0", ("epl2-ref",)),
    ("ISC", ("isc-ref",)),
    ("Unlicense", ("unlicense-ref",)),
    ("BSL-1.0", ("boost-ref",)),
    ("Zlib", ("zlib-ref",)),
    ("Zlib", ("zlib-granted",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("BSD-3-Clause", ("bsd-style-ref",)),
    ("MIT", ("mit-style-ref",)),
    ("MIT", ("mit-ref",)),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-use",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    ("CC-BY-4.0", ("cc-by-4-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("Proprietary", ("rights-reserved",)),
]
#: Unknown sentences that may stand between two sentences of a rule.
MAX_GAP = 1
#: Non-ASCII bytes, ASCII letters and digits make words; line ends stay. Byte 1 stands for the end of a sentence, byte 2
#: for a colon or semicolon, which ends one only if a known sentence stands at its side.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b in (1, 2, 10) else 32 for b in range(256))
_ENDS = [(e + w, m + w) for w in (b" ", b"\t", b"\n") for e, m in ((b".", b"\x01"), (b"!", b"\x01"), (b"?", b"\x01"), (b":", b"\x02"), (b";", b"\x02"))]


#: A mark-up tag, which parts sentences as a line end does.
_TAG = re.compile(rb"</?[A-Za-z][^<>\n]*>")


def _split(line: bytes, table: dict[bytes, str] | None = None) -> list[bytes]:
    out = []
    for x in line.split(b"\x01"):
        if s := b" ".join(x.replace(b"\x02", b" ").split()):
            parts = [p for y in x.split(b"\x02") if (p := b" ".join(y.split()))] if table and b"\x02" in x and s not in table else []
            out += parts if any(p in table for p in parts) else [s]
    return out


def sentences(text: str | None, table: dict[bytes, str] | None = None, starts: tuple[bytes, ...] = ()) -> list[bytes]:
    """Normalised sentences: lower case, words of letters and digits joined by one space.

    A line end ends a sentence, since notices stand on lines of their own. Where lines without a known sentence follow
    one another, they are also read as one wrapped paragraph, and that reading counts if it has a known sentence.
    """
    raw = (text or "").encode().replace(b"\x01", b" ").replace(b"\x02", b" ").replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    if b"<" in raw:
        raw = _TAG.sub(b"\n", raw)
    for end, mark in _ENDS:
        if end in raw:
            raw = raw.replace(end, mark)
    flat = raw.translate(_TABLE)
    lines = flat.split(b"\n")
    rows = [_split(x, table) for x in lines]
    if table is None:
        return [s for row in rows for s in row]
    words = b" ".join(flat.replace(b"\x02", b" ").split())  # a line end may part the first two words
    if not any(x in words for x in starts):
        return [s for row in rows for s in row]
    out: list[bytes] = []
    wrapped: list[int] = []

    def flush():
        whole = _split(b" ".join(lines[k] for k in wrapped), table)
        out.extend(whole if any(s in table for s in whole) else (s for k in wrapped for s in rows[k]))
        wrapped.clear()

    for k, row in enumerate(rows):
        if row and not any(s in table for s in row):
            wrapped.append(k)
        else:
            flush()
            out.extend(row)
    flush()
    return out


def sentence_table(known: dict[str, list[str]]) -> dict[bytes, str]:
    """Normalised sentence to identifier. A known text must be one sentence, or a part of it could stand for it."""
    out = {}
    for name, texts in known.items():
        for text in texts:
            parts = sentences(text)
            if len(parts) != 1:
                raise ValueError(f"{name}: not one sentence: {text!r}")
            if out.setdefault(parts[0], name) != name:
                raise ValueError(f"{name} and {out[parts[0]]} have one sentence: {text!r}")
    return out


def first_words(table: dict[bytes, str]) -> tuple[bytes, ...]:
    """How known sentences begin: their first two words."""
    return tuple(sorted({b" ".join(s.split()[:2]) for s in table}))


def match_rules(found: list[tuple[int, str]], rules: list, max_gap: int) -> list[tuple[str, int, int]]:
    """(licence, first sentence, last sentence) of each match; rules in order, no sentence in two matches."""
    used, out = set(), []
    at = {p: k for p, k in found}
    order = [p for p, _ in found]
    for licence, needs in rules:
        for start in order:
            if at[start] != needs[0] or start in used:
                continue
            taken, pos = [start], start
            for need in needs[1:]:
                pos = next((q for q in range(pos + 1, pos + 2 + max_gap) if at.get(q) == need and q not in used), None)
                if pos is None:
                    break
                taken.append(pos)
            if len(taken) == len(needs):
                used.update(taken)
                out.append((licence, taken[0], taken[-1]))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, list[str]] = SENTENCES, rules: list = RULES, max_gap: int = MAX_GAP) -> DataFrame:
    """One row per document: id_col, n_sentences, n_known, licences, sentence_ids, matches(licence, first, last).

    licences: distinct ids in order of first match. Null and empty texts have no sentences; each row is read alone
    and whole, so ids may repeat or be null and other columns may have any name. There is no shuffle.
    """
    table = sentence_table(known)
    starts = first_words(table)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                parts = sentences(text.as_py(), table, starts)
                found = [(i, table[s]) for i, s in enumerate(parts) if s in table]
                hits = match_rules(found, rules, max_gap) if found else []
                rows.append((len(parts), len(found), list(dict.fromkeys(h[0] for h in hits)), [k for _, k in found], [{"licence": a, "first": b, "last": c} for a, b, c in hits]))
            kind = pa.list_(pa.struct([("licence", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
            cols = [batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), kind)))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_sentences", "n_known", "licences", "sentence_ids", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_sentences bigint, n_known bigint, licences array<string>, sentence_ids array<string>, matches array<struct<licence:string,first:bigint,last:bigint>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
