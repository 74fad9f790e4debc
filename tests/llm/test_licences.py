import re
import textwrap

from tests.conftest import SF
from tests.llm.edges import docs, edge_docs, empty_docs
from weir.llm import queries
from weir.llm.licences import RULES, SENTENCES, first_words, match_rules, scan_licences, sentence_table, sentences

MIT = "\n".join(SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "mit-disclaimer", "mit-liability"))


def found(spark, *texts):
    return [r.licences for r in scan_licences(docs(spark, enumerate(texts))).orderBy("doc_id").collect()]


def test_texts_and_notices(spark):
    out = found(
        spark, MIT, MIT.replace("\n", " "), "Copyright 2020.\n\n" + MIT.upper(), SENTENCES["mit-notice"][0] + "\n" + SENTENCES["mit-grant"][0],
        "Released   under the\tMIT license!", "we like the MIT License.", "Some prose. All rights reserved. More. Licensed under CC BY-NC 4.0.",
        SENTENCES["bsd-redistribute"][0] + " " + SENTENCES["bsd-source"][0] + "\n* " + SENTENCES["bsd-binary"][0], None,
    )
    assert out == [["MIT"], ["MIT"], ["MIT"], [], ["MIT"], [], ["Proprietary", "CC-BY-NC-4.0"], ["BSD-2-Clause"], []]


def test_wrapped_texts_and_look_alikes(spark):
    wrap = "\n".join(textwrap.wrap(MIT.replace("\n", " "), 60))
    gpl = " ".join(SENTENCES[k][0] for k in ("gpl-redistribute", "gpl-warranty", "gpl-details"))
    out = found(spark, "Some prose\n\n" + wrap, "\n".join(textwrap.wrap(gpl, 72)) + "\n\nMore prose", "kommt\nmit\nund mit. Mit.", "SPDX-License-Identifier: MIT", "a line | of cells |\nReleased under the MIT License.\nmore")
    assert out == [["MIT"], ["GPL-3.0-or-later"], [], ["MIT"], ["MIT"]]


def test_a_line_may_end_after_the_first_word(spark):
    out = found(spark, "Released\nunder the MIT License.", "# Licensed\n# under the Apache License, Version 2.0.", "All\n  rights\nreserved.", "Released.\nunder the MIT License.")
    assert out == [["MIT"], ["Apache-2.0"], ["Proprietary"], []]


def test_longer_rules_take_their_sentences():
    table = sentence_table(SENTENCES)
    parts = sentences(MIT + "\nReleased under the MIT License.", table, first_words(table))
    hits = match_rules([(i, table[s]) for i, s in enumerate(parts) if s in table], RULES, 1)
    assert len(hits) == 2 and hits[0][0] == "MIT" and hits[1][1] == len(parts) - 1


def test_order_and_gaps():
    rules = [("X", ("a", "b", "c"))]
    at = lambda s: [(k, x) for k, x in enumerate(s) if x != "."]
    assert match_rules(at("a.bc"), rules, 1) == [("X", 0, 3)]
    assert match_rules(at("a..bc"), rules, 1) == [] and match_rules(at("bac"), rules, 1) == []
    assert match_rules(at("abcabc"), rules, 1) == [("X", 0, 2), ("X", 3, 5)]
    assert match_rules(at("aabc"), rules, 1) == [("X", 0, 3)] or match_rules(at("aabc"), rules, 1) == [("X", 1, 3)]


def test_whole_table_against_lines(spark):
    """In the synthetic table a notice is a line of its own, if with marks between its words, so lines find the same."""
    plain = lambda x: " ".join(re.findall("[a-z0-9\x80-\U0010ffff]+", x.lower()))
    notices = {plain(v): lic for lic, needs in RULES if len(needs) == 1 for v in SENTENCES[needs[0]]}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        hits = [notices[plain(x)] for x in (r.text or "").split("\n") if plain(x) in notices]
        want[r.doc_id] = (",".join(dict.fromkeys(hits)), len(hits))
    got = {r.doc_id: (r.licences, r.n_matches) for r in queries.queries()["op9_licence_scan"](spark, SF).collect()}
    assert got == want and any(n for _, n in want.values())


def test_edges(spark):
    out = scan_licences(edge_docs(spark))
    assert out.count() == edge_docs(spark).count() and out.filter("n_known > 0").count() == 0
    assert scan_licences(empty_docs(spark)).count() == 0


#: Notices as they stand in files, written down apart from the table: comment marks, wrapped lines, other words around them.
IN_FILES = [
    ("Apache-2.0", "/*\n * Copyright 2019 The Authors.\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n *\n * Unless required by applicable law or agreed to in writing, software\n * distributed under the License is distributed on an \"AS IS\" BASIS,\n * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n * See the License for the specific language governing permissions and\n * limitations under the License.\n */\npackage x;"),
    ("GPL-2.0-or-later", "/* foo.c -- does foo\n\n   This program is free software; you can redistribute it and/or\n   modify it under the terms of the GNU General Public License\n   as published by the Free Software Foundation; either version 2\n   of the License, or (at your option) any later version.\n\n   This program is distributed in the hope that it will be useful,\n   but WITHOUT ANY WARRANTY; without even the implied warranty of\n   MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n   GNU General Public License for more details. */"),
    ("GPL-2.0-only", "// SPDX-License-Identifier: GPL-2.0\n#include <x.h>"),
    ("GPL-3.0-or-later", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU General Public License for more details."),
    ("LGPL-2.1-or-later", " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "-- This program is free software: you can redistribute it and/or modify\n-- it under the terms of the GNU Affero General Public License as\n-- published by the Free Software Foundation, either version 3 of the\n-- License, or (at your option) any later version."),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"),
    ("EPL-2.0", " * This program and the accompanying materials are made available under the\n * terms of the Eclipse Public License 2.0 which is available at\n * http://www.eclipse.org/legal/epl-2.0.\n *\n * SPDX-License-Identifier: EPL-2.0"),
    ("ISC", "Copyright (c) 2011, A. Body\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans."),
    ("BSL-1.0", "// Copyright 2004.\n// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)"),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"),
    ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2015 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."),
    ("BSD-3-Clause", "# Copyright 2012. All the authors.\n# Use of this source code is governed by a BSD-style license that can be\n# found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:\n\n   * Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer.\n   * Redistributions in binary form must reproduce the above copyright\nnotice, this list of conditions and the following disclaimer in the\ndocumentation and/or other materials provided with the distribution.\n   * Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission."),
    ("GPL-2.0-only", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions."),
    ("CC-BY-4.0", "<p>This work is licensed under a Creative Commons Attribution 4.0 International License.</p>"),
    ("MIT", "## License\nThis project is licensed under the MIT License."),
    ("Proprietary", "(c) 2020 Some Company. All rights reserved."),
]


def test_recall_on_notices_of_files(spark):
    got = found(spark, *(t for _, t in IN_FILES))
    caught = sum(want in g for (want, _), g in zip(IN_FILES, got, strict=True))
    assert caught >= 0.9 * len(IN_FILES), [(w, g) for (w, _), g in zip(IN_FILES, got, strict=True) if w not in g]
    assert all(not set(g) - {w, "Proprietary"} for (w, _), g in zip(IN_FILES, got, strict=True))
    prose = ["We use the GNU General Public License.", "The software is provided to members.", "Permission is granted to enter.", "version 2, June 1991", "See the License."]
    assert found(spark, *prose) == [[]] * len(prose)


def plain_matches(sequence, rules, gap):
    """Ordered rules by trying every choice of places."""
    from itertools import combinations

    used, out = set(), []
    for licence, needs in rules:
        fits = sorted(c for c in combinations(range(len(sequence)), len(needs)) if all(sequence[k] == n for k, n in zip(c, needs, strict=True)) and all(b - a <= gap + 1 for a, b in zip(c, c[1:], strict=False)))
        for c in fits:
            if not used & set(c):
                used |= set(c)
                out.append((licence, c[0], c[-1]))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def test_rules_against_all_choices():
    import random

    rnd = random.Random(9)
    rules = [("X", ("a", "b", "c")), ("Y", ("a", "b")), ("Z", ("c",)), ("X", ("d", "a"))]
    for _ in range(400):
        s = [rnd.choice("abcd..") for _ in range(rnd.randint(0, 9))]
        got = match_rules([(k, x) for k, x in enumerate(s) if x != "."], rules, 0)
        assert got == plain_matches(s, rules, 0), s
