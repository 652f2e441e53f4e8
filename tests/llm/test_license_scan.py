import random
import re

from tests.llm.helpers import docs, rows
from tests.llm.test_decontaminate import words
from trustlens.llm import license_scan as L
from trustlens.llm.license_rules import CONFIDENCE, all_rules


def brute_near(doc_id, text):
    """``brute`` for a long text: rules look 200 words ahead, containers are sought 200 words back."""
    return brute(doc_id, text, 200)


def brute(doc_id, text, near=None):
    ws = words(text)
    base = [(i, lab) for i in range(len(ws)) for p, lab in L.BASE.items() if ws[i:i + len(p.split())] == p.split()]
    found = set()
    for i, w in enumerate(ws):
        for r in all_rules():
            begins = any(ws[i:i + len(k.split())] == k.split() for k in r.keywords if k.split()[0] == w)
            if begins and (m := re.match(rf"(?:{r.pattern})(?= |$)", " ".join(ws[i:i + near] if near else ws[i:]))):
                found.add((i, i + len(m[0].split(" ")), r.priority, r.label))
    at_start = {}
    for d in found:
        at_start.setdefault(d[0], []).append(d)
    around = lambda d: (e for s in range(d[0] - (near or d[0]), d[0] + 1) for e in at_start.get(s, []))
    stay = [d for d in found if not any(e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and e[1] - e[0] > d[1] - d[0]) for e in around(d))]
    at = [i for i, _ in base]
    labels = {x for _, x in base}
    return (doc_id, len(ws), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {d[3] for d in stay})), max((CONFIDENCE[d[2]] for d in stay), default=0.0))


TEXTS = [
    None, "", "  ...", "mit freundlichen", "Released under the MIT License.", "MIT  license? apache-LICENSE, Version 2.0 and the general public license",
    "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License v2.1 or later",
    "SPDX-License-Identifier: GPL-3.0-or-later", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "neither the name of the copyright holder nor its contributors may be used to endorse or promote products", "Copyright (c) 2020. All rights reserved.",
    "neither the name of " + "an other " * 15 + "may be used to endorse or promote products derived", "neither the name of " + "a " * 60 + "may be used to endorse or promote products",
    "neither the name of " + "a " * 61 + "may be used to endorse or promote products", "neither the name of " + "\u2028b \U0001f600 " * 8 + "may be used to endorse or promote products",
    "general public license " * 3, "mit license " * 3000, "license agreement mit mit license license general public", "ÉMIT license", "the public domain under cc0 1.0 universal",
]


def test_rules_are_many_and_begin_with_their_keywords():
    rules = all_rules()
    assert len(rules) >= 300 and len({(r.label, r.pattern) for r in rules}) == len(rules)
    assert all(r.keywords and len(set(r.keywords)) == len(r.keywords) for r in rules)


def test_against_brute_force(spark):
    rnd = random.Random(8)
    vocab = "licensed under the terms of mit license apache 2 0 gnu general public lesser cc by nc sa version 3 or later all rights reserved released x".split()
    texts = TEXTS + [" ".join(rnd.choice(vocab) for _ in range(60)) for _ in range(40)]
    short = [t for t in texts if t is None or len(t) < 5000]
    df = docs(spark, short, extra=[("words", "string", "w"), ("label", "int", 1), ("found", "string", None)])
    assert rows(L.summary(L.scan(df))) == sorted((brute(i, t) for i, t in enumerate(short)), key=repr)
    long = rows(L.summary(L.scan(docs(spark, ["mit license " * 3000]))))
    assert long == [(0, 6000, 3000, 0, 5998, "mit", "mit", 0.7)]


# A text that a signature finds, its label, and a like text that it leaves alone.
SIGNATURES = [
    ("The above copyright notice and this permission notice shall be included in all copies", "mit", "The above copyright notice and this page"),
    ("without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell", "mit", "without limitation the rights of others"),
    ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY", "mit", "in no event shall the authors be paid"),
    ("THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE", "isc", "the author disclaims all blame"),
    ("provided that the above copyright notice and this permission notice appear in all copies.", "isc", "provided that the above is true"),
    ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES", "bsd", "this software is provided by a friend as is"),
    ("IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL", "bsd", "in no event shall the copyright lapse"),
    ("All advertising materials mentioning features or use of this software must display", "bsd", "all advertising materials must go"),
    ("Grant of Copyright License. Subject to the terms and conditions of this License", "apache", "grant of copyright license to a friend"),
    ("Grant of Patent License. Subject to the terms and conditions of this License", "apache", "grant of patent license to a friend"),
    ("See the License for the specific language governing permissions and limitations", "apache", "see the license for details"),
    ("You must cause any modified files to carry prominent notices stating that You changed the files", "apache", "you must cause any harm"),
    ("You should have received a copy of the GNU General Public License", "gpl", "you should have received a letter"),
    ("You should have received a copy of the GNU Lesser General Public License", "lgpl", "you should have received a copy of the book"),
    ("You should have received a copy of the GNU Affero General Public License", "agpl", "you should have received a parcel"),
    ("Everyone is permitted to copy and distribute verbatim copies of this license document", "gpl", "everyone is permitted to copy this"),
    ("The licenses for most software are designed to take away your freedom", "gpl", "the licenses for most software are short"),
    ("As a special exception, the copyright holders give you permission", "gpl-exception", "as a special exception the shop is open"),
    ("with the Classpath exception", "gpl-exception", "a class path and an exception"),
    ("the GCC Runtime Library Exception", "gpl-exception", "the gcc runtime library"),
    ("A program that contains no derivative of any portion of the Library", "lgpl", "a program that contains no bugs"),
    ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation", "gfdl", "permission is granted to copy this page"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at", "mpl", "if a copy of the mpl is there"),
    ("The contents of this file are subject to the Mozilla Public License", "mpl", "the contents of this file are lost"),
    ("The contents of this file are subject to the terms of the Common Development and Distribution License", "cddl", "the contents of this file are subject to change"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License", "epl", "this program and the accompanying book"),
    ("The origin of this software must not be misrepresented", "zlib", "the origin of this software is unknown"),
    ("This notice may not be removed or altered from any source distribution", "zlib", "this notice may not be seen"),
    ("must be included in all copies of the Software, in whole or in part, and all derivative works", "boost", "must be included in all lists"),
    ("The intent of this document is to state the conditions under which a Package may be copied", "artistic", "the intent of this document is clear"),
    ("PSF is making Python available to Licensee on an \"AS IS\" basis", "python", "psf is making python better"),
    ("DO WHAT THE HECK YOU WANT TO PUBLIC LICENSE", "wtfpl", "do what the doctor told you"),
    ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "unlicense", "anyone is free to copy a smile"),
    ("The person who associated a work with this deed has dedicated the work to the public domain", "cc0", "the person who associated with them"),
    ("You must give appropriate credit, provide a link to the license, and indicate if changes were made", "cc-by", "you must give appropriate credit to staff"),
    ("If you remix, transform, or build upon the material, you must distribute your contributions under the same license", "cc-by-sa", "if you remix transform or sing"),
    ("You may not use the material for commercial purposes", "cc-by-nc", "you may not use the material twice"),
    ("If you remix, transform, or build upon the material, you may not distribute the modified material", "cc-by-nd", "if you remix transform or dance"),
    ("The Font Software may be modified, altered, or added to", "ofl", "the font software may be slow"),
    ("with Reserved Font Name", "ofl", "a reserved name of a font"),
    ("This database is made available under the Open Database License", "odbl", "this database is made by hand"),
    ("Community Data License Agreement - Permissive, Version 2.0", "cdla", "community data and a license agreement"),
    ("the Open Government Licence v3.0", "open-government", "an open government with a licence"),
    ("This software is the confidential and proprietary information of", "proprietary", "this software is the best"),
    ("No part of this publication may be reproduced", "proprietary", "no part of this town may be reached"),
    ("For internal use only.", "proprietary", "for internal users only"),
    ("evaluation purposes only", "proprietary", "evaluation with other purposes"),
    ("reverse engineer, decompile, or disassemble", "proprietary", "reverse the engineer and decompile"),
    ("for non-commercial use only", "non-commercial", "for commercial use"),
    ("For personal use only", "non-commercial", "for personal reasons only"),
    ("for research purposes only", "research-only", "for research and other purposes"),
    ("For academic use only", "research-only", "for academic users"),
]


def test_every_signature_has_an_example_and_a_counter_example(spark):
    seen = rows(L.summary(L.scan(docs(spark, [t for s in SIGNATURES for t in (s[0], s[2])]))))
    labels = [set(r[6].split(",")) - {""} for r in sorted(seen)]
    assert [(s[0], s[1] in own) for s, own in zip(SIGNATURES, labels[::2], strict=True)] == [(s[0], True) for s in SIGNATURES]
    assert [(s[2], s[1] in own) for s, own in zip(SIGNATURES, labels[1::2], strict=True)] == [(s[2], False) for s in SIGNATURES]


def test_suppression_over_many_blocks(spark):
    """More detections than one block holds, and one that contains those of the next block."""
    text = "licensed under the mit license " * 700 + "neither the name of " + "mit license " * 8 + "may be used to endorse or promote products"
    assert rows(L.summary(L.scan(docs(spark, [text])))) == [brute_near(0, text)]


def test_repeated_rows_and_empty_table(spark):
    df = docs(spark, ["mit license", "mit license", None], [1, 1, None])
    assert [r[0] for r in rows(L.summary(L.scan(df)))] == [1, 1, None]
    assert rows(L.scan(docs(spark, []))) == []
    spans = L.scan(docs(spark, ["x Released under the MIT License. y"])).first()["found"]
    assert [(d.start, d.stop, d.label, d.text) for d in spans] == [(1, 6, "mit", "released under the mit license")]
