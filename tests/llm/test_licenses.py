"""License scans against exact containment over all windows."""

import math
import random
import re

from lectern.llm import licenses


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, templates):
    out = set()
    w = words(text)
    for name, body in templates.items():
        t = words(body)
        k = min(5, len(t))
        if not k:
            continue
        own = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        run = len(t) - k + 1
        s = 1
        while s * 3 < run:
            s *= 2
        grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        for a in range(0, len(grams), s):
            if len(own & set(grams[a : a + 4 * s])) / len(own) >= 0.8:
                out.add(name)
    return out


def test_against_brute_force(spark):
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(50)]
    names = sorted(licenses.TEMPLATES)
    docs = []
    for i in range(150):
        w = r.choices(vocab, k=r.choice([0, 3, 40, 300]))
        for _ in range(r.choice([0, 1, 2])):
            t = licenses.TEMPLATES[r.choice(names)].split()
            t = t[r.choice([0, 0, len(t) // 10, len(t) // 2]) :]
            if r.random() < 0.3:
                t[r.randrange(len(t))] = "typo"
            at = r.randrange(len(w) + 1)
            w[at:at] = t
        docs.append((i, r.choice([" ", "\n"]).join(w), "x"))
    docs += [(900, None, ""), (901, "", ""), (902, licenses.TEMPLATES["mit-line"].upper(), ""), (902, licenses.TEMPLATES["mit-line"], "")]
    got = licenses.scanned(spark.createDataFrame(docs, "doc_id long, text string, licenses string")).collect()
    assert sorted((x.doc_id, tuple(x.licenses)) for x in got) == sorted((i, tuple(sorted(brute(t, licenses.TEMPLATES)))) for i, t, _ in docs)
    assert sum(x.n_licenses for x in got) > 80


def test_bands_guarantee_the_collision_probability():
    assert 1 - (1 - licenses.LEAST_SIMILARITY) ** licenses.BANDS >= licenses.COLLISION
    for (k, block), group in licenses.templates_of(licenses.TEMPLATES).items():
        for t in group:
            run = len(words(licenses.TEMPLATES[t.name])) - k + 1
            assert run <= (licenses.BLOCKS - 1) * block and run / (licenses.BLOCKS * block) >= licenses.LEAST_SIMILARITY
            assert math.log2(block).is_integer()


def test_own_templates_and_empty(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "a one two b")], "doc_id long, text string")
    assert [x.licenses for x in licenses.scanned(docs, {"t": "One, two!", "none": " . "}).orderBy("doc_id").collect()] == [["t"], ["t"]]
    assert licenses.scanned(docs.limit(0)).count() == 0


BSD = "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
NOTICE = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
REAL = [
    ("Licensed under the MIT license", "mit-line-licensed"),
    (BSD.format(""), "bsd-2-clause"),
    (BSD.format("3. Neither the name of Some Body nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "), "bsd-3-clause"),
    (NOTICE.format("", "2"), "gpl-2.0"),
    (NOTICE.format("", "3"), "gpl-3.0"),
    (NOTICE.format("Lesser ", "2.1"), "lgpl-2.1"),
    (NOTICE.format("Lesser ", "3"), "lgpl-3.0"),
    (NOTICE.format("Affero ", "3"), "agpl-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0-line"),
    ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "lgpl-3.0-line"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0-name"),
    ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa-4.0-line"),
    ("under the terms of the Eclipse Public License 2.0 which is available", "epl-2.0-line"),
    (licenses.TEMPLATES["mit"], "mit"),
]


def test_relatives_are_told_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REAL)], "doc_id long, text string")
    got = {x.doc_id: list(x.licenses) for x in licenses.scanned(docs).collect()}
    assert got == {i: [name] for i, (_, name) in enumerate(REAL)}
