"""The license scan against plain cosines and plain walks up the directories."""

import collections
import math
import random
import re

import pytest
from test_operators import frame

from rankarena.llm import licenses

MIT = "Released under the MIT License."
APACHE = "Licensed under the Apache License, Version 2.0."
GPL = "This work is licensed under the GNU General Public License, version 3."


def scanned(spark, files):
    """(license, similarity, origin) by path, of (path, text) pairs."""
    rows = [(k, p, t, "h", "d") for k, (p, t) in enumerate(files)]
    docs = spark.createDataFrame(rows, "doc_id bigint, path string, text string, license string, dir string")
    return {(r["doc_id"], r["path"]): (r["license"], r["similarity"], r["origin"]) for r in licenses.scan(docs).collect()}


def test_spdx_expressions(spark):
    tag = "SPDX-License-Identifier: "
    texts = {
        "a": (tag + "MIT", "MIT"),
        "b": (f"# {tag}MIT\n\n// {tag}GPL-2.0-only\n# {tag}MIT", "MIT AND GPL-2.0-only"),
        "c": (tag + "banana", "LicenseRef-banana"),
        "d": (f"{tag}banana\n{APACHE}", "Apache-2.0"),
        "e": (f"{tag}banana\n{tag}ISC", "ISC"),
        "f": (f"{tag}(MIT OR Apache-2.0)\n{tag}Zlib", "(MIT OR Apache-2.0) AND Zlib"),
        "g": (f"{tag}MIT OR Apache-2.0\n{tag}Zlib", "(MIT OR Apache-2.0) AND Zlib"),
        "h": (tag + "GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0-or-later WITH Classpath-exception-2.0"),
        "i": (tag + "MIT OR banana", "LicenseRef-MIT-OR-banana"),
    }
    found = scanned(spark, [(f"src/{k}.txt", t) for k, (t, _) in texts.items()])
    assert {p: v[0] for (_, p), v in found.items()} == {f"src/{k}.txt": e for k, (_, e) in texts.items()}


def test_unknown_identifiers_are_not_inherited(spark):
    found = scanned(spark, [("x/LICENSE", "SPDX-License-Identifier: banana"), ("x/a.py", "code"), ("y/LICENSE", "SPDX-License-Identifier: MIT"), ("y/z/b.py", "code")])
    by_path = {p: v for (_, p), v in found.items()}
    assert by_path["x/LICENSE"][::2] == ("LicenseRef-banana", "own") and by_path["x/a.py"] == (None, None, "none")
    assert by_path["y/z/b.py"] == ("MIT", None, "inherited")


def test_cosines_equal_plain_sums(spark):
    """Every part of every text with every template."""
    texts = ["\n\n" + MIT, f"a\n{APACHE}\nb c\n" * 3, f"/* {GPL}\n more */\ncode", "all rights: copyright of mine\nnext\nlicense here", "x\ny SPDX\n" + MIT, "nothing"]
    texts.append((licenses.BODIES / "ISC.txt").read_text())
    docs = frame(spark, texts).selectExpr("doc_id AS h", "text")
    parts = licenses.notices(docs, text_col="text", keys=["h"])
    held = [(r["h"], r["line"], r["span"], r["block"], r["terms"]) for r in parts.collect()]
    assert len({h[:4] for h in held}) == len(held)
    speaking = {h for h, *_ in held}
    assert speaking == {0, 1, 2, 3, 4, 6}
    df = collections.Counter(t for h in speaking for t in {t for g, _, _, block, terms in held if g == h and block for t in terms})
    total = len(speaking)

    def idf(term):
        return math.log((1 + total) / (1 + df[term])) + 1 if term in df else math.log(1 + total) + 1

    forms = collections.defaultdict(dict)
    for name, kind, number, term, tf in licenses.template_terms():
        forms[(name, kind, number)][term] = (1 + math.log(tf)) * idf(term)
    expected = {}
    for h, line, span, block, terms in held:
        weights = {t: (1 + math.log(n)) * idf(t) for t, n in collections.Counter(terms).items() if t in df}
        for (name, kind, number), form in forms.items():
            if (kind == 3) == block and weights.keys() & form.keys():
                dot = sum(w * form[t] for t, w in weights.items() if t in form)
                norms = math.sqrt(sum(w * w for w in weights.values())) * math.sqrt(sum(w * w for w in form.values()))
                expected.setdefault((h, line, span, block, name, kind), []).append(round(dot / norms, 6))
    found = collections.defaultdict(list)
    for r in licenses.similarities(parts, keys=["h"]).collect():
        found[(r["h"], r["line"], r["span"], r["block"], r["license"], r["kind"])].append(r["similarity"])
    assert found.keys() == expected.keys()
    assert all(sorted(found[k]) == pytest.approx(sorted(expected[k]), abs=2e-6) for k in found)


def test_inheritance_equals_a_walk_up_the_directories(spark):
    rng = random.Random(4)
    # A notice that isn't most of a file says nothing of its directory.
    code = "value = other + 1\n" * 30 + MIT
    folders = ["a", "a/b", "a/b/c", "a/d", "e", "e/f", "g/h/i", ""]
    files = [(f"{d}/LICENSE" if d else "LICENSE", rng.choice([MIT, APACHE, GPL, "no such thing"])) for d in rng.sample(folders, 6)]
    files += [(f"{rng.choice(folders)}/f{k}.py", rng.choice(["code", "x = 1", code])) for k in range(40)] + [(None, "code"), ("alone.py", "code"), (None, code)]
    found = scanned(spark, files)
    names = {code: "MIT", MIT: "MIT", APACHE: "Apache-2.0", GPL: "GPL-3.0"}
    speaks = {p.rpartition("/")[0]: names[t] for p, t in files if p and re.search("LICENSE$", p) and "/" in p and t in names}
    for k, (path, text) in enumerate(files):
        license_, _, origin = found[(k, path)]
        if text in names:
            assert (license_, origin) == (names[text], "own")
            continue
        above, nearest = (path or "").rpartition("/")[0], None
        while above and not nearest:
            nearest, above = speaks.get(above), above.rpartition("/")[0]
        if path and "/" in path:
            assert (license_, origin) == (nearest, "inherited" if nearest else "none")
        elif path is None:
            assert (license_, origin) == (None, "none")


def test_odd_rows(spark):
    many = "\n".join(f"license of part {k}: copyright" for k in range(3000))
    files = [("p/LICENSE", MIT), ("p/LICENSE", MIT), ("p/a", None), ("p/a", ""), ("q/a", many), (None, None)]
    found = scanned(spark, files)
    assert len(found) == 6 and found[(2, "p/a")] == found[(3, "p/a")] == ("MIT", None, "inherited")
    assert licenses.scan(frame(spark, []).withColumnRenamed("kept", "path")).collect() == []


def test_the_plan_is_small(spark):
    docs = frame(spark, [MIT, "code"]).withColumnRenamed("kept", "path")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) < 40 and "MapInArrow" not in plan and "Python" not in plan
