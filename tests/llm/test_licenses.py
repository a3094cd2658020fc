import random
import re
from collections import Counter

from larkspur.llm import licenses

BY = dict(licenses.TEMPLATES)


def brute(rows, templates=licenses.TEMPLATES):
    """Every run of words with every template, by bags of word bigrams."""
    out = []
    for i, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        own = list(zip(w, w[1:]))
        for name, template in templates:
            t = re.findall(r"[^\W_]+", template.lower())
            want = Counter(zip(t, t[1:]))
            size, met = want.total(), []
            for a in (a for a in range(len(own)) if own[a] in want):
                run, both, best = Counter(), 0, (0, 0, 0)
                for b in range(a, min(len(own), a + int(1.5 * size + 1e-9))):
                    run[own[b]] += 1
                    both += run[own[b]] <= want[own[b]]
                    best = max(best, (2 * both / (b - a + 1 + size), -b, b))
                if best[0] >= 0.8:
                    met.append((best[0], a, best[2]))
            if met:
                dice, first, last = max(met, key=lambda x: (x[0], -x[1]))
                regions, end = 0, -1
                for _, a, b in met:
                    regions += a > end
                    end = max(end, b)
                out.append((i, name, round(dice, 9), first, last - first + 2, regions))
    return sorted(out, key=str)


def scanned(docs):
    return sorted(map(tuple, licenses.scan(docs).select("doc_id", "license", "dice", "start_word", "n_words", "n_regions").collect()), key=str)


def published(name):
    """A template in paragraphs and lines, as licences are published."""
    parts = re.split(r"(?<=following conditions: )|(?<=portions of the Software\. )|(?<=distribution\. )|(?<= )(?=2\. Redist)|(?<=written permission\. )", BY[name])
    return "\n\n".join(re.sub(r"(.{50}\S*) ", r"\1\n", p) for p in parts)


def test_equals_every_run_with_every_template(spark):
    mit, noise = BY["MIT"], " ".join(f"w{i}" for i in range(200))
    lines = re.sub(r"(.{60}\S*) ", r"\1\n", mit)
    rows = [
        (1, None), (2, ""), (3, "word"), (4, "Released under the MIT License."), (5, "intro\nreleased UNDER the mit, license!\nend"), (5, "Released under the MIT License."),
        (6, f"some words here\n\n{lines}\n\nand an end"), (7, mit.replace("software", "program")), (8, mit[: len(mit) // 2]), (9, "Licensed under the Apache License, Version 2.0. " * 30),
        (10, "x " * 60000), (11, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (None, "Released under the MIT License."), (12, BY["BSD-3-Clause"]), (13, "\n\n\n"),
        (14, f"{noise}\n\n{published('MIT')}\n\n{noise}"), (15, f"{published('BSD-3-Clause')}\n\n{noise}\n{published('Zlib')}"), (16, f"{noise} all of it is licensed under the Apache License, version 2.0, {noise}"),
        (17, "license " * 400), (18, noise + " released under an mit like license " + noise),
    ]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, license string, size int")
    found = scanned(docs)
    assert found == brute(rows)
    assert {r[0] for r in found} == {4, 5, 6, 7, 9, 11, 12, 14, 15, 16, None}
    assert {(14, "MIT"), (15, "BSD-3-Clause"), (15, "Zlib"), (16, "Apache-2.0-line")} <= {r[:2] for r in found}
    assert [r[2] for r in found if r[:2] in ((14, "MIT"), (15, "BSD-3-Clause"))] == [1.0, 1.0]


def test_random_edits(spark):
    rng, rows = random.Random(5), []
    for i in range(60):
        w = BY[rng.choice(["0BSD", "MIT", "Apache-2.0-header", "GPL-3.0-line", "CC-BY-4.0-line"])].split()
        for _ in range(rng.randrange(len(w) // 6 + 2)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(["the", "of", "software", "x"])] * rng.randrange(3)
        rows.append((i, " ".join(["the", "software", "is"] * rng.randrange(9) + w + ["in", "no", "event"] * rng.randrange(9))))
    found = scanned(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == brute(rows) and len(found) > 30


def test_bounds_are_exact():
    for size in range(1, 60):
        least, most = licenses.bounds(size)
        for other in range(1, 120):
            assert (least <= other <= most) == (2 * min(size, other) / (size + other) >= 0.8 - 1e-12)


def test_matches_have_an_anchor():
    rng = random.Random(0)
    for name, template in licenses.TEMPLATES:
        own, w = licenses.bigrams(template), licenses.normalised(template).split()
        known = licenses.anchors(own)
        for _ in range(60):
            kept = [x for x in w if x not in known]  # nothing but words without an anchor
            rng.shuffle(kept) if rng.random() < 0.3 else None
            a = Counter(f"{x} {y}" for x, y in zip(kept, kept[1:]))
            assert not a or 2 * (a & own).total() / (a.total() + own.total()) < 0.8, name


def test_a_long_document_of_notices(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License. " * 20000), (2, BY["MIT"] * 150)], "doc_id long, text string")
    found = {r[:2]: r[2:] for r in scanned(docs)}
    assert found[1, "MIT-line"][:3] == (1.0, 0, 5) and found[2, "MIT"][:2] == (1.0, 0)


def test_native(spark):
    plan = licenses.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
