import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kanasift.llm import licenses

MIT = licenses.TEMPLATES[0][1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=4), st.text("abcd", max_size=30))
def test_statistics_equal_brute_force(templates, text):
    auto = licenses.build([(str(k), " ".join(t)) for k, t in enumerate(templates)])
    known = [auto.vocabulary.get(c.encode(), -1) for c in text]
    for k, (n, state) in enumerate(auto.statistics(known)):
        want = max(size for size in range(k + 2) if size == 0 or any(text[k + 1 - size : k + 1] in t for t in templates))
        assert n == want
        if n:
            run = text[k + 1 - n : k + 1]
            ends = {(t, e) for t, x in enumerate(templates) for e in range(n, len(x) + 1) if x[e - n : e] == run}
            assert set(auto.ends[state]) == ends


def plain(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = [(k, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for k in range(len(ws)) if ws[k : k + len(p)] == p]
    return len(ws), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_scan(spark):
    rng = random.Random(2)
    cut = MIT.split()
    near = " ".join(w if k % 25 else "changed" for k, w in enumerate(cut))
    texts = [None, "", "MIT License, then the Apache-License and GNU General\nPublic license", "mit\x00license", "KITémit license", MIT, f"words before {near} words after", " ".join(cut[:20]), "Licensed under CC BY-NC 4.0.", "permission " * 20000, "The MIT license is hereby granted free of charge"]
    texts += ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."]
    texts += [" ".join(rng.choices(["mit", "apache", "general", "public", "license", "x", "é"], k=rng.randint(0, 60))) for _ in range(200)]
    out = {r["doc_id"]: r for r in licenses.scan_documents(spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, score int")).collect()}
    for k, t in enumerate(texts):
        assert tuple(out[k][1:6]) == plain(t), t
        assert 0 <= out[k]["score"] <= 1 and set(filter(None, out[k]["base_labels"].split(","))) <= set(out[k]["labels"].split(","))
    assert out[5]["labels"] == "mit" and out[5]["score"] == 1 and out[5]["spans"][0]["first"] == 0
    assert out[6]["labels"] == "mit" and out[6]["score"] > 0.7 and out[6]["spans"][0]["first"] >= 2
    assert out[7]["labels"] == "" and 0 < out[7]["score"] < 0.6
    assert out[8]["labels"] == "cc-by-nc" and out[11]["labels"] == "mit" and out[12]["labels"] == "gpl"
    assert licenses.scan_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_spans(templates, ws, min_match, max_gap, min_cover):
    """Spans and score by comparing every place of the file with every place of each template."""
    spans, score = [], 0.0
    for label, template in templates:
        m = len(template)
        runs = []
        for f in range(len(ws)):
            for p in range(m):
                if ws[f] == template[p] and not (f and p and ws[f - 1] == template[p - 1]):
                    n = 1
                    while f + n < len(ws) and p + n < m and ws[f + n] == template[p + n]:
                        n += 1
                    if n >= min(min_match, m):
                        runs.append((f, p, n))
        chains = []
        for f, p, n in sorted(runs):
            fits = []
            for c in chains:
                front = max(0, c[1] - f, c[2] - p)
                if front < n and f + front - c[1] <= max_gap and p + front - c[2] <= max_gap:
                    fits.append((c, front))
            if fits:
                c, front = max(fits, key=lambda x: x[0][3])
                c[1], c[2], c[3] = f + n, p + n, c[3] + n - front
            else:
                chains.append([f, f + n, p + n, n])
        for first, end, _, covered in chains:
            score = max(score, covered / m)
            if covered / m >= min_cover:
                spans.append((label, first, end, covered / m))
    return sorted(spans, key=lambda s: (s[1], s[2], s[0])), min(1.0, score)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=4, unique=True), st.text("abcd", max_size=60), st.integers(1, 4), st.integers(0, 5))
def test_spans_equal_brute_force(templates, text, min_match, max_gap):
    auto = licenses.build([(str(k), " ".join(t)) for k, t in enumerate(templates)])
    got = licenses.scan(auto, [c.encode() for c in text], min_match, max_gap, 0.5)
    want = plain_spans([(str(k), t) for k, t in enumerate(templates)], text, min_match, max_gap, 0.5)
    assert got == want


def test_a_template_inside_a_longer_one_is_found():
    auto = licenses.build([("a", "x y z w k l m"), ("b", "q x y z w k l m r s")])
    spans, score = licenses.scan(auto, licenses.words("q x y z w k l m r s"))
    assert [s[:3] for s in spans] == [("b", 0, 10), ("a", 1, 8)] and score == 1


def test_repeated_notices_take_time_in_proportion():
    auto = licenses.build()
    spans, _ = licenses.scan(auto, licenses.words("Released under the MIT License. " * 50_000))
    assert len(spans) == 50_000
    assert len(licenses.scan(auto, licenses.words((MIT + " ") * 200))[0]) >= 200


def test_labels_of_documents_equal_brute_force(spark):
    rng = random.Random(7)
    templates = [(label, [w.decode() for w in licenses.words(t)]) for label, t in licenses.TEMPLATES]
    texts = []
    for _ in range(40):
        some = []
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(templates)[1]
            lo = rng.randint(0, len(t) // 3)
            some += [w if rng.random() > 0.04 else "other" for w in t[lo : rng.randint(2 * len(t) // 3, len(t))]] + rng.choices(["software", "the", "license", "q"], k=rng.randint(0, 15))
        texts.append(" ".join(some))
    out = {r["doc_id"]: r for r in licenses.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        spans, score = plain_spans(templates, t.split(), licenses.MIN_MATCH, licenses.MAX_GAP, licenses.MIN_COVER)
        base = set(filter(None, out[k]["base_labels"].split(",")))
        assert out[k]["labels"] == ",".join(sorted(base | {s[0] for s in spans})) and abs(out[k]["score"] - score) < 1e-12
