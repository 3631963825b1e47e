import random
from itertools import combinations

import pytest
from xxhash import xxh64_intdigest

from kanasift.llm import components, simhash

DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "_").split() if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps, most=2):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= most:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in fps}


def test_fingerprint():
    for t in [None, "", " \n", "one", "Two words", "a b c", "A B C a b c A b C d", "Ünï ÄB c d e f g"]:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain_fingerprint(t)
    assert simhash.fingerprint("The cat SAT") == simhash.fingerprint("the\tcat\nsat")


def clouds(rng, n, centres, flips):
    middles = [rng.getrandbits(64) for _ in range(centres)]
    out = []
    for _ in range(n):
        x = rng.choice(middles)
        for b in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("bucket", [4, 256])
def test_links_find_all(spark, bucket):
    rng = random.Random(bucket)
    fps = dict(enumerate(sorted(set(clouds(rng, 500, 12, 4)))))
    signed = {k: v - (1 << 64) if v >> 63 else v for k, v in fps.items()}
    found = components.components(simhash.links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), 2, bucket)).collect()
    back = {v: k for k, v in signed.items()}
    want = plain_components(fps)
    roots = {r["u"]: r["root"] for r in found}
    groups = {}
    for k, v in want.items():
        groups.setdefault(v, set()).add(k)
    got = {}
    for v, k in back.items():
        got.setdefault(roots.get(v, v), set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_thresholds_add_up():
    rng = random.Random(1)
    for n in (2, 1000, 10**9):
        values = [x - (1 << 64) if x >> 63 else x for x in clouds(rng, 300, 300, 0)]
        groups, thresholds = simhash.plan(values, n, 2)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(thresholds) == 2 - len(groups) + 1
    assert simhash.plan([], 0, 2)[1]


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = {k: " ".join(rng.choices(words, k=120)) for k in range(20)}
    for k in range(20, 40):
        w = texts[k - 20].split()
        w[rng.randrange(120)] = "changed"
        texts[k] = " ".join(w)
    texts |= {40: texts[3], 41: "", 42: None, 43: " \n\t", 44: "x " * 5000, 45: texts[3]}
    rows = [(k, v) for k, v in texts.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", fp string, root int")
    out = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = {k: plain_fingerprint(v) for k, v in texts.items()}
    assert {k: v[0] & (1 << 64) - 1 for k, v in out.items()} == fps
    assert {k: v[1] for k, v in out.items()} == plain_components(fps)
    assert out[42][1] == 41 and out[45][1] == out[40][1] <= 3
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({v[1] for v in out.values()})


def test_repeated_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (5, "d e f g")], DOCS)
    assert sorted((r[0] or 0, r[2]) for r in simhash.near_duplicates(rows).collect()) == [(0, 1), (1, 1), (1, 1), (5, 5)]
    assert sorted(r[0] for r in simhash.keep_first(rows).collect()) == [1, 5]
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_first(empty).collect() == []


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (7, 7)]
    out = {r["u"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}
