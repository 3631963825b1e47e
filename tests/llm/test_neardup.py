import random
from itertools import combinations

import corpus_pipeline
import pytest

from kanasift.llm import neardup, simhash

DOCS = "doc_id long, text string"


def plain_components(texts):
    def of(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, root = {k: of(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 10 * len(x & y) >= 8 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {k: find(k) for k in texts}


def edited(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    """Small groups, a group of 150 copies with 0 to 8 changed words, and 60 texts with one passage in common."""
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choices([f"w{k}" for k in range(2000)], k=n))
    texts = [some(rng.randint(40, 200)) for _ in range(40)]
    texts += [edited(rng, t, rng.randint(1, 6)) for t in texts]
    base, passage = some(140), some(80)
    texts += [edited(rng, base, rng.randint(0, 8)) for _ in range(150)]
    texts += [some(15) + " " + passage + " " + some(15) for _ in range(60)]
    texts += [None, "", " \n", "Two words", "two  words", "other words", texts[3], texts[3].upper().replace(" ", "\n")]
    ids = rng.sample(range(1000), len(texts))
    return dict(zip(ids, texts, strict=True))


@pytest.mark.parametrize("bucket", [4, 32])
def test_near_copies_find_all(spark, bucket):
    texts = corpus()
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_copies(spark.createDataFrame(list(texts.items()), DOCS), bucket=bucket).collect()}
    assert out == {k: v for k, v in plain_components({k: t or "" for k, t in texts.items() if (t or "").strip()}).items()} | {k: min(j for j, t in texts.items() if not (t or "").strip()) for k, t in texts.items() if not (t or "").strip()}


def test_sets_too_large_to_send(spark, monkeypatch):
    """Links are the same where the sets of hot texts are repeated by salts instead of sent."""
    monkeypatch.setattr(neardup, "MOST_SENT", -1)
    texts = {k: t for k, t in corpus().items() if (t or "").strip()}
    rows = spark.createDataFrame(list(texts.items()), DOCS)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_copies(rows, bucket=4).collect()} == plain_components(texts)
    monkeypatch.setattr(neardup, "HOT_KEYS", 1)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_copies(rows, bucket=4).collect()} == plain_components(texts)


def test_stage_removes_planted_near_copies(spark, tmp_path):
    rng = random.Random(8)
    texts = {k: " ".join(rng.choices([f"w{k}" for k in range(900)], k=200)) for k in range(20)}
    texts |= {100 + k: edited(rng, texts[k], 3) for k in range(20)}
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], DOCS + ", source string")
    out = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == list(range(20))


def test_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (5, "d e f g")], DOCS)
    assert sorted(r[0] for r in neardup.keep_first(rows).collect()) == [1, 5]
    assert neardup.keep_first(spark.createDataFrame([], DOCS)).collect() == []


def test_simhash_comes_first(spark, monkeypatch):
    """The stage compares all texts within two bits; those that are similar make components before any other search."""
    rng, asked = random.Random(31), []
    texts = {k: " ".join(rng.choices([f"w{k}" for k in range(3000)], k=1500)) for k in range(12)}
    texts |= {100 + k: edited(rng, texts[k % 12], 1) for k in range(36)}
    fps = {k: simhash.fingerprint(t) for k, t in texts.items()}
    near = [(a, b) for a, b in combinations(sorted(fps), 2) if bin((fps[a] ^ fps[b]) & (1 << 64) - 1).count("1") <= 2]
    rows = [(k, fps[k]) for k in fps] + [(500, fps[0]), (501, fps[0])]
    links = [(r["u"], r["v"]) for r in neardup.simhash_pairs(spark.createDataFrame(rows, "node long, fp long")).collect()]
    pairs = {tuple(sorted(p)) for p in links}
    assert len(near) > 12 and {(a, b) for a, b in near if fps[a] != fps[b]} <= {(min(a, b), max(a, b)) for u, v in pairs for a in fps for b in fps if fps[a] == fps.get(u) and fps[b] == fps.get(v)}
    assert {(0, 500), (0, 501)} <= pairs
    whole = neardup.simhash_pairs
    monkeypatch.setattr(neardup, "simhash_pairs", lambda d: asked.append(whole(d)) or asked[-1])
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(list(texts.items()), DOCS), "")
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(12)) and asked


def test_large_groups_with_components_of_simhash(spark):
    """Groups of long texts, many of them within two bits and others far apart, by the prefix filter."""
    rng = random.Random(77)
    some = lambda n: " ".join(rng.choices([f"w{k}" for k in range(2000)], k=n))
    bases = [some(600), some(500)]
    texts = [edited(rng, b, rng.choice([0, 1, 1, 2, 3, 8, 15, 25, 40])) for b in bases for _ in range(40)] + [some(200) for _ in range(10)]
    texts = dict(zip(rng.sample(range(1000), len(texts)), texts, strict=True))
    fps = [simhash.fingerprint(t) for t in texts.values()]
    assert sum(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in combinations(fps, 2)) > 50
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_copies(spark.createDataFrame(list(texts.items()), DOCS), bucket=4).collect()}
    assert out == plain_components(texts)
