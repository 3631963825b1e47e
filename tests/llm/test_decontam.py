import random

import numpy as np

from kanasift.llm import decontam

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORDS = [f"w{k}" for k in range(400)] + ["the", "of", "and"] * 40


def item(rng, n=30):
    return " ".join(rng.choices(WORDS, k=n)) + ". " + " ".join(rng.choices(WORDS, k=6)) + "."


def plain_scores(index, items, ws):
    """BM25 of all items by dictionaries, over each passage, as shares of the items' own scores."""
    from collections import Counter
    from math import log

    split = [decontam.words(t) for _, t in items]
    df, mean = Counter(w for s in split for w in set(s)), sum(map(len, split)) / len(split)
    passages = max(1, -(-len(ws) // index.stride) - 1)
    out = {}
    for p in range(passages):
        seen = set(ws[p * index.stride : (p + 2) * index.stride])
        for k, s in enumerate(split):
            tf = Counter(s)
            w = {t: log(1 + (len(split) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(s) / mean)) for t, n in tf.items()}
            score = sum(v for t, v in w.items() if t in seen) / sum(w.values())
            if score >= decontam.RETRIEVE:
                out[p * index.stride, k] = score
    return out


def test_search_finds_all_above_threshold():
    rng = random.Random(0)
    items = [(k, item(rng)) for k in range(100)]
    index = decontam.build(items)
    docs = [decontam.words(" ".join(rng.choices(WORDS, k=rng.randint(0, 500)) + (items[k % 100][1].split()[: rng.randint(10, 40)] if k % 2 else []))) for k in range(60)]
    got = {(t, first, k): s for t, first, k, s in decontam.search(index, docs)}
    want = {(t, first, k): s for t, ws in enumerate(docs) for (first, k), s in plain_scores(index, items, ws).items()}
    close = {x for x, s in {**got, **want}.items() if abs(s - decontam.RETRIEVE) < 1e-4}
    assert set(got) - close == set(want) - close and len(want) > 20
    assert all(np.isclose(got[x], want[x], atol=1e-4) for x in set(want) - close)


def test_leaks_and_clean(spark):
    rng = random.Random(1)
    items = [(k, item(rng, rng.choice([12, 30, 45]))) for k in range(60)] + [(100, None), (101, "  .. "), (102, item(rng, 300))]
    docs = [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 400)))) for k in range(60)]
    planted = {}
    for k in range(60, 110):
        i, t = items[k % 60]
        ws = rng.choices(WORDS, k=rng.randint(0, 300))
        at = rng.randint(0, len(ws))
        docs.append((k, " ".join([*ws[:at], t.upper().replace(" ", "\n") if k % 3 else t.replace(".", "!"), *ws[at:]])))
        planted[k] = i
    docs += [(110, None), (111, ""), (112, items[-1][1]), (112, items[-1][1]), (113, " ".join(items[0][1].split()[:14])), (114, ("w1 the of " * 60000))]
    df = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", item_id int")
    bench = spark.createDataFrame(items, ITEMS)
    found = [(r["doc_id"], r["item_id"]) for r in decontam.leaks(df, bench).collect()]
    assert sorted(found) == sorted([*planted.items(), (112, 102), (112, 102)])
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in docs if d not in planted and d != 112)
    # A benchmark in several groups gives the same.
    few = sorted((i, len(x.ids)) for i, b in enumerate(decontam.indexes(bench, 20)) for x in [b.value])
    assert sum(n for _, n in few) == 61


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c d e f g h i j")], DOCS)
    bench = spark.createDataFrame([(5, "a b c d e f g h i j")], ITEMS)
    assert decontam.leaks(none, bench).collect() == [] and decontam.leaks(one, spark.createDataFrame([], ITEMS)).collect() == []
    assert decontam.clean(one, spark.createDataFrame([], ITEMS)).count() == 1 and decontam.clean(one, bench).count() == 0
    assert [tuple(r)[:2] for r in decontam.leaks(one, bench).collect()] == [(1, 5)]


def test_grouping_changes_no_result(spark):
    rng = random.Random(4)
    items = [(k, item(rng, rng.choice([4, 12, 30, 90, 200]))) for k in range(80)] + [(90, item(rng, 6000)), (91, "one"), (92, "two words.")]
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 300)) + items[k % 83][1].split()[: rng.randint(3, 250)] + rng.choices(WORDS, k=rng.randint(0, 200))) for k in range(120)]
    statistics = decontam.Statistics(t for _, t in items)

    def found(groups):
        return sorted((k, i, *(round(x, 6) for x in (score, q, a, whole)), first) for some in groups for k, i, score, q, a, first, whole in decontam.matches(decontam.build(some, statistics=statistics), texts))

    whole = found([items])
    assert len(whole) > 20
    for size in (1, 7, 20):
        assert found([items[k : k + size] for k in range(0, len(items), size)]) == whole
    # The same through tables, whose indexes are bounded by items or by characters.
    bench = spark.createDataFrame(items, ITEMS)
    for bound in ({"group": 20}, {"characters": 3000}):
        split = [b.value for b in decontam.indexes(bench, **bound)]
        assert len(split) > 3 and sorted(x for i in split for x in i.ids) == sorted(i for i, _ in items)
        assert sorted((k, i, round(s, 6)) for x in split for k, i, s, *_ in decontam.matches(x, texts)) == sorted(x[:3] for x in whole)


def test_verification_equals_brute_force():
    """All passages against all items by word lists: scores, then shares of question, answer and whole."""
    from collections import Counter
    from math import log

    rng = random.Random(8)
    items = [(k, item(rng, rng.choice([8, 20, 60, 150]))) for k in range(40)]
    split = [decontam.words(t) for _, t in items]
    df, mean = Counter(w for s in split for w in set(s)), sum(map(len, split)) / len(split)
    runs = lambda ws, n: {" ".join(ws[k : k + n]) for k in range(len(ws) - n + 1)}
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 200)) + [w if rng.random() > 0.02 else "changed" for w in split[k % 40]][: rng.randint(5, 200)] + rng.choices(WORDS, k=rng.randint(0, 200))) for k in range(80)]
    want = {}
    for t, text in enumerate(texts):
        ws = decontam.words(text)
        for k, s in enumerate(split):
            stride = next(64 * 2**j for j in range(20) if 64 * 2**j >= len(s) + len(s) // 4)
            tf = Counter(s)
            weight = {w: log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(s) / mean)) for w, n in tf.items()}
            q, a = decontam.question_and_answer(items[k][1])
            for p in range(max(1, -(-len(ws) // stride) - 1)):
                passage = ws[p * stride : (p + 2) * stride]
                if sum(v for w, v in weight.items() if w in set(passage)) / sum(weight.values()) >= decontam.RETRIEVE:
                    shares = [len(x & runs(passage, n)) / len(x) for part in (q, a, s) for n in [min(5, len(part))] for x in [runs(part, n)]]
                    if (min(shares[:2]) >= 0.8 or shares[2] >= 0.8) and max(min(shares[:2]), shares[2]) > want.get((t, k), 0):
                        want[t, k] = max(min(shares[:2]), shares[2])
    got = {(t, k): max(min(q, a), whole) for t, k, _, q, a, _, whole in decontam.matches(decontam.build(items), texts)}
    assert got.keys() == want.keys() and all(np.isclose(got[x], want[x]) for x in want) and len(want) > 10


def test_a_leak_without_its_short_answer_is_found(spark):
    text = "the quick brown fox jumps over a lazy dog near some old river bank while nobody sees it happen there today. Yes"
    bench = spark.createDataFrame([(1, text)], ITEMS)
    docs = spark.createDataFrame([(1, "before it " + text.removesuffix("Yes") + "No and so on"), (2, " ".join(text.split()[:9]))], DOCS)
    assert [r["doc_id"] for r in decontam.leaks(docs, bench).collect()] == [1]


def test_passages_that_reach_no_threshold():
    index = decontam.build([(k, f"rare{k} other{k} third{k} fourth{k} fifth{k} sixth{k}") for k in range(30)])
    assert decontam.search(index, [["rare1"], ["nothing"], [], ["rare2", "x"] * 90]) == []
    assert decontam.search(index, []) == [] and decontam.matches(index, [None, "", "rare1"]) == []
