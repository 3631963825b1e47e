import math
import random
import re
from collections import Counter

from kanasift.llm import quality

DOCS = "doc_id long, text string"


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_figures(spark):
    rng = random.Random(0)
    texts = [None, "", " \n \t", "a", "a a a a", "a b c a b c", "x\ny\nx\n\n\n x\n", "a b #$% | <b> &amp;", "é é é é\x0bé\x0cé\ré", "one two three\nfour one two three four one", "w " * 30000]
    texts += ["".join(rng.choices(["a ", "b ", "c\n", "dé ", "#", "\t", " ", "\n"], k=rng.randint(1, 200))) for _ in range(200)]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], DOCS + ", n_words int")
    for r in quality.base_figures(df).collect():
        assert tuple(r[2:]) == plain(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_score(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choices(["the", "cat", "sat", "down", "again", "slowly", *map(str, range(40))], k=90)) for _ in range(30)]
    junk = [" ".join(w + "%%%" for w in t.split()) for t in good[:10]]
    texts = [*good, *junk, None, "", "few words", "a b c " * 40]
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(25)] + [(None, 1), (3, 1)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.score(spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], DOCS + ", bucket int"), labels).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        n, _, _, _, repeat = plain(t)
        assert rows[k]["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert rows[k]["kept"] == (not rows[k]["base_failed"] and rows[k]["llr"] >= quality.THRESHOLD)
        if not (t or "").strip():
            assert rows[k]["llr"] == 0
    kept = quality.keep(spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], DOCS + ", n_words int"), labels)
    assert kept.columns == ["doc_id", "text", "n_words"] and sorted(r["doc_id"] for r in kept.collect()) == [k for k in rows if rows[k]["kept"]]
    assert min(rows[k]["llr"] for k in range(30)) > max(rows[k]["llr"] for k in range(30, 40))
    # The ratio by hand, for tokens that share no bucket.
    tokens = lambda t: re.findall(r"[a-z0-9]+|[^a-z0-9\s]+", (t or "").lower())
    grams = lambda t: [(x,) for x in tokens(t)] + list(zip(tokens(t), tokens(t)[1:], strict=False))
    raw, trusted = Counter(), Counter()
    for k, t in enumerate(texts):
        raw.update(grams(t))
        if k < 20:
            trusted.update(grams(t))
    a, b = sum(trusted.values()) + quality.BUCKETS, sum(raw.values()) + quality.BUCKETS
    for k in (0, 5, 35, 43):
        g = grams(texts[k])
        assert rows[k]["n_grams"] == len(g)
        by_hand = sum(math.log((trusted[x] + 1) / a) - math.log((raw[x] + 1) / b) for x in g) / len(g)
        assert abs(rows[k]["llr"] - by_hand) < 0.15


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.score(spark.createDataFrame([(1, " ".join(map(str, range(60)))), (1, " ".join(map(str, range(60))))], DOCS), none).collect()
    assert [(r["llr"], r["kept"]) for r in rows] == [(0.0, True)] * 2
    assert quality.score(spark.createDataFrame([], DOCS), none).collect() == []


def test_copies_do_not_weigh(spark):
    # A clean text with many copies that no label covers is judged like one without copies.
    rng = random.Random(4)
    some = lambda: " ".join(rng.choices([f"w{k}" for k in range(400)], k=200))
    texts = [some() for _ in range(60)]
    labels = spark.createDataFrame([(k, 1) for k in range(1, 40)], "doc_id long, quality int")
    rows = [*enumerate(texts), *((1000 + k, texts[0]) for k in range(600))]
    llr = {r["doc_id"]: (r["llr"], r["kept"]) for r in quality.score(spark.createDataFrame(rows, DOCS), labels).collect()}
    alone = {r["doc_id"]: r["llr"] for r in quality.score(spark.createDataFrame(rows[:60], DOCS), labels).collect()}
    assert all(kept for _, kept in llr.values()) and all(abs(llr[k][0] - x) < 1e-9 for k, x in alone.items())
