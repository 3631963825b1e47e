import random
from collections import defaultdict

import corpus_pipeline
from kanasift.llm import decontam, queries, simhash


def write(spark, path, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    words = [f"word{k}" for k in range(900)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    bench = [(k, some(25) + ". " + some(8) + ".") for k in range(20)]
    docs = [(k, "\n".join(some(30) for _ in range(4))) for k in range(60)]
    docs += [(60 + k, docs[k][1] + " x") for k in range(5)]  # near copies
    docs += [(70 + k, some(60) + " " + bench[k][1] + " " + some(40)) for k in range(5)]  # leaks
    docs += [(80 + k, some(30).replace(" ", " %%% ")) for k in range(5)] + [(90, None), (91, "short")]  # junk
    docs = [(k, (t + "\nAll rights reserved to the site owner") if t and k < 40 else t, "en", f"s{k % 10}", len(t or "")) for k, t in docs]
    write(spark, tmp_path, docs, [(k, 1, 0) for k in range(75)] + [(80, 0, 0)], bench)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != names[-1]:
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/{name}")
            now = spark.read.parquet(f"{tmp_path}/{name}")
            seen[name] = {r["doc_id"]: r for r in now.collect()}
    good, lines, unique, clean = (seen[n] for n in names[:4])
    assert set(good) == {*range(65), *range(70, 75)}
    # Boilerplate stays with the first document, and n_chars follows.
    assert [k for k, r in lines.items() if "All rights" in r["text"]] == [0] and all(r["n_chars"] == len(r["text"]) for r in lines.values())
    fps = {k: simhash.fingerprint(r["text"]) for k, r in lines.items()}
    groups = {k: min(j for j in fps if bin((fps[j] ^ fps[k]) & (1 << 64) - 1).count("1") <= 2) for k in fps}
    assert set(unique) == set(groups.values())
    assert set(clean) == set(unique) - set(range(70, 75))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(clean)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_on_an_empty_table(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_queries_are_named(spark):
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(queries.oracle_sql()) <= set(names)
    assert decontam.question_and_answer("One two. Three?") == (["one", "two"], ["three"])


def test_columns_of_the_documents_own_keep_their_values(spark):
    docs = [(k, f"line one of {k} here\nAll rights reserved", f"s{k}", 777, 888, "x") for k in range(8)] + [(9, None, None, 1, 2, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_removed int, n_lines int, __own_x string")
    out = corpus_pipeline.drop_boilerplate(spark, df, "")
    assert out.columns == df.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all((rows[k]["n_removed"], rows[k]["n_lines"]) == d[3:5] for k, d in enumerate(docs[:8]))
    assert [k for k in range(8) if "rights" in rows[k]["text"]] == [0] and rows[9]["text"] is None


def test_near_copies_by_the_contract(spark):
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(600)]
    texts = [" ".join(rng.choices(words, k=rng.randint(20, 200))) for _ in range(40)]
    for k in range(40):
        ws = texts[k].split()
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(len(ws))] = "other"
        texts.append(" ".join(ws))
    texts += [texts[0]] * 3 + [texts[1] + " x"] * 2 + ["short", "short one"]
    sets = []
    for t in texts:
        ws = t.split()
        n = min(5, len(ws))
        sets.append({tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)})
    first = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((first[a], first[b]))
                first = [lo if x == hi else x for x in first]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(first) and len(kept) < 70
