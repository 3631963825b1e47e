import random
import re
from collections import defaultdict

import pytest

from kanasift.llm import linededup

DOCS = "doc_id long, text string, source string"


def plain(rows, min_sites, keep_first=True):
    sites, first = defaultdict(set), {}
    trim = lambda x: re.sub(r"[\t\x0b\f\r]", " ", x).strip(" ")
    for doc_id, text, source in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                sites[trim(line)].add(source or "")
                first[trim(line)] = min(first.get(trim(line), (1 << 62, 0)), (doc_id, pos))
    out = []
    for doc_id, text, _ in rows:
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        lines = text.split("\n")
        keep = [x for pos, x in enumerate(lines) if len(sites.get(trim(x), ())) < min_sites or keep_first and first[trim(x)] == (doc_id, pos)]
        out.append((doc_id, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out)


@pytest.mark.parametrize("keep_first", [True, False])
def test_dedup(spark, keep_first):
    rng = random.Random(4)
    shared = ["Subscribe now", "  Subscribe now\t", "All rights reserved.", "é ü", "", "   ", "x"]
    rows = []
    for k in range(120):
        lines = [f"own {k} {j}" for j in range(rng.randint(0, 4))] + rng.choices(shared, k=rng.randint(0, 4)) + [f"rare {rng.randint(0, 30)}"]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), f"s{rng.randint(0, 9)}"))
    rows += [(200, None, "s1"), (201, "", "s1"), (202, "\n\n", None), (203, "Subscribe now", None), (204, "Subscribe now\n" * 3000, "s2"), (205, "Subscribe now", "s3")]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], DOCS + ", n_lines int, first int")
    out = linededup.dedup(df, 4, keep_first)
    assert out.columns == ["doc_id", "text", "source", "first", "n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()), key=lambda r: r[0]) == plain(rows, 4, keep_first)


def test_many_sites_and_near_threshold(spark):
    rows = [(k, f"a line\nwith {k}" + ("\nnearly" if k < 59 else "") + ("\njust" if k < 60 else ""), f"site{k}") for k in range(400)]
    out = {r["doc_id"]: r for r in linededup.dedup(spark.createDataFrame(rows, DOCS), 60).collect()}
    assert out[0]["text"] == rows[0][1] and out[5]["text"] == "with 5\nnearly" and out[59]["text"] == "with 59" and out[300]["n_removed"] == 1


def test_repeats_and_empty(spark):
    rows = [(1, "a\nb", "s1"), (1, "a\nb", "s1"), (2, "a", "s2"), (3, "a", "s3")]
    out = sorted((r["doc_id"], r["text"]) for r in linededup.dedup(spark.createDataFrame(rows, DOCS), 3).collect())
    assert out == [(1, "a\nb"), (1, "a\nb"), (2, ""), (3, "")]
    assert linededup.dedup(spark.createDataFrame([], DOCS)).collect() == []
