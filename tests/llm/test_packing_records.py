import random
import zlib
from array import array
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kanasift.llm import packing, records, tokens

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


ODD = ["", " ", "a", "  two  spaces ", "line\n\nbreaks\r\nhere\n", "tab\tand\x0bmore\x1cx\x85y", "don't WE'LL 's 12a 3.14 x_y __ ½ ²", "é漢字かな　全角 😀 z", "<|endoftext|> x", "a\0b", "Ⅷ ǅ ٣", "​zero", "x" * 5000]


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(0)
    letters = "abcé ÄB.,!?'\n\t 019_-—½漢\x85 "
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(3000)]
    for t, x in zip(texts, tokens.encoder(None).encode(texts), strict=True):
        assert list(array("I", x)) == tokenizer.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80), st.sampled_from([24, 23, 30]))
def test_plan_places_each_piece_once(lengths, capacity):
    lengths = [x for x in lengths if x <= capacity]
    n = Counter(lengths)
    used, ranks = defaultdict(list), defaultdict(set)
    for length, lo, hi, first, each, offset in packing.plan(dict(n), capacity):
        for r in range(lo, hi):
            assert r not in ranks[length]
            ranks[length].add(r)
            used[first + (r - lo) // each].append((offset + (r - lo) % each * length, length))
    assert {k: set(range(v)) for k, v in n.items()} == dict(ranks)
    assert sorted(used) == list(range(len(used)))
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    # Best fit of sorted lengths, one by one, needs no fewer.
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= x]
        if fit:
            min(fit)[0] -= x
        else:
            bins.append([capacity - x])
    assert len(used) <= len(bins)
    large = [x for x in lengths if 3 * x > capacity]
    assert all(sum(1 for _, x in items if 3 * x > capacity) <= 2 for items in used.values()) and len(used) >= -(-len(large) // 2)


def texts_for(rng, n=150):
    words = ["the", "of", "and", "thinly", "ereanor", "é", "\n", "!!", "Ascirr"]
    return [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 300, 900, 4000]))) for _ in range(n)] + ODD


def test_pack(spark, tokenizer):
    rng = random.Random(5)
    rows = [(k, t) for k, t in enumerate(texts_for(rng))] + [(900, None), (901, "same text"), (901, "same text")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", length int, part int").repartition(5)
    out = packing.pack(df).collect()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    for doc_id, t in dict(rows).items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        copies = 2 if doc_id == 901 else 1
        got = sorted(by[doc_id], key=lambda r: r["piece"])
        assert len(got) == copies * -(-len(ids) // 2048)
        for r in got:
            x = ids[r["start"] : r["start"] + r["length"]]
            assert len(x) == r["length"] and zlib.crc32(array("I", x).tobytes()) == r["ids_crc32"]
        if copies == 1:
            assert [r["length"] for r in got[1:]] == [2048] * (len(got) - 1) and [r["start"] for r in got] == [sum(x["length"] for x in got[:k]) for k in range(len(got))]
            assert sum(r["length"] for r in got) == len(ids)
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []


def test_records_round_trip(spark, tokenizer, tmp_path):
    rng = random.Random(6)
    rows = [(k, t) for k, t in enumerate(texts_for(rng, 60))] + [(None, "no id"), (70, None), (71, "twice"), (71, "twice")]
    rng.shuffle(rows)
    shards = records.write_records(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", shard int"), f"file://{tmp_path}/out", 4)
    out = records.read_records(shards).collect()
    want, start = [], 0
    for doc_id, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in out), key=lambda r: r[1]) == want
    one = max(shards.collect(), key=lambda r: r["records"])
    whole = records.read_at(one["file"], list(range(one["records"])))
    asked = rng.sample(range(one["records"]), min(5, one["records"]))
    assert records.read_at(one["file"], asked) == [whole[p] for p in asked]
    assert records.read_records(records.write_records(spark.createDataFrame([], DOCS), f"file://{tmp_path}/none", 2)).collect() == []


def test_damage_is_noticed():
    good = records.frame(7, array("I", [1, 2, 70000]).tobytes()) + records.frame(None, b"")
    doc_id, ids, at = records.unframe(memoryview(good), 0)
    assert (doc_id, list(array("I", ids))) == (7, [1, 2, 70000])
    assert records.unframe(memoryview(good), at) == (None, b"", len(good))
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            _, _, here = records.unframe(memoryview(bytes(bad)), 0)
            records.unframe(memoryview(bytes(bad)), here)
    with pytest.raises(ValueError):
        records.unframe(memoryview(good[:-1]), at)


def test_records_of_one_doc_id_are_dealt_out(spark, tokenizer, tmp_path):
    rows = [(5, "same text")] * 300 + [(None, f"text {k}") for k in range(300)] + [(6, "é" * 3000), (4, None)]
    shards = records.write_records(spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", front string").repartition(4), f"file://{tmp_path}/hot", 6)
    assert max(r["records"] for r in shards.collect()) < 250
    out = sorted((tuple(r) for r in records.read_records(shards).collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == [None] * 300 + [4] + [5] * 300 + [6]
    at = 0
    for _, start, n, _ in out:
        assert start == at
        at += n


def test_files_of_lost_attempts_go(spark, tmp_path):
    (tmp_path / "out").mkdir()
    for kind in ("rec", "idx"):
        (tmp_path / "out" / f"shard-000000-999999.{kind}").write_bytes(b"half a file")
    shards = records.write_records(spark.createDataFrame([(1, "a b"), (2, "c")], DOCS), f"file://{tmp_path}/out", 2)
    assert records.read_records(shards).count() == 2
    assert {p.name.rsplit(".", 1)[0] for p in (tmp_path / "out").iterdir()} == {r["file"].rsplit("/", 1)[1] for r in shards.collect()}
