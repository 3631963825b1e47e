import random

import pytest

from kanasift import sample
from kanasift.engine import Engine
from kanasift.operators import analyze as core
from kanasift.plans.config import Settings
from kanasift.sources import binary


def test_trie():
    rng = random.Random(0)
    keys = {bytes(rng.choices(range(1, 256), k=rng.randint(1, 5))): k for k in range(300)} | {"東京都".encode(): 1000, "東京".encode(): 1001}
    assert binary.trie_keys(binary.trie_units(keys)) == sorted(keys.items())
    assert binary.trie_keys(binary.trie_units({})) == []


def test_trie_of_many_blocks():
    """Letters far from their node, and the empty key of a node, are found again; so are keys that begin with others."""
    rng = random.Random(1)
    keys = {bytes(rng.choices(range(1, 256), k=rng.randint(1, 5))): k for k in range(3000)} | {b"a" * k: 5000 + k for k in range(1, 300)}
    for near in (256, 1024, 1 << 21):
        units = binary.trie_units(keys, near)
        assert binary.trie_keys(units) == sorted(keys.items())
        inner = units[units < 1 << 31]
        assert bool((inner >> 9 & 1).any()) == (near < 1 << 21)
    # Few units stay empty.
    assert len(units) < 1.2 * len({k[:n] for k in keys for n in range(len(k) + 1)} | {(k,) for k in keys})


def test_round_trip(spark, tmp_path):
    d = sample.system()
    data = binary.write(d, created=12345)
    assert binary.header(data) == {"is_user": False, "version": binary.NEWEST[False], "created": 12345, "description": "sample"}
    again = binary.read(data)
    assert again.words == d.words and again.pos == d.pos and again.matrix.costs == d.matrix.costs
    user = binary.write(sample.user(), len(d.pos))
    mine = binary.read(user, again)
    assert mine.words == sample.user().words and mine.pos == sample.user().pos and mine.user and mine.matrix is None
    (tmp_path / "s.dic").write_bytes(data)
    (tmp_path / "u.dic").write_bytes(user)
    e = Engine.open(spark, Settings({**sample.SETTINGS, "systemDict": f"{tmp_path}/s.dic", "userDict": [f"{tmp_path}/u.dic"]}))
    assert [t.surface for t in core.one_sentence(e.parts, "東京府に行った").tokens("A")] == ["東京", "府", "に", "行っ", "た"]


def test_what_is_no_dictionary():
    for bad in (b"", b"x" * 300):
        with pytest.raises(ValueError):
            binary.header(bad)
    with pytest.raises(ValueError):
        binary.read(binary.write(sample.user(), 8))
