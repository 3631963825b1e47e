import sys
import types

import pytest
from pyspark.sql import functions as F

from kanasift import functions as K
from kanasift import sample
from kanasift.cli import lines_of, main
from kanasift.engine import Engine
from kanasift.operators import analyze as core
from kanasift.operators import formats
from kanasift.operators.lattice import Lattice, Node
from kanasift.operators.text import Text
from kanasift.plans.config import Anchor, Settings, assemble
from kanasift.plans.progress import Progress, statistics
from kanasift.sources import binary

PLAIN = sample.parts({"pathRewritePlugin": []}, 0)


def own(name, **values):
    module = types.ModuleType(name)
    module.__dict__.update(values)
    sys.modules[name] = module


def test_formats(spark, tmp_path):
    own("my_formats", bars=lambda tokens: "|".join(t.surface for t in tokens))
    assert lines_of(PLAIN, "東京都に行った", "C", style="my_formats:bars") == ["東京都|に|行っ|た"]
    assert lines_of(PLAIN, "東京都に行った", "A", style="wakati") == ["東京 都 に 行っ た"]
    assert formats.formatter("tabular") is formats.tabular
    with pytest.raises(ValueError):
        formats.formatter("nothing")
    (tmp_path / "in.txt").write_text("東京都に行った\n")
    assert main(["analyze", "--format", "my_formats:bars", "-o", f"{tmp_path}/out", f"{tmp_path}/in.txt"]) == 0
    assert (tmp_path / "out").read_text() == "東京都|に|行っ|た\n"
    e = Engine(spark, PLAIN)
    docs = spark.createDataFrame([(1, "京都。東京都に行った"), (2, None)], "doc_id long, text string")
    rows = {(r["doc_id"], r["sent_id"]): r["formatted"] for r in e.format(docs, style="detailed").collect()}
    again = {(r["doc_id"], r["sent_id"]): r["formatted"].removesuffix("\n") for r in K.format_tokens(e.analyze(docs), ["doc_id"], details=True).collect()}
    assert rows == again and len(rows) == 2


def test_a_sentence_of_delimiters_has_an_empty_line(spark):
    tokens = spark.createDataFrame([(1, 0, 0, " "), (1, 1, 0, "京都"), (1, 1, 1, ""), (1, 1, 2, "東")], "doc_id long, sent_id int, tok_id int, surface string")
    assert [r["segmented"] for r in K.wakati(tokens, ["doc_id"]).orderBy("sent_id").collect()] == ["", "京都 東"]


def test_plugins_by_path():
    class Whole:
        def __init__(self, settings, lookup):
            self.cost = settings.int("cost")

        def candidates(self, lattice, at, mask):
            return [(len(lattice.text.text), 8, 8, self.cost, 0)]

    own("my_plugins", Everything=Whole)
    p = sample.parts({"oovProviderPlugin": [{"class": "my_plugins.Everything", "cost": -30000}], "pathRewritePlugin": []})
    assert [t.surface for t in core.one_sentence(p, "東京に行く").tokens()] == ["東京に行く"]
    for name in ("my_plugins.Missing", "no_such_module.Thing", "Missing"):
        with pytest.raises(ValueError, match="no plugin"):
            sample.parts({"oovProviderPlugin": [{"class": name}]})


def test_settings_in_steps():
    s = Settings().system_dictionary("/s").add_user_dictionary("/a").add_user_dictionary("/b").allow_empty_morpheme(False)
    s = s.add_plugin("oovProviderPlugin", "SimpleOovProvider", oovPOS=["名詞", "普通名詞", "一般", "*", "*", "*"], leftId=8, rightId=8, cost=6000)
    assert s.string("systemDict") == "/s" and s.strings("userDict") == ["/a", "/b"] and s.clear_user_dictionaries().strings("userDict") == []
    assert not assemble(s, sample.system()).allow_empty and len(s.plugins("oovProviderPlugin")) == 1 and not s.clear_plugins("oovProviderPlugin").plugins("oovProviderPlugin")
    assert s.but(systemDict=None).string("systemDict") is None and s.with_anchor(Anchor(["/z"])).anchor.folders == ["/z"] and s.character_definition("x").string("characterDefinitionFile") == "x"
    with pytest.raises(ValueError):
        s.add_plugin("nothing", "x")


def test_files_at_uris(spark, tmp_path):
    (tmp_path / "settings.json").write_text('{"characterDefinitionFile": "char.def", "systemDict": "s.dic"}')
    (tmp_path / "char.def").write_text("0x3042 HIRAGANA\n")
    (tmp_path / "s.dic").write_bytes(binary.write(sample.system()))
    s = Settings.from_file(f"file://{tmp_path}/settings.json", Anchor([f"file://{tmp_path}/none"]))
    assert s.anchor.resolve("char.def") == f"file://{tmp_path}/char.def" and s.anchor.text("char.def").startswith("0x3042") and not s.anchor.exists("nothing")
    e = Engine.open(spark, s.add_plugin("oovProviderPlugin", "SimpleOovProvider", oovPOS=["名詞", "普通名詞", "一般", "*", "*", "*"], leftId=8, rightId=8, cost=6000))
    assert e.lexicon_table().count() == len(sample.system().words)


def test_headers_of_binary_dictionaries(tmp_path, capsys):
    (tmp_path / "s.dic").write_bytes(binary.write(sample.system(), created=0))
    assert main(["header", f"{tmp_path}/s.dic"]) == 0
    out = capsys.readouterr().out
    assert "type: system dictionary" in out and "1970-01-01" in out and "description: sample" in out
    (tmp_path / "bad.dic").write_bytes(b"x" * 500)
    assert main(["header", f"{tmp_path}/bad.dic"]) == 1


def test_progress_and_statistics(spark):
    told = []
    p = Progress(lambda *x: told.append(x))
    d = p.step("build", sample.system, lambda d: len(d.words))
    assert told == p.steps and told[0][:2] == ("build", len(d.words))
    n = statistics(d)
    assert n["words"] == 38 and n["most homographs"] == 2 and n["parts of speech"] == 8 and n["connections"] == 100
    row = K.dictionary_statistics(Engine(spark, sample.parts(users=1)).lexicon_table()).orderBy("dict_id").collect()
    assert (row[0]["n_words"], row[0]["n_indexed"], row[0]["n_headwords"], row[0]["most_homographs"]) == (n["words"], n["indexed words"], n["headwords"], 2) and row[1]["n_words"] == 4


def test_lattice_queries():
    lattice = Lattice(Text.of("東京都", [], PLAIN.table), PLAIN.lookup, PLAIN.providers)
    assert {lattice.surface(x) for x in lattice.ending(3)} == {"東京都", "都", "京都"} and lattice.cheapest(0, 2).place == 5
    extra = Node(0, 3, 8, 8, -30000, -1, ("x", 0, "x", "x", ""), True)
    lattice.insert(extra)
    assert lattice.cheapest(0, 3) is extra and extra.total is not None
    lattice.remove(extra)
    assert extra not in lattice.spanning(0, 3) and lattice.spanning(0, 3)


def test_chains_are_the_nodes_that_they_stand_for():
    text = "some Latin words, 12 of them, " * 8 + "東京都に行く " + "and more of these " * 5
    lattice = Lattice(Text.of(text, [], PLAIN.table), PLAIN.lookup, PLAIN.providers)
    assert lattice.chains
    path = lattice.best()
    class Plain:
        """The provider without its only(), so that no chains are made."""

        def candidates(self, lattice, at, mask):
            return PLAIN.providers[0].candidates(lattice, at, mask)

    other = Lattice(Text.of(text, [], PLAIN.table), PLAIN.lookup, [Plain()])
    assert not other.chains and other.eos.total == lattice.eos.total
    key = lambda x: (x.begin, x.end, x.left, x.right, x.cost, x.place, x.info, x.oov, x.seq)
    assert list(map(key, path)) == list(map(key, other.best()))
    assert [(*key(x), x.total, x.prev and key(x.prev)) for x in lattice.nodes()] == [(*key(x), x.total, x.prev and key(x.prev)) for x in other.nodes()]


def test_prefix_matches_of_long_headwords_and_texts(spark):
    words = ["a" * 40, "ab", "b", "京都", "都"]
    lexicon = spark.createDataFrame([(k, w, 0) for k, w in enumerate(words)], "word_no int, headword string, left_id int")
    texts = ["x" + "a" * 45 + "b" + "京都" * 400, "", None, "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (256, 7):
        got = sorted((r["doc_id"], r["begin"], r["end"], r["word_no"]) for r in K.prefix_matches(df, lexicon, chunk=chunk).collect())
        want = sorted((d, at, at + len(w), k) for d, t in enumerate(texts) for at in range(len(t or "")) for k, w in enumerate(words) if (t or "").startswith(w, at))
        assert got == want and len(got) > 800


def test_a_long_text_is_analysed_sentence_by_sentence(spark):
    import resource

    text = "東京都に行った。" * 60_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = sum(len(s.columns("C", ["surface"])[0]) for s in core.sentences(PLAIN, text))
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024
    assert n == 300_000 and grown < 100 * len(text)
    df = spark.createDataFrame([(1, "京都。" * 30_000)], "doc_id long, text string")
    assert Engine(spark, PLAIN).analyze(df, columns=["surface"]).where(F.col("surface") == "京都").count() == 30_000
