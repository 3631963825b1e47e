import json
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kanasift import sample
from kanasift.operators import analyze as core
from kanasift.operators import oov, paths
from kanasift.operators.lattice import Lattice, NoPath
from kanasift.operators.text import CATEGORIES, CharTable, Text
from kanasift.plans.config import Anchor, Parts, Settings, assemble, register
from kanasift.plans.dictionary import Lookup, dict_of, number_of, word_id
from kanasift.sources import definitions, lexicon

TEST_TABLE = "0x0021..0x002F SYMBOL\n0x0030..0x0039 NUMERIC\n0x0041..0x005A ALPHA\n0x0061..0x007A ALPHA\n0x3041..0x309F HIRAGANA\n0x30A1..0x30FF KATAKANA\n0x30A1 NOOOVBOW\n0x3005 KANJI\n0x3007 KANJI\n0x4E00..0x9FA5 KANJI"
NOUN = ["名詞", "普通名詞", "一般", "*", "*", "*"]


def parts(**more):
    p = sample.parts({"pathRewritePlugin": [], **more})
    p.table = CharTable(definitions.read_categories(TEST_TABLE))
    return p


PLAIN = parts()


def tokens(text, mode="C", p=PLAIN):
    s = core.one_sentence(p, text)
    return s.tokens(mode) if s else []


def surfaces(text, mode="C", p=PLAIN):
    return [t.surface for t in tokens(text, mode, p)]


@pytest.mark.parametrize(("text", "n"), [("", 0), ("ァ", 1), ("京都", 1), ("特a", 1), ("ab", 1), ("特ab", 2), ("京都…", 4), ("…東京都…", 7), ("な。な", 1), ("六三四", 1)])
def test_token_counts(text, n):
    assert len(tokens(text)) == n


def test_dictionaries_and_synonyms():
    assert [tokens(x)[0].dict_id for x in ("京都", "ぴらる", "京")] == [0, 1, -1]
    assert tokens("京都")[0].synonym_group_ids == (1, 5) and tokens("東京府")[0].synonym_group_ids == (1, 3)
    assert tokens("京")[0].is_oov and tokens("京")[0].reading_form == "" and tokens("行っ")[0].dictionary_form == "行く"


def test_offsets_of_expanded_characters():
    assert [(t.begin, t.end) for t in tokens("…")] == [(0, 1), (1, 1), (1, 1)]
    p = parts(allowEmptyMorpheme=False)
    assert [(t.surface, t.begin, t.end) for t in tokens("…", p=p)] == [("…", 0, 1)] * 3
    assert [(t.surface, t.begin, t.end, t.begin_cp) for t in tokens("😀京都")] == [("😀", 0, 2, 0), ("京都", 2, 4, 1)]


def test_modes():
    assert [surfaces("東京都", m) for m in "CAB"] == [["東京都"], ["東京", "都"], ["東京都"]]
    assert len(surfaces("…東京都…", "A")) == 8 and [(t.begin, t.end) for t in tokens("…東京都…", "A")][3:5] == [(1, 3), (3, 4)]
    t = tokens("な。な", "A")
    assert len(t) == 1 and t[0].normalized_form == "アイウ" and (t[0].begin, t[0].end) == (0, 3)
    with pytest.raises(ValueError):
        tokens("a", "D")


def test_sentences():
    split = lambda x: [[t.surface for t in s.tokens()] for s in core.sentences(PLAIN, x)]
    assert list(map(len, split("京都。東京.東京都。"))) == [2, 2, 2] and split("な。なに。") == [["な。な", "に", "。"]]
    assert list(map(len, split("´´"))) == [4] and split("。😀") == [["。"], ["😀"]] and split("") == []
    x = "京都。" * 2730 + "京都"
    assert list(map(len, split(x))) == [2] * 2730 + [1]
    assert [s.begin for s in core.sentences(PLAIN, "京都。㈱。都")] == [0, 3, 5]


@pytest.mark.parametrize(("text", "cost"), [("東京都に行った", 10248), ("東京都", 4719)])
def test_path_costs(text, cost):
    assert core.one_sentence(PLAIN, text).path_cost() == cost


def brute(p, text):
    """The least cost over all paths of the lattice, by trying them."""
    lattice = Lattice(Text.of(text, p.inputs, p.table), p.lookup, p.providers)
    n, m = len(lattice.text.text), p.lookup.matrix
    nodes = [x for e in lattice.ends for x in e if x is not lattice.bos]
    best = {}

    def go(at, right):
        if (at, right) not in best:
            best[at, right] = m.cost(right, 0) if at == n else min((m.cost(right, x.left) + x.cost + go(x.end, x.right) for x in nodes if x.begin == at), default=10**9)
        return best[at, right]

    return go(0, 0), lattice.eos.total


@settings(max_examples=150, deadline=None)
@given(st.text("東京都に行くった府アイウ1特a。…", min_size=1, max_size=12))
def test_cheapest_path_and_whole_text(text):
    by_hand, found = brute(PLAIN, text)
    assert by_hand == found
    assert "".join(surfaces(text)) == text == "".join(surfaces(text, "A"))
    assert [t.surface for s in core.sentences(PLAIN, text) for t in s.tokens()] and "".join(t.surface for s in core.sentences(PLAIN, text) for t in s.tokens()) == text


def test_lattice_json():
    x = core.lattice_json(PLAIN, "東京都")
    assert len(x["lattice"]) == 7 and x["lattice"][0]["begin"] is None and x["lattice"][-1]["end"] is None and json.dumps(x)
    assert [r["wordId"] for r in x["bestPath"]] == [6] and len(core.lattice_text(PLAIN, "東京都")) == 7
    assert core.lattice_json(PLAIN, "")["lattice"] == []


# Candidates of words that no dictionary has


def candidates(provider, text, mask=0, at=0, table=TEST_TABLE):
    lattice = Lattice.__new__(Lattice)
    lattice.text = Text.of(text, [], CharTable(definitions.read_categories(table)))
    lattice.ends = [[] for _ in range(len(text) + 1)]
    return [e for e, *_ in provider.candidates(lattice, at, mask)]


@pytest.mark.parametrize(
    ("always", "group", "length", "no_words", "with_words"),
    [(0, 0, 0, [], []), (1, 0, 0, [], []), (0, 1, 0, [3], []), (1, 1, 0, [3], [3]), (0, 0, 2, [1, 2], []), (1, 0, 2, [1, 2], [1, 2]), (0, 1, 2, [3, 1, 2], []), (1, 1, 2, [3, 1, 2], [3, 1, 2]), (0, 0, 6, [1, 2, 3], []), (0, 1, 6, [3, 1, 2], [])],
)
def test_templates(always, group, length, no_words, with_words):
    p = oov.Templates({CATEGORIES["KANJI"]: (bool(always), bool(group), length)}, {CATEGORIES["KANJI"]: [(1, 1, 100, 0)]})
    assert candidates(p, "漢字漢あ") == no_words and candidates(p, "漢字漢あ", mask=1) == with_words and candidates(p, "あ") == []
    two = oov.Templates({CATEGORIES["KANJI"]: (True, True, 0)}, {CATEGORIES["KANJI"]: [(1, 1, 1, 0), (2, 2, 2, 0)]})
    assert candidates(two, "漢字") == [2, 2]
    with pytest.raises(ValueError):
        oov.Templates({}, {CATEGORIES["KANJI"]: []})


def regex_parts(**more):
    r = {"class": "RegexOovProvider", "regex": "[0-9a-z-]+", "leftId": 5, "rightId": 5, "cost": 3500, "pos": ["名詞", "数詞", "*", "*", "*", "*"], **more}
    return sample.parts({"pathRewritePlugin": [], "oovProviderPlugin": [r, *sample.SETTINGS["oovProviderPlugin"]]})


def test_pattern():
    p = regex_parts()
    assert surfaces("XAG-2F", p=p) == ["XAG-2F"] and surfaces("京都XAG-2F東京", p=p) == ["京都", "XAG-2F", "東京"]
    t = tokens("２つXＡＧ-2F", p=p)
    assert len(t) == 3 and t[2].normalized_form == "xag-2f" and t[2].reading_form == "" and t[2].is_oov
    assert len(tokens("0123456789" * 30, p=regex_parts(maxLength=500, cost=-9000))) == 1
    text = ":@asda"
    at = {"regex": "@[a-z0-9]{4,}", "cost": 500}
    assert len(tokens(text, p=regex_parts(**at))) == 3 and len(tokens(text, p=regex_parts(**at, boundaries="relaxed"))) == 2
    for bad in ({"boundaries": "odd"}, {"pos": ["a", "b", "c", "d", "e", "f"]}, {"cost": 40000}, {"regex": None}):
        with pytest.raises(ValueError):
            regex_parts(**bad)
    assert regex_parts(pos=["a", "b", "c", "d", "e", "f"], userPOS="allow").lookup.pos_id(["a", "b", "c", "d", "e", "f"]) >= 8


def test_own_plugins():
    class Whole:
        def candidates(self, lattice, at, mask):
            yield (len(lattice.text.text), 8, 8, -30000, 0)

    class Upper:
        def edits(self, text, table):
            return [(k, k + 1, "都") for k, c in enumerate(text) if c == "X"]

    class Drop:
        def rewrite(self, lattice, path):
            return path[:1]

    for name, x in (("my.WholePlugin", Whole), ("Upper", Upper), ("Drop", Drop)):
        register(name, lambda s, k, x=x: x())
    p = sample.parts({"inputTextPlugin": [{"class": "Upper"}], "pathRewritePlugin": [{"class": "Drop"}]})
    assert [t.normalized_form for t in tokens("X東", p=p)] == ["都"]
    assert surfaces("東京", p=sample.parts({"oovProviderPlugin": [{"class": "my.Whole"}], "pathRewritePlugin": []})) == ["東京"]
    with pytest.raises(ValueError):
        sample.parts({"oovProviderPlugin": []})
    with pytest.raises(ValueError):
        sample.parts({"oovProviderPlugin": [{"class": "Nothing"}]})


def test_no_candidate_is_an_error():
    class Never:
        def candidates(self, lattice, at, mask):
            return ()

    p = Parts(Lookup.of(sample.system()), PLAIN.table, [], [Never()], [])
    with pytest.raises(NoPath):
        core.one_sentence(p, "ん")


# Rewriting of paths

NUMBERS = sample.parts({"inputTextPlugin": []}, 0)


@pytest.mark.parametrize(("text", "n", "first"), [("123円20銭", 4, "123"), ("080-121", 3, "080"), ("一二三万二千円", 2, "1232000"), ("二百百", 3, "二"), ("六三四", 1, "六三四"), ("1.20.3", 5, "1"), ("652...", 4, "652"), ("2,00,000,000円", 8, "2"), (",", 1, ","), ("652,,,", 4, "652"), ("256,5.50389", 3, "256"), ("256,550.389", 1, "256550.389"), ("1.002", 1, "1.002"), (".002", 2, "."), ("22.", 2, "22"), ("22.節", 3, "22")])
def test_join_numbers(text, n, first):
    t = tokens(text, p=NUMBERS)
    assert (len(t), t[0].normalized_form) == (n, first)


def test_join_numbers_without_normalization():
    for flag, want in ((True, "3"), (False, "三")):
        p = sample.parts({"pathRewritePlugin": [{"class": "JoinNumeric", "enableNormalize": flag}]}, 0)
        t = tokens("猫三匹", p=p)
        assert len(t) == 3 and t[1].normalized_form == want
    t = tokens("一二三", p=NUMBERS)[0]
    assert (t.dict_id, t.is_oov, t.pos[1], t.reading_form) == (-1, False, "数詞", "イチニサン")


def katakana(min_length):
    p = sample.parts({"pathRewritePlugin": [{"class": "JoinKatakanaOov", "oovPOS": NOUN, "minLength": min_length}]}, 0)
    p.table = CharTable(definitions.read_categories(TEST_TABLE))
    return p


def test_join_katakana():
    assert surfaces("アイアイウ", p=katakana(0)) == ["アイ", "アイウ"] and surfaces("アイアイウ", p=katakana(1)) == ["アイ", "アイウ"]
    assert surfaces("アイアイウ", p=katakana(3)) == ["アイアイウ"] and not tokens("アイアイウ", p=katakana(3))[0].is_oov
    assert surfaces("アイウアイアイウ", p=katakana(3)) == ["アイウアイアイウ"] and tokens("アイウアイアイウ", p=katakana(3))[0].is_oov
    assert surfaces("ァアイアイウ", p=katakana(3)) == ["ァ", "アイアイウ"]
    with pytest.raises(ValueError):
        katakana(-1)
    assert paths.JoinKatakana(4).min_length == 1


# Dictionaries


def test_word_ids():
    assert word_id(3, 7) == 0x30000007 and dict_of(0xE0000001) == 14 and number_of(0xE0000001) == 1
    for bad in ((16, 0), (0, 1 << 28), (-1, 0)):
        with pytest.raises(ValueError):
            word_id(*bad)


def test_user_dictionaries():
    two = sample.parts({"pathRewritePlugin": []}, 2)
    assert tokens("ぴさる", p=two)[0].dict_id == 2 and tokens("かぼす", p=two)[0].pos[5] == "カボス" and tokens("すだち", p=two)[0].pos[5] == "スダチ"
    many = assemble(Settings({**sample.SETTINGS, "pathRewritePlugin": []}), sample.system(), [sample.user()] * 13 + [sample.user(True)])
    assert tokens("ぴさる", p=many)[0].dict_id == 14
    with pytest.raises(ValueError):
        assemble(Settings(sample.SETTINGS), sample.system(), [sample.user()] * 15)
    turned = assemble(Settings({**sample.SETTINGS, "pathRewritePlugin": []}), sample.system(), [sample.user(True), sample.user()])
    assert surfaces("東京府", "A", turned) == ["東京", "府"] and surfaces("東京府", "A") == ["東京", "府"]
    assert len(sample.parts(users=0).lookup.pos) == 8 and len(two.lookup.pos) == 10
    assert two.lookup.find("京都", 3, "キョウト") == 3 and two.lookup.find("府", 4, "フ") == word_id(1, 1) and two.lookup.find("x", 0, "") == -1


def row(head, *, left=0, right=0, cost=0, kind="A", a="*", b="*", s="*", form="*", surface=None, reading=None, more=()):
    return ",".join([head, str(left), str(right), str(cost), surface or head, "名詞", "普通名詞", "一般", "*", "*", "*", reading or head, head, form, kind, a, b, s, *more])


def build(*rows, size=3):
    return lexicon.build_system(["\n".join(rows)], definitions.read_matrix(f"{size} {size}"))


def test_build():
    d = build(row("東京都", kind="B", a='"東京,名詞,普通名詞,一般,*,*,*,東京/2"'.replace("東京/2", "東京") if False else "1/2", s="1/2"), row("東京", more=["3/4"]), row("都", left=-1, right=-1))
    assert d.words[0].a_split == (1, 2) and d.words[1].synonyms == (3, 4) and d.words[2].headword is None
    inline = build(row("東京都", kind="B", a='"東京,名詞,普通名詞,一般,*,*,*,東京/都,名詞,普通名詞,一般,*,*,*,都"'), row("東京"), row("都"))
    assert inline.words[0].a_split == (1, 2)
    assert build(row(r"\u{20BB7}あ")).words[0].headword == "\U00020bb7あ"
    x = lexicon.build_user(sample.system(), [row("新都", kind="B", a="5/U1") + "\n" + row("都x", left=8, right=8)])
    assert x.words[0].a_split == (5, word_id(1, 1)) and x.pos[:8] == sample.system().pos


@pytest.mark.parametrize("bad", [row("a", left=3), row("a", right=5), row("a", kind="D"), row("a", kind="A", a="0/0"), row("a", kind="C", a="9/0"), row("a", kind="C", a="x"), row(""), "a,1,1,1", row("a", form="7"), row("x" * 32768), row("a", kind="C", a="/".join(["0"] * 128)), row("a", cost=99999), "\n".join([row("a")] * 256), row("a") + "\n\n" + row("b"), 'a"b,' + row("c"), '"a"x,' + row("c"), '"' + row("c")])
def test_build_errors(bad):
    with pytest.raises(ValueError):
        build(bad)


def test_dump_round_trip():
    d = sample.system()
    again = lexicon.build_system(["\n".join(lexicon.dump(d))], d.matrix)
    plain = [(w.headword, w.cost, w.a_split, w.b_split, w.dictionary_form, w.normalized, w.pos_id) for w in d.words]
    assert [(w.headword, w.cost, w.a_split, w.b_split, w.dictionary_form, w.normalized, w.pos_id) for w in again.words] == plain
    assert lexicon.dump(sample.user())[2].endswith("B,5/U1,*,5/U1")
    assert lexicon.records('a,"b ""c""\nd",e\n') == [(2, ["a", 'b "c"\nd', "e"])]


# Settings


def test_settings(tmp_path):
    s = Settings.parse('{"a": 1, "b": "x", "c": ["p", "q"], "d": [[1, 2]], "e": true, "path": "/data"}')
    assert (s.int("a"), s.string("b"), s.strings("c"), s.int_lists("d"), s.bool("e"), s.int("none"), s.string("none"), s.int("none", 4), s.ints("none")) == (1, "x", ["p", "q"], [[1, 2]], True, 0, None, 4, [])
    assert s.anchor.folders == ["/data"]
    for bad in (lambda: s.int("b"), lambda: s.string("a"), lambda: s.ints("c"), lambda: s.int("e"), lambda: Settings.parse("[]"), lambda: Settings.parse("{")):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "x").write_text("here")
    a = Anchor(["/nowhere", str(tmp_path)])
    assert a.text("x") == "here" and a.exists("x") and not a.exists("y") and a.resolve("/abs") == "/abs" and a.then(Anchor(["/z"])).folders[-1] == "/z"


def test_fallback():
    left = Settings({"a": 1, "inputTextPlugin": [{"class": "P", "x": 1}]})
    right = Settings({"a": 2, "b": 3, "inputTextPlugin": [{"class": "Q"}, {"class": "P", "x": 5, "y": 6}]})
    m = left.with_fallback(right)
    assert m.values["a"] == 1 and m.values["b"] == 3 and m.values["inputTextPlugin"] == [{"class": "P", "x": 1, "y": 6}]
    assert Settings({}).with_fallback(right).values["inputTextPlugin"] == right.values["inputTextPlugin"]
    with pytest.raises(ValueError):
        Settings({"inputTextPlugin": [{}]}).plugins("inputTextPlugin")


def test_inhibited_connections():
    p = sample.parts({"pathRewritePlugin": [], "editConnectionCostPlugin": [{"class": "InhibitConnection", "inhibitedPair": [[8, 3]]}]}, 0)
    assert p.lookup.matrix.cost(8, 3) == 32767 and sample.system().matrix.cost(8, 3) != 32767
    assert core.one_sentence(p, "東京都に行った").path_cost() > 10248


def test_all_masks_are_kept():
    from kanasift.operators.lattice import length_bit

    assert [length_bit(n) for n in (0, 1, 2, 63)] == [0, 1, 2, 1 << 62] and length_bit(64) == length_bit(100) == 1 << 63
    assert len({length_bit(a) | length_bit(b) for a, b in product(range(1, 5), repeat=2)}) == 10
