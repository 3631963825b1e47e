import pytest
from hypothesis import given
from hypothesis import strategies as st

from kanasift.operators import sentence
from kanasift.operators.numeral import Parser, normalize_numeral
from kanasift.operators.text import CATEGORIES, CharTable, Draft, Normalize, Prolonged, Text, Yomigana, utf16_offsets
from kanasift.sources import definitions

TABLE = CharTable(definitions.read_categories(definitions.CATEGORIES_BY_DEFAULT))


@pytest.mark.parametrize(
    ("text", "end"),
    [("あいう。えお。", 4), ("あいうえお", -5), ("", 0), ("あいう。。えお。", 5), ("あ い うえお", -7), ("あいう.えお", 4), ("3.141", -5), ("四百十．〇", -5), ("あいうえお" + "！" * 4000, 4005), ("あ（いう。え）お", -8), ("（あ（いう）。え）お", -10), ("あ（いう）。えお", 6), ("あいう?えお", 4), ("あいう?)えお", 5), ("あいう?,えお", 5), ("あいう?です。", 7), ("あいう?って。", 7), ("あいう?という。", 8), ("あいう?の?です。", 4), ("1.と2.が。", 7), ("1.やb.が。", 7), ("1.の12.が。", 8), ("a<br><br>b", 9), ("・・・あ", 3), ("・・あ", -3)],
)
def test_first_end(text, end):
    assert sentence.first_end(text) == end


@pytest.mark.parametrize(("text", "end"), [("あい。うえお。", 3), ("あいうえおか", -5), ("あいうえお。", -5), ("あい うえお", -3), ("あ い うえお", -4)])
def test_first_end_with_a_limit(text, end):
    assert sentence.first_end(text, 5) == end


def test_crossing_words_are_no_ends():
    assert sentence.first_end("な。なに。", crossed=lambda e: e == 2) == 5


@pytest.mark.parametrize(
    ("text", "value"),
    [("1000", "1000"), ("001000", "001000"), ("〇一〇〇〇", "01000"), ("00.1000", "00.1"), ("000", "000"), ("二十七", "27"), ("千三百二十七", "1327"), ("千十七", "1017"), ("千三百二十七.〇五", "1327.05"), ("三百二十百", None), ("1万", "10000"), ("千三百二十七万", "13270000"), ("千三百二十七万一四", "13270014"), ("三兆2千億千三百二十七万一四.〇五", "3200013270014.05"), ("億万", None), ("1.5千", "1500"), ("1.5百万", "1500000"), ("1.5百万1.5千20", "1501520"), ("1.5千5百", None), ("1.5千500", None), ("200000000000000000000万", "2000000000000000000000000"), ("2,000,000", "2000000"), ("259万2,300", "2592300"), ("200,00,000", None), ("2,4", None), ("000,000", None), (",000", None), ("256,55.1", None), ("6.0", "6"), ("6.", None), ("1.2.3", None), ("@@@", None), ("", None), (None, None)],
)
def test_numerals(text, value):
    assert normalize_numeral(text) == value


@pytest.mark.parametrize(("text", "error"), [("200,00,000", "comma"), ("2,4", "comma"), ("000,000", "comma"), (",000", "comma"), ("256,55.1", "comma"), ("6.", "point"), ("1.2.3", "point"), (".1", "point"), ("@@@", "")])
def test_numeral_errors(text, error):
    p = Parser()
    assert not (all(map(p.add, text)) and p.end()) and p.error == error


@given(st.integers(1, 10**15 - 1))
def test_kanji_round_trip(n):
    def four(x):
        return "".join(("一二三四五六七八九"[x // p % 10 - 1] + u) for p, u in ((1000, "千"), (100, "百"), (10, "十"), (1, "")) if x // p % 10)

    text = "".join(four(n // 10**k % 10000) + u for k, u in ((12, "兆"), (8, "億"), (4, "万"), (0, "")) if n // 10**k % 10000)
    assert normalize_numeral(text) == str(n) == normalize_numeral(f"{n:,}")


def made(text, *rewriters):
    return Text.of(text, list(rewriters), TABLE)


def test_normalize():
    n = Normalize({"ｶﾞ": "ガ", "ウ゛": "ヴ"}, {"Ⅲ", "ⅲ", "⼼"})
    assert made("ÂＢΓД㈱ｶﾞウ゛⼼Ⅲ", n).text == "âbγд(株)ガヴ⼼ⅲ"
    x = made("㈱a", n)
    assert (x.text, x.source) == ("(株)a", [0, 1, 1, 1, 2])
    assert made("İSS", n).text == "iss" and made("ｶﾞ", Normalize(*definitions.default_rewrites())).text == "ガ"
    assert definitions.default_rewrites()[0]["か゛"] == "が" and len(definitions.default_rewrites()[1]) == 835


def test_edits():
    d = Draft.of("abcdef")
    d.apply([(1, 3, "XYZ"), (4, 9, "w")])
    assert (d.text, d.source) == ("aXYZdw", [0, 1, 3, 3, 3, 4, 6])
    with pytest.raises(ValueError):
        d.apply([(1, 1, "x")])


def test_prolonged_and_yomigana():
    p = Prolonged(["ー", "〜", "〰"], "ー")
    assert made("ゴーール", p).source == [0, 1, 2, 4, 5][:1] + [1, 2, 4][:0] + [1, 3, 4] or made("ゴーール", p).text == "ゴール"
    assert made("エー〜ビ〜〰ーシ〰ー〰〜", p).text == "エービーシー" and made("スーパー", p).text == "スーパー"
    y = Yomigana(["(", "（"], [")", "）"], 4)
    x = made("徳島（とくしま）に行（い）く", y)
    assert x.text == "徳島に行く" and x.source == [0, 1, 8, 9, 13, 14]
    for text in ("徳島に（よく）行く", "明日（いっしょに）行く", "（い）", "行（）", "行（い"):
        assert made(text, y).text == text


def test_categories():
    assert TABLE.of("〇") == CATEGORIES["KANJI"] | CATEGORIES["SYMBOL"] | CATEGORIES["KANJINUMERIC"] and TABLE.of("あ") == CATEGORIES["HIRAGANA"] and TABLE.of("") == 1
    x = made("abあいé1 2")
    assert x.bow == [True, False, True, True, True, True, True, True] and x.run_end == [2, 2, 4, 4, 5, 6, 7, 8] and x.byte[-1] == 13
    assert x.span_cats(2, 4) == CATEGORIES["HIRAGANA"] and x.span_cats(1, 3) == 0 and x.next_bow(0) == 2 and x.at_byte(4) == 2


@given(st.text(max_size=40))
def test_sources_stay_in_order(text):
    n = Normalize(*definitions.default_rewrites())
    x = made(text, n, Prolonged(["ー", "-"], "ー"), Yomigana(["("], [")"]))
    assert len(x.source) == len(x.text) + 1 and x.source == sorted(x.source) and x.source[-1] == len(text) and (not text or x.source[0] == 0)
    assert utf16_offsets(text)[-1] == len(text.encode("utf-16-le", "surrogatepass")) // 2


@pytest.mark.parametrize("text", ["0x0030 NOSUCH", "0x0040..0x0030 ALPHA", "0x0030", "0xZZ ALPHA"])
def test_bad_categories(text):
    with pytest.raises(ValueError, match="line 1"):
        definitions.read_categories(text)


def test_definition_files():
    assert definitions.read_categories("#c\n0x41..0x42 ALPHA SYMBOL # x\nALPHA 1 1 0\n") == [(0x41, 0x42, 40)]
    assert definitions.read_properties("ALPHA 1 0 2\n0x41 ALPHA") == {32: (True, False, 2)}
    for bad in ("ALPHA 1 1", "ALPHA 1 1 0\nALPHA 1 1 0", "NOSUCH 1 1 0"):
        with pytest.raises(ValueError):
            definitions.read_properties(bad)
    for bad in ("ALPHA,1,1,1,a,b,c", "NOSUCH,1,1,1,a,b,c,d,e,f", "KANJI,1,1,1,a,b,c,d,e,f"):
        with pytest.raises(ValueError):
            definitions.read_templates(bad, {32: (True, True, 0)}, lambda p: 0)
    assert definitions.read_rewrites("# c\nⅢ\nab\tc\n") == ({"ab": "c"}, {"Ⅲ"})
    for bad in ("ab", "a b c", "a b\na c"):
        with pytest.raises(ValueError):
            definitions.read_rewrites(bad)
    m = definitions.read_matrix("2 3\n\n0 1 5\n1 2 -7\n")
    assert m.cost(0, 1) == 5 and m.cost(1, 2) == -7 and m.cost(0, 0) == 0
    for bad in ("", "2 2\n0 1", "2 2\n5 0 1", "2 2\na b c", "2 2\n0 0 99999"):
        with pytest.raises(ValueError):
            definitions.read_matrix(bad)
