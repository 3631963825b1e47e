"""A sample dictionary of forty words, small enough to read, on which queries and tests run."""

from __future__ import annotations

from functools import lru_cache

from .plans.config import Parts, Settings, assemble
from .plans.dictionary import Dictionary
from .sources import definitions, lexicon

# Words (headword, left id, right id, cost, surface, part of speech, reading, normalized form,
# dictionary form, split type, splits in units A and B, structure, synonyms).
WORDS = """\
た,1,1,8729,た,助動詞,*,*,*,助動詞-タ,終止形-一般,タ,た,*,A,*,*,*,*
に,2,2,11406,に,助詞,接続助詞,*,*,*,*,ニ,に,*,A,*,*,*,*
に,3,3,4481,に,助詞,格助詞,*,*,*,*,ニ,に,*,A,*,*,*,*
京都,6,6,5293,京都,名詞,固有名詞,地名,一般,*,*,キョウト,京都,*,A,*,*,*,1/5
東,7,7,4675,東,名詞,普通名詞,一般,*,*,*,ヒガシ,東,*,A,*,*,*,*
東京,6,6,2816,東京,名詞,固有名詞,地名,一般,*,*,トウキョウ,東京,*,A,*,*,*,*
東京都,6,8,5320,東京都,名詞,固有名詞,地名,一般,*,*,トウキョウト,東京都,*,B,5/9,*,5/9,*
行く,4,4,5105,行く,動詞,非自立可能,*,*,五段-カ行,終止形-一般,イク,行く,*,A,*,*,*,*
行っ,5,5,5122,行っ,動詞,非自立可能,*,*,五段-カ行,連用形-促音便,イッ,行く,7,A,*,*,*,*
都,8,8,2914,都,名詞,普通名詞,一般,*,*,*,ト,都,*,A,*,*,*,*
アイ,7,7,4675,アイ,名詞,普通名詞,一般,*,*,*,アイ,アイ,*,A,*,*,*,*
アイウ,7,7,4675,アイウ,名詞,普通名詞,一般,*,*,*,アイウ,アイウ,*,A,*,*,*,*
アイアイウ,6,6,32766,アイウ,名詞,固有名詞,地名,一般,*,*,アイアイウ,アイアイウ,*,A,*,*,*,*
0,9,9,2478,0,名詞,数詞,*,*,*,*,ゼロ,0,*,A,*,*,*,*
1,9,9,2478,1,名詞,数詞,*,*,*,*,イチ,1,*,A,*,*,*,*
2,9,9,2478,2,名詞,数詞,*,*,*,*,ニ,2,*,A,*,*,*,*
3,9,9,2478,3,名詞,数詞,*,*,*,*,サン,3,*,A,*,*,*,*
4,9,9,2478,4,名詞,数詞,*,*,*,*,ヨン,4,*,A,*,*,*,*
5,9,9,2478,5,名詞,数詞,*,*,*,*,ゴ,5,*,A,*,*,*,*
6,9,9,2478,6,名詞,数詞,*,*,*,*,ロク,6,*,A,*,*,*,*
7,9,9,2478,7,名詞,数詞,*,*,*,*,ナナ,7,*,A,*,*,*,*
8,9,9,2478,8,名詞,数詞,*,*,*,*,ハチ,8,*,A,*,*,*,*
9,9,9,2478,9,名詞,数詞,*,*,*,*,キュウ,9,*,A,*,*,*,*
〇,9,9,2478,〇,名詞,数詞,*,*,*,*,ゼロ,〇,*,A,*,*,*,*
一,9,9,2478,一,名詞,数詞,*,*,*,*,イチ,一,*,A,*,*,*,*
二,9,9,2478,二,名詞,数詞,*,*,*,*,ニ,二,*,A,*,*,*,*
三,9,9,2478,三,名詞,数詞,*,*,*,*,サン,三,*,A,*,*,*,*
四,9,9,2478,四,名詞,数詞,*,*,*,*,ヨン,四,*,A,*,*,*,*
五,9,9,2478,五,名詞,数詞,*,*,*,*,ゴ,五,*,A,*,*,*,*
六,9,9,2478,六,名詞,数詞,*,*,*,*,ロク,六,*,A,*,*,*,*
七,9,9,2478,七,名詞,数詞,*,*,*,*,ナナ,七,*,A,*,*,*,*
八,9,9,2478,八,名詞,数詞,*,*,*,*,ハチ,八,*,A,*,*,*,*
九,9,9,2478,九,名詞,数詞,*,*,*,*,キュウ,九,*,A,*,*,*,*
六三四,6,6,0,六三四,名詞,固有名詞,地名,一般,*,*,ムサシ,六三四,*,A,*,*,*,*
いく,4,4,5105,いく,動詞,非自立可能,*,*,五段-カ行,終止形-一般,イク,行く,*,A,*,*,*,*
いっ,5,5,5122,いっ,動詞,非自立可能,*,*,五段-カ行,連用形-促音便,イッ,行く,34,A,*,*,*,*
特a,8,8,2914,特a,名詞,普通名詞,一般,*,*,*,トクエー,特a,*,A,*,*,*,*
な。な,8,8,2914,な。な,名詞,普通名詞,一般,*,*,*,ナナ,な。な,*,C,11,11,*,*
"""
USER_WORDS = """\
ぴらる,8,8,-32768,ぴらる,名詞,普通名詞,一般,*,*,*,ピラル,ぴらる,*,A,*,*,*,*
府,8,8,2914,府,名詞,普通名詞,一般,*,*,*,フ,府,*,A,*,*,*,*
東京府,6,6,2816,東京府,名詞,固有名詞,地名,一般,*,*,トウキョウフ,東京府,*,B,5/U1,*,5/U1,1/3
すだち,6,6,2816,すだち,被子植物門,双子葉植物綱,ムクロジ目,ミカン科,ミカン属,スダチ,スダチ,すだち,*,A,*,*,*,*
"""
USER_WORDS_2 = """\
ぴさる,8,8,-32768,ぴさる,名詞,普通名詞,一般,*,*,*,ピサル,ぴさる,*,A,*,*,*,*
かぼす,6,6,2816,かぼす,被子植物門,双子葉植物綱,ムクロジ目,ミカン科,ミカン属,カボス,カボス,かぼす,*,A,*,*,*,*
"""
# Connection costs, a row for each left id.
COSTS = [
    [0, 863, 2124, 1032, 591, -162, -79, 887, 447, -535],
    [-3689, -3361, -7643, -3267, 809, -1098, 4606, 4269, 4567, 1635],
    [-1959, 2457, 811, 840, 903, -958, 517, 2037, 1392, -193],
    [-2288, 1741, 487, 792, -1474, -3429, 126, 437, 605, -547],
    [-2809, -3584, -6743, -2869, -2805, -407, 3422, 5642, 6382, 2165],
    [-509, -3665, -3882, -572, -1036, -54, 2570, 3319, 4059, 882],
    [101, 2933, 2198, -2004, 4392, 4017, 569, 475, -390, 852],
    [-852, 2079, 1180, -3084, 2010, 1570, 746, 2341, 2051, 1393],
    [-522, 3354, 2037, -2542, 3071, 2631, -352, 2847, 1134, 1256],
    [-975, 2498, 1690, -1523, 3023, 3139, 2562, 3962, 418, -2490],
]


def matrix_text() -> str:
    return "10 10\n" + "\n".join(f"{i} {j} {c}" for i, row in enumerate(COSTS) for j, c in enumerate(row))


#: Settings of the sample engine; ids of the out-of-vocabulary words fit the sample matrix.
SETTINGS = {
    "inputTextPlugin": [
        {"class": "DefaultInputText"},
        {"class": "ProlongedSoundMark", "prolongedSoundMarks": ["ー", "-", "⁓", "〜", "〰"], "replacementSymbol": "ー"},
        {"class": "IgnoreYomigana", "leftBrackets": ["(", "（"], "rightBrackets": [")", "）"], "maxYomiganaLength": 4},
    ],
    "oovProviderPlugin": [{"class": "SimpleOovProvider", "oovPOS": ["名詞", "普通名詞", "一般", "*", "*", "*"], "leftId": 8, "rightId": 8, "cost": 6000}],
    "pathRewritePlugin": [{"class": "JoinNumeric", "enableNormalize": True}],
}


@lru_cache(maxsize=1)
def system() -> Dictionary:
    return lexicon.build_system([WORDS], definitions.read_matrix(matrix_text()), "sample")


@lru_cache(maxsize=2)
def user(second: bool = False) -> Dictionary:
    return lexicon.build_user(system(), [USER_WORDS_2 if second else USER_WORDS])


def parts(settings: dict | None = None, users: int = 1) -> Parts:
    """An engine's parts over the sample dictionaries, with settings laid over the sample's."""
    return assemble(Settings({**SETTINGS, **(settings or {})}), system(), [user(), user(True)][:users])
