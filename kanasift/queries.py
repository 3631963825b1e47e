"""The queries over the driver's tables, one or more an operator, and their SQL.

Japanese texts are derived from the keys of orders, each with the key in it so that no two are alike, the same way in
Spark and in SQL; Latin texts are the documents. The SQL finds results in another way: cheapest paths by
enumerating all segmentations, and normalized forms, offsets and sentences from how the texts are made.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as K
from . import sample
from .engine import Engine
from .plans.config import Parts
from .sources import definitions

#: What derived texts begin with; the order's key and one of the ends follow.
TEXTS = ["東京都に行った", "京都に行った", "東に行く", "東京に行く", "都に行った", "東京都", "京都に東京都に行く", "アイアイウに行く", "いくに行った", "六三四に行く", "二三に東京都", "東京に京都に都に行った"]
ENDS = ["に行く", "東京都", "都に行った", "京都", "東に"]
USER_TEXTS = ["東京府に行った", "ぴらるに行く", "すだちに行く", "東京府", "府に東京都", "すだちに東京府に行った"]
#: Texts of which no path is without a connection that the edited costs forbid only there.
FREE_TEXTS = [t for t in TEXTS if "都に" not in t or "京都" in t]

_NOUN = ["名詞", "普通名詞", "一般", "*", "*", "*"]
_PLAIN = {"pathRewritePlugin": []}
_LATIN = """
DEFAULT,8,8,3000,名詞,普通名詞,一般,*,*,*
SPACE,8,8,3000,名詞,普通名詞,一般,*,*,*
SYMBOL,8,8,3000,名詞,普通名詞,一般,*,*,*
NUMERIC,8,8,3000,名詞,普通名詞,一般,*,*,*
ALPHA,8,8,3000,名詞,普通名詞,一般,*,*,*
"""


@lru_cache(maxsize=16)
def parts(kind: str) -> Parts:
    """The parts of an engine that queries share: plain (no path rewriting), full, user, and some with one operator only."""
    if kind == "plain":
        return sample.parts(_PLAIN, 0)
    if kind == "user":
        return sample.parts(_PLAIN, 1)
    if kind == "inhibited":
        return sample.parts({**_PLAIN, "editConnectionCostPlugin": [{"class": "InhibitConnection", "inhibitedPair": [[8, 3]]}]}, 0)
    if kind == "regex":
        pattern = {"class": "RegexOovProvider", "regex": "[0-9a-z-]+", "oovPOS": _NOUN, "leftId": 8, "rightId": 8, "cost": 3500}
        return sample.parts({**_PLAIN, "oovProviderPlugin": [pattern, *sample.SETTINGS["oovProviderPlugin"]]}, 0)
    if kind == "numbers":
        return sample.parts({}, 0)
    if kind == "katakana":
        return sample.parts({"pathRewritePlugin": [{"class": "JoinKatakanaOov", "oovPOS": _NOUN, "minLength": 3}]}, 0)
    if kind == "lower":
        return sample.parts({**_PLAIN, "inputTextPlugin": sample.SETTINGS["inputTextPlugin"][:1]}, 0)
    if kind in ("prolonged", "yomigana"):
        return sample.parts({**_PLAIN, "inputTextPlugin": [sample.SETTINGS["inputTextPlugin"][1 + (kind == "yomigana")]]}, 0)
    if kind == "runs":
        from .operators import oov
        from .operators.text import CharTable
        from .plans.dictionary import Lookup

        few = sample.lexicon.build_system(["\n".join(sample.WORDS.split("\n")[:13])], sample.system().matrix)
        lookup = Lookup.of(few)
        properties = definitions.read_properties(definitions.CATEGORIES_BY_DEFAULT)
        templates = definitions.read_templates(_LATIN, properties, lookup.pos_id)
        return Parts(lookup, CharTable(definitions.read_categories(definitions.CATEGORIES_BY_DEFAULT)), [], [oov.Templates(properties, templates)], [], True, len(few.pos))
    raise ValueError(kind)


def engine(spark: SparkSession, kind: str) -> Engine:
    return Engine(spark, parts(kind))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that are one task's where only keys are moved, and texts are made of them behind.
SHARE = 1 << 19


def _size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has less than a split for each of them: one row group is one task's, however many splits
    its file has, and analysis costs far more than moving so few texts. A larger df is left as it is read."""
    spark = df.sparkSession
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if _size(df) < n * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df


def _keys(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of orders, the first a key, in as many tasks as its size asks for: its files are small for the analysis
    that is made of them, so tasks by splits, or one a core, would each take longer the larger the table is."""
    orders, cores = _table(spark, sf_dir, "orders"), spark.sparkContext.defaultParallelism
    # As many for each core, so that none waits for others.
    n = cores * max(1, -(-_size(orders) // (SHARE * cores)))
    return orders.select(*columns).repartition(n, columns[0])


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """doc_id and text of each order: an expression of its key, that Spark and DuckDB understand alike."""
    return _keys(spark, sf_dir, "o_orderkey", "o_custkey").selectExpr("o_orderkey as doc_id", f"{sql} as text")


def _pick(texts, n: str) -> str:
    """The text of number n modulo how many there are, as SQL."""
    return f"case {n} % {len(texts)} " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(texts)) + " end"


def _text_of(texts, ends=ENDS) -> str:
    return f"concat({_pick(texts, 'o_orderkey')}, cast(o_orderkey as varchar(20)), {_pick(ends, 'o_custkey')})"


def _derived(spark: SparkSession, sf_dir: str, texts) -> DataFrame:
    """doc_id and text of each order: a beginning by its key, the key, an end by its customer."""
    return _made(spark, sf_dir, _text_of(texts))


def _sql_texts(texts) -> str:
    return f"texts(k, t) as (select o_orderkey, {_text_of(texts)} from orders), jp as (select k as doc_id, k, t from texts)"


def _sql_lexicon(kind: str) -> str:
    """The lexicon and the connection costs as VALUES, with each word's form, part of speech and splits."""
    lookup = parts(kind).lookup
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({p}, {text(w.headword)}, {w.left}, {w.right}, {w.cost}, {text(','.join(lookup.pos[w.pos_id]))}, {text(w.normalized)}, {text(lookup.dictionary_form(p))}, {text(w.reading)}, {[lookup.place(i) for i in w.a_split] or [p]}, {[lookup.place(i) for i in w.b_split] or [p]}, {list(w.synonyms) or '[]::int[]'}, {text(w.surface)})" for p, w in enumerate(lookup.words) if w.headword)
    m = lookup.matrix
    costs = ", ".join(f"({i // m.right_size}, {i % m.right_size}, {c})" for i, c in enumerate(m.costs))
    return f"lex(id, head, l, r, c, pos, norm, form, reading, a, b, syn, surf) as (values {rows}), conn(l, r, c) as (values {costs})"


def _sql_raw() -> str:
    """The rows of the sample's CSV as they stand there, dictionary and number first."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [(d, n, *line.split(",")) for d, lines in enumerate((sample.WORDS, sample.USER_WORDS)) for n, line in enumerate(lines.strip().split("\n"))]
    values = ", ".join(f"({d}, {n}, {text(r[0])}, {r[3]}, {text(r[4])}, {text(r[13])}, {text(r[15])}, {text(r[16])})" for d, n, *r in rows)
    return f"raw(dict_id, word_no, headword, cost, surface, form, a, b) as (values {values})"


def _sql_best(texts, kind: str = "plain") -> str:
    """The cheapest segmentation of each text among all, and of each order its tokens in order.

    Where no word begins, a character is an unknown word; none of these texts has one on its cheapest path.
    """
    return f"""with recursive {_sql_texts(texts)}, {_sql_lexicon(kind)},
places as (select k, t, unnest(range(length(t))) as at_ from texts),
hits as (select p.k, p.at_, x.id, length(x.head) as n, x.l, x.r, x.c from places p join lex x on substr(p.t, cast(p.at_ + 1 as integer), length(x.head)) = x.head),
cand as (select * from hits union all select k, at_, -1, 1, 8, 8, 6000 from places p where not exists (select 1 from hits h where h.k = p.k and h.at_ = p.at_)),
paths(k, at_, rid, cost, ids, left_) as (
  select k, 0::bigint, 0, 0, []::int[], length(t) from texts
  union all
  select p.k, p.at_ + x.n, x.r, p.cost + c.c + x.c, list_append(p.ids, x.id), p.left_ - x.n
  from paths p join cand x on x.k = p.k and x.at_ = p.at_
  join conn c on c.l = p.rid and c.r = x.l and c.c <> 32767 where p.left_ > 0
),
ends as (select p.k, p.cost + c.c as cost, p.ids from paths p join conn c on c.l = p.rid and c.r = 0 and c.c <> 32767 where p.left_ = 0),
best as (select k, min(cost) as cost, arg_min(ids, cost) as ids from ends group by k),
tok as (select k, unnest(range(len(ids))) as i, unnest(ids) as id from best),
toks as (select jp.doc_id, tok.k, cast(tok.i as integer) as tok_id, lex.* from jp join tok using (k) join lex using (id))
"""


# Characters and normalization, on documents


def char_category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = engine(spark, "plain").category_table()
    # A text's characters are counted in place, so what is dealt out is a row for each code point.
    chars = _documents(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch != ''").groupBy("ch").agg(F.count("*").alias("n"))
    code = F.conv(F.hex(F.encode("ch", "utf-32")), 16, 10).cast("int")
    cats = chars.withColumn("cp", code).join(F.broadcast(ranges), F.col("cp").between(F.col("lo"), F.col("hi")), "left").groupBy("cp", "n").agg(F.coalesce(F.bit_or("cats"), F.lit(1)).alias("cats"))
    return cats.groupBy("cats").agg(F.sum("n").alias("n_chars"), F.count("*").alias("n_code_points"))


def category_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "runs").normalize(_documents(spark, sf_dir), keep=["doc_id"], columns=["n_runs"])


def bow_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "runs").normalize(_documents(spark, sf_dir), keep=["doc_id"], columns=["n_bow"])


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "lower").normalize(_documents(spark, sf_dir), keep=["doc_id"], columns=["modified"])


#: The key in full-width digits, full-width letters, half-width kana with its mark, and a sign that becomes three characters.
WIDE = "concat(translate(cast(o_orderkey as varchar(20)), '0123456789', '０１２３４５６７８９'), 'ＡＢｃÉ', 'ｶﾞ', '㈱', cast(o_custkey as varchar(20)))"


def _offsets() -> F.Column:
    return F.concat_ws(",", F.transform("mod2orig", lambda x: x.cast("string"))).alias("offsets")


def normalize_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "lower").normalize(_made(spark, sf_dir, WIDE), columns=["modified", "mod2orig"]).select("doc_id", "modified", _offsets())


#: Runs of marks, as long as the key says, between letters.
MARKS = "concat('エ', repeat('ー', cast(o_orderkey % 4 as int)), 'ビ', repeat('〜〰', cast(o_custkey % 3 as int)), 'シ', cast(o_orderkey as varchar(20)), repeat('-', cast(o_orderkey % 3 as int)))"


def collapse_prolonged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "prolonged").normalize(_made(spark, sf_dir, MARKS), columns=["modified", "mod2orig"]).select("doc_id", "modified", _offsets())


#: A reading in brackets of one to six kana, of which the longer ones are none, behind a kanji and behind the key.
BRACKETS = "concat('徳島（', substring('とくしまけん', 1, cast(o_orderkey % 6 + 1 as int)), '）に', cast(o_orderkey as varchar(20)), '(ここ)行(', substring('イッテ', 1, cast(o_custkey % 4 as int)), ')く')"


def strip_yomigana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "yomigana").normalize(_made(spark, sf_dir, BRACKETS), columns=["modified"])


# Sentences


#: Sentences of which a text is made: with brackets, with several stops, with a word across a stop, with and without an end.
SENTENCES = [f"concat({_pick(TEXTS, 'o_orderkey')}, '。')", "concat('京都（東。', cast(o_orderkey as varchar(20)), '）に行く。')", "concat(cast(o_orderkey as varchar(20)), '都！？')", "'な。なに。'", f"concat({_pick(TEXTS, 'o_custkey')}, cast(o_orderkey as varchar(20)))"]


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _made(spark, sf_dir, f"concat({', '.join(SENTENCES)})")
    return engine(spark, "plain").sentences(texts, columns=["sent_id", "sent_begin", "original"]).select("doc_id", "sent_id", "sent_begin", F.col("original").alias("sentence"))


def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark, "plain").sentences(_documents(spark, sf_dir), keep=["doc_id"], columns=["original"])
    return out.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("original")).alias("n_chars"))


# Lookup and paths


def lexicon_prefix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = engine(spark, "plain").lexicon_table().select("word_no", "headword", "left_id", "dict_id")
    return K.prefix_matches(_derived(spark, sf_dir, TEXTS), lexicon).select("doc_id", "begin", "end", "word_no")


def best_path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "plain").sentences(_derived(spark, sf_dir, TEXTS), cost=True).select("doc_id", "path_cost")


def inhibited_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "inhibited").sentences(_derived(spark, sf_dir, FREE_TEXTS), cost=True).select("doc_id", "path_cost")


def connection_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, "plain")
    return K.inhibit(e.connection_table(), [(8, 3), (0, 7)]).groupBy("left").agg(F.sum(F.col("cost").cast("long")).alias("total"), F.count(F.when(F.col("cost") == 32767, 1)).alias("inhibited"))


_SHOWN = ["tok_id", "surface", "normalized_form", "dictionary_form", "reading_form", "pos", "begin", "end"]


def _tokens(spark: SparkSession, sf_dir: str, texts, kind: str = "plain", mode: str = "C", columns=None) -> DataFrame:
    return engine(spark, kind).analyze(_derived(spark, sf_dir, texts), mode=mode, columns=columns)


def _shown(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", *_SHOWN[:5], F.concat_ws(",", "pos").alias("pos"), "begin", "end")


def _named(e: Engine, tokens: DataFrame) -> DataFrame:
    """tokens with pos, found by pos_id."""
    return tokens.join(F.broadcast(e.pos_table()), "pos_id")


def tokens_mode_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_tokens(spark, sf_dir, TEXTS, columns=_SHOWN))


def tokens_mode_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_tokens(spark, sf_dir, TEXTS, mode="A", columns=_SHOWN))


def tokens_mode_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_tokens(spark, sf_dir, TEXTS, mode="B", columns=_SHOWN))


def resplit_stored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, "plain")
    # Parts of speech go along by their numbers: there are few of them, and six strings a token are most of it.
    columns = ["sent_id", "word_id", "pos_id", *(c for c in _SHOWN if c != "pos")]
    return _shown(_named(e, e.resplit(e.analyze(_derived(spark, sf_dir, TEXTS), columns=columns), "A")))


def user_dictionary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(spark, sf_dir, USER_TEXTS, "user")
    return tokens.select("doc_id", "tok_id", "surface", F.concat_ws(",", "pos").alias("pos"), "dict_id")


def user_dictionary_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_tokens(spark, sf_dir, USER_TEXTS, "user", "A", _SHOWN))


def estimated_user_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "user").lexicon_table().where("dict_id = 1").select("headword", F.col("cost").cast("int").alias("cost"))


def lattice_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "plain").lattice(_derived(spark, sf_dir, TEXTS), columns=["n_nodes", "n_best"])


def analyze_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine(spark, "plain").register("analyze", columns=["tok_id", "surface", "normalized_form"])
    _derived(spark, sf_dir, TEXTS).createOrReplaceTempView("kanasift_texts")
    return spark.sql("select d.doc_id, t.tok_id, t.surface, t.normalized_form from kanasift_texts d, lateral analyze(d.text, 'C') t")


# Out-of-vocabulary words


def oov_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = engine(spark, "plain").analyze(_documents(spark, sf_dir), columns=["is_oov"], keep=["doc_id"], sentences=False)
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count(F.when(F.col("is_oov"), 1)).alias("n_oov"))


def oov_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = engine(spark, "runs").analyze(_documents(spark, sf_dir), columns=["surface"], keep=["doc_id"], sentences=False)
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.length("surface")).alias("n_chars"))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("京都xag-"), F.col("o_orderkey").cast("string"), F.lit("東京"))
    return _keys(spark, sf_dir, "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), code.alias("text"))


def oov_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = engine(spark, "regex").analyze(_codes(spark, sf_dir), columns=["tok_id", "surface", "is_oov"])
    return tokens.select("doc_id", "tok_id", "surface", "is_oov")


# Numerals and katakana


def _kanji(n: F.Column) -> F.Column:
    """A number below 100 million in kanji digits and units, units of zero left out."""
    digit = lambda x: F.element_at(F.array(*map(F.lit, "〇一二三四五六七八九")), x.cast("int") + 1)

    def four(x):
        out = [F.when(F.floor(x / p) % 10 > 0, F.concat(digit(F.floor(x / p) % 10), F.lit(u))).otherwise("") for p, u in ((1000, "千"), (100, "百"), (10, "十"))]
        return F.concat(*out, F.when(x % 10 > 0, digit(x % 10)).otherwise(""))

    high = F.floor(n / 10000)
    return F.when(n == 0, "〇").otherwise(F.concat(F.when(high > 0, F.concat(four(high), F.lit("万"))).otherwise(""), four(n % 10000)))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir, "o_orderkey")


def numeral_kanji(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", K.normalize_numeral(_kanji(F.col("o_orderkey"))).alias("value"))


def numeral_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", K.normalize_numeral(F.format_number(F.col("o_orderkey") * 997 + 1000, 0)).alias("value"))


def numeral_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit("."), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("千"))
    return _orders(spark, sf_dir).select("o_orderkey", K.normalize_numeral(text).alias("value"))


def join_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.concat(_kanji(F.col("o_orderkey")), F.lit("円")).alias("text"))
    return engine(spark, "numbers").analyze(rows, columns=["tok_id", "normalized_form", "is_oov", "dict_id"])


#: Katakana of which no dictionary has the whole, between other words.
KATAKANA = f"concat({_pick(['東に', '', '京都'], 'o_custkey')}, repeat('カ', cast(o_orderkey % 4 + 1 as int)), {_pick(['', 'アイ', 'アイウ', 'キ'], 'o_custkey')}, cast(o_orderkey as varchar(20)))"


def join_katakana(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = engine(spark, "katakana").analyze(_made(spark, sf_dir, KATAKANA), columns=["surface", "is_oov"])
    return tokens.where(F.col("surface").rlike("^[ァ-ヺ]+$")).select("doc_id", "surface", "is_oov")


# Parts of speech, sets, formats


def _pos_counts(spark: SparkSession, sf_dir: str, chosen) -> DataFrame:
    e = engine(spark, "plain")
    tokens = e.analyze(_derived(spark, sf_dir, TEXTS), columns=["pos_id", "pos"])
    return tokens.where(chosen(e)).groupBy(F.concat_ws(",", "pos").alias("pos")).agg(F.count("*").alias("n"))


def pos_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pos_counts(spark, sf_dir, lambda e: K.pos_matches(("名詞",), (None, "格助詞")))


def pos_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pos_counts(spark, sf_dir, lambda e: K.PosSet.matching(e, ("動詞",)).union(K.PosSet.matching(e, ("助動詞",))).test())


def pos_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pos_counts(spark, sf_dir, lambda e: K.PosSet.matching(e, ("名詞",)).intersection(K.PosSet.where(e, lambda p: p[2] == "地名")).test())


def pos_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pos_counts(spark, sf_dir, lambda e: K.PosSet.matching(e, ("名詞",)).invert().test())


def synonym_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(spark, sf_dir, TEXTS, columns=["synonym_group_ids"])
    return tokens.select(F.explode("synonym_group_ids").alias("group_id")).groupBy("group_id").agg(F.count("*").alias("n"))


def wakati(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.wakati(_tokens(spark, sf_dir, TEXTS, columns=["sent_id", "tok_id", "surface"]), ["doc_id"]).select("doc_id", "segmented")


def wakati_in_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "plain").format(_derived(spark, sf_dir, TEXTS), style="wakati").select("doc_id", F.col("formatted").alias("segmented"))


def dictionary_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dictionary_statistics(engine(spark, "user").lexicon_table())


def format_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["sent_id", "tok_id", "surface", "pos", "normalized_form", "dictionary_form", "reading_form", "is_oov", "dict_id", "synonym_group_ids"]
    return K.format_tokens(_tokens(spark, sf_dir, TEXTS, columns=columns), ["doc_id"], details=True).select("doc_id", "formatted")


#: Signs that become three characters each, two of them without width.
DOTTED = "concat(repeat('…', cast(o_orderkey % 3 as int)), '京都', repeat('…', cast(o_custkey % 4 as int)), cast(o_orderkey as varchar(20)))"


def empty_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["sent_id", "tok_id", "begin", "end", "begin_cp", "end_cp"]
    tokens = K.suppress_empty(engine(spark, "plain").analyze(_made(spark, sf_dir, DOTTED), columns=columns), ["doc_id"])
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("begin")).alias("width"))


def pos_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.pos_frequency(_tokens(spark, sf_dir, TEXTS, columns=["pos"]))


def oov_rate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = engine(spark, "plain").analyze(_documents(spark, sf_dir), columns=["is_oov"], keep=["lang"], sentences=False)
    return K.oov_rate(tokens, ["lang"])


def top_terms_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = engine(spark, "runs").analyze(_documents(spark, sf_dir), columns=["normalized_form"], keep=["source"], sentences=False)
    return K.top_terms(tokens.where(F.length("normalized_form") >= 4), ["source"], 5)


def dictionary_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dictionary_forms(engine(spark, "user").lexicon_table()).select("dict_id", "word_no", "surface", "dictionary_form")


def split_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = engine(spark, "plain").lexicon_table()
    units = lexicon.select("word_no", F.posexplode("a_split").alias("at", "unit"))
    return units.join(lexicon.select(F.col("word_no").alias("unit"), F.col("surface").alias("unit_surface")), "unit").select("word_no", F.col("at").cast("int").alias("at"), "unit_surface")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import windowed_counts

    out = windowed_counts(_table(spark, sf_dir, "events"), "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


_HELPERS = {"engine", "parts", "queries", "oracle_sql"}


def queries() -> dict:
    return {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k not in _HELPERS}


def oracle_sql() -> dict[str, str]:
    ranges = ", ".join(f"({lo}, {hi}, {c})" for lo, hi, c in definitions.read_categories(definitions.CATEGORIES_BY_DEFAULT))
    chars = f"""with ranges(lo, hi, c) as (values {ranges}),
    ch as (select doc_id, unnest(range(length(text))) as i, unnest(string_split(text, '')) as x from documents where length(text) > 0),
    cp as (select x, unicode(x) as u from (select distinct x from ch)),
    cats as (select x, coalesce(bit_or(c), 1) as c from cp left join ranges on u between lo and hi group by x),
    seq as (select doc_id, i, ch.x, c, lag(c) over (partition by doc_id order by i) as p from ch join cats on cats.x = ch.x)
    """
    best, user = _sql_best(TEXTS), _sql_best(USER_TEXTS, "user")
    inhibited = _sql_best(FREE_TEXTS, "inhibited")
    lex = _sql_lexicon("plain")
    shown = "doc_id, tok_id, head as surface, norm as normalized_form, form as dictionary_form, reading as reading_form, pos, cast(b_ as integer) as begin, cast(e_ as integer) as \"end\""

    def units(base: str, column: str) -> str:
        """Tokens as their units, with offsets summed up."""
        return base + f""", parts_ as (select doc_id, tok_id as t, generate_subscripts({column}, 1) as n, unnest({column}) as uid from toks),
        rows_ as (select p.doc_id, p.t, p.n, x.* from parts_ p join lex x on x.id = p.uid),
        off as (select *, cast(row_number() over w - 1 as integer) as tok_id, sum(length(head)) over w as e_ from rows_ window w as (partition by doc_id order by t, n))
        select {shown.replace('cast(b_', 'cast(e_ - length(head)')} from off"""

    def pos_count(where: str) -> str:
        return best + f"select pos, count(*) as n from toks where {where} group by pos"

    raw = f"with {_sql_raw()} "
    pieces = ", ".join(f"({k}, {x})" for k, x in enumerate(SENTENCES))
    return {
        "char_category_histogram": chars + "select c as cats, count(*) as n_chars, count(distinct x) as n_code_points from seq group by c",
        "category_runs": chars + "select d.doc_id, count(s.doc_id) filter (s.p is null or s.c & s.p = 0) as n_runs from documents d left join seq s using (doc_id) group by d.doc_id",
        "bow_positions": chars + "select d.doc_id, count(s.doc_id) filter (s.p is null or s.c & 1568 = 0 or s.c & s.p = 0) as n_bow from documents d left join seq s using (doc_id) group by d.doc_id",
        "normalize_text": "select doc_id, lower(text) as modified from documents",
        "normalize_japanese": """with k as (select o_orderkey as doc_id, cast(o_orderkey as varchar) as a, cast(o_custkey as varchar) as b from orders)
            select doc_id, a || 'abcéガ(株)' || b as modified,
                array_to_string(list_concat(range(length(a) + 5), [length(a) + 6, length(a) + 7, length(a) + 7], range(length(a) + 7, length(a) + 8 + length(b))), ',') as offsets from k""",
        "collapse_prolonged": f"""with t as (select o_orderkey as doc_id, {MARKS} as t from orders),
            ch as (select doc_id, length(t) as n, unnest(range(length(t))) as i, unnest(string_split(t, '')) as x from t),
            marked as (select *, x in ('ー', '-', '⁓', '〜', '〰') as m from ch),
            runs as (select *, sum(case when m and before then 0 else 1 end) over (partition by doc_id order by i) as g from (select *, coalesce(lag(m) over (partition by doc_id order by i), false) as before from marked)),
            parts as (select doc_id, n, g, min(i) as i, case when any_value(m) and count(*) > 1 then 'ー' else min(x) end as x from runs group by all)
            select doc_id, string_agg(x, '' order by i) as modified, string_agg(cast(i as varchar), ',' order by i) || ',' || any_value(n) as offsets from parts group by doc_id""",
        "strip_yomigana": f"select o_orderkey as doc_id, regexp_replace({BRACKETS}, '([一-龥])[（(][ぁ-んァ-ヶ]{{1,4}}[）)]', '\\1', 'g') as modified from orders",
        "sentences": f"""with p as (select o_orderkey as doc_id, i, s from orders, lateral (values {pieces}) x(i, s))
            select doc_id, cast(i as integer) as sent_id, cast(sum(length(s)) over (partition by doc_id order by i) - length(s) as integer) as sent_begin, s as sentence from p""",
        "sentence_count": f"""with ch as (select doc_id, length(text) as n, unnest(range(length(text))) as i, unnest(string_split(text, '')) as x from documents where length(text) > 0),
            near as (select *, coalesce(lag(x) over w, '') as p, coalesce(lead(x) over w, '') as f from ch window w as (partition by doc_id order by i)),
            marks as (select *, x in ('!', '?', '。', '！', '？', '♪', '…') or x = '.' and not regexp_matches(p, '^[a-zA-Z0-9]$') and not regexp_matches(f, '^[a-zA-Z0-9,]$') as ends, x in ('!', '?', '.', ',', ')', ']', '}}', '。', '！', '？', '♪', '…') as tail from near),
            stops as (select doc_id, n, i, min(case when not tail then i end) over (partition by doc_id order by i rows between 1 following and unbounded following) as e from marks qualify ends),
            firsts as (select doc_id, n, e, min(i) as i from (select doc_id, n, i, coalesce(e, n) as e from stops) group by all),
            chain as (select *, i - coalesce(lag(e) over (partition by doc_id order by i), 0) >= 4096 as far from firsts),
            seen as (select * from chain qualify not bool_or(far) over (partition by doc_id order by i)),
            ends as (select doc_id, count(*) as k, max(e) as e from seen group by doc_id)
            select d.doc_id, cast(coalesce(k, 0) + case when coalesce(e, 0) < length(d.text) then 1 else 0 end as bigint) as n_sentences, cast(length(d.text) as bigint) as n_chars
            from documents d left join ends using (doc_id) where length(d.text) > 0""",
        "lexicon_prefix_matches": f"with {_sql_texts(TEXTS)}, {lex} select doc_id, cast(p as integer) as begin, cast(p + length(head) as integer) as \"end\", cast(id as integer) as word_no from jp, range(0, 64) r(p) join lex on substr(t, cast(p + 1 as integer), length(head)) = head where p < length(t)",
        "best_path_cost": best + "select doc_id, cast(cost as integer) as path_cost from jp join best using (k)",
        "inhibited_pairs": inhibited + "select doc_id, cast(cost as integer) as path_cost from jp join best using (k)",
        "connection_edits": f"with {lex} select cast(l as smallint) as \"left\", cast(sum(case when (l, r) in ((8, 3), (0, 7)) then 32767 else c end) as bigint) as total, count(*) filter ((l, r) in ((8, 3), (0, 7))) as inhibited from conn group by l",
        "tokens_mode_c": best + f"select {shown} from (select *, sum(length(head)) over (partition by doc_id order by tok_id) - length(head) as b_, sum(length(head)) over (partition by doc_id order by tok_id) as e_ from toks)",
        "tokens_mode_a": units(best, "a"),
        "tokens_mode_b": units(best, "b"),
        "resplit_stored_tokens": units(best, "a"),
        "user_dictionary_tokens": user + f"select doc_id, tok_id, head as surface, pos, cast(id >= {len(sample.system().words)} as integer) as dict_id from toks",
        "user_dictionary_split": units(user, "a"),
        "estimated_user_costs": raw + "select headword, cast(case cost when -32768 then -20 * length(headword) else cost end as integer) as cost from raw where dict_id = 1",
        "lattice_nodes": best + ", reached as (select distinct p.k, p.at_, x.id from paths p join cand x on x.k = p.k and x.at_ = p.at_) select doc_id, n_nodes, cast(len(ids) as bigint) as n_best from jp join best using (k) join (select k, count(*) + 2 as n_nodes from reached group by k) n using (k)",
        "analyze_in_sql": best + "select doc_id, tok_id, head as surface, norm as normalized_form from toks",
        "oov_simple": chars + "select doc_id, count(*) filter (p is null or c & 1568 = 0 or c & p = 0) as n_tokens, count(*) filter ((p is null or c & 1568 = 0 or c & p = 0) and not (unicode(x) between 48 and 57)) as n_oov from seq group by doc_id",
        "oov_templates": chars + "select doc_id, count(*) filter (p is null or c & p = 0) as n_tokens, count(*) as n_chars from seq group by doc_id",
        "oov_regex": "select o_orderkey as doc_id, cast(i as integer) as tok_id, case i when 0 then '京都' when 1 then 'xag-' || o_orderkey else '東京' end as surface, i = 1 as is_oov from orders, range(0, 3) r(i)",
        "numeral_kanji": "select o_orderkey, cast(o_orderkey as varchar) as value from orders",
        "numeral_comma": "select o_orderkey, cast(o_orderkey * 997 + 1000 as varchar) as value from orders",
        "numeral_decimal": "select o_orderkey, cast(o_orderkey * 1000 + (o_orderkey % 100) * 10 as varchar) || case when o_orderkey = 0 then '000' else '' end as value from orders",
        "join_numbers": "select o_orderkey as doc_id, cast(i as integer) as tok_id, case i when 0 then cast(o_orderkey as varchar) else '円' end as normalized_form, i = 1 as is_oov, cast(-1 as integer) as dict_id from orders, range(0, 2) r(i)",
        "join_katakana": f"select o_orderkey as doc_id, regexp_extract({KATAKANA}, '[ァ-ヺ]+') as surface, true as is_oov from orders",
        "pos_filter": pos_count("pos like '名詞,%' or pos like '%,格助詞,%'"),
        "pos_union": pos_count("pos like '動詞,%' or pos like '助動詞,%'"),
        "pos_intersection": pos_count("pos like '名詞,%,地名,%'"),
        "pos_invert": pos_count("pos not like '名詞,%'"),
        "synonym_groups": best + "select cast(g as integer) as group_id, count(*) as n from (select unnest(syn) as g from toks) group by g",
        "wakati": best + "select doc_id, string_agg(head, ' ' order by tok_id) as segmented from toks group by doc_id",
        "wakati_in_one_pass": best + "select doc_id, string_agg(head, ' ' order by tok_id) as segmented from toks group by doc_id",
        "format_tokens": best + "select doc_id, string_agg(concat_ws(chr(9), head, pos, norm, form, reading, '0', '[' || array_to_string(syn, ', ') || ']'), chr(10) order by tok_id) || chr(10) || 'EOS' || chr(10) as formatted from toks group by doc_id",
        "empty_tokens": "select o_orderkey as doc_id, cast(3 * (o_orderkey % 3 + o_custkey % 4) + 1 + length(cast(o_orderkey as varchar)) as bigint) as n, cast(3 * (o_orderkey % 3 + o_custkey % 4) + 2 + length(cast(o_orderkey as varchar)) as bigint) as width from orders",
        "pos_frequency": best + "select split_part(pos, ',', 1) as pos, count(*) as n from toks group by 1",
        "oov_rate_by_lang": chars + "select lang, count(*) filter (p is null or c & 1568 = 0 or c & p = 0) as n, count(*) filter ((p is null or c & 1568 = 0 or c & p = 0) and not (unicode(x) between 48 and 57)) as n_oov from seq join documents using (doc_id) group by lang",
        "top_terms_by_source": chars + ", marked as (select doc_id, i, x, sum(case when p is null or c & p = 0 then 1 else 0 end) over (partition by doc_id order by i) as g from seq), words as (select doc_id, g, string_agg(x, '' order by i) as w from marked group by doc_id, g), n as (select source, w as normalized_form, count(*) as n from words join documents using (doc_id) where length(w) >= 4 group by all) select source, normalized_form, n, cast(rank as integer) as rank from (select *, row_number() over (partition by source order by n desc, normalized_form) as rank from n) where rank <= 5",
        "dictionary_forms": raw + "select w.dict_id, w.word_no, w.surface, coalesce(f.surface, w.surface) as dictionary_form from raw w left join raw f on f.dict_id = w.dict_id and cast(f.word_no as varchar) = w.form",
        "dictionary_statistics": raw + "select dict_id, count(*) as n_words, count(*) as n_indexed, count(distinct headword) as n_headwords, count(*) filter (a <> '*' or b <> '*') as n_split, max(n) as most_homographs from (select *, count(*) over (partition by dict_id, headword) as n from raw) group by dict_id",
        "split_references": raw + "select w.word_no, cast(i as integer) as at, u.surface as unit_surface from (select word_no, unnest(string_split(a, '/')) as unit, unnest(range(len(string_split(a, '/')))) as i from raw where dict_id = 0 and a <> '*') w join raw u on u.dict_id = 0 and cast(u.word_no as varchar) = w.unit",
        "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from events group by all",
    }
