"""Column and DataFrame functions over tokens: part-of-speech patterns and sets, formatting, frequencies, numerals."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numeral import normalize_numeral as _normalize

#: Words of a lexicon, or their units, that are sent to all tasks; more are met by a shuffle.
SENT = 200_000


def pos_matches(*patterns: tuple[str | None, ...], pos: str | Column = "pos") -> Column:
    """Whether a part of speech fits one of some patterns: parts from the first on, None standing for any."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    for p in patterns:
        if not 1 <= len(p) <= 6:
            raise ValueError("a pattern has one to six parts")
    if not patterns:
        return F.lit(False)
    fits = [reduce(lambda a, b: a & b, [F.get(pos, F.lit(k)) == v for k, v in enumerate(p) if v is not None], F.lit(True)) for p in patterns]
    return reduce(or_, fits)


class PosSet:
    """Numbers of parts of speech of one engine, with the operations of sets; test() is a constant filter on pos_id."""

    def __init__(self, engine, ids):
        self.engine, self.ids = engine, frozenset(ids)

    @classmethod
    def where(cls, engine, predicate) -> PosSet:
        """The parts of speech that a predicate of the six-part tuple holds for: asked once each, not once a token."""
        return cls(engine, (k for k, p in enumerate(engine.parts.lookup.pos) if predicate(p)))

    @classmethod
    def matching(cls, engine, *patterns) -> PosSet:
        return cls.where(engine, lambda pos: any(all(v is None or v == x for v, x in zip(p, pos, strict=False)) for p in patterns))

    def _same(self, other: PosSet) -> frozenset:
        if other.engine is not self.engine:
            raise ValueError("the sets are of different dictionaries")
        return other.ids

    def union(self, other: PosSet) -> PosSet:
        return PosSet(self.engine, self.ids | self._same(other))

    def intersection(self, other: PosSet) -> PosSet:
        return PosSet(self.engine, self.ids & self._same(other))

    def invert(self) -> PosSet:
        return PosSet(self.engine, set(range(self.engine.pos_size())) - self.ids)

    def __iter__(self):
        return (self.engine.pos_string(k) for k in sorted(self.ids))

    def test(self, pos_id: str | Column = "pos_id") -> Column:
        return (F.col(pos_id) if isinstance(pos_id, str) else pos_id).isin(*sorted(self.ids)) if self.ids else F.lit(False)


def _in_order(value: Column, order: list[str]) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("__v")))), lambda x: x["__v"])


def token_line(details: bool = False) -> Column:
    """A token as a line: surface, part of speech, normalized form; with details also dictionary form, reading, dictionary, synonyms and (OOV)."""
    parts = [F.col("surface"), F.concat_ws(",", "pos"), F.col("normalized_form")]
    if details:
        synonyms = F.concat(F.lit("["), F.concat_ws(", ", F.transform("synonym_group_ids", lambda x: x.cast("string"))), F.lit("]"))
        parts += [F.col("dictionary_form"), F.col("reading_form"), F.col("dict_id").cast("string"), synonyms]
    line = F.concat_ws("\t", *parts)
    return F.when(F.col("is_oov"), F.concat(line, F.lit("\t(OOV)"))).otherwise(line) if details else line


def format_tokens(tokens: DataFrame, by: list[str], details: bool = False, end: str = "\nEOS\n") -> DataFrame:
    """A row for each sentence (columns by and sent_id): its tokens as lines, and an end mark."""
    lines = tokens.groupBy(*by, "sent_id").agg(_in_order(token_line(details), ["tok_id"]).alias("l"))
    return lines.select(*by, "sent_id", F.concat(F.array_join("l", "\n"), F.lit(end)).alias("formatted"))


def wakati(tokens: DataFrame, by: list[str], delimiter: str = " ") -> DataFrame:
    """A row for each sentence: its surfaces with a delimiter between; empty ones and those equal to it are left out.

    A sentence of nothing else has an empty line.
    """
    kept = F.when((F.col("surface") != "") & (F.col("surface") != delimiter), F.struct("tok_id", "surface"))
    words = tokens.groupBy(*by, "sent_id").agg(F.array_sort(F.collect_list(kept)).alias("w"))
    return words.select(*by, "sent_id", F.array_join("w.surface", delimiter).alias("segmented"))


def suppress_empty(tokens: DataFrame, by: list[str]) -> DataFrame:
    """tokens with the offsets of those of no width, but the first, replaced by those of the one before them."""
    w = Window.partitionBy(*by, "sent_id").orderBy("tok_id").rowsBetween(Window.unboundedPreceding, 0)
    own = (F.col("begin") < F.col("end")) | (F.col("tok_id") == 0)
    out = {c: F.last(F.when(own, F.col(c)), ignorenulls=True).over(w) for c in ("begin", "end", "begin_cp", "end_cp")}
    return tokens.select(*[out[c].alias(c) if c in out else F.col(c) for c in tokens.columns])


def pos_frequency(tokens: DataFrame, parts: int = 1) -> DataFrame:
    """Tokens by the first parts of their part of speech."""
    return tokens.groupBy(F.concat_ws(",", F.slice("pos", 1, parts)).alias("pos")).agg(F.count("*").alias("n"))


def oov_rate(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Tokens and out-of-vocabulary tokens by some columns."""
    return tokens.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("is_oov").cast("long")).alias("n_oov"))


def top_terms(tokens: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k most frequent normalized forms for each value of some columns, ties in order of form."""
    n = tokens.groupBy(*by, "normalized_form").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "normalized_form"))
    return n.withColumn("rank", rank).where(F.col("rank") <= k)


@F.pandas_udf(T.StringType())
def normalize_numeral(numeral: pd.Series) -> pd.Series:
    """The plain decimal form of numerals in Arabic and kanji digits; null where it is none."""
    return numeral.map(_normalize, na_action="ignore")


def category_positions(df: DataFrame, ranges: DataFrame, text: str = "text") -> DataFrame:
    """A row for each character of each text: position, code point and category bits, by built-in functions only.

    ranges (lo, hi, cats) is a definition file's table, bounded by it, and is broadcast. Characters are met by
    distinct code points, so the range join is as large as the alphabet and not as the texts.
    """
    chars = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "")).alias("at", "ch")).where("ch != ''")
    code = F.when(F.octet_length("ch") > 0, F.conv(F.hex(F.encode("ch", "utf-32")), 16, 10).cast("int"))
    chars = chars.withColumn("cp", code)
    known = chars.select("cp").distinct().join(F.broadcast(ranges), (F.col("cp") >= F.col("lo")) & (F.col("cp") <= F.col("hi")), "left")
    known = known.groupBy("cp").agg(F.coalesce(F.bit_or("cats"), F.lit(1)).alias("cats"))
    # There are 1.1 million code points at most.
    return chars.join(F.broadcast(known), "cp")


def word_starts(positions: DataFrame, by: list[str]) -> DataFrame:
    """positions with can_bow: a letter of ALPHA, GREEK or CYRILLIC begins a word only where the category changes."""
    before = F.lag("cats").over(Window.partitionBy(*by).orderBy("at"))
    spaced = F.col("cats").bitwiseAND(F.lit(32 | 512 | 1024)) != 0
    return positions.withColumn("__before", before).withColumn("can_bow", F.col("__before").isNull() | ~spaced | (F.col("cats").bitwiseAND(F.col("__before")) == 0)).drop("__before")


def prefix_matches(df: DataFrame, lexicon: DataFrame, text: str = "text", chunk: int = 256) -> DataFrame:
    """A row for each lexicon word that begins at each position of each text: df's other columns, the word's, begin and end.

    A text is cut into chunks that overlap by the longest headword, so rows that are dealt out stay as short as
    words. Only lengths that some headword with the same first character has are looked up. Spark does not know how
    large a lexicon is, so its words are counted: up to SENT they are sent to all tasks, and nothing of the texts is
    moved to where a frequent headword's are. Lengths are as many as first characters and always sent.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    words = lexicon.where("headword is not null and left_id >= 0")
    n, longest = words.agg(F.count("*"), F.coalesce(F.max(F.length("headword")), F.lit(0))).first()
    first = words.groupBy(F.substring("headword", 1, 1).alias("__first")).agg(F.collect_set(F.length("headword")).alias("__sizes"))
    chars = df.select(*others, F.split(F.coalesce(F.col(text), F.lit("")), "").alias("__chars"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("__chars") - 1, F.lit(0)), F.lit(chunk))
    cut = F.transform(starts, lambda k: F.struct(k.alias("at"), F.array_join(F.slice("__chars", k + 1, chunk + max(longest - 1, 0)), "").alias("part")))
    parts = chars.select(*others, F.explode(cut).alias("__c"))
    at = parts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(chunk), F.length("__c.part")))).alias("__k")).where(F.length("__c.part") > 0)
    window = at.select(*others, (F.col("__c.at") + F.col("__k") - 1).alias("begin"), F.substring("__c.part", F.col("__k"), F.lit(longest)).alias("__w"))
    asked = window.withColumn("__first", F.substring("__w", 1, 1)).join(F.broadcast(first), "__first").select(*others, "begin", "__w", F.explode("__sizes").alias("__size")).where(F.col("__size") <= F.length("__w"))
    asked = asked.select(*others, "begin", (F.col("begin") + F.col("__size")).alias("end"), F.substring("__w", F.lit(1), F.col("__size")).alias("headword"))
    return asked.join(F.broadcast(words) if n <= SENT else words, "headword")


def dictionary_statistics(lexicon: DataFrame) -> DataFrame:
    """A row for each dictionary: its words, those that can be found, different headwords, words with splits, and the largest homograph."""
    found = F.col("headword").isNotNull() & (F.col("left_id") >= 0)
    same = lexicon.where(found).groupBy("dict_id", "headword").agg(F.count("*").alias("n")).groupBy("dict_id").agg(F.count("*").alias("n_headwords"), F.max("n").alias("most_homographs"))
    each = lexicon.groupBy("dict_id").agg(F.count("*").alias("n_words"), F.count(F.when(found, 1)).alias("n_indexed"), F.count(F.when((F.size("a_split") > 0) | (F.size("b_split") > 0), 1)).alias("n_split"))
    return each.join(same, "dict_id", "left").select("dict_id", "n_words", "n_indexed", F.coalesce("n_headwords", F.lit(0)).alias("n_headwords"), "n_split", F.coalesce("most_homographs", F.lit(0)).alias("most_homographs"))


def inhibit(connection: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """connection with some (left, right) pairs inhibited: an edit of the table by a join."""
    spark = connection.sparkSession
    edits = spark.createDataFrame([(a, b, 32767) for a, b in pairs], "left smallint, right smallint, edited smallint")
    return connection.join(F.broadcast(edits), ["left", "right"], "left").select("left", "right", F.coalesce("edited", "cost").alias("cost"))


def dictionary_forms(lexicon: DataFrame) -> DataFrame:
    """lexicon with dictionary_form: the surface of the word of the same dictionary that it names, or its own."""
    forms = lexicon.select(F.col("dict_id").alias("d"), F.col("word_no").alias("n"), F.col("surface").alias("form"))
    out = lexicon.join(forms, (F.col("dict_id") == F.col("d")) & (F.col("dic_form_word_id") == F.col("n")), "left")
    return out.withColumn("dictionary_form", F.coalesce("form", "surface")).drop("d", "n", "form")
