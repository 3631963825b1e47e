"""The engine: documents in, tokens out. Analysis is one Arrow function over partitions, without a shuffle."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import SENT
from .operators import analyze as core
from .plans.config import Parts, Settings, assemble, dictionaries
from .plans.dictionary import Dictionary

#: Columns of tokens, in order. mod2orig (how far behind the token's begin each of its normalized characters and its
#: end come from, in code points) is made when asked for; resplit() cuts exactly by it.
TOKENS = {
    "sent_id": "int", "sent_begin": "int", "tok_id": "int", "begin": "int", "end": "int", "begin_cp": "int", "end_cp": "int",
    "surface": "string", "pos_id": "smallint", "pos": "array<string>", "normalized_form": "string", "dictionary_form": "string", "reading_form": "string",
    "is_oov": "boolean", "dict_id": "int", "word_id": "int", "synonym_group_ids": "array<int>", "cost": "int", "mode": "string",
}
MORE = {"mod2orig": "array<int>"}
SENTENCES = {"sent_id": "int", "sent_begin": "int", "original": "string", "modified": "string", "mod2orig": "array<int>", "path_cost": "int"}
NORMALIZED = {"modified": "string", "mod2orig": "array<int>", "cats": "array<int>", "can_bow": "array<boolean>"}
#: Of normalized texts when asked for: how many of their characters may begin a word, and how many runs there are of
#: characters that each share a category with the one before.
FIGURES = {"n_bow": "bigint", "n_runs": "bigint"}
#: Of lattices: all as JSON, how many nodes there are with both ends, how many on the cheapest path without them.
LATTICE = {"lattice": "string", "n_nodes": "bigint", "n_best": "bigint"}
#: Distinct short texts of a task whose analysis is kept for their repeats.
REMEMBERED = 2000
#: Rows that leave a task at once, and characters and elements of arrays in them; a row that has more leaves by itself.
ROWS, VALUES = 20_000, 1 << 20


class Closed(RuntimeError):
    """The engine has been closed."""


class Sent:
    """An engine's parts in a broadcast, pickled by value so that plugins of a notebook or script can go along."""

    _opened: dict[int, Parts] = {}

    def __init__(self, spark: SparkSession, parts: Parts):
        from pyspark import cloudpickle

        self.broadcast = spark.sparkContext.broadcast(cloudpickle.dumps(parts))
        self.key = id(self.broadcast), hash(self.broadcast.value)

    @property
    def value(self) -> Parts:
        """The parts, opened once a worker."""
        if self.key not in Sent._opened:
            import pickle

            Sent._opened.clear()
            Sent._opened[self.key] = pickle.loads(self.broadcast.value)
        return Sent._opened[self.key]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Engine:
    """Dictionaries and settings opened for a session. close() frees what was sent to tasks; later calls raise Closed."""

    def __init__(self, spark: SparkSession, parts: Parts):
        self.spark, self._parts, self._sent = spark, parts, None

    @classmethod
    def open(cls, spark: SparkSession, settings: Settings, system: Dictionary | None = None, users: list[Dictionary] = ()) -> Engine:
        """An engine over given dictionaries, or over those that settings name."""
        if system is None:
            system, users = dictionaries(spark, settings)
        return cls(spark, assemble(settings, system, list(users)))

    @property
    def parts(self) -> Parts:
        if self._parts is None:
            raise Closed("the engine is closed")
        return self._parts

    def close(self) -> None:
        if self._sent is not None:
            self._sent.broadcast.unpersist()
        self._parts = self._sent = None

    def add_user_dictionary(self, d: Dictionary) -> None:
        parts = self.parts
        parts.lookup.add_user(d, parts.system_pos, lambda k, surface: core.estimate_cost(parts, surface))
        self._sent = None

    def broadcast(self):
        """The parts as sent to tasks: a dictionary, whose size does not depend on the texts."""
        parts = self.parts
        if self._sent is None:
            self._sent = Sent(self.spark, parts)
        return self._sent

    # Tables of the dictionaries

    def pos_table(self) -> DataFrame:
        return self.spark.createDataFrame([(k, list(p)) for k, p in enumerate(self.parts.lookup.pos)], "pos_id smallint, pos array<string>")

    def lexicon_table(self) -> DataFrame:
        from .plans.dictionary import dict_of, number_of
        from .sources.lexicon import LEXICON

        lookup = self.parts.lookup
        ids = lambda x: [i - (1 << 32) if i >> 31 else i for i in x]
        rows = [(dict_of(i), number_of(i), w.headword, w.left, w.right, w.cost, w.surface, len((w.headword or w.surface).encode()), w.pos_id, w.reading, w.normalized, w.dictionary_form, ids(w.a_split), ids(w.b_split), ids(w.structure), list(w.synonyms)) for i, w in zip(lookup.ids, lookup.words, strict=True)]
        return self.spark.createDataFrame(rows, LEXICON)

    def connection_table(self) -> DataFrame:
        m = self.parts.lookup.matrix
        return self.spark.createDataFrame([(i // m.right_size, i % m.right_size, c) for i, c in enumerate(m.costs)], "left smallint, right smallint, cost smallint")

    def category_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.parts.table.ranges, "lo int, hi int, cats int")

    def pos_size(self) -> int:
        return len(self.parts.lookup.pos)

    def pos_string(self, pos_id: int) -> tuple[str, ...]:
        return self.parts.lookup.pos[pos_id]

    # Analysis

    def _over_texts(self, df: DataFrame, text: str, schema: T.StructType, per_text, keep: list[str], on_error: str) -> DataFrame:
        """df's columns `keep` with the rows that per_text(parts, text) gives for each text, as lists of columns; streams do the same."""
        if on_error not in ("raise", "skip", "column"):
            raise ValueError("on_error is raise, skip or column")
        sent = self.broadcast()
        out = T.StructType([*(df.schema[c] for c in keep), *schema.fields, *([T.StructField("error", T.StringType())] if on_error == "column" else [])])
        clash = [f.name for f in out.fields if sum(g.name == f.name for g in out.fields) > 1]
        if clash:
            raise ValueError(f"columns of documents and of the result have the same names: {sorted(set(clash))}")
        width, target = len(schema.fields), _arrow(out)
        wide = [k for k, f in enumerate(schema.fields) if isinstance(f.dataType, (T.StringType, T.ArrayType))]

        def run(batches):
            parts, known = sent.value, {}
            for b in batches:
                # Columns that go along are taken by row number, so their values are never copied through Python; the
                # text is not among them.
                *along, texts = b.columns
                at, columns, errors, held = [], [[] for _ in range(width)], [], 0

                def flush():
                    places = pa.array(at, pa.int64())
                    made = [c.take(places) for c in along] + [pa.array(c, f.type) for c, f in zip(columns, list(target)[len(keep) :], strict=False)]
                    if on_error == "column":
                        made.append(pa.array(errors, pa.string()))
                    for c in (at, errors, *columns):
                        c.clear()
                    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(made, target, strict=True)], schema=target)

                for k in range(b.num_rows):
                    t = texts[k].as_py() or ""
                    short, error = len(t) <= 200, None
                    got = known.get(t) if short else None
                    if got is None:
                        got = per_text(parts, t)
                        if short or on_error != "raise":
                            try:
                                got = list(got)
                            except Exception as e:
                                if on_error == "raise":
                                    raise
                                got, error = ([[[None]] * width], f"{type(e).__name__}: {e}") if on_error == "column" else ([], None)
                            else:
                                if short:
                                    if len(known) > REMEMBERED:
                                        known.clear()
                                    known[t] = got
                    # A long text's sentences leave as they are analysed.
                    for some in got:
                        n = len(some[0])
                        at += [k] * n
                        errors += [error] * n
                        for c, x in zip(columns, some, strict=True):
                            c += x
                        for c in wide:
                            held += sum([len(v) for v in some[c] if v is not None])
                        if len(at) >= ROWS or held >= VALUES:
                            yield flush()
                            held = 0
                if at:
                    yield flush()

        return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, out)

    def analyze(self, df: DataFrame, text: str = "text", mode: str = "C", columns: list[str] | None = None, keep: list[str] | None = None, sentences: bool = True, on_error: str = "raise") -> DataFrame:
        """A row for each token of each text of df, batch or stream, with df's columns keep (all but the text, unless told).

        columns picks the token columns that are made: Catalyst cannot prune them from inside the function. With
        sentences=False a text is one sentence. Null and empty texts have no tokens.
        """
        if mode not in core.MODES:
            raise ValueError(f"no mode {mode}")
        names = columns or list(TOKENS)
        kinds = TOKENS | MORE
        schema = T._parse_datatype_string(", ".join(f"{c} {kinds[c]}" for c in names))

        def per_text(parts, t):
            found = core.sentences(parts, t) if sentences else [s for s in [core.one_sentence(parts, t)] if s]
            for i, s in enumerate(found):
                yield _columns(s, i, mode, names)

        keep = [c for c in df.columns if c != text] if keep is None else keep
        return self._over_texts(df, text, schema, per_text, keep, on_error)

    def sentences(self, df: DataFrame, text: str = "text", keep: list[str] | None = None, on_error: str = "raise", cost: bool = False, columns: list[str] | None = None) -> DataFrame:
        """A row for each sentence of each text: its place, original and normalized form, offsets; with cost, its path's cost.

        columns picks those that are made, as in analyze().
        """
        names = columns or [c for c in SENTENCES if cost or c != "path_cost"]
        cost = "path_cost" in names
        order = ("sent_id", "sent_begin", "original")
        plain = all(c in order for c in names)
        chosen = [order.index(c) for c in names if c in order]
        schema = T._parse_datatype_string(", ".join(f"{c} {SENTENCES[c]}" for c in names))

        def per_text(parts, t):
            if plain:
                # Nothing of a sentence itself is asked for but where it stands.
                whole = core.prepare(parts, t)
                places, made = whole.places, []
                for i, (b, e) in enumerate(core.spans(parts, whole)):
                    made.append((i, places[b], t[places[b] : places[e]]))
                    if len(made) == 256:
                        yield [[x[at] for x in made] for at in chosen]
                        made.clear()
                if made:
                    yield [[x[at] for x in made] for at in chosen]
                return
            if cost:
                found = ((s.text, s.begin, s.path_cost()) for s in core.sentences(parts, t))
            else:
                whole = core.prepare(parts, t)
                found = ((whole.slice(b, e, parts.table), whole.places[b], None) for b, e in core.spans(parts, whole))
            for i, (x, begin, total) in enumerate(found):
                made = {"sent_id": i, "sent_begin": begin, "original": x.original, "modified": x.text, "path_cost": total}
                yield [[x.source if c == "mod2orig" else made[c]] for c in names]

        keep = [c for c in df.columns if c != text] if keep is None else keep
        return self._over_texts(df, text, schema, per_text, keep, on_error)

    def normalize(self, df: DataFrame, text: str = "text", keep: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        """A row for each text: its normalized form, where each of its characters comes from, categories, word starts;
        columns picks some, or figures of FIGURES, for which no arrays leave the task."""
        names = columns or list(NORMALIZED)
        kinds = NORMALIZED | FIGURES
        schema = T._parse_datatype_string(", ".join(f"{c} {kinds[c]}" for c in names))
        make = {"modified": lambda d, x: d.text, "mod2orig": lambda d, x: d.offsets, "cats": lambda d, x: x.categories, "can_bow": lambda d, x: x.begins, "n_bow": lambda d, x: int(x.begins.sum()), "n_runs": lambda d, x: x.n_runs}

        def per_text(parts, t):
            draft = core.prepare(parts, t)
            figures = core.Text(t, draft.text, [], parts.table)
            yield [[make[c](draft, figures)] for c in names]

        keep = [c for c in df.columns if c != text] if keep is None else keep
        return self._over_texts(df, text, schema, per_text, keep, "raise")

    def format(self, df: DataFrame, text: str = "text", mode: str = "C", style="tabular", keep: list[str] | None = None, on_error: str = "raise") -> DataFrame:
        """A row for each sentence of each text: its number and its tokens in a format (see operators.formats), made where they are analysed."""
        from .operators.formats import formatter

        made = formatter(style)

        def per_text(parts, t):
            for i, s in enumerate(core.sentences(parts, t)):
                yield [[i], [made(s.tokens(mode))]]

        keep = [c for c in df.columns if c != text] if keep is None else keep
        return self._over_texts(df, text, T._parse_datatype_string("sent_id int, formatted string"), per_text, keep, on_error)

    def lattice(self, df: DataFrame, text: str = "text", keep: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        """A row for each text: its lattice and paths as JSON; columns picks that or figures of LATTICE, which are taken
        from the lattice itself."""
        import json

        names = columns or ["lattice"]
        schema = T._parse_datatype_string(", ".join(f"{c} {LATTICE[c]}" for c in names))

        def per_text(parts, t):
            s = core.one_sentence(parts, t)
            make = {"lattice": lambda: json.dumps(core.lattice_json(parts, t, s), ensure_ascii=False), "n_nodes": lambda: s.lattice.size() if s else 0, "n_best": lambda: s.lattice.length() if s else 0}
            yield [[make[c]()] for c in names]

        keep = [c for c in df.columns if c != text] if keep is None else keep
        return self._over_texts(df, text, schema, per_text, keep, "raise")

    def resplit(self, tokens: DataFrame, mode: str, by: list[str] | None = None) -> DataFrame:
        """tokens (of mode C) in a finer mode, from the dictionary alone; C gives them back.

        A join with the lexicon: the words of a unit take their spelt lengths in order. With the column mod2orig of
        analyze() they are cut exactly where normalization changed lengths; without it lengths are taken as unchanged.
        by names the columns that tell documents apart, for the new tok_id: all that are no token's, unless told.
        """
        if mode not in core.MODES:
            raise ValueError(f"no mode {mode}")
        if mode == "C":
            return tokens
        lookup = self.parts.lookup
        rows = []
        for place, w in enumerate(lookup.words):
            ids = w.a_split if mode == "A" else w.b_split
            if ids and not (len(ids) == 1 and lookup.place(ids[0]) == place):
                for n, (p, b, e) in enumerate(core.resplit(self.parts, place, 0, mode)):
                    u = lookup.words[p]
                    wid = lookup.ids[p]
                    one = len(ids) == 1
                    rows.append((_signed(lookup.ids[place]), n, None if one else b, None if one else e, u.pos_id, list(lookup.pos[u.pos_id]), u.normalized, lookup.dictionary_form(p), u.reading, wid >> 28, _signed(wid), list(u.synonyms)))
        units = self.spark.createDataFrame(rows, "word_id int, u_n int, u_b int, u_e int, u_pos_id smallint, u_pos array<string>, u_norm string, u_form string, u_read string, u_dict int, u_word int, u_syn array<int>")
        keys = (by or [c for c in tokens.columns if c not in TOKENS and c not in MORE]) + (["sent_id"] if "sent_id" in tokens.columns else [])
        if "tok_id" in tokens.columns:
            from pyspark.sql import Window

            # The token's number becomes that of its first unit among the finer tokens of its sentence. It is found
            # before tokens become units, so that only tokens are moved to their sentences.
            sizes = self.spark.createDataFrame(list(Counter(r[0] for r in rows).items()), "word_id int, __size int")
            before = Window.partitionBy(*keys).orderBy("tok_id").rowsBetween(Window.unboundedPreceding, -1)
            first = F.coalesce(F.sum(F.coalesce("__size", F.lit(1))).over(before), F.lit(0))
            tokens = tokens.join(F.broadcast(sizes), "word_id", "left").withColumn("__first", first).select(*tokens.columns, "__first")
        # As large as the dictionaries. Spark does not know how large that is, and frequent words are to move no tokens.
        x = tokens.join(F.broadcast(units) if len(rows) <= SENT else units, "word_id", "left")
        moved = F.col("u_b").isNotNull()
        if "mod2orig" in tokens.columns:
            exact = lambda c: F.get("mod2orig", F.least(F.col(c), F.size("mod2orig") - 1))
            x = x.withColumn("__b", F.when(moved, exact("u_b"))).withColumn("__e", F.when(moved, exact("u_e")))
            offsets = F.slice("mod2orig", F.least(F.col("u_b"), F.size("mod2orig") - 1) + 1, F.col("u_e") - F.col("u_b") + 1)
            x = x.withColumn("mod2orig", F.when(moved, F.transform(offsets, lambda p: p - F.col("__b"))).otherwise(F.col("mod2orig"))).drop("u_b", "u_e").withColumnsRenamed({"__b": "u_b", "__e": "u_e"})
        # begin and end count UTF-16 units.
        wide = lambda n: (F.octet_length(F.encode(F.substring("surface", F.lit(1), n), "UTF-16BE")) / 2).cast("int")
        pick = {"surface": F.when(moved, F.substring("surface", F.col("u_b") + 1, F.col("u_e") - F.col("u_b"))).otherwise(F.col("surface")), "begin": F.when(moved, F.col("begin") + wide(F.col("u_b"))).otherwise(F.col("begin")), "end": F.when(moved, F.col("begin") + wide(F.col("u_e"))).otherwise(F.col("end")), "begin_cp": F.when(moved, F.col("begin_cp") + F.col("u_b")).otherwise(F.col("begin_cp")), "end_cp": F.when(moved, F.col("begin_cp") + F.col("u_e")).otherwise(F.col("end_cp"))}
        for c, u in (("pos_id", "u_pos_id"), ("pos", "u_pos"), ("normalized_form", "u_norm"), ("dictionary_form", "u_form"), ("reading_form", "u_read"), ("dict_id", "u_dict"), ("word_id", "u_word"), ("synonym_group_ids", "u_syn")):
            pick[c] = F.coalesce(u, c)
        pick["mode"] = F.lit(mode)
        if "tok_id" in tokens.columns:
            pick["tok_id"] = (F.col("__first") + F.coalesce("u_n", F.lit(0))).cast("int")
        return x.select(*[pick[c].alias(c) if c in pick else F.col(c) for c in tokens.columns if c != "__first"])

    def register(self, name: str = "analyze", columns: list[str] | None = None) -> None:
        """Registers analysis as a SQL table function: SELECT t.* FROM documents, LATERAL analyze(text, 'C') t.

        columns picks the token columns that are made, as in analyze(): all but the mode, unless told.
        """
        from pyspark.sql.functions import udtf

        sent = self.broadcast()
        names = columns or [c for c in TOKENS if c != "mode"]
        kinds = TOKENS | MORE
        # Values of arrays are to be lists.
        lists = [k for k, c in enumerate(names) if kinds[c].startswith("array")]

        class Analyze:
            def eval(self, text, mode):
                for i, s in enumerate(core.sentences(sent.value, text or "")):
                    made = _columns(s, i, mode, names)
                    for k in lists:
                        made[k] = map(list, made[k])
                    yield from zip(*made, strict=True)

        # "end" and the like are no names in SQL without quotes.
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
        self.spark.udtf.register(name, udtf(Analyze, returnType=schema))


def _signed(wid: int) -> int:
    return wid - (1 << 32) if wid >> 31 else wid


def _columns(s: core.Sentence, number: int, mode: str, names: list[str]) -> list[list]:
    """Columns of a sentence's tokens as they go into tables."""
    out = s.columns(mode, [c if c != "sent_id" else "tok_id" for c in names])
    for k, c in enumerate(names):
        if c == "sent_id":
            out[k] = [number] * len(out[k])
        elif c == "word_id":
            out[k] = [-1 if i < 0 else _signed(i) for i in out[k]]
    return out
