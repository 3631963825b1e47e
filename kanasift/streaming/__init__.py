"""Streams: documents are analysed row by row; texts that arrive in pieces keep their unfinished sentence as state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import analyze as core
from ..operators.sentence import LIMIT

SENTENCES = "stream string, seq bigint, sentence string, tokens array<string>"


def cut(parts, buffer: str, final: bool = False) -> tuple[list[tuple[str, list[str]]], str]:
    """(sentence, its surfaces) of a buffer's finished sentences, and what is left.

    An end at the very end of the buffer may go on in the next piece and so stays, as does text without an end,
    until the buffer holds LIMIT characters or the stream is over.
    """
    out = []
    whole = core.prepare(parts, buffer) if buffer else None
    found = core.spans(parts, whole) if whole else []
    taken = 0
    for b, e in found:
        last = e == len(whole.text)
        if last and not final and len(buffer) - taken < LIMIT:
            break
        s = core.Sentence(parts, whole.slice(b, e, parts.table), whole.places[b])
        out.append((s.text.original, [t.surface for t in s.tokens()]))
        taken = whole.places[e]
    return out, buffer[taken:]


def sentences(engine, pieces: DataFrame, timeout_ms: int = 60_000, forget_ms: int = 86_400_000) -> DataFrame:
    """Sentences of streams of text: pieces (stream, at, text) in order of `at` within a batch of a stream.

    The rest of a stream is given as its last sentence when nothing came for timeout_ms; if more comes within
    forget_ms after that, its sentences are numbered on. The state of a stream is its unfinished text, of LIMIT
    characters at most, and a count.
    """
    sent = engine.broadcast()

    def step(key, batches, state):
        text, seq = state.get if state.exists else ("", 0)
        final = state.hasTimedOut
        if not final:
            rows = pd.concat(list(batches))
            text += "".join(rows.sort_values("at")["text"].fillna(""))
        out, rest = cut(sent.value, text, final)
        if final and not text:
            state.remove()
        else:
            state.update((rest, seq + len(out)))
            state.setTimeoutDuration(timeout_ms if rest else forget_ms)
        if out:
            yield pd.DataFrame({"stream": key[0], "seq": range(seq, seq + len(out)), "sentence": [s for s, _ in out], "tokens": [t for _, t in out]})

    keyed = pieces.select(F.col("stream").cast("string"), F.col("at").cast("long"), F.col("text").cast("string"))
    return keyed.groupBy("stream").applyInPandasWithState(step, SENTENCES, T.StructType([T.StructField("text", T.StringType()), T.StructField("seq", T.LongType())]), "append", "ProcessingTimeTimeout")


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows of events (ts, event_type) by time window and type; those over `late` behind are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "n", "total")
