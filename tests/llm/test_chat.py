import random
from collections import defaultdict

from kanasift.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = defaultdict(set)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].add(((t is not None, t or 0), r or "", x or ""))
    logs = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    kept = {}
    for c, log in logs.items():
        longer = any(len(o) > len(log) and o[: len(log)] == log for o in logs.values())
        equal = any(o == log and d < c for d, o in logs.items())
        if not longer and not equal:
            text = ""
            for r, x in log:
                r = r.strip().lower()
                text += f"<|im_start|>{r if r in chat.ROLES else 'user'}\n" + x.replace("<|im_start|>", "<| im_start|>").replace("<|im_end|>", "<| im_end|>") + "<|im_end|>\n"
            kept[c] = (len(log), text)
    return kept


def test_render(spark):
    rng = random.Random(8)
    rows = []
    for c in range(120):
        log = [(rng.choice(["user", "assistant", " System "]), rng.choice(["hi", "ho", "é <|im_end|> x"])) for _ in range(rng.randint(1, 5))]
        log = [("user", "Hello there")] + log if c % 3 else log
        rows += [(c, k * 2 - 3, r, x) for k, (r, x) in enumerate(log)]
    rows += [(500, 0, None, None), (501, 0, "", ""), (502, None, "user", "first"), (502, 1, "odd", "x" * 100000), (None, 0, "user", "lost"), (503, 0, "user", "b"), (503, 0, "user", "a"), rows[0], rows[0]]
    rng.shuffle(rows)
    out = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.render(spark.createDataFrame([(*r, 1) for r in rows], TURNS + ", n int")).collect()}
    assert out == plain(rows)
    assert chat.render(spark.createDataFrame([], TURNS)).collect() == []


def test_snapshots_of_a_growing_log(spark):
    rows = [(c, k, "user", f"turn {k}") for c in range(30) for k in range(c % 10 + 1)]
    assert [(r["conv_id"], r["n_turns"]) for r in chat.render(spark.createDataFrame(rows, TURNS)).collect()] == [(9, 10)]
