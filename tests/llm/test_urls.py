import random
from datetime import datetime, timedelta

from kanasift.llm import urls

DAY = datetime(2024, 1, 1)


def plain(captures, entries):
    """Each capture against each entry in turn."""
    rank = {"block": 0, "allow": 1, "drop": 2}
    out = {}
    for i, url, at in captures:
        host, keys = "", []
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            for c in "?#":
                rest = rest.split(c)[0]
            host, _, path = rest.partition("/")
            host = host.split("@")[-1].split(":")[0].lower().rstrip(".")
            labels, parts = host.split("."), [p for p in path.split("/") if p]
            keys = [".".join(labels[-k:]) for k in range(min(2, len(labels)), min(6, len(labels)) + 1)] + [host] + [host + "/" + "/".join(parts[:k]) for k in (1, 2) if len(parts) >= k]
        action, key = "allow", None
        for k in keys if host and at else []:
            now = sorted((a for a in entries if a[0] and a[1] in rank and a[2] and a[0].lower() == k and a[2] <= at), key=lambda a: (a[2], -rank[a[1]]))
            if now and now[-1][1] != "drop":
                action, key = now[-1][1], k
        out[i] = (host, key, action, action == "block")
    return out


def test_evaluate(spark):
    rng = random.Random(3)
    hosts = ["example.com", "a.example.com", "b.a.Example.com", "other.org", "x.y.z.w.v.u.t.com", "localhost"]
    paths = ["", "/", "/en", "/en/a", "/en/a/b?q=1", "/de#x", "//en"]
    captures = [(k, f"http{'s' * (k % 2)}://{'user@' * (k % 7 == 0)}{rng.choice(hosts)}{':80' * (k % 5 == 0)}{rng.choice(paths)}", DAY + timedelta(hours=rng.randint(-50, 24 * 60))) for k in range(400)]
    captures += [(1000, None, DAY), (1001, "nonsense", DAY), (1002, "https://example.com/en", None), (1003, "", DAY), (1004, "https://" + "a" * 5000 + ".com/" + "x/" * 5000, DAY)]
    keys = ["example.com", "a.example.com", "OTHER.org", "example.com/en", "a.example.com/en/a", "t.com", "localhost", "v.u.t.com"]
    entries = [(rng.choice(keys), rng.choice(["block", "allow", "drop"]), DAY + timedelta(days=rng.randint(0, 20))) for _ in range(40)]
    entries += [*entries[:5], (None, "block", DAY), ("example.com", "odd", DAY), ("example.com", "block", None)]
    rng.shuffle(entries)
    df = spark.createDataFrame([(*c, 1, 2) for c in captures], "capture_id long, url string, fetched_at timestamp, key int, host int")
    out = urls.evaluate(df, spark.createDataFrame(entries, "key string, action string, at timestamp")).collect()
    assert len(out) == len(captures)
    want = plain(captures, entries)
    for r in out:
        assert (r["host"], r["matched_key"], r["action"], r["blocked"]) == want[r["capture_id"]], r
    assert any(r["blocked"] for r in out) and any(r["matched_key"] and not r["blocked"] for r in out)


def test_repeats_and_empty_tables(spark):
    entries = spark.createDataFrame([("a.com", "block", DAY)], "key string, action string, at timestamp")
    rows = spark.createDataFrame([(1, "http://a.com", DAY)] * 3 + [(None, "http://a.com", DAY)], "capture_id long, url string, fetched_at timestamp")
    assert [r["blocked"] for r in urls.evaluate(rows, entries).collect()] == [True] * 4
    assert [r["blocked"] for r in urls.evaluate(rows, entries.limit(0)).collect()] == [False] * 4
    assert urls.evaluate(rows.limit(0), entries).collect() == []


def as_of(capture, entries):
    """The most specific of all a list's keys that fit a capture, each key looked at by itself."""
    _, url, at = capture
    host, _, path = url.split("://", 1)[1].partition("/")
    parts = [p for p in path.split("/") if p]
    best = None
    for key in {e[0] for e in entries}:
        name, _, front = key.partition("/")
        front = front.split("/") if front else []
        star = name.startswith("*.")
        name = name.removeprefix("*.")
        inside = host == name or host.endswith("." + name)
        if not (inside if star or not front else host == name) or parts[: len(front)] != front:
            continue
        now = max(((e[2], e[1]) for e in entries if e[0] == key and e[2] <= at), default=None)
        if now and now[1] != "drop":
            best = max(best or (0,), (name.count(".") + 1, len(front), not star, key, now[1]))
    return (None, "allow") if best is None else best[3:]


def test_deep_paths_and_long_hosts(spark):
    rng = random.Random(9)
    name = "i.h.g.f.e.d.c.b.a.com".split(".")
    hosts = [".".join(name[k:]) for k in range(9)] + ["other.org", "x.other.org"]
    captures = [(k, f"https://{rng.choice(hosts)}/{rng.choice(['x/y/z/x/W', '/'.join(rng.choices('xyzW', k=rng.randint(0, 6)))])}", DAY + timedelta(hours=rng.randint(0, 500))) for k in range(600)]
    keys = [*hosts[:9], "a.com/x/y/z", "d.c.b.a.com/x/y/z/x", "*.a.com/x/y", "*.c.b.a.com/x", "*.other.org/W", "other.org/x/W/x/y/z", "f.e.d.c.b.a.com"]
    entries = sorted({(k, d): (k, rng.choice(["block", "allow", "drop"]), DAY + timedelta(days=d)) for k in keys for d in rng.sample(range(20), 3)}.values())
    out = urls.evaluate(spark.createDataFrame(captures, "capture_id long, url string, fetched_at timestamp"), spark.createDataFrame(entries, "key string, action string, at timestamp")).collect()
    got = {r["capture_id"]: (r["matched_key"], r["action"]) for r in out}
    assert got == {c[0]: as_of(c, entries) for c in captures}
    assert {k for k, _ in got.values()} >= {"a.com/x/y/z", "*.a.com/x/y", "f.e.d.c.b.a.com"}


def test_one_key_with_many_entries_and_captures(spark):
    # 2,000 entries and 40,000 captures of one host: rows are their sum, not their product.
    entries = spark.range(2000).selectExpr("'a.com' as key", "if(id % 2 = 0, 'block', 'drop') as action", "timestamp'2024-01-01' + make_dt_interval(0, 0, cast(id * 2 as int)) as at")
    rows = spark.range(40000).selectExpr("id as capture_id", "'http://w.a.com/x' as url", "timestamp'2024-01-01' + make_dt_interval(0, 0, cast(id % 4000 as int)) as fetched_at")
    out = urls.evaluate(rows, entries)
    assert out.where("blocked != (cast(floor((capture_id % 4000) / 2) as int) % 2 = 0)").count() == 0 and out.count() == 40000
