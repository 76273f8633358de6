import datetime as dt
import random

from lexivec.llm import url_filters as U
from lexivec.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
DAY0 = dt.datetime(2024, 1, 1)
EVENTS = "list string, kind string, pattern string, action string, at timestamp"
CAPTURES = "page_id long, url string, fetched_at timestamp, host string, `a.b` string"


def day(n):
    return DAY0 + dt.timedelta(days=n)


def test_query_equals_sql(spark):
    import sys

    sys.path.insert(0, "tests")
    from oracle_check import compare, duck

    r = compare(spark, duck(SF), "op4_url_filters", QUERIES["op4_url_filters"], ORACLES["op4_url_filters"], SF)
    assert r["status"] == "ok", r


def brute_intervals(events):
    """The state of each pattern after all events of an instant; remove beats add."""
    keys = {e[:3] for e in events}
    for key in keys:
        at = {}
        for e in events:
            if e[:3] == key:
                at[e[4]] = at.get(e[4], "add") if e[3] == "add" else "remove"
        times = sorted(at)
        for i, t in enumerate(times):
            if at[t] == "add":
                yield (*key, t, times[i + 1] if i + 1 < len(times) else None)


def brute_match(kind, pattern, host, path):
    if kind == "host":
        return host == pattern
    if kind == "domain":
        return host == pattern or host.endswith("." + pattern)
    full = host + path
    return full == pattern or full.startswith(pattern + "/")


def test_equals_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "xexample.com"]
    patterns = [("host", h) for h in hosts] + [("domain", h) for h in hosts + ["com"]] + [("prefix", f"{h}/{p}") for h in hosts for p in ("x", "x/y")]
    events = [(rng.choice(["l1", "l2"]), *rng.choice(patterns), rng.choice(["add", "add", "remove"]), day(rng.randint(0, 20))) for _ in range(150)]
    captures = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/xx', '/x/y?q', '/x/y/z#f'])}", day(rng.randint(-1, 22)), None, "k") for i in range(400)]
    want = {}
    import re

    intervals = list(brute_intervals(events))
    for i, url, at, *_ in captures:
        host, path = re.match(r"http://([^/?#]+)([^?#]*)", url).groups()
        hit = [(x[0], x[1], x[2]) for x in intervals if x[3] <= at and (x[4] is None or at < x[4]) and brute_match(x[1], x[2], host, path)]
        best = min(((-len(p), k, p, n) for n, k, p in hit), default=None)
        want[i] = (len(hit), f"{best[3]}:{best[1]}:{best[2]}" if best else None)
    for limit in (0, 10**6):
        rows = U.judge(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(events, EVENTS), limit=limit).collect()
        assert {r.page_id: (r.n_active, r.entry) for r in rows} == want
        assert all(r.blocked == (r.n_active > 0) and r["a.b"] == "k" for r in rows)


def test_awkward_urls_and_events(spark):
    captures = [
        (1, None, day(1), "clash", "k"), (2, "", day(1), "clash", "k"), (3, "no url", day(1), None, None), (4, "HTTPS://user:pw@EXAMPLE.com.:8080/x", day(1), None, None),
        (5, "http://example.com", None, None, None), (6, "http://example.com/" + "y" * 200_000, day(1), None, None), (4, "HTTPS://user:pw@EXAMPLE.com.:8080/x", day(1), None, None),
    ]
    events = [
        ("l", "host", "Example.com", "add", day(0)), ("l", "host", "example.com", "add", day(0)), ("l", "host", None, "add", day(0)), (None, "domain", "com", "add", day(0)),
        ("l", "prefix", "example.com/x/", "add", day(1)), ("l", "prefix", "example.com/x", "add", None), ("l", "host", "example.com", "other", day(0)), ("l", "domain", "example.com", "add", day(1)), ("l", "domain", "example.com", "remove", day(1)),
    ]
    rows = U.judge(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(events, EVENTS)).collect()
    assert len(rows) == 7
    got = {r.page_id: (r.host, r.n_active, r.blocked) for r in rows}
    assert got[1] == got[2] == got[3] == (None, 0, False)
    assert got[4] == ("example.com", 3, True) and got[5] == ("example.com", 0, False) and got[6] == ("example.com", 2, True)
    none = spark.createDataFrame([], EVENTS)
    assert all(r.n_active == 0 and r.entry is None for r in U.judge(spark.createDataFrame(captures, CAPTURES), none).collect())
    assert U.judge(spark.createDataFrame([], CAPTURES), none).collect() == []


def test_native_plan(spark):
    df = QUERIES["op4_url_filters"](spark, SF)
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
