import hashlib
import heapq
import random
import re
import zlib
from itertools import pairwise

from lexivec.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit) by uniform-cost search over whole audits: no bounds, no dominance."""
    heap, order = [(0, "", 0, "")], re.compile(r"\A(s?(ua)+)?\Z")
    while heap:
        cost, audit, n, out = heapq.heappop(heap)
        if n == len(rows) and order.match(out):
            return cost, audit
        if not re.match(r"\A(s?(ua)*u?)?\Z", out):
            continue
        if audit.count("I") < 4:
            for x in "ua":
                heapq.heappush(heap, (cost + 5, audit + "I", n, out + x))
        if n < len(rows):
            initial, fault = rows[n]
            heapq.heappush(heap, (cost + 2, audit + "D", n + 1, out))
            if fault not in ("b", "d"):
                more = 5 * (fault == "t")
                if initial in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + more, audit + "K", n + 1, out + initial))
                for x in "ua":
                    if x != initial:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", n + 1, out + x))


def test_search_equals_brute_force_with_any_bound():
    rng = random.Random(1)
    nothing = lambda rows: [(0,) * 4] * (len(rows) + 1)
    for _ in range(1500):
        rows = [(rng.choice(["s", "u", "a", "a", "t", " ", ""]), rng.choice(["", "", "", "b", "d", "t"])) for _ in range(rng.randint(0, 6))]
        want = cheapest(rows)
        assert R.repair(rows) == want and R.repair(rows, nothing) == want


def test_long_conversations_are_searched_in_little_time():
    rng = random.Random(2)
    rows = [(rng.choice("suaua "), rng.choice(["", "", "b", "d", "t"])) for _ in range(20_000)]
    cost, audit = R.repair(rows)
    assert len(audit) >= 20_000 and cost > 0


def brute(data):
    """The contract, row by row. Rows of a turn by role and MD5 of the text."""
    by = {}
    for conv, turn, role, text in data:
        conv_rows = by.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        conv_rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in rows:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        cost, audit = cheapest(list(zip(initials, faults, strict=True)))
        left, lines, initials_out = list(rows), [], ""
        for letter in audit:
            expected = "a" if initials_out.endswith("u") else "u"
            if letter == "I":
                lines.append({"u": "user:", "a": "assistant:"}[expected])
                initials_out += expected
                continue
            _, role, text = left.pop(0)
            if letter == "K":
                lines.append(f"{role}:{text}")
                initials_out += role[:1]
            elif letter == "R":
                lines.append({"u": "user:", "a": "assistant:"}[expected] + text)
                initials_out += expected
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows(n, seed):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Hello.", "What?", "No end", " \t\n", "", None, "Fine!", "Fine! ", "a.b", "über ß.", "line\nline."]
    return [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_equals_brute_force(spark):
    for data in (rows(160, 1), rows(160, 2), [(1, None, None, None)] * 3 + [(2, 5, "user", "Hi.")] * 4):
        found = R.damaged_and_repaired(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
        assert {r.conv_id: tuple(r)[1:] for r in found} == brute(data)
        assert len(found) == len({d[0] for d in data})


def test_empty_table_dropped_conversations_and_other_columns(spark):
    assert R.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA).withColumn("part", F.lit("x")).withColumn("fault", F.lit(1))
    (row,) = R.damaged_and_repaired(df).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
