"""Descriptors and parents against a loop over events in order."""

import random
from collections import defaultdict

from tracewell.operators import audit_trail as m


def by_loop(rows, kinds):
    table = {(op, *(("subject", k) if end == "src" else (k, "subject"))): (end, action, n) for op, end, k, action, n in m.RULES}
    following, held, parent, out = defaultdict(lambda: 3), {}, {}, {}
    for uuid, _, src, dst, op in sorted(rows, key=lambda r: (r[1], r[0])):
        rule = table.get((op, kinds.get(src), kinds.get(dst)))
        if rule is None:
            out[uuid] = ("skipped", None, None, None)
            continue
        end, action, _ = rule
        pid, thing = (src, dst) if end == "src" else (dst, src)
        above, opened, fd = parent.get(pid, 0), False, None
        if action == "open" or (action in ("read", "write", "socket") and (pid, thing) not in held):
            opened = action != "open"
            held[pid, thing] = following[pid]
            following[pid] += 1
        if action in ("open", "read", "write", "socket", "close"):
            fd = held.get((pid, thing))
        if action == "close":
            held.pop((pid, thing), None)
        if action == "clone":
            parent[thing] = pid
        out[uuid] = ("missing" if action == "close" and fd is None else "converted", fd, opened, above)
    return out


def test_system_calls(spark):
    r = random.Random(4)
    kinds = {**{i: "subject" for i in range(1, 5)}, **{i: "file" for i in range(10, 14)}, **{i: "netflow" for i in range(20, 22)}}
    ops = sorted({x[0] for x in m.RULES} | {"EVENT_OTHER"})
    rows = []
    for i in range(500):
        op = r.choice([*ops, "EVENT_OPEN", "EVENT_CLOSE", "EVENT_READ"])
        ends = (r.choice([1, 1, 1, 2, 3, 4]), r.choice([1, 2, 3, 4]) if op == "EVENT_CLONE" else r.choice([*range(10, 14), 20, 21, 99]))
        rows.append((i, r.randrange(120), *(ends if r.random() < 0.5 or op == "EVENT_CLONE" else ends[::-1]), op))
    edges = spark.createDataFrame(rows, "event_uuid long, t long, src long, dst long, op string").repartition(3)
    got = m.system_calls(edges, spark.createDataFrame(sorted(kinds.items()), "node long, kind string")).collect()
    assert {x.event_uuid: (x.outcome, x.fd, x.opened, x.ppid) for x in got} == by_loop(rows, kinds)
    assert {x.outcome for x in got} == {"converted", "missing", "skipped"} and len(got) == len(rows)
    assert m.system_calls(edges.limit(0), spark.createDataFrame([], "node long, kind string")).count() == 0
