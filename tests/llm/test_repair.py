"""Conversation repair against an exhaustive dynamic program over whole conversations that shares no code with the operator."""

import collections
import hashlib
import itertools
import re
import zlib

import pyarrow.parquet as pq
import pytest

from claimloom.llm import repair

SPACE = " \t\n\x0b\x0c\r"
PATTERN = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        as_text = lambda x: " " if x is None else str(x)
        role, text = as_text(role), as_text(text)
        kind = zlib.crc32(f"{as_text(conv)}:{as_text(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """All (cost, audit, lines) kept per pattern prefix class: a plain shortest path over (rows done, last initial), relaxed until nothing changes."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def offer(table, key, value):
        if key not in table or value < table[key]:
            table[key] = value
            return True
        return False

    layers = [{"": (0, "", ())}]
    for i in range(len(rows) + 1):
        layer = layers[i]
        changed = True
        while changed:
            changed = False
            for q, (cost, audit, made) in list(layer.items()):
                for role in ("user", "assistant"):
                    if role[0] in follows[q]:
                        changed |= offer(layer, role[0], (cost + 5, audit + "I", (*made, f"{role}:")))
        if i == len(rows):
            break
        _, role, text = rows[i]
        nxt = {}
        for q, (cost, audit, made) in layer.items():
            offer(nxt, q, (cost + 2, audit + "D", made))
            if found[i] in ("blank", "duplicate"):
                continue
            extra = 5 if found[i] == "truncated" else 0
            if role and role[0] in follows[q]:
                offer(nxt, role[0], (cost + extra, audit + "K", (*made, f"{role}:{text}")))
            for other in ("user", "assistant"):
                if other[0] in follows[q]:
                    offer(nxt, other[0], (cost + extra + 1, audit + "R", (*made, f"{other}:{text}")))
        layers.append(nxt)
    return min(v for q, v in layers[-1].items() if q in ("", "a"))


def brute(rows):
    after, out = damage(rows), {}
    for conv in {r[0] for r in rows}:
        mine = after.get(conv, [])
        found = faults(mine)
        cost, audit, made = cheapest(mine, found)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (gaps, *[found.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def through(spark, rows, tmp_path, extra=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in extra.split():
        df = df.withColumn(name, df.conv_id)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op13_repair(spark, str(tmp_path)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01", "sf0.1"])
def test_whole_tables(spark, table):
    t = pq.read_table(f"/root/testdata/{table}/conversations.parquet").to_pylist()
    want = brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in t])
    got = {r.conv_id: tuple(r)[1:] for r in repair.op13_repair(spark, f"/root/testdata/{table}").collect()}
    assert got == want


def test_every_audit_is_the_least_of_all():
    """All edit lists of short conversations, one by one."""
    kinds = [("s", 0), ("u", 0), ("a", 0), ("u", 3), ("a", 3), ("x", 0), ("u", 1), ("", 0)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            best = (99, "")
            for audit in (x for m in range(n + 4) for x in itertools.product("DIKR", repeat=m)):
                if sum(e != "I" for e in audit) != n:
                    continue
                options, cost, i, ok = [""], 0, 0, True
                for e in audit:
                    if e == "I":
                        cost, options = cost + 5, [o + c for o in options for c in "ua"]
                        continue
                    initial, fault = rows[i]
                    i += 1
                    if e == "D":
                        cost += 2
                        continue
                    if fault == 1 or (e == "K" and not initial):
                        ok = False
                        break
                    cost += (e == "R") + (5 if fault == 3 else 0)
                    options = [o + c for o in options for c in (initial if e == "K" else "ua")]
                if ok and any(PATTERN.fullmatch(o) for o in options):
                    best = min(best, (cost, "".join(audit)))
            ends = repair.search(list(rows), 0)
            assert min(v for q, v in ends.items() if q in (0, 3)) == best, rows


ODD = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, None, None, None), (1, 5, "assistant", " \n"), (1, 9, "assistant", "no stop"),
    (None, None, "user", "x."), (None, 3, "assistant", "y."), (None, 3, "assistant", "z."), (2, None, None, None), (3, 4, "", "empty role."), (3, 5, "tool", "a tool."),
    (4, 7, "user", "w " * 40_000 + "end."), (4, 8, "assistant", "v " * 300_000), (5, 1, "user", "é "), (6, -3, "assistant", "only!"), (7, 1, "user", "twice."), (7, 1, "user", "twice."), (7, 1, "user", "Other."),
]


@pytest.mark.parametrize("rows", [ODD, [], [r for r in ODD if r[0] == 2]])
def test_odd_rows(spark, tmp_path, rows):
    assert through(spark, rows, tmp_path, "conv part seq first n kind") == brute(rows)


def test_long_conversations_over_segments(spark):
    """A conversation of most rows, cut into many segments over several partitions; copies in it, ties among turns."""
    roles = ["user", "assistant", "assistant", "system", "tool", "user"]
    rows = [(1, i // 2, roles[(i * i + i // 3) % 6], f"say {i % 171}" + (". " if i % 5 else "")) for i in range(3000)]
    rows += [(1, 77, "user", "again and again.")] * 600 + [(c, t, roles[(c + t) % 6], "Same.") for c in range(2, 40) for t in range(c % 9)]
    want = brute(rows)
    got = repair.repaired(repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), segment_rows=7).collect()
    assert {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == {c: w for c, w in want.items() if c in {r.conv for r in got}}
    assert all(w[5:7] == (0, "") for c, w in want.items() if c not in {r.conv for r in got})
