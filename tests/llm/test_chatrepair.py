import hashlib
import itertools
import random
import re
import zlib

import pytest
from faultline.llm import chatrepair
from faultline.llm.chatrepair import Repair, Stacks, Tables

FORM = re.compile("(s?(ua)+)?")
GAPS = ["", "u", "a", "ua", "au"]
WHITE = " \t\n\v\f\r"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        end = text.rstrip(WHITE)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, audit, repaired) over all edits, with up to two inserts in each place."""
    best = None
    marks = faults(rows)
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in marks]
    for edits in itertools.product(*choices):
        cost = sum({"D": 3, "K": 0}.get(e, 2) + (f == "truncated" and e != "D") for e, f in zip(edits, marks))
        if best and cost > best[0]:
            continue
        for gaps in itertools.product(GAPS, repeat=len(rows) + 1):
            total = cost + 2 * sum(map(len, gaps))
            if best and total > best[0]:
                continue
            audit, roles, lines = "I" * len(gaps[0]), gaps[0], [f"{chatrepair.NAMES[g]}:" for g in gaps[0]]
            for (role, text), e, gap in zip(rows, edits, gaps[1:]):
                audit += e[0] + "I" * len(gap)
                if e != "D":
                    role = role if e == "K" else chatrepair.NAMES[e[1]]
                    roles += role[:1]
                    lines.append(f"{role}:{text}")
                roles += gap
                lines += [f"{chatrepair.NAMES[g]}:" for g in gap]
            if FORM.fullmatch(roles) and (best is None or (total, audit) < best[:2]):
                best = (total, audit, "\n".join(lines))
    return best


def automaton(rows):
    """The same by shortest paths over the five states of the form, with whole audits."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(live):
        live, todo = dict(live), list(live)
        for q in todo:
            for x in "ua":
                if (q, x) in step:
                    c, a, lines = live[q]
                    new = (c + 2, a + "I", [*lines, f"{chatrepair.NAMES[x]}:"])
                    if step[q, x] not in live or new[:2] < live[step[q, x]][:2]:
                        live[step[q, x]] = new
                        todo.append(step[q, x])
        return live

    live = {"0": (0, "", [])}
    for (role, text), fault in zip(rows, faults(rows)):
        out = {}
        for q, (c, a, lines) in inserted(live).items():
            found = [(q, c + 3, "D", lines)]
            if fault not in ("blank", "duplicate"):
                c += fault == "truncated"
                found += [(step[q, role[:1]], c, "K", [*lines, f"{role}:{text}"])] if (q, role[:1]) in step else []
                found += [(step[q, x], c + 2, "R", [*lines, f"{chatrepair.NAMES[x]}:{text}"]) for x in "ua" if (q, x) in step]
            for to, cost, e, ls in found:
                if to not in out or (cost, a + e) < out[to][:2]:
                    out[to] = (cost, a + e, ls)
        live = out
    cost, audit, lines = min(x for q, x in inserted(live).items() if q in "0a")
    return cost, audit, "\n".join(lines)


def repaired(rows):
    repair, edits = Repair(Stacks(Tables())), []
    for (role, text), fault in zip(rows, faults(rows)):
        edits += repair.add(role, text, fault)
    rest, cost = repair.finish()
    edits += rest
    return cost, "".join(e[0] for e in edits), "\n".join(f"{role}:{text}" for e, role, text, _ in edits if e != "D")


def some_rows(rnd, n):
    return [(rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", " ", "sudo"]), rnd.choice(["", " \n", "A.", "B!", "C", "D? ", "E.x", f"{rnd.random()}."])) for _ in range(n)]


def test_tables_accept_the_form_only():
    stacks = Stacks(Tables())
    for n in range(6):
        for word in itertools.product("usa", repeat=n):
            tops = [0]
            for x in word:
                tops = [t for node in tops for t in stacks.after(node, x)]
            assert any(map(stacks.accepts, tops)) == bool(FORM.fullmatch("".join(word)))


def test_repair_equals_all_edits():
    rnd = random.Random(2)
    for _ in range(60):
        rows = some_rows(rnd, rnd.randint(0, 3))
        assert exhaustive(rows) == automaton(rows) == repaired(rows)


def test_long_conversations_settle_and_equal_shortest_paths():
    rnd = random.Random(3)
    for n in [5, 20, 70, 129, 300] * 8:
        rows = some_rows(rnd, n)
        assert automaton(rows) == repaired(rows)
    repair = Repair(Stacks(Tables()))
    for i in range(20_000):
        repair.add(rnd.choice(["user", "assistant", "tool"]), f"{i}.", None)
        assert len(repair.rows) < 1000


def brute(conv, rows):
    harmed = []
    for _, turn, role, text in rows:
        sp = lambda x: " " if x is None else x
        h = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = "user" if h == 4 else sp(role), "" if h == 1 else re.sub("[.!?]", "", sp(text)) if h == 2 else sp(text)
        harmed += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    harmed.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in harmed if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [r[1:] for r in harmed]
    marks = faults(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    cost, audit, text = automaton(pairs)
    return (conv, gaps, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    out = []
    for c in [*range(150), None, -5]:
        for i, (role, text) in enumerate(some_rows(rnd, rnd.randint(1, 14))):
            out.append((c, rnd.choice([i, i, i, 2 * i, None]), rnd.choice([role] * 9 + [None, ""]), rnd.choice([text] * 9 + [None, "é😀."])))
    out += [(900, i, "assistant" if i % 2 else "user", f"{i} " + "long " * 2000) for i in range(300)]
    out += [(901, None, "user", "Only."), (901, None, "assistant", "Nulls."), (902, 0, "system", None)]
    return out + [(903, 7, "user", "Same."), (903, 7, "user", "Same.")]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, there int").repartition(4)


def test_digests(table, rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    got = sorted((tuple(r) for r in chatrepair.repair_digests(chatrepair.damaged(table)).collect()), key=str)
    assert got == sorted((brute(c, own) for c, own in by.items()), key=str)


def test_repaired_rows_have_the_form(table):
    out = chatrepair.repair_turns(chatrepair.damaged(table)).collect()
    by = {}
    for r in out:
        by.setdefault(r.conv_id, []).append(r)
    for own in by.values():
        assert FORM.fullmatch("".join(r.role[:1] for r in own if r.edit != "D"))
        assert all(r.edit == "D" for r in own if r.fault in ("blank", "duplicate"))
    assert chatrepair.repair_turns(chatrepair.damaged(table.limit(0))).isEmpty()
    assert chatrepair.repair_digests(chatrepair.damaged(table.limit(0))).isEmpty()
