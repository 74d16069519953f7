import hashlib
import itertools
import random
import re
import sys
import zlib
from pathlib import Path

import pytest

from regionpairs.llm import conversations

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import oracle  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, gone string, moves int"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, lines) by trying all edits of rows (role, text, required, truncated) with up to two turns inserted at each place."""
    gaps = [c for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    own = [[("D", None, 4)] + ([] if req else [("K", f"{r}:{t}", 3 * late)] + [("R", f"{to}:{t}", 3 + 3 * late) for to in ("user", "assistant")]) for r, t, req, late in rows]
    for picks in itertools.product(*own):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            audit, lines, cost = "", [], 0
            for k in range(len(rows) + 1):
                audit += "I" * len(put[k])
                lines += [f"{x}:" for x in put[k]]
                cost += 3 * len(put[k])
                if k < len(rows):
                    letter, line, c = picks[k]
                    audit, cost = audit + letter, cost + c
                    lines += [line] if line is not None else []
            if best and (cost, audit) >= best[:2]:
                continue
            if re.fullmatch("(s?(ua)+)?", "".join(x.split(":", 1)[0][:1] or "-" for x in lines)):
                best = (cost, audit, lines)
    return best


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in own if t is not None]
        faults, seen = [], set()
        for _, role, text in own:
            last = BLANK.findall(text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest([(r, t, f in ("blank", "duplicate"), f == "truncated") for (_, r, t), f in zip(own, faults)])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some(rnd, n):
    rows = []
    for conv in range(n):
        for k in range(rnd.randrange(1, 4)):
            rows.append((conv, rnd.choice([k, k, k + 1, None, 5]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rnd.choice(["Hi.", "Hi.", "x", "", " \t\n", "no: end\n", "ü!", None, "a\nb?"])))
    return rows + [(None, 1, "user", "Hm."), (None, None, "assistant", "So.")]


def test_against_all_edits(spark):
    rows = some(random.Random(1), 150)
    got = {r.conv_id: tuple(r) for r in conversations.audit(conversations.damaged(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA))).collect()}
    want = brute(rows)
    assert {k for k in got if got[k] != want.get(k)} == set() and len(got) == len(want)


def test_step_against_all_edits():
    """Longer sequences of the states alone, without damage: cost and audit."""
    rnd = random.Random(2)
    for _ in range(60):
        rows = [(rnd.choice(["system", "user", "assistant", "x"]), "t", rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randrange(4))]
        costs, moves = conversations.AFTER_LAST, []
        for role, _, req, late in reversed(rows):
            costs, m = conversations.step(costs, role[:1] if role[:1] in "sua" else "", req, late and not req)
            moves.append(m)
        follow, got = conversations.Follow(), []
        for (role, text, req, late), m in zip(rows, reversed(moves)):
            got += follow.row(role, text, "blank" if req else "truncated" if late else None, m)
        got += follow.end()
        cost, audit, lines = cheapest([(r, t, q, late and not q) for r, t, q, late in rows])
        assert (follow.cost, "".join(x[0] for x in got), [f"{r}:{t}" for x, r, t in got if x != "D"]) == (cost, audit, lines)


def test_repaired_rows_follow_the_grammar(spark):
    rows = some(random.Random(3), 60)
    damaged = conversations.damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    told, audits = {}, {r.conv_id: r for r in conversations.audit(damaged).collect()}
    for r in sorted(conversations.repaired(damaged).collect(), key=lambda r: r.place):
        told.setdefault(r.conv_id, []).append(r)
    for conv, a in audits.items():
        own = told.get(conv, [])
        left = [r for r in own if r.edit != "D"]
        assert "".join(r.edit for r in own) == a.audit and re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in left))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in left).encode()).hexdigest() == a.repaired_sha256


@pytest.mark.parametrize("batch", [7, 10_000])
def test_long_conversation_across_batches(spark, batch):
    """A conversation over many batches: the same as in one, and its cost is what its letters say."""
    rnd = random.Random(4)
    rows = [(1, 2**60 + k, rnd.choice(["user", "assistant"]), rnd.choice(["Yes.", f"No {k}.", f"cut {k}"])) for k in range(3000)] + [(2, 0, "user", "Hi.")]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        got = {r.conv_id: r for r in conversations.audit(conversations.damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))).collect()}
    finally:
        spark.conf.set(key, before)
    assert hashlib.sha256(repr(got[1]).encode()).hexdigest() == test_long_conversation_across_batches.__dict__.setdefault("seen", hashlib.sha256(repr(got[1]).encode()).hexdigest())
    a = got[1]
    assert a.cost >= 4 * a.audit.count("D") + 3 * a.audit.count("I") + 3 * a.audit.count("R") and a.gaps > 50


def test_sql_and_odd_tables(spark, tmp_path):
    rows = some(random.Random(5), 80)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    query = lambda s, d: conversations.audit(conversations.damaged(s.read.parquet(f"{d}/conversations.parquet")))
    assert oracle.compare(spark, query, conversations.ORACLE, str(tmp_path)) == ""
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.audit(conversations.damaged(none)).count() == 0
