import hashlib
import itertools
import random
import re

import pytest
from oracle import same

from factloom.llm import repair

SMALL = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """All edits with up to two inserts at a place: the least (cost, audit), and the digest of what it leaves."""
    inserts = [(), *((r,) for r in ("user", "assistant")), *itertools.product(("user", "assistant"), repeat=2)]
    best = None
    for ops in itertools.product(("D", "K", "user", "assistant"), repeat=len(rows)):
        if any(op != "D" and gone for op, (_, _, gone, _) in zip(ops, rows, strict=True)):
            continue
        for puts in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k, put in enumerate(puts):
                cost, audit, out = cost + 3 * len(put), audit + "I" * len(put), out + [(r, "") for r in put]
                if k < len(rows):
                    role, text, _, cut = rows[k]
                    cost += 4 if ops[k] == "D" else (3 if ops[k] != "K" else 0) + (3 if cut else 0)
                    audit += "R" if len(ops[k]) > 1 else ops[k]
                    if ops[k] != "D":
                        out = [*out, (role if ops[k] == "K" else ops[k], text)]
            if LEGAL.fullmatch("".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    return best


def test_integer_weights_against_all_edits():
    rng = random.Random(4)
    for n in (0, 1, 2, 3):
        for _ in range(60 if n < 3 else 12):
            rows = [(rng.choice(["user", "assistant", "system", "tool"]), f"t{k}", rng.random() < 0.2, rng.random() < 0.3) for k in range(n)]
            r = repair.Repair()
            for x in rows:
                r.row(*x)
            assert r.end() == brute(rows)


def plain(rows):
    """The same graph with (cost, audit) pairs in place of integers."""
    at = {0: (0, "")}

    def put(new, s, x):
        new[s] = min(new.get(s, x), x)

    def inserted(at):
        new = dict(at)
        for s, (c, a) in at.items():
            put(new, repair.other(s), (c + 3, a + "I"))
        return new

    for role, _, gone, cut in rows:
        new = {}
        for s, (c, a) in inserted(at).items():
            put(new, s, (c + 4, a + "D"))
            if not gone:
                if (s, role[0]) in repair.LEGAL:
                    put(new, repair.LEGAL[s, role[0]], (c + 3 * cut, a + "K"))
                put(new, repair.other(s), (c + 3 + 3 * cut, a + "R"))
        at = new
    at = inserted(at)
    return min(at[s] for s in repair.FINAL if s in at)


@pytest.mark.parametrize("seed", range(4))
def test_long_conversations(seed):
    """Letters are put aside many times."""
    rng = random.Random(seed)
    rows = [(rng.choice(["user", "user", "assistant", "system"]), f"t{k}", rng.random() < 0.1, rng.random() < 0.3) for k in range(3000)]
    r = repair.Repair()
    for x in rows:
        r.row(*x)
    assert r.end()[:2] == plain(rows)


def test_equals_sql(spark):
    same(repair.op12_conversation_repair(spark, SMALL), repair.SQL["op12_conversation_repair"], SMALL)


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."),  # a repeated row
    (2, None, None, None), (2, 3, "user", "No end"), (2, 9, "user", "\t\n"), (2, 9, "assistant", "Bye!  "),
    (None, 0, "system", "S."), (None, 1, "user", "Q?"), (3, 5, "", "x" * 2_000_000 + "."), (4, 1, "user", "é?"), (4, 2, "user", "é?"), (4, 3, "assistant", "é?"),
]


def test_odd_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(*r, "x", 7) for r in ROWS], "conv_id long, turn long, role string, text string, audit string, again int")
    got = {r.conv_id: r for r in repair.repairs(df).collect()}
    assert {k: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for k, r in got.items()} == {
        1: (0, 0, 1, 0, 1, 4, "KKD"),
        2: (5, 2, 0, 1, 1, 11, "DKKD"),
        None: (0, 0, 0, 0, 0, 3, "KKI"),
        3: (0, 0, 0, 0, 0, 4, "D"),
        4: (0, 0, 1, 0, 1, 4, "KDK"),
    }
    said = {}
    for r in sorted(repair.repaired(df).collect(), key=lambda r: r.place):
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {k: hashlib.sha256("\n".join(said.get(k, [])).encode()).hexdigest() for k in got} == {k: r.repaired_sha256 for k, r in got.items()}


def test_absent_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", True), (1, 1, "user", "x", True)], "conv_id long, turn long, role string, text string, absent boolean")
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in repair.repairs(df, absent=df.absent).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert repair.repairs(df.filter("conv_id > 1")).collect() == [] and repair.repaired(df.filter("conv_id > 1")).collect() == []


def test_long_conversation_through_the_query(spark):
    rng = random.Random(1)
    rows = [(i % 40 == 0 and 1 or 2, i, rng.choice(["user", "assistant"]), f"{rng.randint(0, 2000)}" + rng.choice([".", ""])) for i in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen, own = set(), {1: [], 2: []}
    for c, _, role, text in rows:
        again = (c, role, text) in seen
        seen.add((c, role, text))
        own[c].append((role, text, again, not again and not text.endswith(".")))
    assert {r.conv_id: (r.cost, r.audit) for r in repair.repairs(df).collect()} == {c: plain(x) for c, x in own.items()}
