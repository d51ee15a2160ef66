import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import Row

from stmtflow.llm import catalog, conversation_repair as cr

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, copies int"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    """Fault of each row of one conversation in order."""
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, lines) of the best of all edit sequences, tried one by one (few rows, at most two inserts a gap)."""
    best = None
    kinds = []
    for (_, role, text), fault in zip(rows, faults(rows)):
        extra = 5 * (fault == "truncated")
        one = [("D", 2, None)]
        if fault in ("none", "truncated"):
            one += [("K", extra, (role[:1], f"{role}:{text}")), ("R", 1 + extra, ("u", f"user:{text}")), ("R", 1 + extra, ("a", f"assistant:{text}"))]
        kinds.append(one)
    put = [()] + [tuple(p) for n in (1, 2) for p in itertools.product("ua", repeat=n)]
    gaps = [put] * (len(rows) + 1)
    for choice in itertools.product(*kinds):
        base = sum(c[1] for c in choice)
        if best is not None and base > best[0]:
            continue
        for inserts in itertools.product(*gaps):
            cost = base + 5 * sum(map(len, inserts))
            if best is not None and cost > best[0]:
                continue
            audit, roles, lines = "", "", []
            for put_in, edit in itertools.zip_longest(inserts, choice):
                audit += "I" * len(put_in)
                roles += "".join(put_in)
                lines += [{"u": "user:", "a": "assistant:"}[x] for x in put_in]
                if edit is not None:
                    audit += edit[0]
                    if edit[2] is not None:
                        roles += edit[2][0] or "?"
                        lines.append(edit[2][1])
            if GRAMMAR.match(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def direct(rows):
    """The same by dynamic programming over prefixes, without tables: for long conversations."""
    state = {"": (0, "", ())}
    after = lambda s, r: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[s].get(r)
    names = {"u": "user", "a": "assistant"}

    def widened(state):
        for _ in range(3):
            for s, (cost, audit, lines) in list(state.items()):
                for r in "ua":
                    t = after(s, r)
                    if t and (t not in state or (cost + 5, audit + "I") < state[t][:2]):
                        state[t] = (cost + 5, audit + "I", (*lines, names[r] + ":"))
        return state

    for (_, role, text), fault in zip(rows, faults(rows)):
        new: dict = {}
        for s, (cost, audit, lines) in widened(state).items():
            options = [(s, 2, "D", lines)]
            if fault in ("none", "truncated"):
                extra = 5 * (fault == "truncated")
                t = after(s, role[:1]) if role[:1] in ("s", "u", "a") else None
                options += [(t, extra, "K", (*lines, f"{role}:{text}"))] if t else []
                options += [(after(s, r), 1 + extra, "R", (*lines, f"{names[r]}:{text}")) for r in "ua" if after(s, r)]
            for t, more, edit, out in options:
                if t not in new or (cost + more, audit + edit) < new[t][:2]:
                    new[t] = (cost + more, audit + edit, out)
        state = new
    return min((v for s, v in widened(state).items() if s in ("", "a")), key=lambda v: v[:2])


def expected(conv_rows):
    rows = sorted(conv_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    found, (cost, audit, lines) = faults(rows), direct(rows)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


TEXTS = ["Fine.", "Cut off", "", " \t", "Yes!"]


@pytest.mark.parametrize("seed", range(6))
def test_direct_equals_brute_force(seed):
    """The prefix program used below is itself held against all edit sequences."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(TEXTS[:3])) for i in range(3)]
    cost, audit, lines = brute(rows)
    assert direct(rows)[:2] == (cost, audit) and list(direct(rows)[2]) == lines


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_tables_equal_direct(block):
    """Costs and traces of every symbol sequence of up to five rows, for several block lengths."""
    tables = cr.BlockTables(block)
    roles = ["system", "user", "assistant", "other"]
    for n in range(0, 5 if block == 4 else 4):
        for symbols in itertools.product(range(cr.SYMBOLS), repeat=n):
            rows = [(i, roles[x % 4], f"t{i}" + ("." if x < 4 else "")) for i, x in enumerate(symbols)]
            cost, audit, _ = direct(rows)
            steps, state = tables.trace(cr._kept(list(symbols)))
            assert tables.cheapest(cr._kept(list(symbols))) == cost
            assert "".join(e for e, _ in steps) + "I" * len(tables.closing(state)) == audit


@pytest.fixture(scope="module")
def made():
    rng = random.Random(8)
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "superuser", ""]),
             rng.choice([*TEXTS, f"Text {c}.", f"More {rng.randint(0, 30)}?"])) for c in [*range(40), None] for _ in range(rng.randint(1, 14))]
    rows += [(77, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}{'.' * (t % 7 > 0)}") for t in range(1500)]
    return rows + [(78, 5, "user", "Same.")] * 40 + [(78, 6, "assistant", "Last.")]


@pytest.mark.parametrize("partitions", [1, 7])
def test_repair_equals_direct(spark, made, partitions):
    """Also for conversations that lie in several partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        repaired, spanning = cr.repair(spark.createDataFrame([(*r, "p", 1) for r in made], SCHEMA).repartition(3))
        got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cr.digests(repaired, spanning).collect()}
        parts = [r["conv_id"] for r in spanning.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {c: expected([r[1:] for r in made if r[0] == c]) for c in {r[0] for r in made}}
    assert got == want
    assert parts.count(77) > 2 if partitions == 7 else not parts


def test_rows_tell_the_repair(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Why"), (1, 2, "tool", "Result."), (1, 2, "tool", "Result.")]
    repaired, _ = cr.repair(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA))
    got = sorted((r["turn"], r["edits"], r["new_role"], r["inserted"], r["appended"], r["copies"]) for r in repaired.collect())
    assert got == [(0, "R", "user", [], [], 1), (1, "D", None, [], [], 1), (2, "RD", "assistant", [], [], 2)]


def test_damage(spark, made):
    rows = [(c, t, r, x) for c, t, r, x in made if c != 78][:300]
    got = sorted(map(str, cr.damaged(spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA)).collect()))
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        want += [(c, t, "user" if k == 4 else r, x)] * {0: 0, 3: 2}.get(k, 1)
    assert got == sorted(str(Row(conv_id=c, turn=t, role=r, text=x)) for c, t, r, x in want)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, None, None, "x" * 200_000 + "."), (1, None, "user", None), (2, 2**62, "user", "A."), (2, -2**62, "user", "B."),
            (3, 1, "user", "é?\n"), (3, 1, "user", "é?\n"), (3, 2, "assistant", "ß !")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cr.digests(*cr.repair(df)).collect()}
    for c in (None, 1, 3):
        clean = [(t, " " if r is None else r, " " if x is None else x) for cc, t, r, x in rows if cc == c]
        assert got[c] == expected(clean)
    assert got[2][0] == 2**63 - 1 and len(cr.audited(df).collect()) == 4
    assert cr.audited(df.limit(0)).count() == 0


def test_conversation_without_rows_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    row = cr.audited(spark.createDataFrame([(gone, 1, "user", "Hi.", "p", 1)], SCHEMA)).first()
    assert tuple(row[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query_equals_sql(spark, sf_small, con):
    got, want = catalog.op11_conversation_repair(spark, sf_small), con.execute(catalog.SQL["op11_conversation_repair"])
    order = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(want.fetchall())
