"""Conversation repair against a plain dynamic program, on pieces of any length, and against its SQL."""
import hashlib
import random
import zlib

import pytest

import __spark_entry__ as ent
from oracle_check import TABLES, compare, rows_of
from tessera.llm import structure

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def plain(rows):
    """The contract by a dynamic program over (role before) states: {conv_id: result}."""
    kept, out = {}, {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        group = kept.setdefault(c, [])
        if hit:
            x = "" if hit == 1 else x.translate({ord(z): None for z in ".!?"}) if hit == 2 else x
            group += [(t is not None, t or 0, "user" if hit == 4 else r, x)] * (2 if hit == 3 else 1)
    for c, group in kept.items():
        group.sort()
        turns = {t for some, t, *_ in group if some}
        counts, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        best = {"": (0, "", ())}                       # state: cost, audit, lines
        put = lambda to, s, v: to.__setitem__(s, min(to.get(s, v), v))

        def more(best):
            for _ in range(2):
                for s, (cost, audit, lines) in list(best.items()):
                    role = "assistant" if s == "u" else "user"
                    put(best, role[0], (cost + 2, audit + "I", (*lines, role + ":")))
            return best
        for *_, r, x in group:
            fault = "blank" if not x.strip(SPACES) else "duplicate" if (r, x) in seen else None
            if not fault and x.rstrip(SPACES)[-1] not in ".!?":
                fault = "truncated"
            seen.add((r, x))
            if fault:
                counts[fault] += 1
            new = {}
            for s, (cost, audit, lines) in more(best).items():
                put(new, s, (cost + 3, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                late = fault == "truncated"
                if r[:1] and s + r[:1] in ("s", "u", "su", "ua", "au") and (s or r[0] in "su"):
                    put(new, r[0], (cost + late, audit + "K", (*lines, f"{r}:{x}")))
                role = "assistant" if s == "u" else "user"
                put(new, role[0], (cost + late + 2, audit + "R", (*lines, f"{role}:{x}")))
            best = new
        cost, audit, lines = min(v for s, v in more(best).items() if s in ("", "a"))
        bad = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        out[c] = (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), bad, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest(), list(lines))
    return out


def made(seed, n, longest, roles=("system", "user", "assistant", "user", "assistant", None, "tool", "", "s")):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.6 else rng.choice(roles)
            text = rng.choice(["Yes.", "no", "", None, " \n", f"word {rng.randrange(9)}!", "x\x0b?\t", "é…", "why?"])
            rows.append((c if c else None, rng.choice([t, t, t, t + 1, None]), role, text))
    return rows


@pytest.mark.parametrize("seed,n,longest", [(1, 300, 9), (2, 60, 40), (3, 6, 600)])
def test_repair(spark, seed, n, longest, monkeypatch):
    rows = made(seed, n, longest)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", audit string, fault long")
    want = plain(rows)
    damaged = structure.damage(docs)
    found = structure.repair(damaged)
    got = {r.conv_id: tuple(r) for r in found.collect()}
    assert set(got) == {r[0] for r in rows} and got == {c: v[:-1] for c, v in want.items()}
    lines = {}
    for r in structure.repaired_rows(damaged, found).orderBy("conv_id", "position").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {c: v[-1] for c, v in want.items() if v[-1]}


def test_pieces_change_nothing(monkeypatch):
    """Any cut into pieces finds the same audit."""
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "t", rng.choice([None, None, None, "truncated", "blank"]))
                for _ in range(rng.randrange(0, 14))]
        seen = set()
        for piece in (1, 2, 3, 5, 64):
            monkeypatch.setattr(structure, "PIECE", piece)
            one = structure.Repair(1)
            for i, r in enumerate(rows):
                one.add(i, *r)
            seen.add(one.result())
        assert len(seen) == 1


def test_repair_edges(spark):
    """Dropped and empty conversations, an empty table, one very long text, a conversation of thousands of one row."""
    dropped = [c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    long = " " * 400000 + "x" + " " * 400000
    rows = [(c, 0, "user", "Hi.") for c in dropped] + [(7001, 1, "user", long), (7001, 2, "assistant", long + ".")]
    rows += [(7002, None, "user", "Again.")] * 3000 + [(7003, 9007199254740993, "user", "a.")]
    got = {r.conv_id: tuple(r) for r in structure.repair(structure.damage(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = plain(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(got[c] == (c, 0, 0, 0, 0, 0, 0, "", empty) for c in dropped)
    assert all(got[c] == want[c][:-1] for c in (7001, 7002, 7003))
    assert structure.repair(structure.damage(spark.createDataFrame([], SCHEMA))).count() == 0


def test_sql(spark, tmp_path):
    """The DuckDB twin on the given table and on made conversations with nulls, ties and repeats."""
    import duckdb
    from oracle_check import duck
    sql = ent.oracle_sql()["op11_structure"]
    assert " MATCH " in compare(spark, duck("/root/testdata/sf0.01"), "/root/testdata/sf0.01", "op11_structure",
                                ent.queries()["op11_structure"], sql)
    spark.createDataFrame(made(5, 80, 12), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = ent.queries()["op11_structure"](spark, str(tmp_path)).toPandas()
    assert rows_of(got)[1] == rows_of(con.execute(sql).df())[1] and "conversations" in TABLES
