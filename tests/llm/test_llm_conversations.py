"""Conversation repair against every edit there is, and against its SQL."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from helpers import DATA

from rasterlines.llm.conversation_repair import CODES, OP11_SQL, damaged, op11_conversation_repair, repair, repaired_turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, there boolean, _n int, audit string"


def bare(rows):
    return [(c, t, r, x, True, 7, "clash") for c, t, r, x in rows]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying every macro edit of every row and every run at the end."""
    found = faults(rows)
    best = None
    for codes in itertools.product(CODES, repeat=len(rows)):
        for run in ("", "I", "II"):
            made, cost, fine = [], 0, True
            for code, (role, text), fault in [*zip(codes, rows, found, strict=True), (run, (None, None), None)]:
                for edit in code:
                    follows = {"u": "assistant"}.get(made[-1][0][:1] if made else "", "user")
                    if edit == "I":
                        made.append((follows, ""))
                    elif edit == "D":
                        cost += 2
                    else:
                        fine &= fault not in ("blank", "duplicate") and role != ""
                        cost += 5 * (fault == "truncated") + (edit == "R")
                        made.append((follows if edit == "R" else role, text))
                    cost += 5 * (edit == "I")
                    fine &= re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in made)) is not None
            if fine and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made)):
                best = min(best or (10**9,), (cost, "".join(codes) + run, "\n".join(f"{r}:{t}" for r, t in made)))
    return best


def illegal(rows):
    return sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))


def test_codes_are_prefix_free_and_in_string_order():
    assert len(CODES) == 9 and sorted(CODES) == CODES
    assert not any(a != b and b.startswith(a) for a in CODES for b in CODES)


def test_against_every_edit(spark):
    rng, given, talks = random.Random(5), [], {}
    for conv in range(150):
        rows = [(rng.choice(["system", "user", "assistant", "tool", " "]), rng.choice(["Yes.", "No!", "and then", "", " \n", "Why? "])) for _ in range(rng.randrange(5))]
        talks[conv] = rows
        given += [(conv, n, r, t) for n, (r, t) in enumerate(rows)]
    table = spark.createDataFrame(bare(given), SCHEMA)
    found = {r.conv_id: r for r in repair(table).collect()}
    texts = {}
    for r in sorted(repaired_turns(table, repair(table)).collect(), key=lambda r: (r.conv_id, r.position)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, rows in talks.items():
        if not rows:
            assert conv not in found
            continue
        cost, audit, repaired = cheapest(rows)
        r, f = found[conv], faults(rows)
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(repaired.encode()).hexdigest()), rows
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.gaps) == (f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal(rows), 0)
        assert "\n".join(texts.get(conv, [])) == repaired


def test_damage_and_awkward_rows(spark):
    long = "word " * 200_000 + "end."
    given = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "Hi."), (1, 5, "assistant", long), (1, 5, "assistant", long), (1, 9, "", "Über İ!"), (2, 7, None, ""), (2, 7, None, "")]
    given += [(c, t, "user", "A. B? C") for c in range(10, 30) for t in range(20)]
    table = spark.createDataFrame(bare(given), SCHEMA)
    want: dict = {}
    for conv, turn, role, text in given:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        want.setdefault(conv, []).extend([(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1))
    found = {r.conv_id: r for r in repair(damaged(table)).collect()}
    assert set(found) == set(want) and len(found) == 23
    for conv, rows in want.items():
        rows.sort()
        turns = {t for has, t, _, _ in rows if has}
        f = faults([x[2:] for x in rows])
        r = found[conv]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert (r.blank, r.duplicate, r.truncated, r.illegal) == (f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal([x[2:] for x in rows]))
        if len(rows) <= 4:
            cost, audit, repaired = cheapest([x[2:] for x in rows])
            assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(repaired.encode()).hexdigest())


def test_a_conversation_without_rows_left(spark):
    gone = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (r,) = repair(damaged(spark.createDataFrame(bare([(gone, 0, "user", "Hi.")]), SCHEMA))).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(damaged(empty)).collect() == [] and repaired_turns(empty, repair(empty)).collect() == []


def test_a_long_conversation_in_one_piece(spark):
    n = 20_000
    given = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(n)]
    (r,) = repair(spark.createDataFrame(bare(given), SCHEMA)).collect()
    assert r.cost == 0 and r.audit == "K" * n and r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for _, _, a, b in given).encode()).hexdigest()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{DATA}/sf0.01/conversations.parquet'")
    df = op11_conversation_repair(spark, str(DATA / "sf0.01"))
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.sql(OP11_SQL).select(", ".join(df.columns)).fetchall()))
