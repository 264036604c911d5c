"""The set joins against brute force and SQL."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
from helpers import AWKWARD, DATA, components, near_copies, shingles, table, words_of

from rasterlines.llm import common, ngram_join
from rasterlines.llm.common import Scratch, connected_components
from rasterlines.llm.decontamination import clean_documents, contamination
from rasterlines.llm.ngram_join import jaccard_components, one_of_each_group
from rasterlines.llm.queries import QUERIES, QUERIES_SQL


@pytest.mark.parametrize("name", sorted(QUERIES_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in (DATA / "sf0.001").glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    found = QUERIES[name](spark, str(DATA / "sf0.001"))
    columns = sorted(found.columns)
    want = con.sql(QUERIES_SQL[name])
    assert sorted(want.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found.collect()) == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.component for r in connected_components(spark, df, Scratch(spark, "c"), "c").collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert connected_components(spark, df.limit(0), Scratch(spark, "c"), "c").collect() == []


def test_stars_are_done_after_one_round(spark, monkeypatch):
    """Each further round is two more tables, and a driver's memory grows with them."""
    written, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, compression=None: written.append(name) or keep(self, df, name, compression))
    df = spark.createDataFrame([(k, k % 3) for k in range(3, 60)] + [(3, 0), (0, 3)], "a bigint, b bigint")
    found = {r.node: r.component for r in connected_components(spark, df, Scratch(spark, "c"), "c").collect()}
    assert found == {k: k % 3 for k in range(60)} and len(written) == 3


def test_the_drivers_garbage_is_collected_every_few_tables(spark):
    """Broadcast tables and shuffle files stay until then."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    scratch, before = Scratch(spark, "c"), full()
    for k in range(2 * common.COLLECT_AFTER):
        scratch.keep(spark.range(1), f"t{k}")
    assert full() >= before + 2


def linked(a, b):
    common = len(a & b)
    return bool(a and b) and 100 * common >= 80 * (len(a) + len(b) - common)


def by_brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    parts = components(sets, linked)
    smallest: dict[int, int | None] = {}
    for (d, _), p in zip(rows, parts, strict=True):
        smallest[p] = min((x for x in (smallest.get(p), d) if x is not None), default=None)
    return sorted((str(d), len(s), str(smallest[p])) for (d, _), s, p in zip(rows, sets, parts, strict=True))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("bucket_bits", [1, 12])
def test_components_of_near_copies(spark, monkeypatch, seed, bucket_bits):
    monkeypatch.setattr(ngram_join, "_BUCKET_BITS", bucket_bits)
    rows = near_copies(seed) + (AWKWARD if seed == 0 else [])
    found = jaccard_components(table(spark, rows), Scratch(spark, "j"), sketch_bits=16).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == by_brute_force(rows)


def test_texts_of_shared_passages_do_not_link_but_their_copies_do(spark):
    rng = random.Random(5)
    passage = words_of(60, rng)
    rows = [(i, " ".join(words_of(90, random.Random(i // 2)) + passage)) for i in range(60)]
    found = jaccard_components(table(spark, rows), Scratch(spark, "j"), sketch_bits=16).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == by_brute_force(rows)


def test_one_of_each_group_stays(spark):
    rows = near_copies(9) + AWKWARD
    kept = one_of_each_group(table(spark, rows), Scratch(spark, "j")).collect()
    sets = [shingles(t) for _, t in rows]
    parts = components(sets, linked)
    assert len(kept) == len({p for p, s in zip(parts, sets, strict=True) if s}) + sum(not s for s in sets)
    assert len({frozenset(shingles(r.text)) for r in kept if shingles(r.text)}) == len([r for r in kept if shingles(r.text)])
    assert one_of_each_group(table(spark, []), Scratch(spark, "j")).collect() == []


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def contaminated(rows, items, window=10):
    out = []
    for doc_id, text in rows:
        words, hits, named = split(text), set(), set()
        places: dict[tuple, list[int]] = {}
        for size in {min(window, len(split(t))) for _, t in items if split(t)}:
            for i in range(len(words) - size + 1):
                places.setdefault(tuple(words[i : i + size]), []).append(i)
        for item, t in items:
            w = split(t)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                for at in places.get(tuple(w[i : i + window]), ()):
                    hits |= set(range(at, at + min(window, len(w))))
                    named.add("null" if item is None else str(item))
        out.append((str(doc_id), len(words), sorted(hits), sorted(named)))
    return sorted(out)


@pytest.mark.parametrize("block_windows", [3, 1 << 18])
def test_windows_of_items_in_documents(spark, block_windows):
    rng = random.Random(1)
    items = [(1, " ".join(words_of(30, rng))), (12, " ".join(words_of(12, rng))), (2, "Short item!"), (3, ""), (4, None), (None, " ".join(words_of(11, rng))), (1, "one"), (5, "x x x x x x x x x x x x")]
    rows = list(AWKWARD) + [(50, "x " * 15), (51, "very SHORT item here"), (52, "short"), (53, "item short item")]
    for i in range(40):
        source = split(rng.choice(items)[1]) or ["none"]
        a = rng.randrange(len(source))
        rows.append((100 + i, ", ".join(words_of(rng.randrange(9), rng) + source[a : a + rng.randrange(1, 20)] + words_of(rng.randrange(9), rng))))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination(table(spark, rows), benchmark, block_windows=block_windows).collect()
    assert sorted((str(r.doc_id), r.n_words, list(r.hits), list(r["items"])) for r in found) == contaminated(rows, items)
    clean = clean_documents(table(spark, rows), benchmark, Scratch(spark, "c")).collect()
    assert sorted(str(r.doc_id) for r in clean) == sorted(d for d, _, h, _ in contaminated(rows, items) if not h)


def test_empty_benchmark_and_empty_documents(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r.hits == [] for r in contamination(table(spark, AWKWARD), none).collect())
    assert contamination(table(spark, []), none).collect() == []
    row = QUERIES["op10_decontamination"](spark, str(DATA / "sf0.001")).where("not contaminated").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
