"""Sharding, toxicity, fixity, quality, licences and lines against brute force and planted cases."""

from __future__ import annotations

import bisect
import gzip
import random
import re
import zlib
from collections import Counter

import pytest
from helpers import AWKWARD, DATA, table, words_of
from pyspark.sql import functions as F

from rasterlines.llm import line_dedup
from rasterlines.llm.common import Scratch
from rasterlines.llm.hilbert_shards import cut_runs, hilbert_index, shard_documents, shard_files, shard_ranges
from rasterlines.llm.license_scan import Scanner, find_notices
from rasterlines.llm.line_dedup import dedup_lines, line_occurrences, without_repeated_lines
from rasterlines.llm.quality_rules import estimate, judge, posterior, rule_votes, with_counts
from rasterlines.llm.queries import QUERIES
from rasterlines.llm.toxicity import ToxicityModel
from rasterlines.llm.warc_fixity import audit, merkle_tree, read_warc, record_spans

SMALL = str(DATA / "sf0.001")


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (3, 3)])
def test_curve_visits_every_cell_in_unit_steps(spark, dims, bits):
    names = [f"d{k}" for k in range(dims)]
    cells = spark.range(1 << dims * bits).select(*(F.expr(f"cast(shiftright(id, {k * bits}) & {(1 << bits) - 1} as int)").alias(n) for k, n in enumerate(names)))
    path = [tuple(r[n] for n in names) for r in hilbert_index(cells, names, bits, "at").orderBy("at").collect()]
    assert len(set(path)) == 1 << dims * bits
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("n", [0, 3, 11])
def test_runs_are_even_and_slots_gapless(spark, n):
    rows = cut_runs(spark.range(n).selectExpr("id % 2 cell", "id"), ["cell", "id"], 4, Scratch(spark, "r")).collect()
    by = Counter(r["shard"] for r in rows)
    assert len(rows) == n and (not n or max(by.values()) - min(by.get(s, 0) for s in range(4)) <= 1)
    assert all(sorted(r.slot for r in rows if r["shard"] == s) == list(range(by[s])) for s in by)


def test_shards_of_awkward_rows_and_files(spark, tmp_path):
    docs = table(spark, AWKWARD)
    rows = shard_documents(docs, 5, Scratch(spark, "s"))
    want = sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in AWKWARD)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows.collect()) == want
    assert shard_ranges(rows).agg(F.sum("rows")).first()[0] == len(AWKWARD)
    shard_files(docs, 5, Scratch(spark, "s"), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(repr, back.drop("shard").select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))


def test_rows_alike_take_their_own_places_in_files(spark, tmp_path):
    alike = [(7, "the same text"), (None, None)] * 20 + [(k, f"text {k}") for k in range(7)]
    docs = table(spark, alike).withColumn("shard", F.lit("mine"))
    shard_files(docs, 5, Scratch(spark, "s"), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(r["count"] for r in back.groupBy("_shard").count().collect()) == [9, 9, 9, 10, 10]
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))


def test_null_dimensions_take_the_lowest_step(spark):
    docs = spark.createDataFrame([(k, f"text {k}", None if k % 3 == 0 else f"l{k}", None if k % 4 == 0 else f"s{k}") for k in range(200)], "doc_id bigint, text string, lang string, source string")
    for r in shard_documents(docs, 5, Scratch(spark, "s")).collect():
        assert (r.doc_id % 3 or r.lang_step == 0) and (r.doc_id % 4 or r.source_step == 0)


def test_shards_prune_by_each_dimension(spark):
    rows = QUERIES["op3_hilbert_shards"](spark, SMALL)
    assert rows.select("shard").distinct().count() == 40
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "source")
    spread = rows.join(docs, "doc_id").groupBy("shard").agg(F.count_distinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    assert spread < docs.select("lang").distinct().count()


def test_toxicity_on_held_out_rows(spark):
    sf = str(DATA / "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op4_toxicity"](spark, sf).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    kept_out = [r for r in rows if r.held_out]
    accuracy = sum(r.predicted == r.toxic for r in kept_out) / len(kept_out)
    usual = max(Counter(r.toxic for r in kept_out).values()) / len(kept_out)
    assert accuracy > max(0.9, usual)


def test_toxicity_of_awkward_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = ToxicityModel.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scored = model.score(table(spark, AWKWARD))
    assert scored.columns == [*table(spark, []).columns, "toxicity"]
    assert all(0 <= r.toxicity <= 1 for r in scored.collect()) and scored.count() == len(AWKWARD)
    assert model.score(table(spark, [])).collect() == []
    unlabelled = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    assert {r.toxicity for r in ToxicityModel.learn(docs, unlabelled).score(docs).collect()} == {0.0}


def test_sampling_leaves_the_prior_of_toxicity(spark):
    rng = random.Random(9)
    toxic = [i % 10 == 0 for i in range(2500)]
    texts = [" ".join([*words_of(12, rng, 40), *(rng.choice(["vileword", "nastyword", "foulword"]) for _ in range(3) if rng.random() < (0.5 if y else 0.15)), *words_of(8, rng, 40)]) for y in toxic]
    docs = table(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id bigint, toxic int")
    means = {n: ToxicityModel.learn(docs, labels, per_class=n).score(docs).agg(F.avg("toxicity")).first()[0] for n in (10**6, 150)}
    assert all(abs(m - 0.1) < 0.03 for m in means.values()), means


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(spark):
    rng = random.Random(3)
    rows = AWKWARD + [(20 + i, "".join(rng.choice(["a ", "b ", "c\n", "#", "\U0001f600 ", " ", " \n\n", "\x1c"]) for _ in range(rng.randrange(80)))) for i in range(60)]
    found = with_counts(table(spark, rows).drop("n_words")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == sorted((str(d), *counts(t)) for d, t in rows)


def test_quality_verdicts(spark):
    rng = random.Random(4)
    good = [(1000 + i, "\n".join(" ".join("".join(rng.choices("aeioulmnrst", k=rng.randrange(3, 9))) for _ in range(12)).capitalize() + "." for _ in range(10))) for i in range(80)]
    bad = [(100 + i, "BUY!!! NOW!!! $$$ ### 100%% " * 3 + " ".join(f"DEAL{rng.randrange(10**6)}!! $$" for _ in range(40))) for i in range(20)]
    found = {r.doc_id: r for r in judge(table(spark, good + bad + AWKWARD[2:5]), Scratch(spark, "q")).collect()}
    assert all(found[d].kept for d, _ in good) and not any(found[d].kept for d, _ in bad)
    assert all(found[d].base_failed and not found[d].kept for d in (2, 3, 4))
    assert judge(table(spark, []), Scratch(spark, "q")).collect() == []


RATES = [(0.9, 0.98), (0.7, 0.95), (0.6, 0.9), (0.85, 0.99), (0.33, 0.67), (0.5, 0.97)]


def test_em_recovers_the_accuracies_of_rules(spark):
    """The fifth rule accuses good and bad documents alike: it gets no weight, and documents that it alone accuses are kept."""
    rng, rows = random.Random(12), []
    for _ in range(20000):
        good = rng.random() < 0.8
        rows.append([0 if rng.random() < 0.2 else 1 if (rng.random() < r[1]) == good and good or not good and rng.random() >= r[0] else -1 for r in RATES])
    names = [f"r{k}" for k in range(len(RATES))]
    patterns = spark.createDataFrame([(*k, n) for k, n in Counter(map(tuple, rows)).items()], ", ".join(f"{n} int" for n in names) + ", n bigint")
    accuracies, prior = estimate(patterns, names)
    assert abs(prior - 0.8) < 0.02
    assert all(abs(x - y) < 0.05 for n, want in zip(names, RATES, strict=True) for x, y in zip(accuracies[n], want, strict=True)), accuracies
    alone = patterns.where("r4 = -1 and r0 = 1 and r1 = 1 and r2 = 1 and r3 = 1 and r5 = 1").withColumn("p", posterior(accuracies, prior)).first()
    assert alone.p > 0.5


def test_quality_of_labelled_documents(spark):
    sf = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect()}
    rules = list(rule_votes())
    for votes in ({}, {"digits": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, -1).otherwise(F.col("digits"))}):
        scratch = Scratch(spark, "q")
        voted = scratch.keep(with_counts(docs.select("doc_id", "text")).withColumns(rule_votes()).withColumns(votes), "v")
        accuracies, prior = estimate(voted.groupBy(*rules).agg(F.count("*").alias("n")), rules)
        found = voted.withColumn("quality", posterior(accuracies, prior)).collect()
        right = {y: [r for r in found if labels.get(r.doc_id) == y] for y in (0, 1)}
        assert sum(r.quality < 0.5 for r in right[0]) >= 0.9 * len(right[0])
        assert sum(r.quality >= 0.5 for r in right[1]) >= 0.97 * len(right[1])
        passing = {r.doc_id for r in found if all(r[x] >= 0 for x in rules)}
        assert any(r.quality >= 0.5 and r.doc_id not in passing for r in found)


def test_the_quality_query_on_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op6_quality_rules"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_of_awkward_rows(spark):
    found = judge(table(spark, AWKWARD), Scratch(spark, "q")).collect()
    assert len(found) == len(AWKWARD) and sum(r.doc_id is None for r in found) == 2
    twice = [r.asDict() for r in found if r.doc_id == 6]
    assert twice[0] == twice[1] and all(r.base_failed for r in found if r.n_words < 50)


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def test_license_base_counts(spark):
    rng = random.Random(6)
    pieces = ["CC-BY", "cc", "by", "General Public", "license", "all rights", "Reserved.", "é", "all rights reserved", "x"]
    rows = AWKWARD + [(100 + i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(30)))) for i in range(80)]
    want = []
    for d, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        want.append((str(d), len(words), places))
    found = find_notices(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, sorted((p.first_word, p.label) for p in r.phrases)) for r in found) == sorted(want)


def test_license_notices_with_edits(spark):
    text = "Some text. Licensed undr the Apachee License, Version 2.0 and more; Permision is hereby granted, free of charge, to any person."
    row = find_notices(table(spark, [(1, text), (2, "Nothing of that kind stands here at all.")])).orderBy("doc_id").collect()
    assert [(n.label, n.edits) for n in row[0].notices] == [("apache-2.0", 2), ("mit", 1)] and row[1].notices == []
    first = row[0].notices[0]
    assert text.encode()[first.start : first.end].decode() == "Licensed undr the Apachee License, Version 2.0"
    edited = Scanner(phrases=(), notices=(("all rights reserved", "reserved"),))
    for k in range(len("all rights reserved")):
        assert edited.scan(" all rights reserved "[: k + 1] + "#" + " all rights reserved "[k + 2 :])[1], k
    assert find_notices(table(spark, [])).collect() == []


def blocks(hashes, votes):
    """Of each block the majority, bit by bit, of the first hashes from its pivot on (signed order, going round)."""
    ring = sorted(hashes)
    out = set()
    for pivot in line_dedup._PIVOTS:
        at = bisect.bisect_left(ring, pivot)
        voting = [(ring + ring[:4])[at + i] if at + i < len(ring) + 4 and at + i < len(ring + ring[:4]) else 0 for i in range(votes)]
        value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in voting) > votes)
        out.add(value - (1 << 64) if value >> 63 else value)
    return out


def test_simhash_blocks_are_majorities_of_word_hashes(spark):
    rng = random.Random(7)
    rows = [(n, " ".join(words_of(n, rng, 10**6))) for n in (5, 6, 7, 8, 10, 12, 13, 40, 63, 400, 3000)] + [(9, "a b a b c\td\x0be  F f"), (3, "only three words"), (4, "one of four words")]
    hashes = {r.doc_id: set(r.h) for r in table(spark, rows).select("doc_id", F.expr(r"transform(split(trim(regexp_replace(lower(text), '\\s+', ' ')), ' '), w -> xxhash64(w)) h")).collect()}
    for r in line_occurrences(table(spark, rows)).collect():
        want = set() if r.n < 5 else (blocks(hashes[r.doc_id], 5) if r.n >= 8 else set()) | (blocks(hashes[r.doc_id], 3) if r.n <= 12 else set())
        assert set(r.blocks) == want and len(r.blocks) == len(want)


def test_a_text_is_hashed_once_and_not_for_each_line(spark):
    plan = line_occurrences(table(spark, [(1, "a line of words\nand one more")]))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate ")
    assert "xxhash64(coalesce(text" in below and "xxhash64(coalesce(text" not in above


def test_words_lie_between_separators_of_any_kind(spark):
    seps = line_dedup._SEPARATORS.replace("\n", "")
    rng = random.Random(4)
    texts = ["".join(rng.choice([rng.choice(seps), " ", "  ", "aB\u00dc", "\u03a3x", "\u0085y", "z"]) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    want = {k: n for k, x in enumerate(texts) if (n := len(re.sub(f"[{re.escape(seps)}]", " ", x).split(" ")) - re.sub(f"[{re.escape(seps)}]", " ", x).split(" ").count(""))}
    assert {r.doc_id: r.n for r in line_occurrences(table(spark, list(enumerate(texts)))).collect()} == want


def edit_distance(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
        before = row
    return before[-1]


def similar_pairs(lines):
    """All pairs of different lines (tuples of words) of similarity 0.8 or more, by brute force over those that can share enough words."""
    out = []
    counts = [Counter(x) for x in lines]
    by_word = {}
    for k, x in enumerate(lines):
        for w in set(x):
            by_word.setdefault(w, []).append(k)
    for k, x in enumerate(lines):
        most = len(x) // 5
        rare = sorted(x, key=lambda w: (len(by_word[w]), w))[: most + 1]  # one of these, of the longer line, is in both
        for j in {j for w in rare for j in by_word[w] if (len(lines[j]), j) < (len(x), k)}:
            if len(x) - sum((counts[k] & counts[j]).values()) <= most and edit_distance(x, lines[j], most) <= most:
                out.append((j, k))
    return out


def groups_of(spark, docs):
    """line hash -> group, and (doc_id, line number) -> line hash."""
    scratch = Scratch(spark, "g")
    occurrences = scratch.keep(line_occurrences(docs), "o")
    lines = scratch.keep(occurrences.groupBy("line").agg(F.first("n").alias("n"), F.first("blocks").alias("blocks"), F.min(line_dedup._place()).alias("place")), "l")
    groups = {r.line: r.component for r in line_dedup.line_groups(lines, docs, 0.8, scratch).collect()}
    return groups, {(r.doc_id, r.nth): r.line for r in occurrences.collect()}


def test_similar_lines_of_the_documents_are_found(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    groups, place = groups_of(spark, docs)
    words, lines = {}, {}
    for r in docs.collect():
        for nth, x in enumerate((r.text or "").split("\n")):
            if (r.doc_id, nth) in place:
                words[tuple(re.sub(f"[{re.escape(line_dedup._SEPARATORS)}]", " ", x.lower()).split())] = place[r.doc_id, nth]
    lines = list(words)
    pairs = similar_pairs(lines)
    assert len(pairs) > 300
    for low, high in ((1, 20), (20, 60), (60, 10**9)):
        own = [(words[lines[j]], words[lines[k]]) for j, k in pairs if low <= len(lines[k]) < high]
        assert own and sum(groups.get(a, a) == groups.get(b, b) for a, b in own) >= 0.9 * len(own), (low, len(own))
    # Groups hold only lines that a chain of such pairs connects.
    parent = {h: h for h in words.values()}
    for j, k in pairs:
        a, b = words[lines[j]], words[lines[k]]
        old, new = parent[a], parent[b]
        parent = {h: new if p == old else p for h, p in parent.items()} if old != new else parent
    by_group = {}
    for h, g in groups.items():
        by_group.setdefault(g, set()).add(parent[h])
    assert all(len(x) == 1 for x in by_group.values())


#: Words of a line, how many of them are replaced, and the share of such pairs that must be found.
REPLACED = [(10, 1, 0.9), (14, 1, 0.9), (20, 1, 0.95), (20, 3, 0.85), (30, 6, 0.6), (60, 1, 0.95), (60, 6, 0.9), (60, 12, 0.6), (100, 10, 0.9)]


def test_lines_with_replaced_words_are_found(spark):
    rng, rows = random.Random(3), []
    for c, (n, replaced, _) in enumerate(REPLACED):
        for i in range(100):
            words = words_of(n, rng, 10**9)
            other = list(words)
            for k in rng.sample(range(n), replaced):
                other[k] = f"other{rng.randrange(10**9)}"
            rows += [(1000 * c + 2 * i, " ".join(words)), (1000 * c + 2 * i + 1, " ".join(other))]
    groups, place = groups_of(spark, table(spark, rows))
    for c, (n, replaced, least) in enumerate(REPLACED):
        found = sum(groups.get(place[1000 * c + 2 * i, 0], 0) == groups.get(place[1000 * c + 2 * i + 1, 0], 1) for i in range(100))
        print(n, replaced, found)
        assert found >= 100 * least, (n, replaced, found)


def test_the_query_takes_out_the_occurrences_after_the_first(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    groups, place = groups_of(spark, docs)
    first = {}
    keys = {r.doc_id: r.doc for r in line_occurrences(docs).select("doc_id", "doc").distinct().collect()}
    for (d, nth), line in place.items():
        g = groups.get(line, line)
        first[g] = min(first.get(g, (d, keys[d], nth)), (d, keys[d], nth))
    for r in QUERIES["op9_line_dedup"](spark, SMALL).join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id").collect():
        lines = (r.whole or "").split("\n") if r.whole is not None else []
        left = [x for nth, x in enumerate(lines) if (r.doc_id, nth) not in place or first[groups.get(place[r.doc_id, nth], place[r.doc_id, nth])] == (r.doc_id, keys[r.doc_id], nth)]
        assert r.n_lines == len(lines) and r.n_removed == len(lines) - len(left) and (r.whole is None or r.text == "\n".join(left))


def test_lines_keep_one_of_each_group(spark):
    rng = random.Random(8)
    lines = [" ".join(words_of(60, rng, 10**6)) for _ in range(12)]
    near = [" ".join("changed" if i == 6 else w for i, w in enumerate(x.split())) for x in lines]
    rows = [(i, "\n".join([lines[i % 12], "short line", f"only here {' '.join(words_of(9, rng, 10**6))}", "", near[(i + 5) % 12], lines[(i + 3) % 12].upper()])) for i in range(36)]
    found = dedup_lines(table(spark, rows), Scratch(spark, "l")).orderBy("doc_id").collect()
    kept = Counter(x.lower() for r in found for x in r.text.split("\n"))
    assert all(kept[a] + kept[b] == 1 for a, b in zip(lines, near, strict=True))
    assert kept["short line"] == 1 and sum(x.startswith("only here") for x in kept) == 36
    assert all(r.n_lines == 6 and r.n_removed == 6 - len(r.text.split("\n")) for r in found if r.text)


def test_lines_equal_but_for_punctuation_are_one(spark):
    words = "this page was made by the same people as before".split()
    rows = [(1, " ".join(words)), (2, " ".join(f"({w})," if i % 3 == 0 else w for i, w in enumerate(words)) + "!"), (3, "-".join(words).upper())]
    found = dedup_lines(table(spark, rows), Scratch(spark, "l")).orderBy("doc_id").collect()
    assert [r.text for r in found] == [rows[0][1], "", ""]


def test_short_lines_are_matched_exactly(spark):
    rows = [(i, f"Share this page\nmy number {i}\n---\nmenu") for i in range(1, 9)]
    found = without_repeated_lines(table(spark, rows), Scratch(spark, "l")).orderBy("doc_id").collect()
    assert [r.text for r in found] == [rows[0][1], *(f"my number {i}\n---" for i in range(2, 9))]


def test_lines_of_awkward_rows(spark):
    rows = dedup_lines(table(spark, AWKWARD), Scratch(spark, "l"))
    assert rows.columns == [*table(spark, []).columns, "n_lines", "n_removed"]
    by = {}
    for r in rows.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [r.text for r in by[6]] == ["Same row twice, word for word, in every column."] * 2 and by[7][0].text == ""
    assert by[1][0].text is None and by[1][0].n_lines == 0 and by[5][0].n_removed == 0 and by[3][0].text == AWKWARD[3][1]
    left = without_repeated_lines(table(spark, AWKWARD), Scratch(spark, "l"))
    assert left.columns == table(spark, []).columns and left.count() == len(AWKWARD) - 1
    assert dedup_lines(table(spark, []), Scratch(spark, "l")).collect() == []


def warc(path, pages, compress):
    out = b""
    for k, body in enumerate(pages):
        record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{k}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        out += gzip.compress(record) if compress else record
    path.write_bytes(out)
    return out


@pytest.mark.parametrize("compress", [False, True])
def test_audit_finds_the_damaged_record(spark, tmp_path, compress):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    rng = random.Random(2)
    for f in range(3):
        pages = [rng.randbytes(rng.randrange(400)) for _ in range(50)]
        warc(tmp_path / f"a/{f}.warc", pages, compress)
        if f == 1:
            pages[17] = pages[17][::-1] + b"!"
        warc(tmp_path / f"b/{f}.warc", pages, compress)
    trees = [merkle_tree(read_warc(spark, f"file://{tmp_path}/{x}"), Scratch(spark, "w"), "t", 4) for x in "ab"]
    assert trees[0][0].count() == 150 and [t[-1].count() for t in trees] == [3, 3]
    found = audit(*trees, Scratch(spark, "w"), 4).collect()
    assert [(r.file, r.nth, r.finding) for r in found] == [("1.warc", 17, "changed")]
    (tmp_path / "b/2.warc").unlink()
    missing = audit(trees[0], merkle_tree(read_warc(spark, f"file://{tmp_path}/b"), Scratch(spark, "w"), "t", 4), Scratch(spark, "w"), 4)
    assert Counter((r.file, r.finding) for r in missing.collect()) == {("1.warc", "changed"): 1, ("2.warc", "missing"): 50}


def test_damaged_bytes_are_one_record_to_the_end(spark, tmp_path):
    whole = warc(tmp_path / "x.warc", [b"a", b"bb", b"ccc"], False)
    (tmp_path / "x.warc").write_bytes(whole.replace(b"Content-Length: 2", b"Content-Length: x"))
    spans = sorted((r.begin, r.end) for r in read_warc(spark, f"file://{tmp_path}").collect())
    assert len(spans) == 2 and spans[-1][1] == len(whole)


def test_a_damaged_member_leaves_the_others(tmp_path):
    rng = random.Random(5)
    whole = warc(tmp_path / "x.warc.gz", [rng.randbytes(40) + b"text " * 30 for _ in range(4)], True)
    spans = list(record_spans(whole))
    assert len(spans) == 4 and spans[-1][1] == len(whole)
    begin, end = spans[1]
    for bit in range(8 * begin, 8 * end):
        damaged = bytearray(whole)
        damaged[bit // 8] ^= 1 << bit % 8
        assert list(record_spans(bytes(damaged))) == spans, bit
    assert list(record_spans(whole[: spans[2][1] - 9])) == [*spans[:2], (spans[2][0], spans[2][1] - 9)]


@pytest.mark.parametrize("n", [5, 4096, 6000])
def test_words_of_a_pair_are_told_apart_however_many(spark, n):
    from rasterlines.llm.line_dedup import _letters

    x = [k << 16 for k in range(n)]  # alike in their last bits
    y = x[:2] + x[3:-1] + [-1]
    d = spark.createDataFrame([(x, y)], "x array<bigint>, y array<bigint>").withColumn("both", F.array_distinct(F.concat("x", "y")))
    assert tuple(d.selectExpr(f"length({_letters('x')})", f"length({_letters('y')})", f"levenshtein({_letters('x')}, {_letters('y')})").first()) == (n, n - 1, 2)


def test_unlike_lines_of_a_bucket_are_not_written_as_pairs(spark, monkeypatch):
    """Versions of a line with a sixth of the words replaced share buckets, but hardly any two are similar."""
    rng, rows = random.Random(5), []
    base = [f"w{i}" for i in range(80)]
    for k in range(60):
        text = list(base)
        for i in rng.sample(range(80), 13):
            text[i] = f"new{k}x{i}"
        rows.append((k, " ".join(text)))
    made, keep = {}, Scratch.keep

    def counted(self, df, name, compression=None):
        kept = keep(self, df, name, compression)
        made[name] = kept.count()
        return kept

    monkeypatch.setattr(Scratch, "keep", counted)
    found = dedup_lines(table(spark, rows), Scratch(spark, "l"))
    assert made["mixed"] > 60 and made["pairs-2"] <= 60
    assert found.where("n_removed > 0").count() == 0


def test_shifted_and_replaced_words_are_judged_alike(spark):
    """Pairs of as many words are judged by places first, but moved words must not hide a similar pair."""
    base = [f"w{i}" for i in range(40)]
    alike = {1: base, 2: ["first", *base[:-1]], 3: [*base[:10], "x", *base[11:]], 4: [*base[1:20], "y", *base[20:]], 5: base[::-1]}
    lines = spark.createDataFrame([(k, [hash(w) % 10**9 for w in words]) for k, words in alike.items()], "line bigint, words array<bigint>")
    pairs = spark.createDataFrame([(1, k) for k in alike if k > 1], "a bigint, b bigint")
    links = line_dedup.verified(pairs, lines, 0.8, Scratch(spark, "v"), "t")
    assert {r.b for r in links.collect()} == {2, 3, 4}
