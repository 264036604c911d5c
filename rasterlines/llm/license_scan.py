"""Licence notices: exact phrases, and short notices with a bounded number of edits.

Words are runs of digits, ASCII letters (A-Z in lower case) and all characters
beyond ASCII; a text is searched as its words with one space between them.

Each notice may differ by up to one edit (a character inserted, dropped or
replaced) in eight characters.  It is split into one more piece than edits
allowed, so any match holds one piece unchanged (pigeonhole).  One Aho-Corasick
pass finds all pieces and phrases; around each piece with enough of the
notice's trigrams the regex library's bounded-error matching verifies the
notice and reports its edits and span.  Of
notices that overlap the closest stays.

Nulls: a null text counts as empty; a null doc_id stays.  Repeated rows give
repeated results.  Texts of any length are searched whole.  Other columns are
ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .common import limit_batches
from .decontamination import text_words

#: Phrases that count word for word.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices searched with edits.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person", "mit"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("eclipse public license version 2 0", "epl-2.0"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero public domain dedication", "cc0"),
    ("this work is in the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
)
#: Characters of a notice for each edit allowed.
CHARACTERS_PER_EDIT = 8

_SPAN = "struct<label:string,first_word:bigint,last_word:bigint,start:bigint,end:bigint,edits:int,strength:double>"
_FOUND = f"doc_id bigint, n_words bigint, phrases array<{_SPAN}>, notices array<{_SPAN}>"


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES, per_edit: int = CHARACTERS_PER_EDIT):
        import ahocorasick

        self.notices = []
        seeds: dict[str, list[tuple]] = {}
        for text, label in phrases:
            seeds.setdefault(f" {text} ", []).append(("phrase", text, label))
        for k, (text, label) in enumerate(notices):
            edits = len(text) // per_edit
            self.notices.append((text, label, edits, regex.compile(rf"(?e)(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}")))
            cuts = [round(i * len(text) / (edits + 1)) for i in range(edits + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                seeds.setdefault(text[a:b], []).append(("notice", k, a))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[list[tuple], list[tuple]]:
        """(phrases, notices) of a text with one space around each word, as (label, start, end, edits, strength)."""
        phrases, stretches = [], {}
        for last, (n, uses) in self.automaton.iter(text):
            for kind, what, more in uses:
                if kind == "phrase":
                    phrases.append((more, last - n + 2, last, 0, 1.0))
                else:
                    size, edits = len(self.notices[what][0]), self.notices[what][2]
                    begin = last - n + 1 - more - edits
                    stretches.setdefault(what, []).append((max(0, begin), min(len(text), begin + size + 2 * edits)))
        notices = []
        for k, found in stretches.items():
            notice, label, edits, pattern = self.notices[k]
            merged: list[list[int]] = []
            for a, b in sorted(found):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                # An edit spoils three trigrams at most, so a match leaves this many of the notice's in the stretch.
                there = {text[i : i + 3] for i in range(a, b - 2)}
                if sum(notice[i : i + 3] in there for i in range(len(notice) - 2)) < len(notice) - 2 - 3 * edits:
                    continue
                for m in pattern.finditer(text, a, b):
                    n = sum(m.fuzzy_counts)
                    lead = len(m.group()) - len(m.group().lstrip())
                    notices.append((label, m.start() + lead, m.start() + len(m.group().rstrip()), n, 1 - n / len(notice)))
        best: list[tuple] = []  # of notices that overlap, the one of fewest edits for its length
        for x in sorted(notices, key=lambda x: (-x[4], x[1] - x[2], x)):
            at = bisect.bisect(best, x[1], key=lambda y: y[1])  # those in ``best`` don't overlap: only its neighbours can
            if (not at or best[at - 1][2] <= x[1]) and (at == len(best) or x[2] <= best[at][1]):
                best.insert(at, x)
        return sorted(phrases, key=lambda x: x[1:3]), best


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner()


def spaced_texts(low: np.ndarray, offsets: np.ndarray):
    """Each text as its words between single spaces."""
    inside = vectors.ALNUM[low]
    after = np.zeros(len(low), bool)
    after[1:] = inside[:-1]
    keep = inside | after
    kept = np.where(inside, low, np.uint8(32))[keep].tobytes()
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield f" {kept[a:b].decode('utf-8', 'replace').strip(' ')} "


def find_notices(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, and the spans of exact phrases and of notices with edits.

    A span has the numbers of its first and last word (from 0) and byte offsets
    into the text.
    """

    limit_batches(docs.sparkSession)

    def find(batches):
        scanner = _scanner()
        for batch in batches:
            raw, offsets = vectors.column_bytes(batch.column(1))
            for i, j in vectors.slices(offsets):
                own = offsets[i : j + 1] - offsets[i]
                low = vectors.LOWER[raw[offsets[i] : offsets[j]]]
                starts, ends = vectors.word_spans(low, own, vectors.ALNUM)
                bounds = vectors.counts_in(starts, own)
                columns: tuple[list, list] = ([], [])
                for d, text in enumerate(spaced_texts(low, own)):
                    for spans, column in zip(scanner.scan(text), columns, strict=True):
                        out = []
                        gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32) if spans else None
                        for label, a, b, edits, strength in spans:
                            first, last = (int(n) - 1 for n in np.searchsorted(gaps, (a, b)))
                            at = int(bounds[d])
                            out.append({"label": label, "first_word": first, "last_word": last, "start": int(starts[at + first] - own[d]), "end": int(ends[at + last] - own[d]), "edits": edits, "strength": strength})
                        column.append(out)
                kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("strength", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(columns[0], kind), pa.array(columns[1], kind)], ["doc_id", "n_words", "phrases", "notices"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(find, _FOUND)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_notices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("bigint").alias("n_base"),
        F.array_min("phrases.first_word").alias("first_word"),
        F.array_max("phrases.first_word").alias("last_word"),
        joined(F.col("phrases.label")).alias("base_labels"),
        joined(F.concat("phrases.label", "notices.label")).alias("labels"),
        F.coalesce(F.array_max(F.concat("phrases.strength", "notices.strength")), F.lit(0.0)).alias("score"),
    )
