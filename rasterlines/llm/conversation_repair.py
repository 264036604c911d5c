"""Conversation structure repair by a rank-compressed dynamic program.

The rows of a conversation, in the order of their turns, are edited at the
least cost so that the role initials read ``(s?(ua)+)?``: Keep (0), Rerole to
user or assistant (1), Delete (2), Insert an empty user or assistant turn (5);
a truncated turn that stays costs 5 more, a blank or repeated one has to go.
Of equally cheap edits the ones whose initials come first in ASCII are taken.

A macro edit is a run of Inserts and then the edit of one row, written as
``D``, ``ID``, ``IIK`` and so on.  No such code is the beginning of another, and
their order is that of the audit strings, so after any row the strings that
lead to the automaton's four states compare as (rank of the string before, code):
a layer holds a cost, a rank, a parent and a code for each state, never a
string.  A run of three Inserts ends where one does and costs more, so nine
codes are all.  The audit string is read off the parents once the conversation
ends.  The differences of a layer's costs are bounded, so a step is made once
for each (differences, ranks, kind of row) and remembered.

Rows are dealt by conv_id and sorted within the partitions by Spark; a
conversation streams through its task.  The digest of the repaired text is
sequential by its definition, so it is kept for each of the four states and
forked at each row: texts are never collected.  What grows with a conversation
is four bytes and one digest a row, as the audit itself does by a letter.

Nulls: a null role or text counts as one space, in ``damaged`` also a null
conv_id or turn in the key; rows of null conv_id are one conversation, null
turns come first.  Rows of one turn are in the order of role and text.  An
empty role has no initial and can't be kept as it is.  Repeated rows are
duplicates.  Empty texts are blank.  A conversation without rows left gives
zeros, an empty audit and the digest of the empty string.  Other columns are
ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, n_partitions

#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States by what the repaired turns end in: nothing yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that a state lets follow, besides system at the start.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAME = {USER: b"user", ASSISTANT: b"assistant"}
#: Macro edits in the order of their strings.
CODES = sorted("I" * n + edit for n in range(3) for edit in "DKR")
BLANK, DUPLICATE, CUT = 1, 2, 3
_TEXT_END = re.compile(rb"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
SCHEMA = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _moves(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(state, code, cost, state after) of each macro edit of a row."""
    out = []
    for state in range(4):
        for number, code in enumerate(CODES):
            at, cost = state, INSERT * (len(code) - 1)
            for _ in code[:-1]:
                at = _NEXT[at]
            stays = TRUNCATED if fault == CUT else 0
            if code[-1] == "D":
                out.append((state, number, cost + DELETE, at))
            elif fault in (BLANK, DUPLICATE):
                continue
            elif code[-1] == "R":
                out.append((state, number, cost + REROLE + stays, _NEXT[at]))
            elif initial == "s" and at == START:
                out.append((state, number, cost + KEEP + stays, SYSTEM))
            elif initial == {USER: "u", ASSISTANT: "a"}[_NEXT[at]]:
                out.append((state, number, cost + KEEP + stays, _NEXT[at]))
    return out


class Layers:
    """Steps from layer to layer; a layer is (cost above the least, rank) of each state, None where it can't be reached."""

    FIRST = ((0, 0), None, None, None)

    def __init__(self):
        self._moves: dict = {}
        self._steps: dict = {}

    def step(self, layer: tuple, initial: str, fault: int) -> tuple:
        """(layer, cost of its cheapest state, ((state, parent, code), ...))."""
        key = (layer, initial, fault)
        found = self._steps.get(key)
        if found is None:
            found = self._steps[key] = self._made(*key)
        return found

    def _made(self, layer: tuple, initial: str, fault: int) -> tuple:
        moves = self._moves.setdefault((initial, fault), _moves(initial, fault))
        best: dict[int, tuple] = {}
        for state, code, cost, after in moves:
            if layer[state] is not None:
                way = (layer[state][0] + cost, layer[state][1], code, state)
                if after not in best or way < best[after]:
                    best[after] = way
        least = min(way[0] for way in best.values())
        rank = {s: n for n, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        after = tuple((best[s][0] - least, rank[s]) if s in best else None for s in range(4))
        return after, least, tuple((s, way[3], way[2]) for s, way in sorted(best.items()))


def _ending(layer: tuple) -> tuple[int, int, str]:
    """Cost above the layer's least, state and last run of Inserts of the cheapest whole."""
    ends = []
    for state, held in enumerate(layer):
        at = state
        for n in range(3):
            if held is not None and at in (START, ASSISTANT):
                ends.append((held[0] + INSERT * n, held[1], "I" * n, state))
            at = _NEXT[at]
    cost, _, run, state = min(ends)
    return cost, state, run


class Conversation:
    """One conversation's state while its rows stream by."""

    def __init__(self, layers: Layers):
        self.layers, self.layer, self.cost = layers, Layers.FIRST, 0
        self.parents = bytearray()
        self.digests = [hashlib.sha256(), None, None, None]
        self.seen: set[bytes] = set()
        self.counts = [0, 0, 0, 0]
        self.illegal, self.before = 0, None
        self.low = self.high = self.last = None
        self.turns = 0

    def add(self, turn: int | None, role: bytes, text: bytes) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last  # turns are sorted
            self.high = self.last = turn
        initial = role.decode()[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        key = hashlib.blake2b(len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()
        end = _TEXT_END.search(text)
        fault = BLANK if end is None else DUPLICATE if key in self.seen else CUT if end[1] not in b".!?" else 0
        self.seen.add(key)
        self.counts[fault] += 1
        self.layer, cost, ways = self.layers.step(self.layer, initial if initial in ("s", "u", "a") else "", fault)
        self.cost += cost
        pointers, digests = [0, 0, 0, 0], [None] * 4
        for state, parent, code in ways:
            pointers[state] = parent * 16 + code
            digests[state] = self._written(parent, CODES[code], role, text)
        self.digests = digests
        self.parents += bytes(pointers)

    def _written(self, state: int, code: str, role: bytes = b"", text: bytes = b""):
        digest = self.digests[state].copy()
        for edit in code:
            if edit != "D":
                digest.update(b"" if state == START else b"\n")
                made = SYSTEM if edit == "K" and state == START and role[:1] == b"s" else _NEXT[state]
                digest.update(role if edit == "K" else _NAME[made])
                digest.update(b":")
                if edit != "I":
                    digest.update(text)
                state = made
        return digest

    def row(self) -> tuple:
        cost, state, run = _ending(self.layer)
        digest = self._written(state, run).hexdigest()
        codes = [run]
        for at in range(len(self.parents) - 4, -1, -4):
            pointer = self.parents[at + state]
            codes.append(CODES[pointer & 15])
            state = pointer >> 4
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.counts[1:], self.illegal, self.cost + cost, "".join(reversed(codes)), digest)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(``conv_id:turn``) % 20, and ``there``: false for rows that are dropped, which stay so that each conversation does."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), one_space("role").alias("role"), one_space("text").alias("text"), fate.alias("_fate"))
    text = F.when(F.col("_fate") < 2, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_fate") > 0).alias("there"), copies.alias("_copy")).drop("_copy")


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation: its counts, the least cost, the edits and the digest of the repaired turns.

    ``rows`` has conv_id, turn, role, text and optionally ``there``.
    """
    spark = rows.sparkSession
    limit_batches(spark)
    there = F.coalesce(F.col("there"), F.lit(True)) if "there" in rows.columns else F.lit(True)
    given = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), there.alias("there"))
    dealt = given.repartition(n_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def stream(batches):
        layers, current, talk, out = Layers(), None, None, []
        for batch in batches:
            role, text = (batch.column(k).cast(pa.binary()) for k in (2, 3))
            for conv, turn, r, t, present in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), role, text, batch.column(4).to_pylist(), strict=True):
                if talk is None or conv != current:
                    if talk is not None:
                        out.append((current, *talk.row()))
                    current, talk = conv, Conversation(layers)
                if present:
                    talk.add(turn, r.as_py(), t.as_py())
            if out:
                yield _batch(out)
                out = []
        if talk is not None:
            yield _batch([(current, *talk.row())])

    return dealt.mapInArrow(stream, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text, turn (null for inserted ones): the repaired conversations.

    ``repairs`` is what ``repair`` gives for ``rows``.  Each macro edit meets the
    row it edits by the row's number; the roles follow from how many turns are made before.
    """
    from pyspark.sql.window import Window

    if "there" in rows.columns:
        rows = rows.where("there")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    given = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), space("role"), space("text")).withColumn("_n", F.row_number().over(order) - 1)
    edits = repairs.select(F.col("conv_id").alias("_conv"), (F.length(F.translate("audit", "D", "")) % 2).alias("_odd"), F.posexplode(F.expr("regexp_extract_all(audit, '(I*[DKR]|I+$)', 1)")).alias("_at", "_code"))
    made = F.length(F.translate("_code", "D", ""))
    before = Window.partitionBy("_conv").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    edits = edits.withColumn("_made", F.coalesce(F.sum(made).over(before), F.lit(0))).where(made > 0)
    turns = edits.join(given, F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_at") == F.col("_n")), "left")
    each = turns.select("*", F.posexplode(F.split(F.translate("_code", "D", ""), "")).alias("_k", "_edit"))
    position = F.col("_made") + F.col("_k")
    named = F.when((position - F.col("_odd")) % 2 == 0, "user").otherwise("assistant")
    inserted = F.col("_edit") == "I"
    return each.select(
        F.col("_conv").alias("conv_id"),
        position.cast("bigint").alias("position"),
        F.when(F.col("_edit") == "K", F.col("role")).otherwise(named).alias("role"),
        F.when(inserted, "").otherwise(F.col("text")).alias("text"),
        F.when(~inserted, F.col("turn")).alias("turn"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP11_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k
  FROM conversations
),
fated AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::int, 1))::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                               lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::bigint) ELSE x >> 1 END)
    ), 4294967295::bigint) % 20 AS fate
  FROM named
),
rows_left AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM fated WHERE fate > 0
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM rows_left
),
faulty AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated'
              ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
  FROM numbered
),
runs(state, run, after, inserted) AS (
  VALUES ('', '', '', ''), ('', 'I', 'u', E'\nuser:'), ('', 'II', 'a', E'\nuser:\nassistant:'),
         ('s', '', 's', ''), ('s', 'I', 'u', E'\nuser:'), ('s', 'II', 'a', E'\nuser:\nassistant:'),
         ('u', '', 'u', ''), ('u', 'I', 'a', E'\nassistant:'),
         ('a', '', 'a', ''), ('a', 'I', 'u', E'\nuser:')
),
ways AS (
  SELECT conv_id, pos, state, run || edit AS edits, 5 * length(run) + cost AS cost, ending AS state_after, inserted || line AS lines
  FROM (
    SELECT f.conv_id, f.pos, r.*, e.edit,
           CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN f.fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END AS cost,
           CASE e.edit WHEN 'D' THEN r.after WHEN 'R' THEN CASE r.after WHEN 'u' THEN 'a' ELSE 'u' END ELSE f.initial END AS ending,
           CASE e.edit WHEN 'D' THEN '' WHEN 'R' THEN E'\n' || CASE r.after WHEN 'u' THEN 'assistant' ELSE 'user' END || ':' || f.text
                       ELSE E'\n' || f.role || ':' || f.text END AS line
    FROM faulty f, runs r, (VALUES ('D'), ('K'), ('R')) e(edit)
    WHERE (e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
      AND (e.edit <> 'K' OR r.after || '>' || f.initial IN ('>s', '>u', 's>u', 'u>a', 'a>u'))
  )
),
best AS (
  SELECT conv_id, 0::bigint AS pos, '' AS state, 0::bigint AS cost, '' AS audit, '' AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, state, (way).cost, (way).audit, (way).lines FROM (
    SELECT b.conv_id, b.pos + 1 AS pos, w.state_after AS state,
           min({'cost': b.cost + w.cost, 'audit': b.audit || w.edits, 'lines': b.lines || w.lines}) AS way
    FROM best b JOIN ways w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.pos = b.pos + 1 AND w.state = b.state
    GROUP BY ALL
  )
),
counted AS (
  SELECT c.conv_id, count(f.pos) AS n, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0) AS gaps,
         count(*) FILTER (f.fault = 'blank') AS blank, count(*) FILTER (f.fault = 'duplicate') AS duplicate,
         count(*) FILTER (f.fault = 'truncated') AS truncated, count(*) FILTER (f.pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
),
ended AS (
  SELECT c.*, min({'cost': b.cost + 5 * length(r.run), 'audit': b.audit || r.run, 'lines': b.lines || r.inserted}) AS way
  FROM counted c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.pos = c.n JOIN runs r ON r.state = b.state AND r.after IN ('', 'a')
  GROUP BY ALL
)
SELECT conv_id, gaps::bigint AS gaps, blank, duplicate, truncated, illegal, (way).cost::bigint AS cost, (way).audit AS audit,
       sha256(substr((way).lines, 2)) AS repaired_sha256
FROM ended
"""
