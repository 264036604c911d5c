"""Fuzzy line deduplication over a whole corpus.

A line's words are its runs of characters other than ASCII punctuation and
white space, in lower case.  Lines of equal words are one node, however short;
lines without a word always stay.

1. SimHash: a line's bits come in blocks of 64.  A block has a pivot, and the
   line's distinct words whose hashes follow it first (five words; three in
   short lines) vote on its bits; the other words weigh nothing there.  So a
   word that is changed moves the few blocks that it votes in, before and
   after, and no other.  One SimHash over all words would not do: of 63 bits
   13 differ, on average, between lines of similarity 0.8.
2. Pigeonhole: edits that don't reach every block leave one as it was, and a
   block is a bucket of its own, so such lines meet.  The ten pivots are spread
   evenly over the hashes.  64 bits are too many for unrelated lines to meet by
   chance; lines meet that have the block's words in common.  Each line of
   a bucket is paired with one of them only, another one in each bucket;
   buckets that a sample shows to be large are dealt out by line, their first
   lines meeting in a second step.
3. Pairs are verified: edit similarity over words, 1 - distance / longer
   length, of at least ``similarity``.  Lines too short for one edit are done.
4. Linked lines give connected groups.  Buckets that still hold lines of several
   groups are joined across groups; those pairs whose sets of words allow the
   similarity are verified, too.
5. Of each group the occurrence with the smallest (doc_id, text hash, line
   number) stays; the others are taken out of their documents.

Only DataFrame expressions are used.  Nulls: a null text stays null; a null
doc_id sorts last when choosing what stays.  Rows of equal doc_id and text are
one document: they keep the same lines.  Empty lines stay.  Other columns stay
as they are; names that start with "_line_" are reserved.  An empty table gives
no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, connected_components, text_key

SIMILARITY = 0.8
#: A bucket of more than about this many lines is dealt out.
BUCKET_LINES = 4096
_SAMPLE = 1 / 64

#: Blocks of a line's SimHash, and where each begins among the word hashes.
BLOCKS = 10
_PIVOTS = [-(1 << 63) + 1 + k * ((1 << 64) // BLOCKS) for k in range(BLOCKS)]
#: Lines of up to LONG_FROM + 4 words have blocks of three words, those of LONG_FROM or more (also) blocks of five.
LONG_FROM = 8
_SEPARATORS = "\t\n\x0b\f\r !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What stands for the words of a pair, in the order of their first places; pairs of more words use 16 times as many characters by hash.
_LETTERS = "".join(map(chr, range(0x100, 0x100 + 4096)))


def _words(line):
    """The hashes of a line's words; the line has a word.

    Runs of separators become one space each, single spaces stay as they are: at a
    space Java splits without a pattern, and no word is empty.  Spark's translate
    makes a string of every character.
    """
    other, every = re.escape(_SEPARATORS.replace(" ", "")), re.escape(_SEPARATORS)
    spaced = F.regexp_replace(F.lower(line), f"[{other}][{every}]*| [{every}]+", " ")
    return F.transform(F.split(F.trim(spaced), " "), lambda w: F.xxhash64(w))


def _majority(votes: list[str]) -> str:
    """Bits that most of three or five numbers have (SQL): full adders over all bits at once."""
    a, b, c = votes[:3]
    carry, one = f"(({a} & {b}) | (({a} ^ {b}) & {c}))", f"({a} ^ {b} ^ {c})"
    if len(votes) == 3:
        return carry
    d, e = votes[3:]
    again, one = f"(({one} & {d}) | (({one} ^ {d}) & {e}))", f"({one} ^ {d} ^ {e})"
    return f"(({carry} & {again}) | (({carry} | {again}) & {one}))"


def _blocks(votes: int) -> str:
    """The blocks (SQL) of ``votes`` words each, from ``_ring``, the hashes in order and the first again, and ``_mixed``, those and the pivots.

    A pivot's place among the hashes is its place in ``_mixed`` less the pivots before it.
    """
    starts = [f"cast(array_position(_mixed, {p}L) as int) - {k + 1}" for k, p in enumerate(_PIVOTS)]
    return "array(" + ", ".join(_majority([f"coalesce(get(_ring, {at} + {i}), 0L)" for i in range(votes)]) for at in starts) + ")"


def _with_blocks(lines: DataFrame) -> DataFrame:
    """``lines`` with ``blocks`` in place of ``_hashes``; n is the number of words.

    Both kinds are made for every line, without a condition, so that generated
    code evaluates what they have in common once.
    """
    pivots = "array(" + ", ".join(f"{p}L" for p in _PIVOTS) + ")"
    lines = lines.withColumn("_sorted", F.sort_array("_hashes"))
    lines = lines.withColumns({"_mixed": F.sort_array(F.concat("_sorted", F.expr(pivots))), "_ring": F.expr("concat(_sorted, slice(_sorted, 1, 4))")})
    lines = lines.withColumns({"_wide": F.expr(_blocks(5)), "_narrow": F.expr(_blocks(3))})
    blocks = F.expr(f"array_distinct(if(n < {LONG_FROM}, _narrow, if(n > {LONG_FROM + 4}, _wide, concat(_wide, _narrow))))")
    return lines.withColumn("blocks", blocks).drop("_hashes", "_sorted", "_mixed", "_ring", "_wide", "_narrow")


def line_occurrences(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """line (hash of the words), doc_id, doc (text hash), nth, n (words) and SimHash blocks of each line with a word.

    Lines in which the similarity allows no edit have no blocks.
    """
    # Made before the lines are, or each line would bring its text along and hash it once more.
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("doc"), F.split("text", "\n").alias("_lines"))
    # A filter on the words would make them twice.
    lines = lines.select("doc_id", "doc", F.posexplode("_lines").alias("nth", "_text")).where(F.ltrim("_text", F.lit(_SEPARATORS)) != "")
    lines = lines.select("doc_id", "doc", "nth", _words(F.col("_text")).alias("words"))
    lines = lines.select(F.xxhash64("words").alias("line"), "doc_id", "doc", "nth", F.size("words").alias("n"), F.array_distinct("words").alias("_hashes"))
    lines, none = _with_blocks(lines), F.expr("cast(array() as array<bigint>)")
    edits = F.floor(F.col("n") * (1 - similarity) + 1e-9)
    return lines.select("line", "doc_id", "doc", "nth", "n", F.when(edits > 0, F.col("blocks")).otherwise(none).alias("blocks"))


def _place():
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc", "nth")


def _bucket_rows(lines: DataFrame) -> DataFrame:
    """A row for each line and bucket; ``x`` is the line mixed with the bucket, which orders each bucket's lines anew."""
    return lines.select("line", "n", F.explode("blocks").alias("bucket")).select("bucket", F.expr("line ^ bucket").alias("x"), "n")


def _star(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its bucket's first line as ``to_x`` and ``to_n``."""
    w = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"to_x": F.first("x").over(w), "to_n": F.first("n").over(w)})


def _lengths(n: str, m: str, similarity: float):
    """Whether these lengths allow the similarity."""
    return F.least(n, m) >= F.greatest(n, m) * (similarity - 1e-9)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it holds few enough items of fixed size."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _made(df: DataFrame, **columns) -> DataFrame:
    """These columns, made once for each row: a later filter isn't moved below the explosion of one row, and so repeats none of them."""
    return df.select(F.explode(F.array(F.struct(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items())))).alias("_made")).select("_made.*")


#: Characters from U+1000 on that four hexadecimal digits write, before the surrogates.
_CODES = 0xC800
#: Characters beyond the first plane.
_PLANES = 1 << 20


def _letters(words: str) -> str:
    """The text that has one character for each number in ``words`` (SQL): by the number itself if that tells those in ``both`` apart, else by its place there, which takes a search for each."""
    own = f"decode(unhex(array_join(transform({words}, w -> hex(pmod(w, {_CODES}L) + 4096L)), '')), 'UTF-16BE')"
    apart = f"size(array_distinct(transform(both, w -> pmod(w, {_CODES}L)))) = size(both)"
    few = f"array_join(transform({words}, w -> get(split('{_LETTERS}', ''), cast(array_position(both, w) as int) - 1)), '')"
    place = f"if(size(both) < {_PLANES}, array_position(both, w), pmod(w, {_PLANES}L) + 1)"
    many = f"decode(unhex(array_join(transform({words}, w -> lpad(hex({place} + 65535L), 8, '0')), '')), 'UTF-32')"
    return f"if({apart}, {own}, if(size(both) <= {len(_LETTERS)}, {few}, {many}))"


def line_words(wanted: DataFrame, lines: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """line, words (their hashes) of the lines in ``wanted``, which are read again at their first place."""
    wanted = scratch.keep(wanted, "wanted")
    n_wanted = wanted.count()
    wanted = _sized(wanted, n_wanted)
    places = lines.join(wanted, "line", "left_semi").select("line", "place.*").groupBy(F.col("doc_id").alias("_line_id"), F.col("doc").alias("_line_doc")).agg(F.collect_list(F.struct("nth", "line")).alias("at"))
    places = scratch.keep(places, "places")
    places = _sized(places, places.agg(F.sum(F.size("at"))).first()[0] or 0)
    found = docs.select("doc_id", "text", text_key().alias("doc")).join(places, F.col("doc_id").eqNullSafe(F.col("_line_id")) & (F.col("doc") == F.col("_line_doc")))
    found = found.select(F.split("text", "\n").alias("split"), F.explode("at").alias("at")).select("at.line", F.expr("split[at.nth]").alias("text"))
    texts = scratch.keep(found.select("line", _words(F.col("text")).alias("words")), "texts")
    # Rows alike in doc_id and text give a line several times.
    return texts if texts.count() <= n_wanted else scratch.keep(texts.dropDuplicates(["line"]), "texts-once")


def _most(x: str, y: str, similarity: float) -> str:
    """The edits (SQL) that the similarity allows between these words."""
    return f"cast(floor({1 - similarity:.6f} * greatest(size({x}), size({y})) + 1e-9) as int)"


def _may_be_alike(x: str, y: str, similarity: float) -> str:
    """Whether (SQL) so few edits can do: each takes away or adds one word at most."""
    most = _most(x, y, similarity)
    return f"abs(size({x}) - size({y})) <= {most} and size(array_except({x}, {y})) <= {most} and size(array_except({y}, {x})) <= {most}"


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of lines whose word edit similarity is high enough; ``texts`` has line, words.

    Pairs of as many words are done if few enough places differ.  The words of
    others become one character each, so the edit distance is that of words; a
    pair of over a million different words has no characters for them all, and
    there they go by hash.
    """
    n_pairs = pairs.count()
    if 2 * n_pairs <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct()), "line", "left_semi")
    both = _sized(pairs, n_pairs).join(texts.select(F.col("line").alias("a"), F.col("words").alias("x")), "a").join(texts.select(F.col("line").alias("b"), F.col("words").alias("y")), "b")
    both = both.where(_may_be_alike("x", "y", similarity)).withColumn("most", F.expr(_most("x", "y", similarity)))
    done = F.expr("size(x) = size(y) and size(array_compact(zip_with(x, y, (v, w) -> if(v = w, null, 1)))) <= most")
    both = _made(both, a="a", b="b", most="most", x="x", y="y", done=done)
    none = F.expr("cast(array() as array<bigint>)")
    both = both.withColumns({c: F.when(F.col("done"), none).otherwise(F.col(c)) for c in ("x", "y")})
    both = _made(both, a="a", b="b", most="most", x="x", y="y", both=F.expr("array_distinct(concat(x, y))"))
    return scratch.keep(both.where(f"levenshtein({_letters('x')}, {_letters('y')}, most) >= 0").select("a", "b"), f"{name}-links")


def line_groups(lines: DataFrame, docs: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """line, component of the lines that have linked lines other than themselves; ``lines`` has line, n, blocks, place."""
    spark = docs.sparkSession
    rows = _bucket_rows(lines)
    # Large buckets by a sample of all lines; this decides only in how many parts a bucket is worked on.
    large = _bucket_rows(lines.where(F.pmod(F.xxhash64("line"), F.lit(round(1 / _SAMPLE))) == 0)).groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(_SAMPLE * BUCKET_LINES)).alias("parts")).where("parts > 1")
    large = scratch.keep(large, "large")
    n_large = large.count()
    if n_large:
        rows = rows.join(_sized(large, n_large), "bucket", "left").withColumn("part", F.pmod("x", F.coalesce("parts", F.lit(1)))).withColumn("dealt", F.col("parts").isNotNull()).drop("parts")
        first = scratch.keep(_star(rows, ["bucket", "part"]).where("x <> to_x or dealt"), "buckets")
        second = _star(first.where("x = to_x and dealt").select("bucket", "x", "n"), ["bucket"])
        paired = first.select("bucket", "x", "n", "to_x", "to_n").union(second.select("bucket", "x", "n", "to_x", "to_n")).where("x <> to_x")
    else:
        paired = scratch.keep(_star(rows, ["bucket"]).where("x <> to_x"), "buckets")
    paired = paired.select("bucket", F.expr("x ^ bucket").alias("line"), "n", F.expr("to_x ^ bucket").alias("to"), "to_n")

    pairs = scratch.keep(paired.where(_lengths("n", "to_n", similarity)).select(F.least("line", "to").alias("a"), F.greatest("line", "to").alias("b")).distinct(), "pairs-1")
    texts = line_words(paired.select("line").union(paired.select("to")).distinct(), lines, docs, scratch)
    links = verified(pairs, texts, similarity, scratch, "first")
    found = scratch.keep(connected_components(spark, links, scratch, "components-1"), "found-1")
    found = _sized(found, found.count())

    # A bucket of one pair is done; a larger one may hold pairs beside those with its first line.
    part = lambda df, c: df.join(found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")), c, "left").withColumn(f"{c}_part", F.coalesce(f"{c}_part", c))
    apart = part(part(paired.select("line", "to").distinct(), "line"), "to").where("line_part <> to_part").select("line", "to")
    mixed = paired.join(apart, ["line", "to"], "left_semi").select("bucket").distinct()
    rows = paired.join(mixed, "bucket", "left_semi")
    rows = rows.select("bucket", "line", "n").union(rows.select("bucket", "to", "to_n")).distinct()
    rows = scratch.keep(part(rows, "line").withColumnRenamed("line_part", "component"), "mixed")
    main = rows.groupBy("bucket", "component").agg(F.count("*").alias("rows")).groupBy("bucket").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.sum("rows").alias("all")).where("all > 2").select("bucket", "main")
    rows = scratch.keep(rows.join(main, "bucket").withColumn("odd", F.col("component") != F.col("main")).drop("main"), "odd")
    # The words that a pair may differ in are held against each other here, so that only pairs that may be alike are made.
    rows = _sized(rows, rows.count()).join(texts, "line")
    odd = rows.where("odd").select("bucket", *(F.col(c).alias(f"x_{c}") for c in ("line", "n", "component", "words")))
    apart = (F.col("x_component") != F.col("component")) & (~F.col("odd") | (F.col("x_line") < F.col("line"))) & _lengths("x_n", "n", similarity)
    cross = odd.join(rows, "bucket").where(apart & F.expr(_may_be_alike("x_words", "words", similarity)))
    cross = cross.select(F.least("x_line", "line").alias("a"), F.greatest("x_line", "line").alias("b")).distinct()
    cross = scratch.keep(cross.join(pairs, ["a", "b"], "left_anti"), "pairs-2")
    if cross.isEmpty():
        return found.withColumnRenamed("node", "line")
    links = links.union(verified(cross, texts, similarity, scratch, "second"))
    return connected_components(spark, links, scratch, "components-2").withColumnRenamed("node", "line")


def dedup_lines(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """The columns of ``docs`` with the lines taken out of ``text``, and n_lines, n_removed (null text: 0)."""
    occurrences = scratch.keep(line_occurrences(docs, similarity), "occurrences")
    lines = scratch.keep(occurrences.groupBy("line").agg(F.first("n").alias("n"), F.first("blocks").alias("blocks"), F.min(_place()).alias("place"), F.count("*").alias("copies")), "lines")
    groups = scratch.keep(line_groups(lines.drop("copies"), docs, similarity, scratch), "groups")
    groups = _sized(groups, groups.count())
    # Only lines with another occurrence or a linked line can lose any.
    lines = lines.drop("blocks").join(groups, "line", "left").where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "line"))
    kept = lines.groupBy("component").agg(F.min("place").alias("kept"))
    removed = lines.select("line", "component").join(kept, "component").select("line", "kept").join(occurrences.drop("blocks"), "line").where(~_place().eqNullSafe(F.col("kept")))
    removed = removed.groupBy(F.col("doc_id").alias("_line_id"), F.col("doc").alias("_line_doc")).agg(F.sort_array(F.collect_set("nth")).alias("_line_removed"))
    removed = scratch.keep(removed, "removed")
    removed = _sized(removed, removed.agg(F.sum(F.size("_line_removed"))).first()[0] or 0)
    key = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_line_id")) & (text_key() == F.col("_line_doc"))
    joined = docs.join(removed, key, "left").drop("_line_id", "_line_doc").withColumn("_line_removed", F.coalesce("_line_removed", F.expr("cast(array() as array<int>)"))).withColumn("_line_split", F.split("text", "\n"))
    left = F.filter("_line_split", lambda x, i: ~F.array_contains(F.col("_line_removed"), i))
    joined = joined.withColumns({"text": F.when(F.size("_line_removed") == 0, F.col("text")).otherwise(F.array_join(left, "\n")), "n_lines": F.coalesce(F.size("_line_split"), F.lit(0)).cast("bigint"), "n_removed": F.size("_line_removed").cast("bigint")})
    return joined.withColumn("n_lines", F.greatest("n_lines", F.lit(0))).drop("_line_removed", "_line_split")


def without_repeated_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The columns of ``docs`` with repeated lines taken out; a document of which no word is left goes."""
    found = dedup_lines(docs, scratch)
    found = found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return found.select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint"), "text")
    return dedup_lines(docs, Scratch(spark, "line-dedup"))
