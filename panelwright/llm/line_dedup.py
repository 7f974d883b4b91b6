"""Line dedup: lines that repeat an earlier line, exactly or within one edit, are taken out of the documents.

The method is a deletion-neighbourhood join with DataFrame functions only. Two lines are within one edit (a character put in, taken
out or changed) if and only if deleting one character from the longer, or one at the same position from both, gives
equal texts. So every such variant of a line is emitted as a hashed key, equal keys meet, and `levenshtein` verifies each
meeting. To keep the variants short and few, a line is seen as blocks of about the square root of its length: a variant's key is
the hash of what stands before its block, of what stands after it, and of the block without the character. Before that, lines
that share neither half with another line of a fitting length are set aside, then those that share no all-but-one-block with another:
such lines have no partner, so nothing is lost.

Meetings stay linear: all lines under one key with one deleted position are within one edit of each other, so each is compared with the
earliest only; and a shorter line is compared with the longer ones that reduce to it, each of which reduces to it or does not.

What counts as a line: the text between line feeds, trimmed. Blank lines are kept and never compared; all others are, however short (so two
lines of one character each are within one edit). Order is by doc_id (nulls first), then row key, then line number. A line goes if an earlier
line, itself kept or not, is equal or within one edit. Null texts stay null; rows alike in doc_id and text are one
document given twice and are treated alike; an empty table stays empty; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import passing, row_key, saved


def _lines(docs: DataFrame) -> DataFrame:
    """pos (order of a line: null id first, doc_id, row key, number), line (trimmed, not blank) and its 128-bit key a, b."""
    split = docs.select("doc_id", row_key().alias("r"), F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    line = split.select("doc_id", "r", "no", F.trim("raw").alias("line")).filter("line != ''")
    pos = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "r", "no")
    return line.select(pos.alias("pos"), "line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def _part(start: Column, end: Column) -> Column:
    """Characters from start (0-based) to before end."""
    return F.substring(F.col("line"), start + 1, end - start)


def _halves(lines: DataFrame) -> DataFrame:
    """Adds halves: for both lengths t that the longer line of a pair can have, the hash of the first half and of the last part."""
    n = F.length("line")

    def keys(t: Column, name: str) -> list[Column]:
        p = F.floor(t / 2).cast("int")
        return [F.xxhash64(t, F.lit(name), _part(F.lit(0), p)), F.xxhash64(t, F.lit(name + "r"), _part(n - (t - p), n))]

    return lines.withColumn("halves", F.array(*keys(n, "h"), *keys(n + 1, "h")))


def _meeting(keyed: DataFrame, ids: list[str], key: str) -> DataFrame:
    """ids of the rows of `keyed` (one row for each id and key) whose key another row has too."""
    shared = keyed.groupBy(key).agg(F.count("*").alias("k")).filter("k > 1").select(key)
    return keyed.join(shared, key, "left_semi").select(*ids).distinct()


def _block_count(t: Column) -> Column:
    return F.ceil(F.sqrt(t.cast("double"))).cast("int")


def _blocks(lines: DataFrame) -> DataFrame:
    """One row for each line, fitting length t and block: s, e (block in the longer line), key (hash of the rest), own (the line is the longer)."""
    n = F.length("line")
    longer = F.explode(F.array(F.lit(True), F.lit(False))).alias("own")
    out = lines.select("a", "b", "pos", "line", longer).withColumn("t", F.when(F.col("own"), n).otherwise(n + 1))
    out = out.select("*", F.explode(F.sequence(F.lit(0), _block_count(F.col("t")) - 1)).alias("j"))
    edge = lambda j: F.floor(j * F.col("t") / _block_count(F.col("t"))).cast("int")
    out = out.withColumn("s", edge(F.col("j"))).withColumn("e", edge(F.col("j") + 1))
    rest = F.xxhash64("t", "j", _part(F.lit(0), F.col("s")), F.lit("|"), _part(n - (F.col("t") - F.col("e")), n))
    return out.withColumn("key", rest)


def _variants(blocks: DataFrame) -> DataFrame:
    """Adds h (hashed variant) and i (deleted position; -1 where the line is the shorter and nothing is deleted)."""
    n = F.length("line")
    inside = F.when(F.col("own"), F.expr("transform(sequence(s, e - 1), i -> struct(i AS i, xxhash64(key, concat(substring(line, s + 1, i - s), substring(line, i + 2, e - i - 1))) AS h))"))
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.xxhash64("key", _part(F.col("s"), n - (F.col("t") - F.col("e")))).alias("h")))
    return blocks.select("a", "b", "pos", "line", "own", F.explode(F.coalesce(inside, whole)).alias("v")).select("a", "b", "pos", "line", "own", "v.*")


def near_lines(lines: DataFrame) -> DataFrame:
    """a, b of the lines (distinct: a, b, pos, line) that have an earlier line within one edit."""
    blocks = _blocks(lines)
    busy = _meeting(blocks.select("a", "b", "key"), ["a", "b", "key"], "key")
    some = blocks.join(busy, ["a", "b", "key"], "left_semi")
    variants = saved(_variants(some), "variants")
    one_edit = lambda x, y: F.levenshtein(x, y, 1).between(0, 1)
    # Changed characters: one position deleted from both.
    longer = variants.filter("own")
    first = longer.groupBy("h", "i").agg(F.min(F.struct("pos", "line")).alias("first"), F.count("*").alias("k")).filter("k > 1")
    changed = longer.join(first, ["h", "i"]).filter(F.col("pos") > F.col("first.pos")).filter(one_edit(F.col("line"), F.col("first.line"))).select("a", "b")
    # Characters put in or taken out: a longer line reduces to a shorter one.
    shorter = variants.filter("not own").select("h", F.col("pos").alias("pos2"), F.col("line").alias("line2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    pairs = longer.join(shorter, "h").filter(one_edit(F.col("line"), F.col("line2")))
    dropped = pairs.select(F.when(F.col("pos") > F.col("pos2"), F.struct("a", "b")).otherwise(F.struct(F.col("a2").alias("a"), F.col("b2").alias("b"))).alias("d")).select("d.*")
    return changed.union(dropped).distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """a, b (key), pos (where it stands first), near (an earlier line is within one edit): one row for each distinct line."""
    lines = _halves(_lines(docs))
    first = lines.groupBy("a", "b").agg(F.min("pos").alias("pos"), *[F.max(F.col("halves")[k]).alias(f"h{k}") for k in range(4)])
    first = saved(first, "lines")
    halves = first.select("a", "b", F.explode(F.array(*[f"h{k}" for k in range(4)])).alias("half"))
    some = _meeting(halves, ["a", "b"], "half")
    places = saved(first.join(some, ["a", "b"], "left_semi").select("a", "b", "pos"), "places")
    # The lines' words are read again only where a partner is possible; pos names one place of each.
    again = passing(_lines(docs).select("a", "b", "line", "pos"), places, "a")
    # An inner join: a semi-join would be moved to before the filter, and all lines would be shuffled.
    texts = again.join(places, ["a", "b", "pos"]).dropDuplicates(["a", "b"])
    near = near_lines(saved(texts, "texts")).withColumn("near", F.lit(True))
    return first.select("a", "b", "pos").join(near, ["a", "b"], "left").select("a", "b", "pos", F.coalesce("near", F.lit(False)).alias("near"))


def _kept_bits(kept: DataFrame) -> DataFrame:
    """__r and __bits: a bit for each line number of the document that stays, 64 to a word, from line 0 on without a gap."""
    no = F.col("pos.no")
    words = kept.groupBy(F.col("pos.r").alias("__r"), F.floor(no / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos.no % 64)")).alias("bits"))
    known = words.groupBy("__r").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("known"), F.max("word").alias("last"))
    return known.select("__r", F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.col("known")[w], F.lit(0).cast("long"))).alias("__bits"))


def _judged(docs: DataFrame) -> DataFrame:
    """docs with repeated lines out of text, and __lines (not blank) and __removed (both null where text is null)."""
    both = docs.withColumn("__r", row_key()).join(_kept_bits(repeated_lines(docs).filter("not near")), "__r", "left")
    parts = F.split("text", "\n")
    blank = lambda x: F.trim(x) == ""
    bit = lambda i: F.getbit(F.get("__bits", F.floor(i / 64).cast("int")), i % 64) == 1
    stays = F.filter(parts, lambda x, i: blank(x) | F.coalesce(bit(i), F.lit(False)))
    real = lambda x: F.size(F.filter(x, lambda y: ~blank(y))).cast("long")
    out = both.withColumn("__parts", parts).withColumn("__stays", stays)
    counts = {"__lines": real(F.col("__parts")), "__removed": real(F.col("__parts")) - real(F.col("__stays"))}
    known = {name: F.when(F.col("text").isNotNull(), value) for name, value in counts.items()}
    text = F.when(F.col("text").isNotNull(), F.array_join("__stays", "\n"))
    return out.withColumns(known).withColumn("text", text).select(*docs.columns, *counts)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with repeated lines out of text, and n_lines (not blank), n_removed; columns of docs by these names are replaced."""
    own = docs.drop("n_lines", "n_removed")
    return _judged(own).withColumnsRenamed({"__lines": "n_lines", "__removed": "n_removed"})


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out, n_chars brought up to date, and documents of which nothing is left gone."""
    out = _judged(docs)
    emptied = F.coalesce((F.col("__removed") > 0) & (F.col("__removed") == F.col("__lines")), F.lit(False))
    return out.filter(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
