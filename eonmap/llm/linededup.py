"""Line dedup by content-defined chunks: only DataFrame functions, no Python on the executors.

A text is a row of lines; physical lines are wrapped at the ends of sentences, so that a passage
counts alike whether it stands in many short lines or in a few long ones. A rolling hash over the
hashes of two neighbouring lines chooses the cuts between chunks.
A cut depends on the two lines beside it alone, so a passage is cut alike wherever it stands and
whatever was put in before it.

Cuts seen again anywhere in the corpus (by the hash of their two lines) are held against the first
of them: from the cut outwards, the chunk before and the chunk after are compared with the first's,
line by line and byte by byte. The lines that agree, two at least, are the repeated chunk, and are
removed. So the ends of a passage, whose chunks also hold lines of the surroundings, go as well, and
a passage is left whole only if none of its line pairs is a cut: one pair of three.

Every removed line stands earlier in the corpus, so that the first of all occurrences stays.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eonmap.llm.common import bind, hot_join, materialise, release, row_key

#: Multiplier of the rolling hash over line hashes; any odd value does.
ROLL = 31
#: A pair of lines is a cut if its rolling hash modulo ``DIVISOR`` is less than ``CUTS``.
DIVISOR, CUTS = 3, 2
#: Least characters of a sentence that ends a wrapped line.
SENTENCE = 40
#: Stands between wrapped lines while they are made; a line that holds it is not wrapped.
MARK = "\u0001"
#: A line's end; blank lines belong to the line before.
NEWLINE = r"\n(?![\r\n])"
#: Ends of sentences.
SENTENCE_ENDS = (". ", "! ", "? ", "。", "！", "？")


def lines_of(text: Column) -> Column:
    """The lines of a text. A physical line's first has a line end before it, so that
    ``joined`` restores the exact text. All steps are linear in the length of the text."""
    def logical(line: Column) -> Column:
        wraps = ~F.contains(line, F.lit(MARK))
        # no two ends overlap, so that marks behind each of them in turn are those of one pass
        ended = functools.reduce(lambda s, end: F.replace(s, F.lit(end), F.lit(end + MARK)), SENTENCE_ENDS, line)
        sentences = F.transform(F.split(ended, MARK), lambda s: F.when(F.length(s) >= SENTENCE, F.concat(s, F.lit(MARK))).otherwise(s))
        some = F.when(wraps, F.split(F.rtrim(F.array_join(sentences, ""), F.lit(MARK)), MARK)).otherwise(F.array(line))
        return F.transform(some, lambda s, i: F.when(i == 0, F.concat(F.lit("\n"), s)).otherwise(s))

    return F.flatten(F.transform(F.split(text, NEWLINE), logical))


def joined(lines: Column) -> Column:
    return F.substr(F.array_join(lines, ""), F.lit(2))


def contents(lines: Column) -> Column:
    """Lines without white space at their ends, as they are compared."""
    return F.transform(lines, lambda s: F.btrim(s, F.lit(" \t\r\n")))


def cuts_of(text: Column, divisor: int = DIVISOR, cuts: int = CUTS) -> Column:
    """The cuts of a text in order: pos (the line after the cut), lo and hi (first line of the chunk
    before, end of the chunk after) and hash (of the two lines beside the cut, which aren't blank)."""
    def rolled(hashes: Column) -> Column:
        # the hash of a blank line is null
        pair = lambda h, i: F.struct(i.alias("pos"), F.when(
            (i > 0) & h.isNotNull() & F.get(hashes, i - 1).isNotNull(), F.xxhash64(F.get(hashes, i - 1), F.lit(ROLL), h)).alias("hash"))
        found = F.filter(F.transform(hashes, pair), lambda c: F.pmod(c["hash"], F.lit(divisor)) < cuts)
        return bind(found, lambda some: F.transform(some, lambda c, i: F.struct(
            c["pos"].alias("pos"), F.coalesce(F.get(some, i - 1)["pos"], F.lit(0)).alias("lo"),
            F.coalesce(F.get(some, i + 1)["pos"], F.size(hashes)).alias("hi"), c["hash"].alias("hash"))))

    return bind(F.transform(contents(lines_of(text)), lambda s: F.when(s != "", F.xxhash64(s))), rolled)


def agreeing(a: Column, b: Column) -> Column:
    """How many of the first elements of two arrays are equal."""
    return bind(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)), lambda at: F.when(at == 0, F.size(a)).otherwise(at.cast("int") - 1))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, cuts: int = CUTS) -> DataFrame:
    """All columns of ``docs``, with the text less its repeated chunks, and n_removed (cuts at which
    something repeated stands) and lines_removed (lines, of those that ``lines_of`` gives).

    Order of occurrences: id (null first), then a hash of id and text, then place. The first stays.
    Nulls: a null text stays null; null ids are ids like others. Rows of equal id and text count as
    one document and get the same result. A text that is removed wholly becomes empty. An empty
    table gives an empty result. Extra columns are kept as they are, but for ones that bear the
    names of the two new columns, which replace them.
    """
    names = [c for c in docs.columns if c not in ("n_removed", "lines_removed")]
    text, key = F.col(f"`{text_col}`"), row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), key.alias("__ld_key"), text.alias("_text"))
    # the outer form, since for the inner one Spark would copy the whole expression into a filter
    seen = own.select("__ld_key", F.explode_outer(cuts_of(F.col("_text"), divisor, cuts)).alias("_c"))
    seen = materialise(seen.where("_c is not null").select("__ld_key", "_c.pos", "_c.lo", "_c.hi", F.col("_c.hash").alias("_hash")))
    again = materialise(seen.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"))
    flags = hot_join(seen, again, "_hash").groupBy("__ld_key").agg(F.collect_set(F.struct("pos", "lo", "hi", "_hash")).alias("_flags"))

    def sides(lines: Column) -> Column:
        return F.transform("_flags", lambda c: F.struct(
            c["_hash"].alias("_hash"), c["pos"].alias("pos"), F.reverse(F.slice(lines, c["lo"] + 1, c["pos"] - c["lo"])).alias("before"),
            F.slice(lines, c["pos"] + 1, c["hi"] - c["pos"]).alias("after")))

    # only texts with cuts that are seen again are moved, and of them only the chunks beside those
    around = own.join(flags, "__ld_key").select("_id", "__ld_key", F.explode_outer(bind(contents(lines_of(F.col("_text"))), sides)).alias("_c"))
    around = materialise(around.select("_c._hash", F.struct("_id", "__ld_key", "_c.pos").alias("_place"), F.struct("_c.before", "_c.after").alias("_sides")))
    first = around.groupBy("_hash").agg(F.min(F.struct("_place", "_sides")).alias("_first"))
    held = hot_join(around, first, "_hash").where(~F.col("_place").eqNullSafe(F.col("_first._place")))
    span = held.select("_place.*", agreeing(F.col("_sides.before"), F.col("_first._sides.before")).alias("up"), agreeing(F.col("_sides.after"), F.col("_first._sides.after")).alias("down"))
    gone = span.where("up > 0 and down > 0").groupBy("__ld_key").agg(F.collect_set(F.struct((F.col("pos") - F.col("up")).alias("lo"), (F.col("pos") + F.col("down") - 1).alias("hi"))).alias("_l"))
    gone = materialise(gone.select("__ld_key", F.size("_l").alias("__ld_cuts"), F.array_distinct(F.flatten(F.transform("_l", lambda x: F.sequence(x["lo"], x["hi"])))).alias("__ld_gone")))
    release(seen, again, around)

    whole = docs.select(*[F.col(f"`{c}`") for c in names], key.alias("__ld_key")).join(gone, "__ld_key", "left")
    # texts that lose nothing are not cut again
    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__ld_gone"))
        return joined(F.transform(kept, lambda i: F.get(lines, i)))

    left = bind(lines_of(F.when(F.col("__ld_gone").isNotNull(), text)), rest)
    new = F.when(F.col("__ld_gone").isNull(), text).otherwise(left)
    return whole.select(
        *[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.coalesce("__ld_cuts", F.lit(0)).alias("n_removed"), F.coalesce(F.size("__ld_gone"), F.lit(0)).alias("lines_removed"))
