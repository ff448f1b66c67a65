"""Near-duplicate lines by deletion neighbourhoods: variants as hashed keys, joined and verified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch, small
from .tables import id_and_text

#: Lines of fewer characters are only compared as equal; one edit would change too much of them.
#: This and the next are defaults of ``dedup_lines``, and what the SQL of op3 takes.
LEAST_CHARS = 16
#: Characters by which two lines may differ: inserted, deleted or exchanged.
EDITS = 1
#: Lines whose lengths lie in one band of so many characters sign with halves of the same length.
BAND = 8
#: Pieces of a line of which one edit changes one; variants are emitted of that piece only.
PIECES = 16


def _lines(docs: DataFrame) -> DataFrame:
    """Rows of (row, doc_id, line_no, line, h, c) of every line that is not blank."""
    return (
        docs.filter("text is not null")
        .select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
        .select("row", "doc_id", "line_no", "line", F.xxhash64("line").alias("h"), F.crc32("line").alias("c"))
    )


def _half_keys(least_chars: int) -> Column:
    """Keys of which two lines within one edit share one: their first or last half is intact.

    A half is half of the least length in the band.  A line of that least length may be near one
    of the band below, so it signs there as well.  Null for lines that are compared as equal only.
    """
    n, band = "length(line)", f"length(line) div {BAND}"
    keys = lambda b: f"array(xxhash64(0, {b}, left(line, int(({b}) * {BAND // 2}))), xxhash64(1, {b}, right(line, int(({b}) * {BAND // 2}))))"
    return F.expr(
        f"if({n} >= {least_chars}, if({n} % {BAND} = 0, concat({keys(band)}, {keys(band + ' - 1')}), {keys(band)}), null)"
    )


def _pieces(lines: DataFrame) -> DataFrame:
    """Every line with each of its pieces: ``at`` 0 to ``2 * PIECES - 1``, ``around``, ``piece``.

    Two lines of one length that differ in a piece agree on ``around``, the hash of all else.  A
    line of n + 1 characters meets one of n where it is cut for n characters, the piece longer by
    one; these cuts follow in the second half of ``at``.
    """
    cut = lambda k: f"int(total * ({k}) div {PIECES})"
    return (
        lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * PIECES - 1))).alias("at"))
        .selectExpr("*", f"at div {PIECES} = 1 as longer", f"int(at % {PIECES}) as k", f"int(length(line) - at div {PIECES}) as total")
        .selectExpr("*", f"{cut('k')} as before", f"total - {cut('k + 1')} as after")
        .withColumn("around", F.expr("xxhash64(total, k, left(line, before), right(line, after))"))
        .withColumn("piece", F.expr("substring(line, before + 1, length(line) - before - after)"))
        .drop("k", "total", "before", "after")
    )


def _meeting(keys: DataFrame, key: str) -> DataFrame:
    """Rows of (h, ``key``) whose key two different lines hold; no key's lines are held together."""
    shared = keys.groupBy(key).agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a < b").select(key)
    return keys.join(shared, key, "left_semi")


def _variants(pieces: DataFrame) -> DataFrame:
    """Rows of (h, c, first, variant, kind): kind 1 a piece as it is, 0 and 2 one less a character.

    Pieces that lose a character at the same place and are then equal differ in that character
    (kind 0); a piece that is equal to a longer one without a character lacks it (1 and 2).
    """
    less = "concat(left(piece, p - 1), substring(piece, p + 1))"
    places = "if(length(piece) > 0, sequence(1, length(piece)), cast(array() as array<int>))"
    same = f"transform({places}, p -> struct(xxhash64(around, p, {less}) as variant, 0 as kind))"
    whole = "array(struct(xxhash64(around, 0, piece) as variant, 1 as kind))"
    shorter = f"array_distinct(transform({places}, p -> struct(xxhash64(around, 0, {less}) as variant, 2 as kind)))"
    return pieces.select("h", "c", "first", F.expr(f"inline(if(longer, {shorter}, concat({whole}, {same})))"))


def near_lines(lines: DataFrame, keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, c, near) of each line with an earlier one within an edit; ``near`` is the earliest place.

    Lines are first reduced to those that share a half with another line, then to their pieces
    around which all else is shared; only these pieces emit their variants.
    """
    place = F.struct("doc_id", "row", "line_no")
    halves = keyed.select("h", "c", F.explode("halves").alias("half"))
    meeting, (many,) = scratch.write_counted(_meeting(halves, "half").select("h", "c").distinct(), F.count(F.lit(1)))
    candidates = scratch.write(
        lines.join(small(meeting, many, 2), ["h", "c"]).groupBy("h", "c").agg(F.min(place).alias("first"), F.min("line").alias("line"))
    )
    shared = _meeting(_pieces(candidates).select("h", "c", "at", "around"), "around")
    where = shared.groupBy("h", "c").agg(F.collect_set("at").alias("shared"))
    pieces = _pieces(candidates.join(where, ["h", "c"])).filter(F.array_contains("shared", F.col("at")))
    variants = scratch.write(_variants(pieces))
    # The earliest of each bucket: among exchanged ones, and between a whole piece and longer ones.
    mine = F.struct("first", "h", "c")
    least = (
        variants.groupBy("variant")
        .agg(
            F.min(F.when(F.col("kind") != 2, mine)).alias("of_whole"),
            F.min(F.when(F.col("kind") == 2, mine)).alias("of_longer"),
            F.min("h").alias("a"),
            F.max("h").alias("b"),
        )
        .filter("a < b")
        .drop("a", "b")
    )
    other = F.when(F.col("kind") == 1, F.col("of_longer")).otherwise(F.col("of_whole"))
    pairs = (
        variants.join(least, "variant")
        .select("h", "c", "first", other.alias("other"))
        .filter("other.first < first")
        .select("h", "c", "other")
        .distinct()
    )
    text = candidates.select(F.col("h").alias("oh"), F.col("c").alias("oc"), F.col("line").alias("other_line"))
    near = scratch.write(
        pairs.join(candidates.select("h", "c", "line"), ["h", "c"])
        .join(text, (F.col("other.h") == F.col("oh")) & (F.col("other.c") == F.col("oc")))
        .filter(F.levenshtein("line", "other_line", 1) >= 0)
        .groupBy("h", "c")
        .agg(F.min("other.first").alias("near"))
    )
    scratch.drop(meeting, candidates, variants)
    return near


def _part_keys(edits: int) -> Column:
    """Keys (key, own) of which two lines within ``edits`` share one, own to one of them.

    A line is cut into ``edits + 1`` parts, of which so many edits leave one intact; the other
    line holds that part up to ``edits`` places off, whatever the first one's length.
    """
    cut = lambda k: f"int(total * ({k}) div {edits + 1})"
    part = lambda at: f"xxhash64(total, k, substring(line, {cut('k')} + 1 + {at}, {cut('k + 1')} - {cut('k')}))"
    own = f"transform(sequence(0, {edits}), k -> struct({part('0').replace('total', 'length(line)')} as key, true as own))"
    others = (
        f"flatten(flatten(transform(sequence(greatest(1, length(line) - {edits}), length(line) + {edits}), total -> "
        f"transform(sequence(0, {edits}), k -> transform(filter(sequence(-{edits}, {edits}), d -> {cut('k')} + d >= 0), "
        f"d -> struct({part('d')} as key, false as own))))))"
    )
    return F.expr(f"array_distinct(concat({own}, {others}))")


def _gapped(lines: DataFrame, edits: int) -> DataFrame:
    """Rows of (h, c, first, variant): the line with up to ``edits`` gaps, each of no or one character.

    Two lines share a variant of k gaps where k edits at most make one of the other.  A line holds
    no line feed, which marks a gap.
    """
    mark = "concat(left(v, p - 1), '\n', substring(v, p + {}))"
    step = (
        "inline(flatten(transform(sequence(at, length(v) + 1), p -> if(p > length(v), "
        f"array(struct({mark.format(0)} as v, p + 1 as at)), "
        f"array(struct({mark.format(0)} as v, p + 1 as at), struct({mark.format(1)} as v, p + 1 as at))))))"
    )
    grown, rows = lines.select("h", "c", "first", F.col("line").alias("v"), F.lit(1).alias("at")), []
    for gaps in range(1, edits + 1):
        grown = grown.select("h", "c", "first", F.expr(step))
        rows.append(grown.select("h", "c", "first", F.xxhash64(F.lit(gaps), "v").alias("variant")))
    return reduce(DataFrame.unionAll, rows).distinct()


def near_lines_within(lines: DataFrame, edits: int, least_chars: int, scratch: Scratch) -> DataFrame:
    """(h, c, near) of each line with an earlier one within any number of ``edits``, as ``near_lines``.

    Only lines that share an intact part with another emit variants, about (2 n) ** edits / edits!
    of a line of n characters.
    """
    firsts = scratch.write(
        lines.filter(F.length("line") >= least_chars)
        .groupBy("h", "c")
        .agg(F.min(F.struct("doc_id", "row", "line_no")).alias("first"), F.min("line").alias("line"))
    )
    keys = firsts.select("h", "c", F.inline(_part_keys(edits)))
    shared = keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.max("own").alias("own"))
    meeting = keys.join(shared.filter("a < b and own").select("key"), "key", "left_semi").select("h", "c").distinct()
    candidates = scratch.write(firsts.join(meeting, ["h", "c"]))
    variants = scratch.write(_gapped(candidates, edits))
    mine = F.struct("first", "h", "c")
    least = variants.groupBy("variant").agg(F.min(mine).alias("other"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pairs = variants.join(least, "variant").filter("other.first < first").select("h", "c", "other").distinct()
    text = candidates.select(F.col("h").alias("oh"), F.col("c").alias("oc"), F.col("line").alias("other_line"))
    near = scratch.write(
        pairs.join(candidates.select("h", "c", "line"), ["h", "c"])
        .join(text, (F.col("other.h") == F.col("oh")) & (F.col("other.c") == F.col("oc")))
        .filter(F.levenshtein("line", "other_line", edits) >= 0)
        .groupBy("h", "c")
        .agg(F.min("other.first").alias("near"))
    )
    scratch.drop(firsts, candidates, variants)
    return near


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least_chars: int = LEAST_CHARS
) -> DataFrame:
    """Every row without the lines that repeat an earlier one within ``edits``, one by default.

    Earlier is a smaller id, then a smaller place in the table, then an earlier line of the text.
    A line goes when an equal line, or one that differs by so many characters inserted, deleted or
    exchanged, is earlier, whether or not that one stays.  Lines of fewer than ``least_chars``
    characters go for equal ones only; blank lines stay.  More than one edit costs far more, see
    ``near_lines_within``.  Columns: doc_id, n_lines (with a word),
    n_equal and n_near (lines that went), text.  A null text stays null; repeated rows and null
    ids (earliest of all) are rows like others.
    """
    if edits < 1 or least_chars < 1:
        raise ValueError("edits and least_chars must be 1 or more")
    scratch = Scratch(docs.sparkSession)
    numbered = scratch.write(id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    lines = _lines(numbered)
    keyed = scratch.write(lines.withColumn("halves", _half_keys(least_chars)).drop("line"))
    if edits == 1:
        near = near_lines(lines, keyed, scratch)
    else:
        near = near_lines_within(lines, edits, least_chars, scratch)
    mine = F.struct("doc_id", "row", "line_no")
    # Only the first of equal lines may stay.  Lines that are alone and near none need no join; the
    # others are written, so that the rows of a frequent line are dealt by a join of its own.
    firsts = keyed.groupBy("h", "c").agg(F.min(mine).alias("first"), F.count(F.lit(1)).alias("many"))
    places = scratch.write(firsts.join(near, ["h", "c"], "left").filter("many > 1 or near is not null").drop("many"))
    gone = (
        keyed.drop("halves")
        .join(places, ["h", "c"])
        .withColumn("equal", F.col("first") < mine)
        .filter("equal or near is not null")
        .groupBy("row")
        .agg(
            F.count_if("equal").alias("n_equal"),
            F.count_if(~F.col("equal")).alias("n_near"),
            F.collect_list("line_no").alias("gone"),
        )
    )
    # all_lines is named twice, so that the optimizer leaves it a column: written into the lambda,
    # the text would be split once per line
    kept = F.expr(
        "array_join(transform(array_except(sequence(0, size(all_lines) - 1), gone), i -> all_lines[i]), '\\n')"
    )
    n_lines = F.size(F.filter("all_lines", lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    return (
        numbered.join(gone, "row", "left")
        .withColumn("all_lines", F.split("text", "\n"))
        .select(
            "doc_id",
            F.when(F.col("text").isNotNull(), n_lines).otherwise(0).cast("long").alias("n_lines"),
            *[F.coalesce(name, F.lit(0)).alias(name) for name in ("n_equal", "n_near")],
            F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("text")).alias("text"),
        )
    )
