"""Quality rules: a table of thresholds compiled into one projection over each text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import id_and_text

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SHOUTS = "!?"

# The most common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on with as be by this are at from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans a par plus pas au "
    "el los y las se del por con una su para es al lo"
).split()


class Rule(NamedTuple):
    """A document fails when ``measure`` lies outside ``least`` to ``most``; null measures pass."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Measures are SQL over the columns of ``measures``.  Ratios are per word or per line.
RULES = (
    Rule("word_length", "word_chars / n_words", least=2.0, most=12.0),
    Rule("symbols", "n_symbols / n_words", most=0.10),
    Rule("shouts", "n_shouts / n_words", most=0.50),
    Rule("stop_words", "n_stop_words / n_words", least=0.02),
    Rule("repeated_lines", "n_dup_lines / n_lines", most=0.45),
)


def n_of(chars: str) -> Column:
    """How many characters of the text are among the ASCII ``chars``."""
    gone = [F.octet_length(F.replace(F.col("_t"), F.lit(c), F.lit(""))) for c in chars]
    return sum(F.octet_length("_t") - left for left in gone).cast("long")


#: A window is sorted as one long: its hash in the high bits, its place in the low ones.
PLACE_BITS = 24


def window_codes(words: str, bits: int) -> Column:
    """The three-word windows of a text as sorted codes; equal windows stand side by side."""
    code = f"xxhash64({words}[i], {words}[i + 1], {words}[i + 2])"
    return F.expr(
        f"sort_array(transform(sequence(0, size({words}) - 3), "
        f"i -> shiftleft(shiftright({code}, {bits}), {bits}) + i))"
    )


def _neighbours(windows: str, marks: str) -> str:
    """The distinct places that ``marks`` gives for sorted neighbours ``a`` and ``b``."""
    return (
        f"array_distinct(flatten(filter(zip_with(slice({windows}, 1, size({windows}) - 1), "
        f"slice({windows}, 2, size({windows}) - 1), (a, b) -> {marks}), x -> x is not null)))"
    )


def repeated_places(words: str, codes: str, bits: int) -> Column:
    """Places of the words inside a three-word window that occurs twice or more in the text.

    Neighbours of equal hash are compared word by word, then mark the words of both windows.  Unequal
    windows of equal hash may stand between equal ones; the place -1 tells that there are such.
    """
    place = f"cast(%s & {(1 << bits) - 1} as int)"
    a, b = place % "a", place % "b"
    same = " and ".join(f"{words}[{a} + {k}] = {words}[{b} + {k}]" for k in range(3))
    marks = ", ".join(f"{x} + {k}" for x in (a, b) for k in range(3))
    alike = f"shiftright(a, {bits}) = shiftright(b, {bits})"
    return F.expr(_neighbours(codes, f"if({alike}, if({same}, array({marks}), array(-1)), null)"))


def repeated_words(words: str, places: str, bits: int) -> Column:
    """How many words lie inside a repeated window.

    Where hashes collide, or a text has more words than a code has places, the windows themselves
    are sorted, which takes more memory and gives the count without any hash.
    """
    window = f"struct({words}[i] as u, {words}[i + 1] as v, {words}[i + 2] as w, i as at)"
    windows = f"sort_array(transform(sequence(0, size({words}) - 3), i -> {window}))"
    marks = ", ".join(f"{x}.at + {k}" for x in "ab" for k in range(3))
    same = f"if(a.u = b.u and a.v = b.v and a.w = b.w, array({marks}), null)"
    return F.expr(
        f"cast(case when size({words}) <= 3 then 0 "
        f"when size({words}) > {1 << bits} or array_contains({places}, -1) "
        f"then size({_neighbours(windows, same)}) else size({places}) end as long)"
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Counts of words, characters, lines and repeats of every text.

    A null text counts as empty: all counts are 0.  Counts are longs.  With ``keep`` the input
    row travels along as the struct ``_row``.
    """
    row = [F.struct("*").alias("_row")] if keep else []
    base = docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("_t"), *row
    )
    carried = ["doc_id", *(["_row"] if keep else [])]
    forms = sorted({form for word in STOP_WORDS for form in (word, word.capitalize())})
    split = base.select(
        *carried,
        "_t",
        F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda line: line.rlike(WORD)).alias("_l"),
    )
    counted = split.select(
        *carried,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        n_of(SYMBOLS).alias("n_symbols"),
        n_of(SHOUTS).alias("n_shouts"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: w.isin(*forms))).cast("long").alias("n_stop_words"),
        F.when(F.size("_w").between(4, 1 << PLACE_BITS), window_codes("_w", PLACE_BITS)).alias("_s"),
    )
    placed = counted.withColumn("_p", repeated_places("_w", "_s", PLACE_BITS))
    return placed.withColumn("n_repeat_words", repeated_words("_w", "_p", PLACE_BITS)).drop("_w", "_s", "_p")


BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the table fails."""
    passed = []
    for rule in rules:
        measure = f"({rule.measure.replace(' / ', ' / nullif(')}, 0))" if " / " in rule.measure else rule.measure
        for sign, bound in ((">=", rule.least), ("<=", rule.most)):
            if bound is not None:
                passed.append(f"coalesce({measure} {sign} {bound}, true)")
    return F.expr(" and ".join(passed) or "true")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Measures and verdict per row: ``base_failed`` and ``kept``.

    A null or empty text has no words, fails the base rule and is not kept.  Repeated rows are
    judged one by one; nothing is shuffled.  Other columns of ``docs`` are not read.
    """
    judged = measures(id_and_text(docs, id_col, text_col)).withColumn("base_failed", F.expr(BASE_FAILED))
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    judged = measures(docs, id_col, text_col, keep=True)
    passed = ~F.expr(BASE_FAILED) & verdict(rules)
    # A filter would be pushed below the projections and repeat their work.
    return judged.select(F.explode(F.when(passed, F.array("_row"))).alias("_row")).select("_row.*")
