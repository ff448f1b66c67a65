"""Personal data by candidate gradient boosting: generators propose spans, boosted trees select."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import Scratch
from .tables import id_and_text


class Kind(NamedTuple):
    """``gate`` is a cheap test that every text with a match passes, ``passes`` a check of a match s."""

    name: str
    pattern: str
    gate: str
    passes: str = "true"


#: Validated kinds; their spans are always part of the answer.  Patterns are written so that a long
#: run costs time in proportion: a repeated group never gives back (++), which would take a level
#: of the stack for each repetition, and a match starts at the start of a run of its characters or
#: where the match before it ended (\G), since no later start of a run can match where that fails.
BASE = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "contains(_t, '@')",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        r"_t rlike '[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]'",
        r"forall(split(s.x, '[.]'), part -> coalesce(try_cast(part as bigint) <= 255, false))",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"_t rlike '[0-9]([ -]?[0-9]){13}'",
        "length(translate(s.x, ' -', '')) between 14 and 19 and luhn_check(translate(s.x, ' -', ''))",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "contains(_t, '+')",
        "length(translate(s.x, '+ ().-', '')) between 10 and 15",
    ),
)

#: Generators of high recall; their spans overlap each other and the validated ones.
GENERATORS = (
    Kind("handle", r"[^\s@]{1,64}@[^\s@]{1,255}", "contains(_t, '@')"),
    Kind("number", r"[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+", r"_t rlike '[0-9]([ ()./-]{0,2}[0-9]){6}'"),
    Kind("key", r"[A-Za-z0-9+/_-]{16,}=*", r"_t rlike '[A-Za-z0-9+/_-]{16}'"),
)

#: Matches whose lengths are summed in one array.
SUM_BLOCK = 256
#: Characters of context on either side that the features see.
CONTEXT = 24
#: An assignment to one of these names marks a key for the training labels.  The features do not
#: see the names, so that the trees learn what keys look like.
KEY_NAMES = r"(?i)(token|secret|password|passwd|api.?key|access.?key|private.?key)[\\x22\\x27]?\\s*[:=]\\s*[\\x22\\x27]?$"
#: A candidate is selected from the score on at which this share of the calibration rows is personal.
PRECISION = 0.95

#: Format and context of a candidate s: its text x and the surroundings before and after it.
FEATURES = (
    "length(s.x)",
    "length(s.x) - length(regexp_replace(s.x, '[0-9]', ''))",
    "length(s.x) - length(regexp_replace(s.x, '[a-z]', ''))",
    "length(s.x) - length(regexp_replace(s.x, '[A-Z]', ''))",
    "length(regexp_replace(s.x, '[A-Za-z0-9]', ''))",
    "size(array_distinct(split(s.x, '')))",
    "size(split(s.x, '[^0-9]+'))",
    "size(split(s.x, '(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])'))",
    "if(s.x rlike '^[0-9a-fA-F]+$', 1, 0)",
    "if(startswith(s.x, '+'), 1, 0)",
    "if(contains(s.x, '@'), 1, 0)",
    "if(s.x rlike '@.*[.][A-Za-z]{2,}$', 1, 0)",
    r"if(s.before rlike '[=:]\\s*[\\x22\\x27]?$', 1, 0)",
    r"if(s.before rlike '[\\x22\\x27]$', 1, 0)",
    "if(s.before rlike '[0-9]$', 1, 0)",
    "if(s.before rlike '[A-Za-z]$', 1, 0)",
    r"if(s.after rlike '^[\\x22\\x27]', 1, 0)",
    "if(s.after rlike '^[A-Za-z0-9]', 1, 0)",
    "if(s.before = '' or s.after = '', 1, 0)",
)


def _positions(kinds: tuple[Kind, ...], base: DataFrame, carried: list[str]) -> DataFrame:
    """Matches of every kind with places and surroundings, one array of structs per kind.

    The text between matches and the matches alternate, so a match starts where the lengths of
    all before it end.
    """
    none = F.array().cast("array<string>")
    found = base.select(
        *carried,
        *[
            column
            for k, kind in enumerate(kinds)
            for column in (
                F.when(F.expr(kind.gate), F.regexp_extract_all("_t", F.lit(kind.pattern), F.lit(0))).otherwise(none).alias(f"m{k}"),
                F.when(F.expr(kind.gate), F.split("_t", kind.pattern)).otherwise(none).alias(f"p{k}"),
            )
        ],
    )
    lengths = [f"transform(m{k}, (x, i) -> length(p{k}[i]) + length(x))" for k in range(len(kinds))]
    sums = found.select("*", *[F.expr(_block_sums(each)).alias(f"b{k}") for k, each in enumerate(lengths)])
    starts = sums.select("*", *[F.expr(_running(f"transform(b{k}, b -> element_at(b, -1))")).alias(f"o{k}") for k in range(len(kinds))])
    block, place = f"(i - i % {SUM_BLOCK}) div {SUM_BLOCK}", f"i % {SUM_BLOCK}"
    return starts.select(
        *carried,
        *[
            F.expr(
                f"transform(m{k}, (x, i) -> struct("
                f"cast(o{k}[{block}] + b{k}[{block}][{place}] + length(p{k}[i]) as int) as start, "
                f"cast(o{k}[{block}] + b{k}[{block}][{place} + 1] as int) as end, x as x, "
                f"right(p{k}[i], {CONTEXT}) as before, left(p{k}[i + 1], {CONTEXT}) as after))"
            ).alias(f"s{k}")
            for k in range(len(kinds))
        ],
    )


def _running(values: str) -> str:
    """SQL of the running sums of an array, from 0 on."""
    return f"aggregate({values}, array(0L), (sums, v) -> concat(sums, array(element_at(sums, -1) + v)))"


def _block_sums(values: str) -> str:
    """SQL of the running sums within blocks of an array: a growing array is copied at every step."""
    blocks = f"sequence(0, greatest(size(v) - 1, 0) div {SUM_BLOCK})"
    sums = f"transform({blocks}, b -> {_running(f'slice(v, cast(b * {SUM_BLOCK} as int) + 1, {SUM_BLOCK})')})"
    return f"element_at(transform(array({values}), v -> {sums}), 1)"


def candidates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A written table of (row, doc_id, spans); spans have kind, place, label and features.

    Rows are numbered here unless they are already.

    ``rank`` is the place of a validated kind in its list, and -1 for a generator's candidate.
    """
    kinds = (*BASE, *GENERATORS)
    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id().alias("row")
    base = docs.select(row, "doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    placed = _positions(kinds, base, ["row", "doc_id"])
    seen = ", ".join(f"cast({feature} as double)" for feature in FEATURES)
    spans = []
    for k, kind in enumerate(kinds):
        head = f"'{kind.name}' as kind, {k if k < len(BASE) else -1} as rank, s.start as start, s.end as end"
        if k < len(BASE):
            made = f"struct({head}, false as is_key, cast(array() as array<double>) as features)"
        else:
            made = f"struct({head}, s.before rlike '{KEY_NAMES}' as is_key, array({seen}) as features)"
        spans.append(F.expr(f"transform(filter(s{k}, s -> {kind.passes}), s -> {made})"))
    return scratch.write(placed.select("row", "doc_id", F.concat(*spans).alias("spans")))


def _beside_base(found: DataFrame) -> DataFrame:
    """Spans with ``on_base``: whether the span itself overlaps a validated one.

    A base span counts from its start on, a candidate is asked at its end, so a candidate overlaps
    one where the furthest end of those that start before its end lies behind its start.
    """
    is_base = F.col("rank") >= 0
    upto = (
        Window.partitionBy("row")
        .orderBy(F.when(is_base, F.col("start")).otherwise(F.col("end")), is_base)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    furthest = F.coalesce(F.max(F.when(is_base, F.col("end"))).over(upto), F.lit(0))
    return found.withColumn("on_base", furthest > F.col("start"))


def _best_apart(scored: DataFrame) -> DataFrame:
    """The best span of every row, then the best of those that overlap none chosen before, and so on.

    Spans of different runs of overlapping spans cannot touch, so each run is chosen from alone.
    """
    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    runs = scored.withColumn(
        "_apart", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int")
    ).withColumn("run", F.sum("_apart").over(upto))
    span = F.struct("score", F.expr("end - start as long"), F.expr("-start as early"), "kind", "rank", "start", "end")
    listed = runs.groupBy("row", "run").agg(F.sort_array(F.collect_list(span), asc=False).alias("s"))
    chosen = F.expr(
        """
        if(size(s) = 1, s, aggregate(s, slice(s, 1, 0), (taken, x) ->
          if(exists(taken, y -> x.start < y.end and y.start < x.end), taken, concat(taken, array(x)))))
        """
    )
    return listed.select("row", F.explode(chosen).alias("b")).select("row", "b.kind", "b.rank", "b.start", "b.end")


def _fit(rows: DataFrame, scratch: Scratch):
    """Boosted trees and a threshold per generator, or None where the labels do not differ.

    A candidate counts as personal where it overlaps a validated span or is assigned to a key's
    name.  A quarter of the rows is kept from the trees to set the thresholds.  All candidates count,
    equal ones as one row with their number as its weight.
    """
    draw = F.xxhash64("doc_id", "start", "end", "kind")
    labelled = rows.select(
        "kind",
        (F.col("on_base") | F.col("is_key")).cast("double").alias("label"),
        "features",
        (F.pmod(draw, F.lit(4)) == 0).alias("kept"),
    )
    weighted = scratch.write(
        labelled.groupBy("kind", "label", "features", "kept").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    ).withColumn("vector", array_to_vector("features"))
    fitted = weighted.filter("not kept")
    two = fitted.agg(F.min("label"), F.max("label")).first()
    if two[0] == two[1]:  # or no candidates
        return None
    trees = GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", maxIter=10, maxDepth=4, maxBins=64, stepSize=0.3, seed=7
    )
    model = trees.fit(fitted)
    model.setFeaturesCol("vector")
    scored = model.transform(weighted.filter("kept")).select(
        "kind", "label", "weight", F.floor(vector_to_array("probability")[1] * 100).alias("score")
    )
    above = Window.partitionBy("kind").orderBy(F.desc("score"))
    bins = (
        scored.groupBy("kind", "score")
        .agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all"))
        .withColumn("precision", F.sum("good").over(above) / F.sum("all").over(above))
        .filter(F.col("precision") >= PRECISION)
        .groupBy("kind")
        .agg(F.min("score").alias("least"))
        .collect()  # a row per generator
    )
    return model, {row.kind: row.least / 100 for row in bins}


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, rank, start, end; code points, end exclusive) of every row.

    Validated spans (rank 0 to 3 in the order of ``BASE``) are always there.  Of the candidates
    that overlap none of them and reach their generator's threshold, the one that the trees score
    highest is added, then the next that overlaps none added before, and so on.  Spans are sorted
    by start and rank.  Null and empty texts have none; rows are judged one by one, and without
    candidates of both labels nothing is added.
    """
    return _find(id_and_text(docs, id_col, text_col), Scratch(docs.sparkSession)).drop("row")


def _find(docs: DataFrame, scratch: Scratch) -> DataFrame:
    table = candidates(docs, scratch)
    found = table.select("row", "doc_id", F.inline("spans"))
    placed = scratch.write(_beside_base(found))
    base = placed.filter("rank >= 0").select("row", "kind", "rank", "start", "end")
    proposed = placed.filter("rank < 0")
    fitted = _fit(proposed, scratch)
    if fitted is not None and fitted[1]:
        model, least = fitted
        vectors = proposed.filter("not on_base").withColumn("vector", array_to_vector("features"))
        scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
        enough = F.coalesce(*[F.when(F.col("kind") == kind, F.col("score") >= at) for kind, at in least.items()], F.lit(False))
        base = base.unionByName(_best_apart(scored.filter(enough)))
    later = F.when(F.col("rank") < 0, len(BASE)).otherwise(F.col("rank"))
    per_row = base.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", later.alias("at"), "end", "kind", "rank"))).alias("spans")
    )
    spans = F.transform(
        F.coalesce("spans", F.array().cast("array<struct<start:int,at:int,end:int,kind:string,rank:int>>")),
        lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return table.select("row", "doc_id").join(per_row, "row", "left").select("row", "doc_id", spans.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` with every span as ``[KIND]``; overlapping spans become one.

    Null texts stay null; rows are judged one by one, so repeated and null ids stay as they are.
    """
    scratch = Scratch(docs.sparkSession)
    numbered = scratch.write(id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    found = _find(numbered, scratch).drop("doc_id")
    merged = F.aggregate(
        F.reverse("spans"),
        F.struct(F.col("text").alias("text"), F.length("text").alias("cut")),
        lambda state, s: F.when(
            s["end"] <= state["cut"],
            F.struct(
                F.concat(
                    F.left(state["text"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"),
                    F.substr(state["text"], s["end"] + 1),
                ).alias("text"),
                s["start"].alias("cut"),
            ),
        ).otherwise(state),
        lambda state: state["text"],
    )
    return numbered.join(found, "row").select("doc_id", merged.alias("text"))
