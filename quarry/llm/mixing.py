"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Every document gets a rate: how often the mix should take it.  Among all rates between 0 and ``cap`` whose tokens
meet each source's target, the ones closest to 1 in relative entropy are wanted.  The dual of that convex program has
one multiplier for each token constraint and its solution tilts the rates exponentially,

    rate = min(cap, exp(lambda_source * size / mean_size_source)).

Newton iterations find the multipliers: each is one distributed aggregation of tokens and their
derivative by source, over the table of (source, size, number of documents), with a bracket that turns a step that
leaves it into a bisection.  Rates are then rounded to whole copies by running sums over (size, hash) within each
source, so a source's rounding error stays within about one document.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach, mark, release, running_sum, stage, unused

#: What a word is, for sizes.
WORD = r"[^\x20\x09-\x0D]+"
#: Relative error of a source's expected tokens at which its iterations end.
TOLERANCE = 1e-7
MAX_ROUNDS = 48
#: Corrections of a source's rounding error by one copy of its best-fitting document.
POLISH = 2
#: Fractions of copies are counted in units of 2**-32, so that sums are exact in any order.
UNIT = 1 << 32


def _key(source: str) -> Column:
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """_key, source_size, n_docs, target from (_source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share all tokens; a target stops at ``cap`` times
    its source's size and the excess is reshared by weight until none is above.  That fixed point is found in one
    pass: in the order of cap * size / weight, the capped sources are those whose ratio is below the level that the
    sources from there on would share.  Both orders go by range partitions, so that millions of sources don't meet
    in one task.
    """
    by_source = sizes.groupBy("_source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs")).withColumn("one", F.lit(1).cast("long"))
    placed = running_sum(by_source, [], [F.col("_source").asc_nulls_last()], {"rank": "one"}, "mix-sources")
    weighed = placed.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    weighed = weighed.select(_key("_source").alias("_key"), "source_size", "n_docs", "w", (cap * F.col("source_size") / F.col("w")).alias("ratio"))
    weighed = running_sum(weighed, [], [F.col("ratio"), F.col("_key")], {"size_before": "source_size", "w_before": "w"}, "mix-weights")
    weighed = stage(weighed, "mix-weighed")
    total = F.broadcast(weighed.agg(F.sum("source_size").alias("size_all"), F.sum("w").alias("w_all")))  # a single row
    level = weighed.crossJoin(total).withColumns({"left": F.col("size_all") - cap * F.col("size_before"), "w_left": F.col("w_all") - F.col("w_before")})
    level = level.withColumn("capped", cap * F.col("source_size") * F.col("w_left") <= F.col("w") * F.col("left"))
    # the capped sources are a prefix of this order; the first other one sets the level for all that follow
    first = F.broadcast(level.where("NOT capped").agg(F.min_by(F.struct("left", "w_left"), F.struct("ratio", "_key")).alias("at")))
    share = F.col("w") * F.col("at.left").cast("double") / F.col("at.w_left").cast("double")
    target = F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(share)
    return level.crossJoin(first).select("_key", "source_size", "n_docs", target.alias("target"))


def tilts(histogram: DataFrame, sources: DataFrame, cap: int = 3) -> DataFrame:
    """_key, lam, mean, source_size, n_docs, target from the histogram (_key, size, n) and the targets: the dual's solution.

    Each round is one Newton step of the sources that are still open; its plan is the same every time, and the
    multipliers are staged between two rounds.  A source that is not done after `MAX_ROUNDS` keeps its last multiplier.
    """
    keep = ["_key", "source_size", "n_docs", "target", "mean"]
    start = sources.select(
        "_key", "source_size", "n_docs", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"),
        F.when(F.col("target") >= cap * F.col("source_size"), F.lit(1e9)).otherwise(F.lit(0.0)).alias("lam"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"),
        # nothing to solve for an empty source or a target at the cap
        ((F.col("source_size") == 0) | (F.col("target") >= cap * F.col("source_size"))).alias("done"),
    )
    state = stage(start, "mix-lam")
    solved = [state.where("done")]
    for _ in range(MAX_ROUNDS):
        if state.where("NOT done").isEmpty():
            break
        state = stage(_newton(histogram, state.where("NOT done"), cap), "mix-lam")
        solved.append(state.where("done"))
    every = reduce(DataFrame.unionByName, [*solved, state.where("NOT done")])
    return every.select(*keep, F.round("lam", 9).alias("lam"))  # the last digits depend on the order of sums


def _rate(cap: int) -> Column:
    tilt = F.col("lam") * F.col("size") / F.col("mean")
    free = F.exp(F.least(tilt, F.lit(50.0)))
    return F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(free, F.lit(float(cap))))


def _newton(histogram: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """One step for every source in ``state``: partial sums by source, so a hot source costs no more than others."""
    same = [c for c in state.columns if c != "_key"]
    rate = _rate(cap)
    tokens = F.col("n") * F.col("size") * rate
    slope = F.when(rate < cap, tokens * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
    sums = histogram.join(state, "_key").groupBy("_key", *same).agg(F.sum(tokens).alias("tokens"), F.sum(slope).alias("slope"))
    over = F.col("tokens") > F.col("target")
    low = F.when(over, F.col("low")).otherwise(F.col("lam"))
    high = F.when(over, F.col("lam")).otherwise(F.col("high"))
    near = F.abs(F.col("tokens") - F.col("target")) <= TOLERANCE * F.col("target")
    step = F.col("lam") - (F.col("tokens") - F.col("target")) / F.col("slope")
    inside = (F.col("slope") > 0) & (step > low) & (step < high)
    lam = F.when(near, F.col("lam")).when(inside, step).otherwise((low + high) / 2)
    made = {"lam": lam, "low": low, "high": high, "done": near}
    return sums.select("_key", *[made[c].alias(c) if c in made else F.col(c) for c in same])


def entropy_mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, rate, copies, taken) of every document; the text isn't carried along.

    size is the number of words (null and empty texts: 0; such documents are taken once and cost nothing), copies the
    number of times the mix takes the document (0 to ``cap``), taken = copies * size.  A null source is a source of its
    own, the last.  Rounding goes by size, then by a hash of the id, then by the id: ties and repeated rows share a
    place in that order and reruns agree.  An empty table gives an empty table.
    """
    begin = mark()
    sized = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("_source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    targets = stage(source_targets(sized, weights, cap), "mix-targets")
    histogram = stage(sized.groupBy(_key("_source").alias("_key"), "size").agg(F.count("*").alias("n")), "mix-histogram")
    solved = stage(tilts(histogram, targets, cap), "mix-solved")
    rated = attach(sized.withColumn("_key", _key("_source")), solved, ["_key"], "n_docs").withColumn("rate", _rate(cap))
    rated = rated.select(
        "doc_id", F.col("_source").alias("source"), "size", "source_size", "target", "rate",
        F.floor("rate").cast("long").alias("whole"),
        F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("long").alias("part"),
        F.xxhash64("doc_id").alias("shuffled"),
    )
    summed = running_sum(rated, ["source"], [F.col("size"), F.col("shuffled"), F.col("doc_id")], {"before": "part"}, "mix-order")
    half = UNIT // 2  # of a copy, so that rounding is to the nearest
    extra = F.floor((F.col("before") + F.col("part") + half) / F.lit(UNIT)) - F.floor((F.col("before") + half) / F.lit(UNIT))
    copies = F.least(F.col("whole") + extra.cast("long"), F.lit(cap))
    out = stage(summed.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies")), "mix-copies")
    for _ in range(POLISH):
        out = stage(_polish(out, cap), "mix-copies")
    release(docs.sparkSession, begin, out)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def _polish(rounded: DataFrame, cap: int) -> DataFrame:
    """Bring every source nearer to its target by one copy more or less of the document whose size fits best."""
    rows = rounded.withColumn("_key", _key("source"))
    gaps = rows.groupBy("_key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("_gap"), F.count("*").alias("_n"))
    near = attach(rows, stage(gaps, "mix-gaps"), ["_key"], "_n")
    fits = F.when(F.col("_gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0) & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("_gap"))
    place = F.struct(F.abs(F.abs("_gap") - F.col("size")), F.xxhash64("doc_id"), "doc_id")
    best = near.where(fits).groupBy("_key").agg(F.min_by(F.struct("doc_id", "size", F.signum("_gap").cast("long").alias("by")), place).alias("_best"))
    best = stage(best.select("_key", F.col("_best.doc_id").alias("doc_id"), F.col("_best.size").alias("size"), F.col("_best.by").alias("_by")).where("doc_id IS NOT NULL"), "mix-best")
    # one row for each source at most, so whole documents decide: of rows that repeat id, source and size all change
    return rows.join(best, ["_key", "doc_id", "size"], "left").withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(cap), F.col("copies") + F.coalesce("_by", F.lit(0))))).select(*rounded.columns)


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row repeated as often as ``mixed`` takes it; rows that repeat an id share its copies of one row each.

    Rows with a null id are taken as often as the mix takes null ids.  Extra columns, whatever they are called, pass
    through; an empty table gives an empty table.
    """
    begin = mark()
    doc, total, rows, turn = (unused(x, docs.columns) for x in ("_id", "_sum", "_rows", "_turn"))
    plan = mixed.where("copies > 0").groupBy(F.col("doc_id").alias(doc)).agg(F.sum("copies").alias(total), F.count("*").alias(rows))
    plan = stage(plan, "mix-plan")
    joined = docs.join(plan, F.col(id_col).eqNullSafe(F.col(doc)))
    times = F.greatest(F.lit(1), F.round(F.col(total) / F.col(rows))).cast("int")
    release(docs.sparkSession, begin, plan)
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op1_entropy_mix(docs: DataFrame) -> DataFrame:
    return entropy_mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
