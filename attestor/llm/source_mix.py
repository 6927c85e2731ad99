"""Mixing sources to target word counts by entropy balancing.

Each document's rate has the odds of its prior rate against the cap, rate / (cap - rate), tilted by
exp(a_s + b_s * size / mean size of its source). These rates are the ones closest to the prior rates in (bounded) relative
entropy that give each source s its target number of words and keep its mean document size, so a mix doesn't favour
short or long documents. a_s and b_s solve the convex dual of that problem by
Newton steps; each step is one aggregation over all (source, size, prior) classes, and every source has its own two by
two system, so nothing of the corpus goes to the driver but the largest remaining gap.

Rates become copies by systematic rounding: copies = floor(C_i + u) - floor(C_(i-1) + u) where C sums the rates in an order
that keeps equal sizes together and deals the sizes out by a hash. Documents of a size then miss their rate by less than
one copy in all, and of 64 offsets u the one whose words miss the target least is taken for each source. Prefix sums are taken in small bins, then over bins, so a source with a third of all
rows is not ordered in one task. Sums are in whole numbers, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace

#: Rates are whole multiples of 2**-24 when they are summed; a source may then hold 2**38 documents.
UNIT = 1 << 24
#: Newton's sums are in whole multiples of this share of a source's own size: fine enough that the rounding of a million classes stays under `near`.
FINE = 10**15
OFFSETS = 64


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    Sources in code-point order, null last, take the weights in turn and share `share` times all words by weight; a
    source stops at cap times its size and what is over goes to the others by weight. That is one water level over
    source_size / weight, found by sums in that order. One row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    by = Window.orderBy("fill", F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("fill", F.col("source_size") * F.lit(float(cap)) / F.col("weight"))
    whole = Window.partitionBy()
    rows = rows.withColumn("all", F.sum("source_size").over(whole) * F.lit(share)).withColumn("weights", F.sum("weight").over(whole))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.col("all") - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))).withColumn("heavy", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = F.when(F.col("left") / F.col("heavy") <= F.col("fill"), F.col("left") / F.col("heavy"))
    rows = rows.withColumn("level", F.max(level).over(whole))
    return rows.select("source", "source_size", "weight", F.least(F.col("source_size").cast("double") * cap, F.coalesce(F.col("level") * F.col("weight"), F.lit(float("inf")))).alias("target"))


def rate(cap: int) -> Column:
    """The tilted rate, between 0 and cap; the prior where a and b are 0."""
    tilt = F.least(F.lit(float(cap)), F.col("prior")) * F.exp(F.least(F.lit(50.0), F.greatest(F.lit(-50.0), F.col("a") + F.col("b") * F.col("x"))))
    return F.lit(float(cap)) * tilt / (F.greatest(F.lit(0.0), F.lit(float(cap)) - F.col("prior")) + tilt + F.lit(1e-300))


def dual(work: Workspace, classes: DataFrame, goals: DataFrame, cap: int, steps: int, near: float) -> DataFrame:
    """goals (source, mean, source_size, docs, target) with a, b, the dual's solution: words miss no target by more than `near` of their source. Raises if no such is found."""
    full = F.col("target") >= F.col("source_size") * cap  # the dual's solution lies at infinity: every rate is the cap
    found = work.keep(goals.where("source_size > 0").withColumns({"a": F.when(full, 50.0).otherwise(0.0), "b": F.lit(0.0)}), "dual0")
    whole = lambda c: F.sum(F.round(c * F.lit(float(FINE))).cast("decimal(38,0)")).cast("double") / F.lit(float(FINE))
    for k in range(1, steps + 1):
        now = classes.join(found, classes.source.eqNullSafe(found.source)).select(found.source, "target", "source_size", "docs", "a", "b", "prior", (F.col("size") / F.col("mean")).alias("x"), "n")
        now = now.withColumn("r", rate(cap)).withColumn("free", F.col("r") * (1 - F.col("r") / cap) * F.col("n")).withColumn("all", F.col("r") * F.col("n"))
        now = now.groupBy("source").agg(
            whole(F.col("all") / F.col("docs")).alias("g0"), whole(F.col("all") * F.col("x") / F.col("docs")).alias("g1"),
            *(whole(F.col("free") * F.pow(F.col("x"), F.lit(float(p))) / F.col("docs")).alias(f"h{p}") for p in (0, 1, 2)),
        )
        t = F.col("target") / F.col("source_size")
        step = found.join(now.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(found.source))
        step = step.withColumns({"d0": t - F.col("g0"), "d1": t - F.col("g1"), "h0": F.col("h0") + 1e-9, "h2": F.col("h2") + 1e-9 + F.col("h0") * 1e-9})
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        solid = det > 1e-12 * F.col("h0") * F.col("h2")
        da = F.when(solid, (F.col("h2") * F.col("d0") - F.col("h1") * F.col("d1")) / det).otherwise(F.col("d1") / F.greatest(F.col("h1"), F.lit(1e-9)))
        db = F.when(solid, (F.col("h0") * F.col("d1") - F.col("h1") * F.col("d0")) / det).otherwise(0.0)
        bound = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)), 12)
        step = step.withColumn("gap", F.abs("d1"))
        step = step.select("source", "mean", "source_size", "docs", "target", (F.col("a") + bound(da)).alias("a"), (F.col("b") + bound(db)).alias("b"), "gap")
        found = work.keep(step, f"dual{k}")
        gap = found.agg(F.max("gap")).first()[0] or 0.0
        if gap < near:
            return found
        work.drop(f"dual{k - 1}")
    raise RuntimeError(f"after {steps} Newton steps a source misses its target by {gap:.3g} of its size; rows with a prior of 0 may put it out of reach")


def mix_sources(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", prior: Column | None = None,
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, steps: int = 30, near: float = 1e-9,
) -> DataFrame:
    """Returns a row for each row of docs: doc_id, source, size, source_size, target, rate, copies, taken (copies * size).

    size is the number of words (maximal runs other than space and 0x09-0x0D) of the text, 0 for a null text. A source
    may be null; it is last. prior is a base rate for each row (default 1, nulls and negatives count as 0). Documents of
    size 0, and those of sources without words, are taken once. Ids may repeat; every row is a document. An empty table
    gives an empty result. Other columns, whatever their names, are ignored. At most cap copies are made of a document.
    Priors under which a source cannot reach its target raise.
    """
    work = Workspace(docs.sparkSession, "mix")
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long")).alias("size"),
        F.greatest(F.coalesce((F.lit(1.0) if prior is None else prior).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("prior"),
    )
    rows = work.keep(rows, "sizes")
    classes = work.keep(rows.groupBy("source", "size", "prior").agg(F.count("*").alias("n")), "classes")
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("docs"))
    goal = targets(sizes.select("source", "source_size"), weights, share, cap)
    goal = goal.join(sizes.select(F.col("source").alias("s"), "docs"), F.col("s").eqNullSafe(F.col("source"))).select("source", "source_size", "target", "docs", (F.col("source_size") / F.col("docs")).alias("mean"))
    goal = work.keep(goal, "goals")
    solved = dual(work, classes, goal, cap, steps, near)
    solved = goal.join(solved.select(F.col("source").alias("s"), "a", "b"), F.col("s").eqNullSafe(F.col("source")), "left").drop("s")

    # Rates by class, as whole numbers, then sums over what precedes: bins of a source first, then classes in a bin.
    rated = classes.join(solved.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source"))).drop("s").withColumn("x", F.col("size") / F.col("mean"))
    units = F.when(F.col("size") == 0, F.lit(UNIT)).otherwise(F.least(F.lit(cap * UNIT), F.round(rate(cap) * UNIT)))
    rated = rated.withColumn("rate", F.coalesce(units, F.lit(UNIT)).cast("long")).select("source", "size", "prior", "n", "source_size", "target", "rate")
    rated = rated.withColumn("bin", F.pmod(F.xxhash64("size", "prior"), F.lit(256)).cast("int"))
    inside = Window.partitionBy("source", "bin").orderBy("size", "prior").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("here", F.coalesce(F.sum(F.col("rate") * F.col("n")).over(inside), F.lit(0)))
    bins = rated.groupBy("source", "bin").agg(F.sum(F.col("rate") * F.col("n")).alias("sum"))
    ahead = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("source").alias("s"), F.col("bin").alias("k"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
    rated = rated.join(bins, F.col("s").eqNullSafe(F.col("source")) & (F.col("k") == F.col("bin"))).select("source", "size", "prior", "n", "source_size", "target", "rate", (F.col("ahead") + F.col("here")).alias("start"))
    rated = work.keep(rated, "rates")
    offset = lambda at: f"({UNIT // OFFSETS // 2} + u * {UNIT // OFFSETS} + {at}) div {UNIT}"
    tried = rated.select("source", "size", "target", "start", (F.col("start") + F.col("rate") * F.col("n")).alias("stop"), F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1))).alias("u"))
    tried = tried.groupBy("source", "u").agg(F.max("target").alias("target"), F.sum(F.col("size") * F.expr(f"{offset('stop')} - {offset('start')}")).alias("words"))
    chosen = tried.groupBy(F.col("source").alias("s")).agg(F.min_by("u", F.struct(F.abs(F.col("words") - F.col("target")), F.col("u"))).alias("u"))
    rated = rated.join(chosen, F.col("s").eqNullSafe(F.col("source"))).select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("prior").alias("p"), "source_size", "target", "rate", "start", "u")

    # Within a class all rates are equal: a document's place in its class is its place in one of 64 salts plus the salts before.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))
    salts = salted.groupBy("source", "size", "prior", "salt").agg(F.count("*").alias("c"))
    past = Window.partitionBy("source", "size", "prior").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salts = salts.select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("prior").alias("p2"), F.col("salt").alias("t2"), F.coalesce(F.sum("c").over(past), F.lit(0)).alias("past"))
    placed = salted.withColumn("k", F.row_number().over(Window.partitionBy("source", "size", "prior", "salt").orderBy("doc_id")))
    placed = placed.join(salts, F.col("s2").eqNullSafe(F.col("source")) & (F.col("z2") == F.col("size")) & (F.col("p2") == F.col("prior")) & (F.col("t2") == F.col("salt")))
    placed = placed.join(rated, F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")) & (F.col("p") == F.col("prior")))
    copies = F.expr(f"{offset('start + (past + k) * rate')} - {offset('start + (past + k - 1) * rate')}")
    out = placed.withColumn("copies", F.least(F.lit(cap).cast("long"), copies))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("rate") / F.lit(UNIT)).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
