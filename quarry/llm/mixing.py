"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words: its weight's part of all words,
at most ``MOST`` times its own, the excess reshared by weight.  A document's
expected copies are target / source size: the whole part is taken for sure,
the fraction is rounded by the pivotal method.  Two units with fractions p
and q meet, and the mass of one moves to the other at random (keeping both
expectations) until one is 0 or 1; the other carries the rest on.  Units meet
units of similar size first: they are folded in blocks of about ``BLOCK``
within a (source, size class) stratum, the residual units of the blocks fold
in the next level of the tree, and the last residuals of the strata fold from
the largest size to the smallest.  The words taken thus stay within about one
small document, plus size differences inside a class, of the target.

Everything is DataFrame expressions.  Blocks are split by hash, repeated rows
are numbered apart first, and randomness is a hash of the units that meet, so
reruns agree.  Levels are staged to the shared folder, a document is decided
in exactly one.

Defined cases: a null or wordless text has size 0 and takes 0; null sources
form one source, ordered last; repeated rows are separate documents; an
empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.io import staged

WEIGHTS, MOST, BLOCK = (5.0, 2.0, 1.0), 3, 64
_TINY = 1e-9
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row a source (the one small table that is ranked as a whole)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * most
    ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    # sources in order of cap / weight: the first ones stop at their caps, the others share what is left
    shared = (per.withColumn("w", weight).withColumn("cap", cap)
              .withColumn("total", F.sum("source_size").over(everything))
              .withColumn("w_left", F.sum("w").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("capped", F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("level", (F.col("total") - F.col("capped")) / F.col("w_left"))
              .withColumn("stops", F.col("level") * F.col("w") >= F.col("cap"))
              # the water level is the one at the first source that does not stop
              .withColumn("final", F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(
                  ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    target = F.coalesce(F.least(F.col("final") * F.col("w"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return shared.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def _uniform(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def _fold(units: Column) -> Column:
    """Fold an array of units by pivotal meetings: struct(done array<struct(unit, bit)>, rest unit or null)."""
    unit = "struct<p:double,key:string,doc:struct<u:bigint,size:bigint>>"
    start = F.struct(F.expr(f"cast(array() as array<struct<unit:{unit},bit:int>>)").alias("done"),
                     F.expr(f"cast(null as {unit})").alias("rest"))

    def meet(state, new):
        a, b = state["rest"], new
        s = a["p"] + b["p"]
        r = _uniform(a["key"], b["key"], F.lit(7))
        low = s < 1 - _TINY
        full = F.abs(s - 1) <= _TINY
        # low: one drops to 0; otherwise one rises to 1; "first" says whether a is the one decided
        first = F.when(low | full, r < b["p"] / s).otherwise(r < (1 - b["p"]) / (2 - s))
        bit = F.when(low, 0).when(full, 0).otherwise(1)
        carried = F.when(full, 1.0).when(low, s).otherwise(s - 1)
        decided, stays = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
        with_p = lambda u, p: F.struct(p.alias("p"), u["key"].alias("key"), u["doc"].alias("doc"))
        closed = (carried <= _TINY) | (carried >= 1 - _TINY)
        out = F.array(F.struct(decided.alias("unit"), bit.alias("bit")))
        both = F.array(F.struct(decided.alias("unit"), bit.alias("bit")),
                       F.struct(with_p(stays, carried).alias("unit"), F.round(carried).cast("int").alias("bit")))
        return F.when(a.isNull(), F.struct(state["done"].alias("done"), b.alias("rest"))).otherwise(F.struct(
            F.concat(state["done"], F.when(closed, both).otherwise(out)).alias("done"),
            F.when(closed, F.expr(f"cast(null as {unit})")).otherwise(with_p(stays, carried)).alias("rest")))

    return F.aggregate(units, start, meet)


def _level(units: DataFrame, group: list, order: Column, label: str) -> DataFrame:
    """One level of the tree, staged: columns source, stratum, done, rest."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("unit").alias("unit"))))
    return staged(units.groupBy("source", *group).agg(rows.alias("rows")).select(
        "source", *[c for c in ("stratum",) if c in group],
        _fold(F.transform("rows", lambda x: x["unit"])).alias("f")).select(
        "source", *[c for c in ("stratum",) if c in group], "f.done", "f.rest"), label)


def round_copies(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pivotal rounding of units (source, stratum, unit): u, bit; each unit once."""
    def decided(df):
        return df.select(F.explode("done").alias("d")).select(F.col("d.unit.doc.u").alias("u"), F.col("d.bit").alias("bit"))

    by_key = F.xxhash64("unit.key")
    out, level = None, 0
    while True:
        held = staged(units.groupBy("source", "stratum").agg(F.count("*").alias("n")), f"mix-strata-{level}")
        if level and (held.agg(F.max("n").alias("m")).first().m or 0) <= 1:
            break
        level += 1
        held = held.select(F.col("source").alias("_s"), F.col("stratum").alias("_t"), F.col("n").alias("_n"))
        blocked = units.join(held, F.col("source").eqNullSafe(F.col("_s")) & (F.col("stratum") == F.col("_t"))).withColumn(
            "b", F.pmod(F.xxhash64("unit.key", F.lit(level)), F.ceil(F.col("_n") / block)))
        folded = _level(blocked, ["stratum", "b"], by_key, f"mix-{level}")
        out = decided(folded) if out is None else out.unionByName(decided(folded))
        units = folded.filter(F.col("rest").isNotNull()).select("source", "stratum", F.col("rest").alias("unit"))
    last = _level(units, [], F.struct((-F.col("unit.doc.size")).alias("s"), by_key.alias("k")), "mix-last")
    rest = last.filter(F.col("rest").isNotNull()).select(
        F.col("rest.doc.u").alias("u"), (_uniform("rest.key", F.lit(11)) < F.col("rest.p")).cast("int").alias("bit"))
    return out.unionByName(decided(last)).unionByName(rest)


def group_key(documents: DataFrame) -> Column:
    """Equal rows share it."""
    return F.xxhash64(*documents.columns)


def plan(documents: DataFrame, text: str = "text", weights=WEIGHTS, most: int = MOST, keep=("doc_id",)) -> DataFrame:
    """One row per distinct document: _group, _n (equal rows), kept columns, size, source_size,
    target, sure (copies each of them has) and extra (how many of them have one more)."""
    groups = staged(documents.select(
        group_key(documents).alias("_group"), F.col("source"), word_count(F.col(text)).alias("size"), *keep)
        .groupBy("_group").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("source", "size", *keep)]),
        "mix-sizes")
    goal = staged(targets(groups.select("source", (F.col("size") * F.col("_n")).alias("size")), weights, most),
                  "mix-targets").withColumnRenamed("source", "_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ruled = groups.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn(
        "sure", F.floor(rate + _TINY))
    # n equal units of fraction p meet each other first: floor(n p) rise to 1 and one residual is left
    mass = F.when(F.col("size") > 0, F.col("_n") * F.greatest(rate - F.col("sure"), F.lit(0.0))).otherwise(0.0)
    ruled = ruled.withColumn("_whole", F.floor(mass + _TINY)).withColumn("_p", mass - F.col("_whole"))
    units = ruled.filter(F.col("_p") > _TINY).select(
        "source", F.floor(F.log2(F.col("size").cast("double")) * 4).cast("int").alias("stratum"),
        F.struct(F.col("_p").alias("p"), F.col("_group").cast("string").alias("key"),
                 F.struct(F.col("_group").alias("u"), F.col("size").alias("size")).alias("doc")).alias("unit"))
    bits = round_copies(units).withColumnRenamed("u", "_u")
    return (ruled.join(bits, F.col("_group") == F.col("_u"), "left")
            .withColumn("extra", F.col("_whole") + F.coalesce("bit", F.lit(0)))
            .select("_group", "_n", *keep, "size", "source_size", "target", "sure", "extra"))


def mix(documents: DataFrame, text: str = "text", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    cols = documents.columns
    rows = documents.withColumn("_of", group_key(documents)).groupBy("_of").agg(
        F.first(F.struct(*[F.col(c) for c in cols])).alias("_row"))
    copies = plan(documents, text, weights, most, keep=()).select(
        "_group", (F.col("_n") * F.col("sure") + F.col("extra")).cast("int").alias("_copies"))
    taken = rows.join(copies, F.col("_of") == F.col("_group")).filter("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op9_mixing(spark, sf_dir) -> DataFrame:
    """Words of every document that the mix takes."""
    from quarry.llm.io import read

    p = plan(read(spark, sf_dir, "documents"))
    return (p.withColumn("_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * (F.col("sure") + (F.col("_no") <= F.col("extra")).cast("int"))).alias("taken")))
