"""Mixing sources to target weights by Pivotal dependent rounding.

A source's documents are taken target / size times on average, at most three times.  The whole part is certain; the
fractional parts are rounded together: two documents play, and words are moved from one's share to the
other's until one share is 0 or 1, either way with odds that keep both expectations; the other plays
on.  So the words taken from a source stay what they are but for the last document.

A document of more than 1 % of its source (there are fewer than a hundred) plays against all smaller ones of the
source together, which changes their common share.  For the rest the games form a reduction tree over narrow
rows: a block holds one source's documents of one size class and hash bucket, some 64 of them, and
hands one undecided document up.  Upper levels join buckets, then neighbouring classes, then the whole
source.  All draws are hashes, so a rerun takes the same.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftwarden.session import stage_table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BITS = 6
CLASSES_PER_OCTAVE = 8
MOST = 3
LARGE = 100


def source_ranks(sources: DataFrame) -> DataFrame:
    """`sources` (one row per source) with `rank` from 1: by code point, null last."""
    ordered = stage_table(sources.orderBy(F.col("source").asc_nulls_last())
                          .withColumn("_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # one row per partition
    offsets = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = ordered.withColumn("_part", part).join(offsets, "_part")
    return ranked.withColumn("rank", F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(
        "_at", "_part", "_offset")


def targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MOST) -> DataFrame:
    """source, source_size, target of `sized` (source, size): shares of all sizes by weight, at most `most` times a
    source's size, what is above reshared by weight until none is."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stage_table(source_ranks(sums).withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))), "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:     # the level rises until no further source is filled
        over = F.lit(level) * F.col("weight") > most * F.col("source_size")
        filled, held, free = ranked.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if filled == full or not free:
            break
        level, full = (total - held) / free, filled
    return ranked.select("source", "source_size", F.least(
        F.lit(level) * F.col("weight"), (most * F.col("source_size")).cast("double")).alias("target"))


def _uniform(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _nobody(units: Column) -> Column:
    """An empty array of (unit, take)."""
    return F.filter(F.transform(units, lambda u: F.struct(u.alias("unit"), F.lit(0).alias("take"))), lambda x: F.lit(False))


def _play(units: Column, seed: int) -> Column:
    """Fold of an array of units (p from 0 to 1): `out` lists (unit, take), `left` is the undecided unit."""
    def game(acc, x):
        a = acc["left"]
        give, room = x["p"] * x["size"], (1 - x["p"]) * x["size"]
        own, missing = a["p"] * a["size"], (1 - a["p"]) * a["size"]
        up, down = F.least(missing, give), F.least(own, room)      # words to a, words from a
        rises = _uniform(F.lit(seed), a["draw"], x["draw"]) * (up + down) < down
        settled = F.when(rises, missing <= give).otherwise(own <= room)     # a is decided, else x
        take = F.when(settled, rises).otherwise(~rises).cast("int")
        rest = F.when(settled, x["p"] + F.when(rises, -up).otherwise(down) / x["size"]).otherwise(
            a["p"] + F.when(rises, up).otherwise(-down) / a["size"])
        left = F.when(settled, x).otherwise(a).withField("p", F.least(F.greatest(rest, F.lit(0.0)), F.lit(1.0)))
        decided = F.struct(F.when(settled, a).otherwise(x).alias("unit"), take.alias("take"))
        return F.struct(left.alias("left"), F.array_append(acc["out"], decided).alias("out"))

    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))),
                       F.struct(F.element_at(units, 1).alias("left"), _nobody(units).alias("out")), game)


def _settle(units: Column, p: Column, words: Column, seed: int) -> Column:
    """Fold of units of one common share p, the largest first, each against all after it, `words` in all: the units'
    (unit, take) in `out` and the share of those that are not in the array in `p`."""
    def game(acc, x):
        p, size, pool = acc["p"], x["size"], acc["words"] - x["size"]
        up, down = F.least((1 - p) * size, p * pool), F.least(p * size, (1 - p) * pool)
        luck = _uniform(F.lit(seed), x["draw"])
        rises = luck * (up + down) < down
        own = F.when(up + down > 0, p + F.when(rises, up).otherwise(-down) / size).otherwise(p)
        # without enough words in the pool the unit's share stays a fraction: it is drawn
        take = F.when(own >= 1 - 1e-12, 1).when(own <= 1e-12, 0).otherwise((_uniform(F.lit(seed + 1), x["draw"]) < own).cast("int"))
        rest = F.when((up + down > 0) & (pool > 0), p + F.when(rises, -up).otherwise(down) / pool).otherwise(p)
        return F.struct(F.least(F.greatest(rest, F.lit(0.0)), F.lit(1.0)).alias("p"), pool.alias("words"),
                        F.array_append(acc["out"], F.struct(x.alias("unit"), take.alias("take"))).alias("out"))

    return F.aggregate(units, F.struct(p.alias("p"), words.alias("words"), _nobody(units).alias("out")), game)


def rounded(units: DataFrame, seed: int = 20) -> DataFrame:
    """source, unit, take (0 or 1) of every unit: struct (size, draw, doc_id, n, p) of a source, size above 0, p in (0, 1).

    Per source the words taken are the sum of p * size, give or take one unit.
    """
    total = units.count()
    bits = max(0, math.ceil(math.log2(max(total, 1) / 2 ** BLOCK_BITS)))
    steps = [(0, b) for b in range(bits, 0, -BLOCK_BITS)] + [(0, 0), (3, 0), (40, 0)]
    classed = units.withColumn("class", F.floor(F.log2(F.col("unit.size") + 1) * CLASSES_PER_OCTAVE).cast("int"))
    done, left = [], classed
    for i, (shift, depth) in enumerate(steps):
        block = left.groupBy("source", F.shiftright("class", shift).alias("band"),
                             F.pmod(F.col("unit.draw"), F.lit(1 << depth)).alias("bucket"))
        # the largest play first: what is undecided in the end is small
        block = block.agg(F.max("class").alias("class"),
                          F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
        block = stage_table(block.select("source", "class", _play(F.col("units"), seed + i).alias("game")), "games")
        done.append(block.select("source", F.inline("game.out")))
        left = block.select("source", "class", F.col("game.left").alias("unit"))
    last = left.select("source", "unit", (_uniform(F.lit(seed - 1), "unit.draw") < F.col("unit.p")).cast("int").alias("take"))
    for part in done:
        last = last.union(part)
    return last


def _copies(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """doc_id, source, size, n, source_size, target, total: copies of n equal rows together."""
    equal = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    rated = equal.alias("e").join(goals.alias("g"), F.col("e.source").eqNullSafe(F.col("g.source"))).select(
        "e.*", "g.source_size", "g.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = rated.withColumn("share", rate * F.col("n")).withColumn("sure", F.floor("share"))
    rated = stage_table(rated.withColumn("p", F.col("share") - F.col("sure")), "rates")
    units = rated.filter("p > 0 and size > 0").select("source", "source_size", F.struct(
        "size", F.xxhash64(F.lit(3), "doc_id", "source", "size").alias("draw"), "doc_id", "n", "p").alias("unit"))
    large = F.col("unit.size") * LARGE > F.col("source_size")
    alone = units.filter("unit.n = 1")
    heads = alone.groupBy("source").agg(
        F.max("unit.p").alias("p"), F.sum("unit.size").cast("double").alias("words"),
        F.sort_array(F.collect_list(F.when(large, F.col("unit"))), asc=False).alias("units"))      # under LARGE of them
    heads = stage_table(heads.select("source", _settle(F.col("units"), F.col("p"), F.col("words"), 7).alias("game")), "large")
    pools = heads.select(F.col("source").alias("_source"), F.col("game.p").alias("_p"))
    rest = alone.filter(~large).join(pools, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", F.col("unit").withField("p", F.col("_p")).alias("unit"))
    sure = rest.filter("unit.p = 1").select("source", "unit", F.lit(1).alias("take"))
    open_ = rest.filter("unit.p > 0 and unit.p < 1").union(units.filter("unit.n > 1").select("source", "unit"))
    taken = rounded(open_).union(heads.select("source", F.inline("game.out"))).union(sure).select(
        "source", "unit.doc_id", "unit.size", "take")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "source", "size")]
    return rated.alias("r").join(taken.alias("t"), same, "left").select(
        "r.doc_id", "r.source", "r.size", "r.n", "r.source_size", "r.target",
        (F.col("r.sure") + F.coalesce("t.take", F.lit(0))).alias("total"))


def _share(total: str, n: str, place: Column) -> Column:
    """Copies of the row at `place` (from 0) of n equal rows with `total` copies."""
    return F.floor(F.col(total) / F.col(n)) + (place < F.pmod(F.col(total), F.col(n))).cast("long")


def sized_documents(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))


def mix_sizes(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken per row of `docs` (doc_id, source, text).

    A null or empty text has size 0 and gets no words; a null source is a source, the last; rows without doc_id take
    part; equal rows share their copies evenly.  An empty table gives no rows.
    """
    sized = stage_table(sized_documents(docs), "sizes")
    units = _copies(sized, targets(sized, weights)).withColumn("place", F.explode(F.expr("sequence(0L, n - 1)")))
    return units.select("doc_id", "source", "size", "source_size", "target",
                        _share("total", "n", F.col("place")).alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """`docs` (all columns) with `copies`, without the rows that get none; cases as in `mix_sizes`."""
    marked = docs.select(*[docs[c] for c in docs.columns if c != "copies"])
    sized = sized_documents(marked)
    whole = marked.withColumn("__size", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))
    chosen = _copies(sized, targets(sized, weights)).filter("total > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__words"),
        F.col("n").alias("__n"), F.col("total").alias("__total"))
    rows = whole.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source"))
                      & (F.col("__size") == F.col("__words")))
    order = Window.partitionBy("__id", "__source", "__words").orderBy(F.xxhash64("text"))
    single = rows.filter("__n = 1").withColumn("copies", F.col("__total"))
    several = (rows.filter("__n > 1").withColumn("__place", F.row_number().over(order) - 1)
               .withColumn("copies", _share("__total", "__n", F.col("__place"))).drop("__place"))
    out = single.unionByName(several).filter("copies > 0")
    return out.select(*marked.columns, F.col("copies").cast("long").alias("copies"))
