"""Mixing sources to target weights by pivotal rounding, with DataFrame operations only.

Every document of a source is wanted target / size times. The whole part is
given to each; the fractional parts are rounded by the pivotal method: two
documents pair up, mass (words) moves from one to the other at random, with
chances that keep both expectations, until one of them is integral. Pairs are
formed by a fold over small blocks; the one document a block leaves open goes
up a reduction tree of blocks until each source has a single open document,
which is drawn last. The words taken thus differ from the target by less than
one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docverify.plans.storage import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
#: Documents that one fold of the tree takes.
FAN_IN = 64
SEED = 20240131

_OPEN = "struct<doc_id:{id},size:bigint,copy:bigint,mass:double>"
_DONE = "array<struct<doc_id:{id},size:bigint,copy:bigint,up:int>>"


def source_targets(
    sized: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """(source, source_size, n, target) from rows (source, size).

    Sources by code point, null last, get the weights in turn and share
    share x all sizes. A target stops at max_repeat x its source's size; what
    is over is shared again by weight until none is above, which is the level
    at which the capped sources are those with the least capacity a weight.
    The sorts run over one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = per.withColumn("turn", turn).withColumn("weight", F.get(cycle, F.pmod("turn", F.lit(len(weights)))))
    ranked = ranked.withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    full = ranked.withColumn("total", total).withColumn("capped", F.col("weight") * level >= F.col("cap"))
    rest = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    left = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("weight") * F.try_divide(rest, left))
    )
    return full.withColumn("target", target).select("source", "source_size", "n", "target")


def _unit(*parts: Column) -> Column:
    """The same number in [0, 1) for the same parts on every run."""
    return F.pmod(F.xxhash64(*parts, F.lit(SEED)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _step(acc: Column, y: Column) -> Column:
    """One pairing: x is the open document, y the next one."""
    x, done = acc["open"], acc["done"]
    to_x = F.least(x["size"] - x["mass"], y["mass"])
    to_y = F.least(x["mass"], y["size"] - y["mass"])
    gain = _unit(x["doc_id"], x["copy"], y["doc_id"], y["copy"]) * (to_x + to_y) < to_y

    def left(z: Column, mass: Column) -> Column:
        return F.struct(z["doc_id"], z["size"], z["copy"], mass.alias("mass"))

    def settled(z: Column, up: int) -> Column:
        return F.array(F.struct(z["doc_id"], z["size"], z["copy"], F.lit(up).alias("up")))

    x_full = x["size"] - x["mass"] <= y["mass"]
    x_empty = x["mass"] <= y["size"] - y["mass"]
    stays = (
        F.when(gain & x_full, left(y, y["mass"] - to_x))
        .when(gain, left(x, x["mass"] + to_x))
        .when(x_empty, left(y, y["mass"] + to_y))
        .otherwise(left(x, x["mass"] - to_y))
    )
    goes = (
        F.when(gain & x_full, settled(x, 1))
        .when(gain, settled(y, 0))
        .when(x_empty, settled(x, 0))
        .otherwise(settled(y, 1))
    )
    return F.struct(stays.alias("open"), F.concat(done, goes).alias("done"))


def _fold(blocks: DataFrame, id_type: str) -> DataFrame:
    """Add `out` (open, done) to rows with an array `items`."""
    as_open, as_done = _OPEN.format(id=id_type), _DONE.format(id=id_type)
    start = F.struct(
        F.get("items", F.lit(0))["unit"].cast(as_open).alias("open"), F.array().cast(as_done).alias("done")
    )
    kind = f"struct<open:{as_open},done:{as_done}>"
    rest = F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0)))
    return blocks.withColumn("out", F.aggregate(rest, start.cast(kind), lambda a, y: _step(a, y["unit"]).cast(kind)))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """One row per input row: doc_id, source, copy, size, source_size, target, times, taken.

    size is the number of words (null text: 0), times how often the mix takes
    the row, taken = times x size. Documents without words have times 0. Null
    sources are one source. Rows that repeat id, source and size are told apart
    by copy (1, 2, ...). Draws depend on ids and sizes alone, so reruns agree.
    Other columns are ignored; an empty table gives an empty result.
    """
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    id_type = sized.schema["doc_id"].dataType.simpleString()
    targets = written(source_targets(sized, share, weights, max_repeat), "mix-targets")
    units = (
        sized.groupBy("source", "doc_id", "size")
        .count()
        .select("source", "doc_id", "size", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("copy"))
    )
    wanted = (
        units.alias("u")
        .join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
        .select("u.*", "n", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("times"))
        .withColumn("whole", F.floor("times"))
        .withColumn("mass", (F.col("times") - F.col("whole")) * F.col("size"))
    )
    open_ = wanted.where("mass > 0")
    level = (
        open_.withColumn("block", F.pmod(F.xxhash64("doc_id", "copy", F.lit(SEED)), F.ceil(F.col("n") / FAN_IN)))
        .groupBy("source", "block")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.xxhash64("doc_id", "copy", "size", F.lit(SEED)).alias("order"),
                        F.struct("doc_id", "size", "copy", "mass").alias("unit"),
                    )
                )
            ).alias("items")
        )
    )
    most = targets.agg(F.max("n")).first()[0] or 0
    parts, blocks = [], -(-most // FAN_IN)
    while True:
        folded = written(_fold(level, id_type).select("source", "block", "out"), "mix-level")
        parts.append(folded.select("source", F.explode("out.done").alias("d")).select("source", "d.*"))
        if blocks <= 1:
            break
        blocks = -(-blocks // FAN_IN)
        level = (
            folded.groupBy("source", F.floor(F.col("block") / FAN_IN).alias("block"))
            .agg(
                F.sort_array(
                    F.collect_list(F.struct(F.col("block").alias("order"), F.col("out.open").alias("unit")))
                ).alias("items")
            )
        )
    last = folded.select("source", "out.open.*")
    parts.append(
        last.withColumn("up", (_unit(F.col("doc_id"), F.col("copy")) * F.col("size") < F.col("mass")).cast("int"))
        .drop("mass")
    )
    decided = wanted.where("mass <= 0").select("source", "doc_id", "size", "copy", F.lit(0).alias("up"))
    for part in parts:
        decided = decided.unionByName(part)
    d, t = decided.alias("d"), targets.alias("t")
    return (
        d.join(t, F.col("d.source").eqNullSafe(F.col("t.source")))
        .withColumn(
            "times", (F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))) + F.col("up")).cast("long")
        )
        .select(
            "doc_id", "d.source", "copy", "size", "source_size", "target", "times",
            (F.col("times") * F.col("size")).alias("taken"),
        )
    )


def apply_mix(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row repeated `times` times (dropped at 0); columns as in docs.

    Rows that repeat id, source and size share out their copies' draws.
    """
    columns = docs.columns
    own = docs.withColumn(
        "__size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    )
    same = [F.col(id_col), F.col(source_col), F.col("__size")]
    own = own.withColumn("__copy", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1))).cast("long"))
    m = mix.where("times > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__m"),
        F.col("copy").alias("__c"), "times",
    ).withColumnRenamed("times", "__times")
    return (
        own.join(
            m,
            F.col(id_col).eqNullSafe(F.col("__id"))
            & F.col(source_col).eqNullSafe(F.col("__source"))
            & (F.col("__size") == F.col("__m"))
            & (F.col("__copy") == F.col("__c")),
        )
        .withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), "__times")))
        .select(*columns)
    )
