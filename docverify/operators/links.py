"""Rings: cases linked through the photographs, addresses and patterns they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docverify.functions.bind import let
from docverify.operators.allpairs import near_links, near_pairs
from docverify.operators.components import connected_components
from docverify.plans.storage import written

#: Severity of a ring by what is shared.
SEVERITY = {"photo": "CRITICAL", "pattern": "HIGH", "address": "MEDIUM"}
#: Cases of an entity that are paired with one another; above it each is paired with the smallest.
PAIRED = 50


def links(cases: DataFrame, case_id: str, **entities: Column) -> DataFrame:
    """G1: distinct (case_id, entity_type, entity_id) of the given columns; null and blank ids give no link."""
    each = [F.struct(F.lit(k).alias("entity_type"), v.cast("string").alias("entity_id")) for k, v in entities.items()]
    long = cases.select(F.col(case_id).alias("case_id"), F.explode(F.array(*each)).alias("e")).select("case_id", "e.*")
    return long.where("case_id is not null and coalesce(entity_id, '') <> ''").distinct()


def shared_entities(found: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """(entity_type, entity_id, n_cases) of entities with two cases or more.

    With people (case_id, name, id_number; a row a case) also n_names and n_ids,
    the exact numbers of different names and numbers, null and blank ones apart.
    Rows are first reduced to an entity's different people; then names and
    numbers are each counted by value before they are by entity, so that a hot
    entity is spread and no task holds a set of its values.
    """
    entity = ["entity_type", "entity_id"]
    if people is None:
        return found.groupBy(*entity).agg(F.count_distinct("case_id").alias("n_cases")).where("n_cases > 1")
    shown = people.select("case_id", F.nullif(F.trim("name"), F.lit("")).alias("name"), F.nullif(F.trim("id_number"), F.lit("")).alias("id_number"))
    kinds = written(found.join(shown, "case_id", "left").groupBy(*entity, "name", "id_number").agg(F.count(F.lit(1)).alias("n")), "people")
    names = kinds.groupBy(*entity, "name").agg(F.sum("n").alias("n")).groupBy(*entity).agg(F.sum("n").alias("n_cases"), F.count("name").alias("n_names"))
    ids = kinds.groupBy(*entity, "id_number").agg(F.lit(1).alias("one")).groupBy(*entity).agg(F.count("id_number").alias("n_ids"))
    return names.where("n_cases > 1").join(ids, entity)


def rings(found: DataFrame) -> DataFrame:
    """A row a ring with its severity, number of cases, and smallest and largest case.

    The cases themselves stay rows (suspicious_links): an entity may have any number.
    """
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return (
        found.groupBy("entity_type", "entity_id")
        .agg(F.count_distinct("case_id").alias("n_cases"), F.min("case_id").alias("first_case"), F.max("case_id").alias("last_case"))
        .where("n_cases > 1")
        .withColumn("severity", severity[F.col("entity_type")])
        .withColumn("title", F.concat_ws(" ", F.lit("Shared"), "entity_type", "entity_id"))
    )


def suspicious_links(found: DataFrame) -> DataFrame:
    """Found with is_suspicious: the entity is shared."""
    return found.join(shared_entities(found), ["entity_type", "entity_id"], "left").select(
        "case_id", "entity_type", "entity_id", F.col("n_cases").isNotNull().alias("is_suspicious")
    )


def case_pairs(found: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b, entity_type, entity_id, all_pairs), a < b, for cases that share an entity.

    An entity with more than `paired` cases pairs each with its smallest only:
    as many rows as cases, and the same components. all_pairs is false for
    these, so that a reader sees where pairs are meant but not listed.
    """
    sizes = found.groupBy("entity_type", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("least")).where("n > 1")
    sized = found.join(sizes, ["entity_type", "entity_id"])
    few = sized.where(F.col("n") <= paired).select("entity_type", "entity_id", "case_id")
    both = few.alias("l").join(few.alias("r"), ["entity_type", "entity_id"]).where("l.case_id < r.case_id")
    star = sized.where((F.col("n") > paired) & (F.col("case_id") > F.col("least")))
    named = ["entity_type", "entity_id"]
    return both.select(F.col("l.case_id").alias("a"), F.col("r.case_id").alias("b"), *named, F.lit(True).alias("all_pairs")).unionByName(
        star.select(F.col("least").alias("a"), F.col("case_id").alias("b"), *named, F.lit(False).alias("all_pairs"))
    )


def clusters(found: DataFrame) -> DataFrame:
    """(case_id, ring_id) of cases in a ring; ring_id is the ring's smallest case.

    Components run over one edge from each case to its entity's smallest case.
    """
    least = found.groupBy("entity_type", "entity_id").agg(F.min("case_id").alias("least"), F.count(F.lit(1)).alias("n"))
    edges = found.join(least.where("n > 1").drop("n"), ["entity_type", "entity_id"]).where("case_id <> least")
    return connected_components(edges, "case_id", "least").select(F.col("node").alias("case_id"), F.col("root").alias("ring_id"))


def entity_status(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(entity_type, entity_id, degree, status): flagged where a case of it was escalated or it is shared."""
    joined = found.join(verdicts.select("case_id", (F.col("action") == "ESCALATE").alias("bad")), "case_id", "left")
    return joined.groupBy("entity_type", "entity_id").agg(
        F.count_distinct("case_id").alias("degree"),
        F.when(F.coalesce(F.bool_or("bad"), F.lit(False)) | (F.count_distinct("case_id") > 1), "flagged").otherwise("normal").alias("status"),
    )


def exact_portraits(portraits: DataFrame, hist: str = "hist") -> DataFrame:
    """C5, equal histograms: portraits with print (SHA-256) and n_same."""
    prints = portraits.withColumn("print", F.sha2(F.concat_ws(",", F.col(hist).cast("array<string>")), 256))
    sizes = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n_same"))
    return prints.join(sizes, "print")


def _unit(vector: Column) -> Column:
    """The vector at length 1; null where its length is null, 0 or not finite."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return let(norm, lambda n: F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x / n)))

    return let(vector.cast("array<double>"), scaled)


def near_portraits(portraits: DataFrame, least: float = 0.95, id_col: str = "vec_id", hist: str = "embedding") -> DataFrame:
    """C5, near: (a, b, similarity) of all portraits whose cosine is at least `least`; every pair is compared (see allpairs).

    Equal portraits are one class, represented by the smallest id; null, empty
    and all-zero vectors, and those without a finite length, are in no pair.
    """
    rows = portraits.select(F.col(id_col).cast("long").alias("id"), _unit(F.col(hist)).alias("u")).where("id is not null and u is not null")
    return near_pairs(written(rows.groupBy("u").agg(F.min("id").alias("id")), "portraits"), least)


def portrait_groups(portraits: DataFrame, least: float = 0.95, id_col: str = "vec_id", hist: str = "embedding") -> DataFrame:
    """C5, near, at any number of alike portraits: (id, group_id, n_links), a row a portrait.

    group_id is the smallest id that links reach, a link being a cosine of at
    least `least`; every pair is compared, but none is written: a task gives the
    trees that its pairs make (see allpairs). n_links counts all links of a
    portrait's class. Equal portraits are one class. Null, empty and all-zero
    vectors, and those without a finite length, are alone; rows without an id
    are left out, and rows that share one are in one group.
    """
    rows = portraits.select(F.col(id_col).cast("long").alias("id"), _unit(F.col(hist)).alias("u")).where("id is not null")
    same = F.when(F.col("u").isNotNull(), F.sha2(F.concat_ws(",", F.col("u").cast("array<string>")), 256)).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    rows = written(rows.withColumn("print", same), "portraits")
    # one vector a class: that of the smallest id of each print
    classes = rows.groupBy("print").agg(F.min("id").alias("least_id"))
    firsts = rows.join(classes, "print").where("id = least_id and u is not null").dropDuplicates(["id", "print"])
    found = written(near_links(written(firsts.select("id", "u"), "portrait-units"), least), "portrait-links")
    roots = connected_components(found, "node", "root")
    degree = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    linked = roots.join(degree, "node").withColumnRenamed("node", "least_id")
    grouped = classes.join(linked, "least_id", "left")
    return rows.select("id", "print").join(grouped, "print").select("id", F.coalesce("root", "least_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
