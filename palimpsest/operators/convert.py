"""Versioned dumps to quads, snapshots and operations: full copies or change sets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import literal
from ..functions.times import convert_to_datetime, iso
from ..functions.updates import update_texts

T = ["entity", "s", "p", "o"]


def copies_to_changes(copies: DataFrame, versions: int) -> DataFrame:
    """(version, op, entity, s, p, o) from full copies (version from 0, entity, s, p, o): one pass over all versions; a gap before a version is an insertion, one after it a deletion."""
    rows = copies.select("version", *T).distinct()
    w = Window.partitionBy(*T).orderBy("version")
    rows = rows.withColumn("before", F.lag("version").over(w)).withColumn("after", F.lead("version").over(w))
    ins = rows.where((F.col("version") > 0) & (F.col("before").isNull() | (F.col("before") < F.col("version") - 1))).select("version", F.lit("I").alias("op"), *T)
    dele = rows.where((F.col("version") < versions - 1) & (F.col("after").isNull() | (F.col("after") > F.col("version") + 1))).select((F.col("version") + 1).cast("int").alias("version"), F.lit("D").alias("op"), *T)
    return ins.unionByName(dele)


def apply_changes(initial: DataFrame, changes: DataFrame) -> DataFrame:
    """(entity, s, p, o) after all change sets: of each triple the last change counts, insertions after deletions of the same version."""
    start = initial.select(*T, F.lit(0).alias("version"), F.lit("I").alias("op"))
    rows = start.unionByName(changes.select(*T, "version", "op"))
    return rows.groupBy(*T).agg(F.max_by("op", F.struct("version", "op")).alias("op")).where("op = 'I'").select(*T)


def times_frame(spark, timestamps: list[datetime | str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(i, convert_to_datetime(t)) for i, t in enumerate(timestamps)], "version int, generated_at timestamp"))


def numbered(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """(entity, number, version, emptied): snapshot 1 of every entity is dated to version 0 whatever version it appears in; each version with a change gets the next number."""
    first = entities.select("entity").distinct().select("entity", F.lit(1).alias("number"), F.lit(0).alias("version"))
    per = changes.select("entity", "version").distinct()
    more = per.withColumn("number", (F.row_number().over(Window.partitionBy("entity").orderBy("version")) + 1).cast("int"))
    return first.unionByName(more.select("entity", "number", "version"))


def snapshots_of(numbers: DataFrame, alive: DataFrame, changes: DataFrame, graph: str, agent: str, timestamps: list) -> DataFrame:
    """The snapshot table of numbered versions. The last snapshot of an entity that is not alive after its last change is invalidated at that change's time."""
    spark = numbers.sparkSession
    when = times_frame(spark, timestamps)
    texts = update_texts(changes.withColumn("g", F.lit(f"<{graph}>")), "entity", "version")
    last = numbers.groupBy("entity").agg(F.max("number").alias("last"))
    rows = numbers.join(when, "version").join(texts, ["entity", "version"], "left").join(last, "entity").join(alive.select("entity", F.lit(True).alias("alive")).distinct(), "entity", "left")
    bare = F.regexp_replace("entity", "^<|>$", "")
    snap = lambda n: F.concat(F.lit("<"), bare, F.lit("/prov/se/"), n.cast("string"), F.lit(">"))
    ended = (F.col("number") == F.col("last")) & (F.col("number") > 1) & F.col("alive").isNull()
    return rows.select(
        "entity", snap(F.col("number")).alias("snapshot"), "generated_at", F.when(ended, F.col("generated_at")).alias("invalidated_at"), F.lit(f"<{agent}>").alias("attributed_to"), F.lit(None).cast("string").alias("primary_source"),
        F.when(F.col("number") == 1, F.lit("created")).otherwise(F.lit("modified")).alias("description"), F.when(F.col("number") > 1, F.col("update_query")).alias("update_query"), F.when(F.col("number") > 1, F.array(snap(F.col("number") - 1))).otherwise(F.array().cast("array<string>")).alias("derived_from"), "number",
    )


def convert_copies(copies: DataFrame, timestamps: list, graph: str, agent: str) -> tuple[DataFrame, DataFrame]:
    """(quads, snapshots) of full copies, one for each of timestamps."""
    n = len(timestamps)
    changes = copies_to_changes(copies, n)
    last = copies.where(F.col("version") == n - 1).select(*T).distinct()
    return last.withColumn("g", F.lit(f"<{graph}>")), snapshots_of(numbered(copies, changes), last, changes, graph, agent, timestamps)


def convert_changes(initial: DataFrame, changes: DataFrame, timestamps: list, graph: str, agent: str) -> tuple[DataFrame, DataFrame]:
    """(quads, snapshots) of a first copy and change sets (version from 1, op, entity, s, p, o). Update texts hold the change sets as they are."""
    last = apply_changes(initial, changes)
    both = initial.select("entity").union(changes.select("entity"))
    return last.withColumn("g", F.lit(f"<{graph}>")), snapshots_of(numbered(both, changes), last, changes, graph, agent, timestamps)


#: IRIs of the provenance vocabulary.
_P = "http://www.w3.org/ns/prov#"
IRIS = {"generated_at": _P + "generatedAtTime", "invalidated_at": _P + "invalidatedAtTime", "entity": _P + "specializationOf", "derived_from": _P + "wasDerivedFrom", "primary_source": _P + "hadPrimarySource", "attributed_to": _P + "wasAttributedTo", "description": "http://purl.org/dc/terms/description", "update_query": "https://w3id.org/oc/ontology/hasUpdateQuery"}
_RDF = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def dataset_lines(quads: DataFrame) -> DataFrame:
    """(value): N-Quads lines, sorted by entity, predicate and object."""
    return quads.orderBy("entity", "p", "o").select(F.concat_ws(" ", "s", "p", "o", "g", F.lit(".")).alias("value"))


def provenance_lines(snapshots: DataFrame) -> DataFrame:
    """(value): N-Quads lines of snapshots in the graph <entity>/prov/."""
    g = F.concat(F.lit("<"), F.regexp_replace("entity", "^<|>$", ""), F.lit("/prov/>"))
    typed = lambda c: F.concat(F.lit('"'), iso(F.col(c)), F.lit('"^^<http://www.w3.org/2001/XMLSchema#dateTime>'))
    one = lambda p, o: F.when(o.isNotNull(), F.array(F.concat_ws(" ", "snapshot", F.lit(p), o, g, F.lit(".")))).otherwise(F.array().cast("array<string>"))
    iri = lambda k: f"<{IRIS[k]}>"
    lines = F.concat(
        one(_RDF, F.lit(f"<{_P}Entity>")), one(iri("entity"), F.col("entity")), one(iri("generated_at"), typed("generated_at")), one(iri("invalidated_at"), typed("invalidated_at")), one(iri("attributed_to"), F.col("attributed_to")), one(iri("primary_source"), F.col("primary_source")),
        one(iri("description"), literal(F.col("description"))), one(iri("update_query"), literal(F.col("update_query"))), F.transform("derived_from", lambda d: F.concat_ws(" ", F.col("snapshot"), F.lit(iri("derived_from")), d, g, F.lit("."))),
    )
    return snapshots.select(F.explode(lines).alias("value"))
