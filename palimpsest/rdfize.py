"""The driver's tables as quads, snapshots and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.terms import XSD, iri, literal
from .plans.query import Catalog
from .scratch import small_pieces, written

USERS = "<urn:g:users>"
STATUS, VALUE = "<urn:p:status>", "<urn:p:value>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


def user(x: Column) -> Column:
    return iri(F.concat(F.lit("urn:user/"), x.cast("string")))


#: Rows of a table, and of what is made from it, that one task takes, about.
PER_TASK, MADE_PER_TASK = 50_000, 250_000


def dealt(df: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """df over tasks of about so many rows: a file of a few row groups is read by few tasks, however much is made of a row."""
    n = -(-df.count() // per_task)
    return df.repartition(n) if n > 1 else df


def static_quads(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("customer", "nation", "region", "supplier", "part", "orders"), deal: bool = False) -> DataFrame:
    """Each non-null column of each row as a quad; keys of other tables are IRIs, doubles are cents. deal: rows are dealt over tasks first."""
    keys = {"custkey": "customer", "nationkey": "nation", "regionkey": "region", "suppkey": "supplier", "partkey": "part", "orderkey": "orders"}
    out = None
    for name in names:
        df = table(spark, sf_dir, name)
        df = dealt(df) if deal else df
        s = iri(F.concat(F.lit(f"urn:t:{name}/"), F.col(df.columns[0]).cast("string")))
        pairs = []
        for c, kind in df.dtypes:
            ref = keys.get(c.split("_", 1)[-1])
            if ref and c != df.columns[0]:
                o = iri(F.concat(F.lit(f"urn:t:{ref}/"), F.col(c).cast("string")))
            elif kind == "double":
                o = literal(cents(F.col(c)), XSD + "integer")
            elif kind.startswith(("int", "bigint")):
                o = literal(F.col(c), XSD + "integer")
            elif kind.startswith("timestamp"):
                o = literal(F.date_format(c, "yyyy-MM-dd"), XSD + "date")
            else:
                o = literal(F.col(c))
            pairs.append(F.struct(F.lit(f"<urn:p:{c}>").alias("p"), o.alias("o")))
        rows = df.select(s.alias("s"), F.explode(F.array(*pairs)).alias("x")).where("x.o is not null").select(F.col("s").alias("entity"), "s", "x.p", "x.o", F.lit(f"<urn:g:{name}>").alias("g"))
        out = rows if out is None else out.unionByName(rows)
    return out


def snapshot_name(user_id: Column, number: Column, padded: bool) -> Column:
    n = number.cast("string")
    return F.concat(F.lit("<urn:user/"), user_id.cast("string"), F.lit("/prov/se/"), F.lpad(n, 9, "0") if padded else n, F.lit(">"))


def event_states(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    """(user_id, generated_at, event_id, event_type, cents, number, last, prev_type, prev_cents): each event of a user, with what was known before it. daily: times are cut to days, so that many snapshots share one."""
    ev = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = ev.select("user_id", "ts", "event_id", "event_type", cents(F.col("value")).alias("cents")).withColumns({"number": F.row_number().over(w), "prev_type": F.lag("event_type").over(w), "prev_cents": F.lag("cents").over(w), "last": F.lead(F.lit(True)).over(w).isNull()})
    at = F.date_trunc("day", "ts") if daily else F.col("ts")
    return rows.select("user_id", at.alias("generated_at"), "event_id", "event_type", "cents", "number", "last", "prev_type", "prev_cents")


def pairs_of(states: DataFrame) -> list[tuple[str, Column, Column]]:
    """(predicate, object, object before) of a user's two quads after an event."""
    number = lambda c: literal(F.col(c), XSD + "integer")
    return [(STATUS, literal(F.col("event_type")), literal(F.col("prev_type"))), (VALUE, number("cents"), number("prev_cents"))]


SNAPSHOT = ["entity", "snapshot", "generated_at", "invalidated_at", "attributed_to", "primary_source", "description", "update_query", "derived_from"]
OPS = ["entity", "snapshot", "generated_at", "op_seq", "quad_seq", "op", "s", "p", "o", "g"]


def snapshots_from(rows: DataFrame, derived: Column, invalidated: Column | None = None, description: str = "event") -> DataFrame:
    """rows (entity, snapshot, generated_at, ...) with the other columns of a snapshot."""
    none = F.lit(None).cast("string")
    return rows.select("entity", "snapshot", "generated_at", (F.lit(None).cast("timestamp") if invalidated is None else invalidated).alias("invalidated_at"), F.lit("<urn:agent:driver>").alias("attributed_to"), none.alias("primary_source"), F.lit(description).alias("description"), none.alias("update_query"), derived.alias("derived_from"))


def event_catalog(spark: SparkSession, sf_dir: str, kind: str = "") -> Catalog:
    """Histories of users: a snapshot for each event; operations are the differences between states; the dataset is the last state.

    kind: "" as it is; "ties" cuts times to days and leaves snapshot numbers unpadded; "deleted" ends users whose last event is
    an error by a snapshot one second later that deletes all and is invalidated; "merged" adds the merges of user_merges as
    snapshots of the survivors.
    """
    with small_pieces(spark):
        states = written(event_states(spark, sf_dir, kind == "ties"), "states")
    name = lambda n: snapshot_name(F.col("user_id"), n, kind != "ties")
    first = states.withColumns({"entity": user(F.col("user_id")), "snapshot": name(F.col("number"))})
    op = lambda seq, op, p, o: F.struct(F.lit(seq).alias("op_seq"), F.lit(op).alias("op"), F.lit(p).alias("p"), o.alias("o"))
    changes = [F.when(~prev.eqNullSafe(o) & x.isNotNull(), op(seq, kind_, p, x)) for p, o, prev in pairs_of(states) for seq, kind_, x in ((0, "D", prev), (1, "I", o))]
    # the creation's operations belong to the creation: the first snapshot has no update text
    ops = first.select("entity", "snapshot", "generated_at", F.explode(F.array(*changes)).alias("x")).where("x is not null").select("entity", "snapshot", "generated_at", "x.*", F.col("entity").alias("s"))
    ops = ops.withColumns({"quad_seq": F.lit(0), "g": F.lit(USERS)}).select(*OPS)
    held = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o, _ in pairs_of(states)]))
    left = first.where("last").select("*", held.alias("x")).select("*", "x.*").where("o is not null")
    snaps = snapshots_from(first, F.when(F.col("number") > 1, F.array(name(F.col("number") - 1))).otherwise(F.array().cast("array<string>")))
    if kind == "deleted":
        end = left.where("event_type = 'error'").withColumns({"generated_at": F.col("generated_at") + F.expr("interval 1 second"), "snapshot": name(F.col("number") + 1)})
        ops = ops.unionByName(end.select("entity", "snapshot", "generated_at", F.lit(0).alias("op_seq"), F.lit(0).alias("quad_seq"), F.lit("D").alias("op"), F.col("entity").alias("s"), "p", "o", F.lit(USERS).alias("g")))
        snaps = snaps.unionByName(snapshots_from(end.where(F.col("p") == STATUS), F.array(name(F.col("number"))), F.col("generated_at")))
        left = left.where("not (event_type <=> 'error')")
    if kind == "merged":
        snaps = snaps.unionByName(merge_snapshots(first.where("last")))
    out = Catalog.build(left.select("entity", F.col("entity").alias("s"), "p", "o", F.lit(USERS).alias("g")), snaps, ops, tasks=-(-4 * states.count() // MADE_PER_TASK) or 1)
    out.tables.append(states)
    return out


def merge_snapshots(last: DataFrame) -> DataFrame:
    """Merges as snapshots: user u is absorbed by u - u % 5, and tens by hundreds, at its last event. last (user_id, snapshot, generated_at): each user's last snapshot."""
    u = F.col("user_id")
    to = F.when(u % 5 != 0, u - u % 5).when(u % 10 == 0, u - u % 100)
    rows = last.withColumn("to", to).where("to is not null and to <> user_id")
    rows = rows.select(user(F.col("to")).alias("entity"), F.concat(F.lit("<urn:merge/"), u.cast("string"), F.lit(">")).alias("name"), "generated_at", F.col("snapshot").alias("from"))
    return snapshots_from(rows.withColumnRenamed("name", "snapshot"), F.array("from"), description="merge")


def static_catalog(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> Catalog:
    """Tables as a dataset in which every entity has one snapshot, of 2020."""
    q = static_quads(spark, sf_dir, names, deal=True)
    rows = q.select("entity").distinct().select("entity", F.concat(F.lit("<"), F.regexp_replace("entity", "[<>]", ""), F.lit("/prov/se/1>")).alias("snapshot"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("generated_at"))
    ops = spark.createDataFrame([], "entity string, snapshot string, generated_at timestamp, op_seq int, quad_seq int, op string, s string, p string, o string, g string")
    return Catalog.build(q, snapshots_from(rows, F.array().cast("array<string>"), description="row"), ops, tasks=-(-q.count() // MADE_PER_TASK) or 1)


def nation_merges(spark: SparkSession, sf_dir: str, catalog: Catalog) -> Catalog:
    """catalog, in which the first nation of each region absorbs the others in 2021."""
    n = table(spark, sf_dir, "nation")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("to"))
    of = lambda c, k: F.concat(F.lit("<urn:t:nation/"), F.col(c).cast("string"), F.lit(k))
    rows = n.join(first, "n_regionkey").where("n_nationkey <> to").groupBy("to").agg(F.array_sort(F.collect_list(of("n_nationkey", "/prov/se/1>"))).alias("from"))
    rows = rows.select(of("to", ">").alias("entity"), of("to", "/prov/se/2>").alias("snapshot"), F.lit("2021-01-01 00:00:00").cast("timestamp").alias("generated_at"), "from")
    return Catalog(catalog.quads, catalog.snapshots.unionByName(snapshots_from(rows, F.col("from"), description="merge")), catalog.ops, catalog.validity)


def moved_out(spark: SparkSession, sf_dir: str) -> Catalog:
    """Customers and nations that referred to their nation or region at creation in 2020, and no longer do since 2021: only updates tell."""
    q = static_quads(spark, sf_dir, ("customer", "nation", "region"))
    bare = F.regexp_replace("entity", "[<>]", "")
    name = lambda n: F.concat(F.lit("<"), bare, F.lit(f"/prov/se/{n}>"))
    at = lambda year: F.lit(f"{year}-01-01 00:00:00").cast("timestamp").alias("generated_at")
    refers = F.col("o").startswith("<")
    ops = q.where(refers).select("entity", name(2).alias("snapshot"), at(2021), F.lit(0).alias("op_seq"), F.lit(0).alias("quad_seq"), F.lit("D").alias("op"), "s", "p", "o", "g")
    first = snapshots_from(q.select("entity", name(1).alias("snapshot"), at(2020)).distinct(), F.array().cast("array<string>"))
    second = snapshots_from(q.where(refers).select("entity", name(2).alias("snapshot"), at(2021)).distinct(), F.array(name(1)))
    return Catalog.build(q.where(~refers), first.unionByName(second), ops)


def daily_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version, entity, s, p, o): the event types a user had on a day, as one full copy for each day from the first on."""
    ev = table(spark, sf_dir, "events").where("user_id is not null and ts is not null and event_type is not null")
    day = F.date_trunc("day", "ts")
    first = ev.agg(F.min(day).alias("first"))
    return ev.join(F.broadcast(first)).select(F.datediff(day, F.col("first")).cast("int").alias("version"), user(F.col("user_id")).alias("entity"), user(F.col("user_id")).alias("s"), F.lit("<urn:p:did>").alias("p"), literal(F.col("event_type")).alias("o")).distinct()


def daily_changes(copies: DataFrame) -> DataFrame:
    """(version, op, entity, s, p, o) of daily copies as change sets are often published: each day adds all that it has, also what was there, and removes what only the day before had."""
    t = ["version", "entity", "s", "p", "o"]
    add = copies.where("version > 0").select(F.lit("I").alias("op"), *t)
    last = copies.agg(F.max("version").alias("last"))
    gone = copies.withColumn("version", F.col("version") + 1).join(copies, t, "left_anti").join(F.broadcast(last), F.col("version") <= F.col("last")).select(F.lit("D").alias("op"), *t)
    return add.unionByName(gone)
