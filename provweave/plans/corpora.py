"""Provenance corpora derived from the star-schema tables, as JSON texts (graph, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables that a corpus is brought together from, with the key of a document; the others are looked up.
KEYS = {"commerce": {"lineitem": "l_orderkey", "orders": "o_orderkey"}, "dialogue": {"conversations": "conv_id"}, "telemetry": {"events": "user_id"}}

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def member(name: Column, record: Column) -> Column:
    """``"name":record`` for plain names."""
    return F.concat(F.lit('"'), name, F.lit('":'), record)


def record(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k.replace("__", ":")) for k, v in fields.items()]))


def typed(value: Column, kind: str) -> Column:
    return F.struct(value.alias("$"), F.lit(kind).alias("type"))


def input_bytes(spark: SparkSession, sf_dir: str, corpus: str) -> int:
    """Bytes of the tables of KEYS, as Spark lists them."""
    size = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return sum(map(size, KEYS[corpus]))


def in_share(key: str, share: tuple[int, int]) -> Column:
    """Whether a key, which may be null, falls into the first of so many shares."""
    return F.pmod(F.xxhash64(key), F.lit(share[1])) == share[0]


def table(spark: SparkSession, sf_dir: str, corpus: str, name: str, share: tuple[int, int]) -> DataFrame:
    """The rows of a share of a table of KEYS."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows if share[1] == 1 else rows.where(in_share(KEYS[corpus][name], share))


def lines(spark: SparkSession, sf_dir: str, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """Line items with a number within their order; the stored line number is not unique."""
    return table(spark, sf_dir, "commerce", "lineitem", share).withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))


def _documents(parts: list[DataFrame], prefix: str, *sections: str) -> DataFrame:
    """Documents from (key, section, member) rows; texts are exchanged once, all members of a document together."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    whole = rows.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("section", "member"))).alias("members"))
    own = lambda s: F.transform(F.filter("members", lambda x: x["section"] == s), lambda x: x["member"])
    texts = [F.when(F.size(own(s)) > 0, F.concat(F.lit(f'"{s}":{{'), F.array_join(own(s), ","), F.lit("}"))) for s in sorted(sections)]
    return whole.select(F.concat(F.lit(prefix), F.col("key").cast("string"), F.lit(".json")).alias("graph"), F.concat(F.lit("{"), F.concat_ws(",", *texts), F.lit("}")).alias("body"))


def commerce(spark: SparkSession, sf_dir: str, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """One document per order: parts, customer and suppliers, and what the order used."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    c, s, l = F.col, F.lit, lines(spark, sf_dir, share)
    orders = table(spark, sf_dir, "commerce", "orders", share).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("key", c("o_orderkey"))
    items = l.join(read("part"), c("l_partkey") == c("p_partkey")).withColumn("key", c("l_orderkey"))
    n = lambda kind, col: F.concat(s(f"{kind}:"), c(col).cast("string"))
    when = lambda col: F.date_format(c(col), "yyyy-MM-dd'T'HH:mm:ss")
    row = lambda df, section, name, rec: df.select("key", s(section).alias("section"), member(name, rec).alias("member"))
    return _documents([
        row(items, "entity", n("part", "l_partkey"), record(prov__type=s("part"), ex__brand=c("p_brand"), ex__type=c("p_type"), prov__label=c("p_name"))),
        row(orders, "entity", n("order", "o_orderkey"), record(prov__type=s("order"), ex__status=c("o_orderstatus"), ex__priority=c("o_orderpriority"), prov__value=typed(c("o_totalprice"), "xsd:double"), prov__generatedAtTime=when("o_orderdate"))),
        row(orders, "activity", n("fulfil", "o_orderkey"), record(prov__type=s("fulfil"), prov__startTime=when("o_orderdate"))),
        row(orders, "agent", n("cust", "o_custkey"), record(prov__type=s("customer"), ex__segment=c("c_mktsegment"))),
        row(items, "agent", n("supp", "l_suppkey"), record(prov__type=s("supplier"))),
        row(items, "used", n("u", "rn"), record(prov__activity=n("fulfil", "l_orderkey"), prov__entity=n("part", "l_partkey"), prov__role=c("l_returnflag"), prov__time=typed(when("l_shipdate"), "xsd:dateTime"))),
        row(items, "wasAttributedTo", F.concat(s("t:"), c("l_partkey").cast("string"), s(":"), c("l_suppkey").cast("string")), record(prov__entity=n("part", "l_partkey"), prov__agent=n("supp", "l_suppkey"))),
        row(orders, "wasGeneratedBy", s("g"), record(prov__entity=n("order", "o_orderkey"), prov__activity=n("fulfil", "o_orderkey"))),
        row(orders, "wasAssociatedWith", s("a"), record(prov__activity=n("fulfil", "o_orderkey"), prov__agent=n("cust", "o_custkey"))),
    ], "order/", "entity", "activity", "agent", "used", "wasAttributedTo", "wasGeneratedBy", "wasAssociatedWith")


def dialogue(spark: SparkSession, sf_dir: str, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """One document per conversation: turns, messages and who said them."""
    t = table(spark, sf_dir, "dialogue", "conversations", share).withColumn("key", F.col("conv_id"))
    c, s = F.col, F.lit
    t = t.withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    n = lambda kind, col: F.concat(s(f"{kind}:"), c(col).cast("string"))
    row = lambda df, section, name, rec: df.select("key", s(section).alias("section"), member(name, rec).alias("member"))
    later = t.where(c("before").isNotNull())
    return _documents([
        row(t, "agent", n("role", "role"), record(prov__type=c("role"))),
        row(t, "activity", n("turn", "turn"), record(prov__type=s("turn"))),
        row(t, "entity", n("message", "turn"), record(prov__type=s("message"), prov__value=c("text"))),
        row(t, "wasGeneratedBy", n("g", "turn"), record(prov__entity=n("message", "turn"), prov__activity=n("turn", "turn"))),
        row(later, "wasInformedBy", n("i", "turn"), record(prov__informed=n("turn", "turn"), prov__informant=n("turn", "before"))),
    ], "conv/", "agent", "activity", "entity", "wasGeneratedBy", "wasInformedBy")


def telemetry(spark: SparkSession, sf_dir: str, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """One document per user: events, with nested properties as an off-schema field, and a bundle of their entities."""
    e = table(spark, sf_dir, "telemetry", "events", share).withColumn("key", F.col("user_id"))
    c, s = F.col, F.lit
    name = F.concat(s("event:"), c("event_id").cast("string"))
    row = lambda section, name, rec: e.select("key", s(section).alias("section"), member(name, rec).alias("member"))
    used = F.concat(s('{"prov:activity":"'), name, s('","prov:entity":"kind:'), c("event_type"), s('","ex:props":'), c("props"), s("}"))
    inner = F.concat(s('{"entity":{"kind:'), c("event_type"), s('":{"prov:type":"kind"}}}'))
    return _documents([
        row("activity", name, record(prov__type=s("event"), prov__value=c("value"))),
        row("used", F.concat(s("u"), c("event_id").cast("string")), used),
        row("bundle", F.concat(s("kinds:"), c("event_type")), inner),
    ], "user/", "activity", "used", "bundle")
