"""The given tables seen as trips, zones and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odflow.functions.spread import dealt

# Order lines of one task, in the mean.
LINES_A_TASK = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the nation of buyer and seller."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linenumber"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    buyers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sellers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    )


def nation_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between the 25 nations, cut by order priority, one per day."""
    return order_lines(spark, sf_dir).select(
        F.lit("nations").alias("study_area"),
        F.col("c_nationkey").cast("string").alias("origin"),
        F.col("s_nationkey").cast("string").alias("destination"),
        F.col("l_quantity").alias("flow"),
        F.col("o_orderpriority").alias("partition"),
        F.col("o_orderdate").cast("date").alias("date"),
    )


NATION_REFERENCE = "1-URGENT"


def nation_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations on a 5-wide grid of 10 km squares; population = customers, attractiveness = sellers."""
    buyers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("pop"))
    sellers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("m"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    pop = F.coalesce("pop", F.lit(0)).cast("double")
    attractiveness = (1 + F.coalesce("m", F.lit(0))).cast("double")
    return (
        nations.join(buyers, "k", "left")
        .join(sellers, "k", "left")
        .select(
            F.lit("nations").alias("study_area"),
            F.col("k").cast("string").alias("zone"),
            (10.0 * F.pmod("k", F.lit(5))).alias("x"),
            (10.0 * F.floor(F.col("k") / 5)).alias("y"),
            F.lit(100.0).alias("area"),
            pop.alias("pop"),
            attractiveness.alias("attractiveness"),
            F.array(pop, attractiveness).alias("features"),
            F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("group"),
        )
    )


def fine_zone_count(spark: SparkSession, sf_dir: str) -> int:
    """As many fine zones as sellers, so the zone table grows with the data."""
    return table(spark, sf_dir, "supplier").count()


def fine_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks among which the flows of fine zones are dealt, so that one holds no fixed share of them."""
    return -(-table(spark, sf_dir, "lineitem").count() // LINES_A_TASK)


def fine_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between fine zones, cut by return flag.

    The destination lies a step before or after the buyer's zone. Steps are the seller's number cut down by halves, as often as the
    part says, so that near zones get more flow; more so for returned goods.
    """
    k = F.lit(fine_zone_count(spark, sf_dir))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    halved = F.pmod("l_partkey", F.when(F.col("l_returnflag") == "R", 8).otherwise(6))
    step = F.floor(F.pmod("l_suppkey", k) / F.pow(F.lit(2.0), halved)) * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)
    lines = dealt(lines, fine_tasks(spark, sf_dir), ["l_orderkey"])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("grid").alias("study_area"),
        F.pmod("o_custkey", k).cast("string").alias("origin"),
        F.pmod(F.pmod("o_custkey", k) + step, k).cast("long").cast("string").alias("destination"),
        F.col("l_quantity").alias("flow"),
        F.col("l_returnflag").alias("partition"),
        F.lit(None).cast("date").alias("date"),
    )


FINE_REFERENCE = "A"


def fine_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One zone per seller on a square grid of 2 km; population = customers, attractiveness = parts."""
    count = fine_zone_count(spark, sf_dir)
    k = F.lit(count)
    width = 1
    while width * width < count:
        width += 1
    buyers = table(spark, sf_dir, "customer").groupBy(F.pmod("c_custkey", k).alias("k")).agg(F.count("*").alias("pop"))
    parts = table(spark, sf_dir, "part").groupBy(F.pmod("p_partkey", k).alias("k")).agg(F.count("*").alias("m"))
    zones = table(spark, sf_dir, "supplier").select(F.pmod("s_suppkey", k).alias("k"))
    pop = (1 + F.coalesce("pop", F.lit(0))).cast("double")
    attractiveness = (1 + F.coalesce("m", F.lit(0)) + F.pmod("k", F.lit(7))).cast("double")
    return (
        zones.join(buyers, "k", "left")
        .join(parts, "k", "left")
        .select(
            F.lit("grid").alias("study_area"),
            F.col("k").cast("string").alias("zone"),
            (2.0 * F.pmod("k", F.lit(width))).alias("x"),
            (2.0 * F.floor(F.col("k") / width)).alias("y"),
            F.lit(4.0).alias("area"),
            pop.alias("pop"),
            attractiveness.alias("attractiveness"),
            F.array(pop, attractiveness).alias("features"),
            F.concat_ws("_", F.lit("g"), F.floor(F.pmod("k", F.lit(width)) / 2), F.floor(F.floor(F.col("k") / width) / 2)).alias("group"),
        )
    )


def queen_edges(zones: DataFrame, step: float) -> DataFrame:
    """Neighbours on the grid, corners included: each zone looks its eight neighbours up by position."""
    offsets = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
    near = F.explode(
        F.array(*[F.struct((F.col("x") + dx * step).alias("x"), (F.col("y") + dy * step).alias("y")) for dx, dy in offsets])
    )
    at = zones.select("study_area", F.col("zone").alias("src"), near.alias("at"))
    there = zones.select(F.col("study_area"), F.col("zone").alias("dst"), "x", "y")
    return at.select("study_area", "src", F.col("at.x").alias("x"), F.col("at.y").alias("y")).join(
        there, ["study_area", "x", "y"]
    ).select("study_area", "src", "dst")


def trips_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of vendor product A, with its spelling noise."""
    events = table(spark, sf_dir, "events")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    start = (
        F.when(F.coalesce(before, F.lit("signup")) == "signup", "casa")
        .when(before == "purchase", "trabajo_estudio")
        .when(before == "click", "frecuente")
        .when(before == "view", "no_frecuente")
        .otherwise("home")
    )
    end = (
        F.when(F.col("event_type") == "signup", "casa")
        .when(F.col("event_type") == "purchase", "trabajo_estudio")
        .when(F.col("event_type") == "click", "frecuente")
        .when(F.col("event_type") == "view", " No_Frecuente ")
        .otherwise("work_or_study")
    )
    event = F.col("event_id")
    return events.select(
        F.pmod("user_id", F.lit(25)).cast("string").alias("origen"),
        F.pmod(event * 7 + F.col("user_id"), F.lit(25)).cast("string").alias("destino"),
        F.date_format("ts", "yyyyMMdd").alias("date"),
        F.hour("ts").cast("long").alias("hora"),
        start.alias("actividad_origen"),
        end.alias("actividad_destino"),
        F.when(event % 4 == 0, "true").when(event % 4 == 1, "0").when(event % 4 == 2, "no").alias("estudio_destino_posible"),
        F.when(event % 97 == 0, "bad").otherwise(F.round("value").cast("string")).alias("n_trips"),
    )


def trips_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rows of vendor product B."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber") % 4
    return order_lines(spark, sf_dir).select(
        F.col("c_nationkey").cast("string").alias("ORIGINE"),
        F.col("s_nationkey").cast("string").alias("DESTINAZIONE"),
        F.when(flag == "A", "lavoro").when(flag == "N", "Studio").when(flag == "R", "rientri a casa").alias("MOTIVO"),
        F.when(line == 0, "Mattina").when(line == 1, "07-10").when(line == 2, "17-20").otherwise("sera").alias("FASCIA_ORARIA"),
        F.col("l_quantity").alias("TRIPS"),
    )
