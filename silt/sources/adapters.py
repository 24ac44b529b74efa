"""Other tables as fact tables: any with the fact columns, and orders and their lines read as a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silt.schema import FACT
from silt.shared import partitions

JOINED = 8 << 20  # stored bytes of lines for each partition of the join


def as_facts(df: DataFrame) -> DataFrame:
    """A table with the fact columns; ``has_loc`` and ``ord`` may be missing."""
    if "has_loc" not in df.columns:
        df = df.withColumn("has_loc", F.lit(True))
    if "ord" not in df.columns:
        df = df.withColumn("ord", F.monotonically_increasing_id())
    missing = {f.name for f in FACT} - set(df.columns)
    if missing:
        raise ValueError(f"the table has no {', '.join(sorted(missing))}")
    return df.select(*[f.name for f in FACT])


def order_history(spark: SparkSession, sf_dir: str, ranked: bool = False) -> DataFrame:
    """Orders as commits, customers as authors, parts as files.

    People are joined to orders, which are fewer than lines.  Where the input asks for more partitions than the session's, lines and orders are dealt by its size, so a task's sorts don't grow with it.
    ``ranked`` numbers the rows over all columns for ``ord``, which sorts everything; else ``ord`` is the tuple itself, which orders the same and costs nothing.
    """
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    people, parts = t("customer").select("c_custkey", "c_name"), t("part").select("p_partkey", "p_brand")
    commits = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    if (n := partitions(lines, JOINED)) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines, commits = lines.repartition(n, "l_orderkey"), commits.repartition(n, "o_orderkey")
    rows = lines.join(commits, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    binary = F.col("l_returnflag") == "N"
    facts = rows.select(
        F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/part"), F.col("l_partkey").cast("string")).alias("entity"),
        F.lower(F.hex("o_orderkey")).alias("rev"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("c_name").alias("author"),
        F.col("o_orderpriority").alias("message"),
        F.when(binary, 0).otherwise(F.col("l_quantity").cast("bigint")).cast("bigint").alias("loc_added"),
        F.when(binary, 0).otherwise(F.round(F.col("l_discount") * 100).cast("bigint")).cast("bigint").alias("loc_deleted"),
        binary.alias("binary"),
        F.lit(True).alias("has_loc"),
    )
    if ranked:
        return facts.withColumn("ord", F.row_number().over(Window.orderBy(*KEY)).cast("bigint"))
    return facts.withColumn("ord", order_key())


KEY = ["date", "rev", "entity", "author", "message", "loc_added", "loc_deleted", "binary"]


def order_key() -> Column:
    """The tuple that orders the history's rows; made when it is read, so a written history needn't hold every column twice."""
    return F.struct(*KEY)


def nation_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(author, team): customers and their nations."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return people.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("author"), F.col("n_name").alias("team"))
