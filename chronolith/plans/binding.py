"""A deterministic binding of the domain to the star-schema tables, so that every operator has input to run on.

An order is a commit, its lines are files, the part's type and name the module; see README.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.paths import module_of
from ..operators.serve import Repository

NOW = datetime(2001, 8, 15)
SETTINGS = Settings()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, path, p_size)."""
    ending = F.when(F.col("p_size") % 10 == 0, "md").otherwise("py")
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("/f"), F.col("p_partkey"), F.lit("."), ending)
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), "p_size")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, as a changed file."""
    removed = F.col("l_returnflag") == "R"
    amount = F.col("l_quantity").cast("bigint")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.when(removed, 0).otherwise(amount).alias("added"), F.when(removed, amount).otherwise(0).alias("deleted"))
    return rows.join(part_paths(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bot = F.col("o_custkey") % 10 == 0
    author = F.when(bot, "dependabot").otherwise(F.concat(F.lit("C"), F.col("o_custkey")))
    email = F.when(bot, "dependabot@example.com").otherwise(F.concat(F.lit("c"), F.col("o_custkey"), F.lit("@example.com")))
    subject = F.when(F.col("o_orderpriority") == "5-LOW", "Bump deps").otherwise(F.concat(F.lit("feat: "), F.col("o_orderpriority")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderkey"), F.col("o_orderdate").alias("ts"), author.alias("author"), email.alias("email"), subject.alias("subject"))
    # Dealt out by the key of the join with orders, which needs that for large tables; one-file tables come in one task.
    rows = lines(spark, sf_dir).repartition("l_orderkey")
    return rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("hash", "ts", "author", "email", "subject", "path", "added", "deleted")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within an order, the module of the first line imports that of the second."""
    module = module_of(F.col("path"), SETTINGS)
    first = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "path", module.alias("module"))
    one = first.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "module", "path"))).alias("m")).where(F.size("m") > 1)
    rows = one.select(F.col("m")[0]["path"].alias("src_path"), F.col("m")[0]["module"].alias("src_module"), F.col("m")[1]["module"].alias("dst_module"))
    return rows.where("src_module <> dst_module").distinct()


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module metrics: parts are files, their sizes complexities."""
    rows = part_paths(spark, sf_dir).withColumn("module", module_of(F.col("path"), SETTINGS))
    files = F.count(F.lit(1))
    return rows.groupBy("module").agg(
        files.alias("files"), F.sum("p_size").alias("nloc"), files.alias("functions"), (F.sum("p_size") / files).alias("ccn_avg"), F.max("p_size").cast("bigint").alias("ccn_max"),
        F.lit(None).cast("double").alias("maintainability"), F.count_if(F.col("p_size") > 10).alias("classes"), F.count_if(F.col("p_size") > 40).alias("abstract_classes"),
    )


def repository(spark: SparkSession, sf_dir: str, store: bool = False) -> Repository:
    return Repository(changes(spark, sf_dir), NOW, SETTINGS, edges(spark, sf_dir), metrics(spark, sf_dir), store)


def proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a proposed change: diff_id, path, added, deleted, is_deleted."""
    return changes(spark, sf_dir).select(F.col("hash").alias("diff_id"), "path", "added", "deleted", F.lit(False).alias("is_deleted"))


def gate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as warnings: a user is a module, a type a rule, a purchase a commit that resolves."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").cast("string").alias("module"), F.col("event_type").alias("rule"), (F.col("event_type") == "purchase").alias("resolves"), F.pmod(F.floor("value"), F.lit(5)).cast("int").alias("deviation"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, blob, content."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id"), F.lit(".sql")).alias("path"), F.md5("text").alias("blob"), F.col("text").alias("content"))
