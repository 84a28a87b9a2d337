"""Views of relational tables as notes, links and vectors.

Each adapter is a projection (the Markdown of orders needs one join and one bounded
aggregate), so filters and column choices still reach the scans.

Notes have the columns path, dir, stem, ext, file_id, fm_id, title, aliases, tags,
present_keys, content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table that comes in fewer pieces than there are cores, such as one small file, to all cores; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes: the title is the start of the first line, the tags language and source."""
    d = spread(table(spark, sf_dir, "documents"))
    stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    file_id = F.lpad(F.col("doc_id").cast("string"), 14, "0")
    return d.select(
        F.concat(F.lit("vault/"), "source", F.lit("/"), stem, F.lit(".md")).alias("path"),
        F.concat(F.lit("vault/"), "source").alias("dir"),
        stem.alias("stem"),
        F.lit(".md").alias("ext"),
        file_id.alias("file_id"),
        file_id.alias("fm_id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"),
        F.array().cast("array<string>").alias("aliases"),
        F.array("lang", "source").alias("tags"),
        F.array(F.lit("title"), F.lit("tags"), F.lit("id")).alias("present_keys"),
        F.col("text").alias("content"),
    )


#: One Markdown line for each line item; the same SQL runs on Spark and on DuckDB.
LINE_SQL = """
CASE l_linenumber
 WHEN 1 THEN concat('- [[', lpad(CAST(l_partkey AS {s}), 14, '0'), '|', p_name, ']] by ', p_brand)
 WHEN 2 THEN concat('See [[', lpad(CAST(l_partkey AS {s}), 14, '0'), ']] and [docs](https://example.com/', CAST(l_partkey AS {s}), ') or [none]( )')
 WHEN 3 THEN concat('[', lpad(CAST(l_partkey AS {s}), 14, '0'), '|', p_name, ']: /parts/', CAST(l_partkey AS {s}), ' "', p_brand, '"')
 WHEN 4 THEN concat('${{[[', lpad(CAST(l_partkey AS {s}), 14, '0'), ']]}} then `', p_name, '` and [[9', lpad(CAST(l_orderkey + 1 AS {s}), 13, '0'), '|next]]')
 WHEN 5 THEN concat('| [[', lpad(CAST(l_partkey AS {s}), 14, '0'), ']] | ', p_name, ' |')
 WHEN 6 THEN concat('# ', p_name, ' [[', lpad(CAST(l_partkey AS {s}), 14, '0'), '|here]]')
 ELSE concat('Plain ', p_name, ' at https://example.com/p/', CAST(l_partkey AS {s}), ' <%= x %> end') END
"""


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as notes, with one Markdown line for each line item; some have code fences."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.expr(LINE_SQL.format(s="STRING"))
    fenced = (
        F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 7 == 0), F.concat(F.lit("```\n"), line, F.lit("\n```")))
        .when((F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 11 == 0), F.concat(F.lit("```\n"), line))
        .otherwise(line)
    )
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), fenced.alias("t")))), lambda x: x["t"]), "\n")
    bodies = items.groupBy("l_orderkey").agg(content.alias("content"))
    o = table(spark, sf_dir, "orders").join(bodies, F.col("o_orderkey") == F.col("l_orderkey"))
    key = F.col("o_orderkey").cast("string")
    file_id = F.concat(F.lit("9"), F.lpad(key, 13, "0"))
    return o.select(
        F.concat(F.lit("vault/orders/order_"), key, F.lit(".md")).alias("path"),
        F.lit("vault/orders").alias("dir"),
        F.concat(F.lit("order_"), key).alias("stem"),
        F.lit(".md").alias("ext"),
        file_id.alias("file_id"),
        file_id.alias("fm_id"),
        F.concat(F.lit("Order "), key).alias("title"),
        F.array().cast("array<string>").alias("aliases"),
        F.array("o_orderstatus", "o_orderpriority").alias("tags"),
        F.array(F.lit("title"), F.lit("tags"), F.lit("id")).alias("present_keys"),
        "content",
    )


def part_notes(spark: SparkSession, sf_dir: str, size: int = 25) -> DataFrame:
    """The smaller parts as notes; links to other parts are dead."""
    p = table(spark, sf_dir, "part").where(F.col("p_size") <= size)
    key = F.col("p_partkey").cast("string")
    file_id = F.lpad(key, 14, "0")
    return p.select(
        F.concat(F.lit("vault/parts/part_"), key, F.lit(".md")).alias("path"),
        F.lit("vault/parts").alias("dir"),
        F.concat(F.lit("part_"), key).alias("stem"),
        F.lit(".md").alias("ext"),
        file_id.alias("file_id"),
        file_id.alias("fm_id"),
        F.col("p_name").alias("title"),
        F.array("p_type").alias("aliases"),
        F.array("p_brand", "p_type").alias("tags"),
        F.array(F.lit("title"), F.lit("aliases"), F.lit("tags"), F.lit("id")).alias("present_keys"),
        F.concat(F.lit("A part of size "), F.col("p_size").cast("string"), F.lit(".")).alias("content"),
    )


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of orders and parts together."""
    return order_notes(spark, sf_dir).unionByName(part_notes(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as indexed vectors (document_id, vector, metadata, ordinal)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("document_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
        F.col("vec_id").alias("ordinal"),
    )
