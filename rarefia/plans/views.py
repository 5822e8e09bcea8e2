"""Genotype views of the given tables, as DataFrames and as SQL that gives the same calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import from_wide


def equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations are the parts' keys by remainder; one locus misses 3 of 10 calls in each, the next 4 of 10, the last none."""
    df = _read(spark, sf_dir, "part").withColumn("tenth", F.floor(F.col("p_partkey") / 4) % 10)
    some = lambda n, c: F.when(F.col("tenth") >= n, F.col(c))
    rows = df.select((F.col("p_partkey") % 4).alias("pop"), some(3, "p_brand").alias("three"), some(4, "p_brand").alias("four"), F.col("p_size").alias("none"))
    return from_wide(rows, "pop", ["three", "four", "none"])


EQUAL_SQL = """
 select (p_partkey % 4)::varchar as pop, 'three' as locus, case when (p_partkey // 4) % 10 >= 3 then p_brand end as allele from part
 union all select (p_partkey % 4)::varchar, 'four', case when (p_partkey // 4) % 10 >= 4 then p_brand end from part
 union all select (p_partkey % 4)::varchar, 'none', p_size::varchar from part"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations are part types; loci are brand, size and the first word of the name."""
    df = _read(spark, sf_dir, "part").select("p_type", "p_brand", "p_size", F.split("p_name", " ")[0].alias("p_word"))
    return from_wide(df, "p_type", ["p_brand", "p_size", "p_word"])


PART_SQL = """
 select p_type as pop, 'p_brand' as locus, p_brand as allele from part
 union all select p_type, 'p_size', p_size::varchar from part
 union all select p_type, 'p_word', split_part(p_name, ' ', 1) from part"""


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations are the customers' regions; loci are columns of the line items. Only the columns read are scanned; the
    dimension tables are small enough for Spark to broadcast by their measured size."""
    items, orders, customer = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    who = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey).select("c_custkey", "r_name")
    df = items.join(orders, items.l_orderkey == orders.o_orderkey).join(who, orders.o_custkey == who.c_custkey)
    exact = [F.col(c).cast("decimal(12,2)").alias(c) for c in ("l_quantity", "l_discount", "l_tax")]
    return from_wide(df.select("r_name", "l_returnflag", "l_linestatus", "l_linenumber", *exact), "r_name", ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"])


LINE_SQL = """
 select r_name as pop, u.locus, u.allele from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
 join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey,
 lateral (select unnest(['l_returnflag', 'l_linestatus', 'l_linenumber', 'l_quantity', 'l_discount', 'l_tax']) as locus,
   unnest([l_returnflag, l_linestatus, l_linenumber::varchar, l_quantity::decimal(12,2)::varchar, l_discount::decimal(12,2)::varchar, l_tax::decimal(12,2)::varchar]) as allele) u"""


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations are event types; loci are the properties and the user's remainder by 50."""
    df = _read(spark, sf_dir, "events").select("event_type", "props", (F.col("user_id") % 50).alias("user_mod"))
    return from_wide(df, "event_type", ["props", "user_mod"])


EVENT_SQL = """
 select event_type as pop, 'props' as locus, props as allele from events
 union all select event_type, 'user_mod', (user_id % 50)::varchar from events"""


def supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations are nations with a few suppliers each, two at least; one locus is the first digit of the balance, one the
    key's remainder by 7."""
    s, n = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "nation")
    few = s.groupBy("s_nationkey").agg(F.count("*").alias("c")).where("c >= 2")
    df = s.join(few, "s_nationkey").join(n, s.s_nationkey == n.n_nationkey).select("n_name", (F.col("s_suppkey") % 7).alias("s_mod"), F.floor(F.col("s_acctbal") / 1000).cast("long").alias("s_thousands"))
    return from_wide(df, "n_name", ["s_mod", "s_thousands"])


SUPP_SQL = """
 select n_name as pop, 's_mod' as locus, (s_suppkey % 7)::varchar as allele from supplier join nation on s_nationkey = n_nationkey
 where s_nationkey in (select s_nationkey from supplier group by 1 having count(*) >= 2)
 union all select n_name, 's_thousands', floor(s_acctbal / 1000)::bigint::varchar from supplier join nation on s_nationkey = n_nationkey
 where s_nationkey in (select s_nationkey from supplier group by 1 having count(*) >= 2)"""


def miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``part``, with calls missing: every seventh part's size and every fiftieth part's brand."""
    df = _read(spark, sf_dir, "part").select("p_type", F.when(F.col("p_partkey") % 50 != 0, F.col("p_brand")).alias("p_brand"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"), F.split("p_name", " ")[0].alias("p_word"))
    return from_wide(df, "p_type", ["p_brand", "p_size", "p_word"])


MISS_SQL = """
 select p_type as pop, 'p_brand' as locus, case when p_partkey % 50 <> 0 then p_brand end as allele from part
 union all select p_type, 'p_size', case when p_partkey % 7 <> 0 then p_size::varchar end from part
 union all select p_type, 'p_word', split_part(p_name, ' ', 1) from part"""
