"""Queries of the readers of typed columns: the readings of ``reading``'s texts, from the columns themselves, with the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holosna.functions import typed
from holosna.plans import reading
from holosna.plans.queries import _t


def ua_typed_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices in three currencies, whose forms come from the table of currencies."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    for out, code in (("uah", "UAH"), ("usd", "USD"), ("eur", "EUR")):
        orders = typed.with_amounts(orders.withColumn("code", F.lit(code)), "price", "code", out)
    said = lambda c: F.concat(F.lit("Сума "), F.col(c)).alias(c)
    return orders.select("o_orderkey", said("uah"), said("usd"), said("eur"))


def ua_typed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    said = lambda words: F.concat(F.lit("Подія "), words, F.lit("."))
    return _t(spark, sf_dir, "orders").select("o_orderkey", said(typed.date_words(at)).alias("dotted"), said(typed.date_words(at)).alias("iso"), said(typed.month_words(at)).alias("month"))


def ua_typed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Початок о "), typed.clock_words(F.col("ts"), after_o=True)).alias("spoken"))


def ua_typed_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.round(F.col("l_discount") * 100).cast("long")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Знижка "), typed.percent_words(rate)).alias("spoken"))


def ua_typed_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("n"), F.lit("кг").alias("unit"))
    return typed.with_quantities(items, "n", "unit", "said").select("l_orderkey", "l_linenumber", F.concat(F.lit("Вага "), F.col("said")).alias("spoken"))


QUERIES = {f.__name__: f for f in (ua_typed_money, ua_typed_dates, ua_typed_times, ua_typed_percents, ua_typed_measures)}
ORACLE_SQL = {name: reading.ORACLE_SQL[name.replace("typed", "read")] for name in QUERIES}
