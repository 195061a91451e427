"""The given star-schema tables read as attention, returns and links.

Topics are order priorities and their level the number of orders a day. Assets
are part brands and their return the mean of discount minus tax over the lines
shipped that day; lines shipped on a weekend belong to the Monday after it.
Trading days are the days that lines belong to.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.session import bounded_list, materialise
from loomline.operators import kernel
from loomline.operators.align import period_returns
from loomline.operators.calendar import trading_calendar
from loomline.operators.panel import build_panel
from loomline.operators.shocks import attention_shocks

TABLE_NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

SOURCES = ("customer", "lineitem", "orders", "part")  # what the kept projections are built on


class Tables:
    """Readers for one data directory and the projections built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    _kept: tuple[tuple, Tables] | None = None

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Tables:
        """The tables of a folder; the last one used in a session is kept while its files stay as they are, so its intermediate tables are shared."""
        files = spark.read.format("binaryFile").load([f"{sf_dir}/{name}.parquet" for name in SOURCES]).select("path", "length", "modificationTime")
        key = (spark.sparkContext.applicationId, sf_dir, *sorted(map(tuple, files.collect())))
        if cls._kept is None or cls._kept[0] != key:
            cls._kept = (key, cls(spark, sf_dir))
        return cls._kept[1]

    @classmethod
    def forget(cls) -> None:
        """The next query builds its own intermediate tables."""
        cls._kept = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lineitem(self) -> DataFrame:
        """Lines with the day they count for: the ship day, or the Monday after a weekend."""
        day = F.to_date("l_shipdate")
        late = F.when(F.dayofweek(day) == 7, 2).when(F.dayofweek(day) == 1, 1).otherwise(0)
        return self.read("lineitem").withColumn("date", F.date_add(day, late))

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders").withColumn("date", F.to_date("o_orderdate"))

    @cached_property
    def calendar(self) -> DataFrame:
        return self.calendar_of("M")

    def calendar_of(self, period: str) -> DataFrame:
        """Calendar of one period length; one small file, so every join with it can be broadcast by size."""
        return materialise(trading_calendar(self.lineitem.select("date").distinct(), period), "calendar")

    @cached_property
    def returns(self) -> DataFrame:
        """(date, asset, ret), written once: the line table is scanned a single time per study.

        Lines are summed per day and part before the join, so a hot part is one
        row a day on its join key.
        """
        per_part = self.lineitem.groupBy("date", "l_partkey").agg(
            F.sum(F.col("l_discount") - F.col("l_tax")).alias("s"), F.count("*").alias("n")
        )
        brand = self.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset"))
        daily = per_part.join(brand, "l_partkey").groupBy("date", "asset").agg((F.sum("s") / F.sum("n")).alias("ret"))
        return materialise(daily, "returns")

    @cached_property
    def order_counts(self) -> DataFrame:
        """(date, topic, level) for the cells that occur, written once."""
        counts = self.orders.groupBy("date", F.col("o_orderpriority").alias("topic")).agg(F.count("*").cast("double").alias("level"))
        return materialise(counts, "order_counts")

    @cached_property
    def topics(self) -> list[str]:
        return bounded_list(self.order_counts, "topic", 10_000)

    @cached_property
    def assets(self) -> list[str]:
        return bounded_list(self.returns, "asset")

    @cached_property
    def order_days(self) -> DataFrame:
        """(date) every day from the first to the last order; a day without orders has level zero, it is not missing."""
        ends = self.order_counts.agg(F.min("date").alias("first"), F.max("date").alias("last")).where("first is not null")
        return ends.select(F.explode(F.sequence("first", "last")).alias("date"))

    def on_every_day(self, counts: DataFrame, topics: list[str]) -> DataFrame:
        """(date, topic, level) of counted cells on every order day, zero where a topic has none."""
        grid = self.order_days.select("date", F.explode(F.array(*[F.lit(t) for t in topics])).alias("topic"))
        return grid.join(counts, ["date", "topic"], "left").select("date", "topic", F.coalesce("level", F.lit(0.0)).alias("level"))

    @cached_property
    def attention_all_days(self) -> DataFrame:
        """(date, topic, level) on every day from the first to the last order."""
        return self.on_every_day(self.order_counts, self.topics)

    @cached_property
    def attention(self) -> DataFrame:
        """Attention on trading days."""
        return self.attention_all_days.join(self.calendar.select("date"), "date", "left_semi")

    @cached_property
    def shocks(self) -> DataFrame:
        return materialise(attention_shocks(self.attention, self.calendar, 5), "shocks")

    @cached_property
    def panel(self) -> DataFrame:
        """Estimation panel of the default kernel."""
        cfg = kernel.KernelConfig()
        cov = kernel.kernel_covariance(self.returns, self.shocks, self.calendar, len(self.topics), cfg)
        rows = build_panel(kernel.pack_topics(cov, self.topics), period_returns(self.returns, self.calendar), cfg.burn_in, 20)
        return materialise(rows, "panel")

    @cached_property
    def wide_returns(self) -> DataFrame:
        """(date, asset, ret) with suppliers as assets."""
        daily = self.lineitem.groupBy("date", F.col("l_suppkey").cast("string").alias("asset")).agg(
            F.avg(F.col("l_discount") - F.col("l_tax")).alias("ret"))
        return materialise(daily, "wide_returns")

    @cached_property
    def wide_attention(self) -> DataFrame:
        """(date, topic, level) with one topic per customer nation and order priority, zero-filled.

        Orders are counted per customer before the join, so a hot customer is one
        row per day and priority.
        """
        per_customer = self.orders.groupBy("date", "o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
        nation = self.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        topic = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(" "), "o_orderpriority")
        counts = per_customer.join(nation, "o_custkey").groupBy("date", topic.alias("topic")).agg(F.sum("n").cast("double").alias("level"))
        counts = materialise(counts, "wide_counts")
        return self.on_every_day(counts, bounded_list(counts, "topic", 10_000))

    @cached_property
    def risk_free(self) -> DataFrame:
        """A rate published once a month, on the last shipping day."""
        return (
            self.lineitem.groupBy(F.date_trunc("month", "date").alias("month"))
            .agg(F.max("date").alias("date"), (F.avg("l_tax") / 252).alias("rf"))
            .select("date", "rf")
        )


def tidy(df: DataFrame, digits: int = 8, **more: int) -> DataFrame:
    """Output form shared with the SQL side: text dates, long integers, rounded doubles."""
    cols = []
    for field in df.schema.fields:
        c, kind = F.col(field.name), field.dataType.simpleString()
        if kind in ("date", "timestamp"):
            c = c.cast("date").cast("string")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), more.get(field.name, digits)) + F.lit(0.0)
        cols.append(c.alias(field.name))
    return df.select(*cols)
