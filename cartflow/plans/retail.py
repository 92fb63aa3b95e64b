"""The retail tables as a view of a sales schema (`orders`, `lineitem`, `part`), and what is built on them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartflow.functions.baskets import items_of_bits, set_bits, set_of
from cartflow.operators import kpi, mining, recommend, silver
from cartflow.operators.mining import Grid, MinedGrid
from cartflow.plans.ordering import number_within
from cartflow.session import materialize
from cartflow.sources.specs import table_specs

# Thresholds that give non-empty cells on data whose items are close to independent.
GRID = Grid(supports=(0.002, 0.005, 0.01), confidences=(0.10, 0.15, 0.18))
# The cell whose rules are served; it leaves some baskets without a rule.
FINAL = (0.005, 0.18)
# Single parts: an itemset counts from one in so many baskets on, and from so many baskets at least.
PRODUCT_SHARE, PRODUCT_BASKETS = 20_000, 3
# Fixed value: the longest gap the source tables record.
MAX_GAP_DAYS = 30


class Retail:
    """Retail tables over the sales tables in one folder.

    Every property is a lazy plan except where it says `stored`. The grid mines departments, whose baskets are
    dense; the `product_` properties mine and serve single parts, a wide alphabet of rare items.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.specs = table_specs("long")
        self._sources: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        if name not in self._sources:
            self._sources[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._sources[name]

    @cached_property
    def raw_lines(self) -> DataFrame:
        """Order and product of every line, repeats included; enough where sets are built anyway."""
        return self.source("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id")
        )

    @cached_property
    def order_lines(self) -> DataFrame:
        """Distinct (order, product) pairs; duplicates fold on the map side before the shuffle."""
        return (
            self.source("lineitem")
            .groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))
            .agg(F.min("l_linenumber").alias("add_to_cart_order"))
        )

    @cached_property
    def department_codes(self) -> range:
        """The range of the department ids; a brand number has three characters at most."""
        first, last = self.brands.agg(F.min("department_id"), F.max("department_id")).first()
        return range(0) if first is None else range(first, last + 1)

    @cached_property
    def placed(self) -> DataFrame:
        return self.source("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("placed"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        """All orders. The last observed order of a user with two or more is `train`; unobserved ones are `test`.

        The orders are shuffled twice: by order to see which have lines, and by user to number them.
        """
        observed = self.raw_lines.select("order_id").distinct().withColumn("observed", F.lit(True))
        seen = self.placed.join(observed, "order_id", "left")
        numbered = number_within(seen, "user_id", "placed", "order_id", mark="observed")
        is_last = (F.col("marked") >= 2) & (F.col("order_id") == F.col("last_marked"))
        gap = F.least(F.date_diff("placed", "previous"), F.lit(MAX_GAP_DAYS)).cast("double")
        return numbered.select(
            "order_id",
            "user_id",
            F.when(F.col("observed").isNull(), "test").when(is_last, "train").otherwise("prior").alias("eval_set"),
            F.col("position").alias("order_number"),
            (F.dayofweek("placed") - 1).alias("order_dow"),
            F.hour("placed").alias("order_hour_of_day"),
            F.when(F.col("previous").isNotNull(), gap).alias("days_since_prior_order"),
        )

    @cached_property
    def stored_orders(self) -> DataFrame:
        return materialize(self.orders, "orders")

    @cached_property
    def stored_lines(self) -> DataFrame:
        """Stored: order lines with the user, position and split of their order. Two steps read them."""
        owners = self.stored_orders.select("order_id", "user_id", "order_number", "eval_set")
        return materialize(self.order_lines.join(owners, "order_id"), "lines")

    @cached_property
    def items(self) -> DataFrame:
        """Order items; `reordered` marks a product that the user bought in an earlier order.

        The first order per user and product is a grouping, not a window: a pair with very many rows stays a
        partial minimum, and the join back can split it.
        """
        lines = self.stored_lines
        first = lines.groupBy("user_id", "product_id").agg(F.min("order_number").alias("first_order"))
        return lines.join(first, ["user_id", "product_id"]).select(
            "order_id",
            "product_id",
            "add_to_cart_order",
            (F.col("order_number") > F.col("first_order")).cast("int").alias("reordered"),
            "eval_set",
        )

    @cached_property
    def stored_items(self) -> DataFrame:
        return materialize(self.items, "items")

    def split_items(self, eval_set: str) -> DataFrame:
        """The items of one split, read from the stored items."""
        return self.stored_items.where(F.col("eval_set") == eval_set).drop("eval_set")

    @cached_property
    def order_items(self) -> DataFrame:
        return self.items.drop("eval_set")

    @cached_property
    def silver_items(self) -> DataFrame:
        """`order_items` from storage, for plans that read them more than once."""
        return self.stored_items.drop("eval_set")

    @cached_property
    def aisles(self) -> DataFrame:
        """One aisle per part type, identified by its first part."""
        return (
            self.source("part")
            .groupBy(F.col("p_type").alias("aisle"))
            .agg((F.min("p_partkey") + 1).alias("aisle_id"))
            .select("aisle_id", "aisle")
        )

    @cached_property
    def departments(self) -> DataFrame:
        """One department per brand, identified by the brand number."""
        return self.source("part").select(self._brand().alias("department_id"), F.col("p_brand").alias("department")).distinct()

    @cached_property
    def products(self) -> DataFrame:
        return (
            self.source("part")
            .withColumnRenamed("p_type", "aisle")
            .join(self.aisles, "aisle")
            .select(
                F.col("p_partkey").alias("product_id"),
                F.col("p_name").alias("product_name"),
                "aisle_id",
                self._brand().alias("department_id"),
            )
        )

    @staticmethod
    def _brand():
        return F.substring("p_brand", 7, 3).cast("long")

    @cached_property
    def product_dim(self) -> DataFrame:
        return silver.product_dim(self.products, self.aisles, self.departments)

    @cached_property
    def stored_products(self) -> DataFrame:
        return materialize(self.product_dim, "products")

    @cached_property
    def enriched(self) -> DataFrame:
        return silver.order_items_enriched(self.order_items, self.product_dim)

    @cached_property
    def baskets(self) -> DataFrame:
        return silver.baskets(self.raw_lines, self.orders)

    @cached_property
    def line_departments(self) -> DataFrame:
        """The department of every order line."""
        return self.raw_lines.join(self.brands, "product_id").select("order_id", "department_id")

    @cached_property
    def brands(self) -> DataFrame:
        return self.source("part").select(
            F.col("p_partkey").alias("product_id"), self._brand().cast("int").alias("department_id")
        )

    @cached_property
    def split_sets(self) -> DataFrame:
        """Stored: the departments of all baskets as bits, with the split and time of their orders."""
        lines = self.raw_lines.join(self.brands.withColumn("known", F.lit(True)), "product_id", "left")
        gathered = set_bits("department_id", self.department_codes)
        return materialize(silver.split_sets(lines, self.placed, gathered), "split_sets")

    @cached_property
    def split_baskets(self) -> DataFrame:
        return silver.split_baskets(self.split_sets, self.department_codes)

    @cached_property
    def stored_baskets(self) -> DataFrame:
        """From storage: the department baskets, on which rules are mined."""
        return self.split_baskets.select("order_id", "user_id", "items", "basket_size")

    @cached_property
    def stored_training(self) -> DataFrame:
        """From storage; the miner reads it several times."""
        return silver.prior_baskets(self.split_baskets, mining.MIN_BASKET_SIZE)

    @cached_property
    def counted_training(self) -> DataFrame:
        """Stored: the different ones of `stored_training` with their numbers, for the miner."""
        counted = silver.counted_baskets(self.split_sets, self.department_codes, mining.MIN_BASKET_SIZE)
        return materialize(counted, "counted")

    @cached_property
    def mined(self) -> MinedGrid:
        """Stored: itemsets and rules of the grid, from one fit at its lowest support. Baskets of departments recur, so
        that two passes over the different ones are less work than a fit of MLlib over all."""
        return mining.mine_grid(self.counted_training, GRID, miner=mining.two_pass_itemsets)

    @cached_property
    def contexts(self) -> DataFrame:
        """Stored: target and last prior basket of every eligible user."""
        baskets, orders = self.stored_baskets, self.stored_orders
        pairs = recommend.eval_contexts(
            recommend.ground_truth(baskets, orders), recommend.latest_context(baskets, orders)
        )
        return materialize(pairs, "contexts")

    @cached_property
    def pairs(self) -> DataFrame:
        """Stored: the items of `contexts`, found without the positions of the orders."""
        found = recommend.target_and_context(self.split_sets, items_of_bits(self.department_codes))
        return materialize(recommend.eval_contexts(*found), "pairs")

    @cached_property
    def department_names(self) -> DataFrame:
        return self.departments.select(
            F.col("department_id").alias("product_id"), F.col("department").alias("product_name")
        )

    @cached_property
    def final_rules(self) -> DataFrame:
        """Stored: the named useful rules of the served cell."""
        level = self.mined.cell_rules(*FINAL)
        named = mining.rule_names(mining.useful_rules(level, FINAL[1]).drop("freq"), self.department_names)
        return materialize(named, "association_rules")

    @cached_property
    def lookup(self) -> DataFrame:
        return recommend.recommendation_lookup(self.final_rules)

    @cached_property
    def popular(self) -> DataFrame:
        """The most purchased departments: counted per product first, then per department."""
        top = kpi.top_departments(self.order_lines, self.product_dim, recommend.POPULAR)
        return top.select(F.col("department_id").cast("int").alias("product_id"), "count")

    @cached_property
    def rule_index(self) -> DataFrame:
        return recommend.index_rules(self.mined.config_rules())

    @cached_property
    def predictions(self) -> DataFrame:
        """Stored: recommendations of all grid cells."""
        return materialize(recommend.recommendations(self.pairs, self.rule_index), "predictions")

    # --- single parts ---

    @cached_property
    def split_product_baskets(self) -> DataFrame:
        """From storage: the baskets of parts with the split and time of their orders."""
        lines = self.raw_lines.withColumn("known", F.lit(True))
        split = materialize(silver.split_sets(lines, self.placed, set_of("product_id")), "split_product_sets")
        return silver.split_baskets(split)

    @cached_property
    def stored_product_baskets(self) -> DataFrame:
        return self.split_product_baskets.select("order_id", "user_id", "items", "basket_size")

    @cached_property
    def product_mined(self) -> MinedGrid:
        """Stored: itemsets and rules of single parts, mined in two passes."""
        training = silver.prior_baskets(self.split_product_baskets, mining.MIN_BASKET_SIZE)
        baskets = training.count()
        least = max(PRODUCT_BASKETS, -(-baskets // PRODUCT_SHARE))
        support = (least - 0.5) / max(baskets, least)
        return mining.mine_grid(training, Grid((support,), (0.0,)), miner=mining.two_pass_itemsets)

    @cached_property
    def product_names(self) -> DataFrame:
        return self.products.select("product_id", "product_name")

    @cached_property
    def product_rules(self) -> DataFrame:
        """Stored: the named useful rules over single parts."""
        useful = mining.useful_rules(self.product_mined.rules, 0.0).drop("freq")
        return materialize(mining.rule_names(useful, self.product_names), "product_rules")
