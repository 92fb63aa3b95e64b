"""The registered queries: every operator on the whole test tables.

Arrays leave as text, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartflow.functions import checks
from cartflow.functions.baskets import config_id, rule_label
from cartflow.operators import changes, kpi, mining, quality, recommend, silver, sketches, temporal
from cartflow.operators.frames import stack
from cartflow.plans.layers import GRID as LAYER_GRID
from cartflow.plans.retail import FINAL, GRID, Retail
from cartflow.session import materialize, scratch_path
from cartflow.sources import commits, files, sampling, split_csv
from cartflow.streaming import events

BUILDERS: dict[str, Callable[[Retail], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

RUN_ID = "run_1"
TIMEOUT_SECONDS = 1200
# The fit time that a cell is given is this over its support; the failed cell is the one of most rules.
FIT_SECONDS = 1.5
FAILED = (min(GRID.supports), min(GRID.confidences))
DIGITS = 9


def query(build: Callable[[Retail], DataFrame]) -> Callable[[Retail], DataFrame]:
    BUILDERS[build.__name__] = build
    QUERIES[build.__name__] = lambda spark, folder: build(Retail(spark, folder))
    return build


def text(column: str):
    return F.array_join(column, ",").alias(column)


def flat(df: DataFrame) -> DataFrame:
    """Array columns as comma-separated text."""
    return df.select(*[text(f.name) if f.dataType.typeName() == "array" else f.name for f in df.schema])


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Averages depend on the order of summation in the last digits."""
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def labelled(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.select(F.lit(value).alias(name), "*")


# --- sources and sinks ------------------------------------------------------------------------------------


@query
def read_csv_strict(r: Retail) -> DataFrame:
    path = scratch_path(r.spark, "products_csv")
    files.export_csv(r.products, path)
    return files.read_csv_strict(r.spark, path, r.specs["products"].schema)


@query
def read_csv_split(r: Retail) -> DataFrame:
    """A file without free text, which Spark may split."""
    path = scratch_path(r.spark, "orders_csv")
    files.export_csv(r.orders, path)
    return files.read_csv_strict(r.spark, path, r.specs["orders"].schema, multi_line=False)


@query
def read_csv_records(r: Retail) -> DataFrame:
    """Names with quotes and line breaks, read by many tasks a file."""
    path = scratch_path(r.spark, "products_csv")
    name = F.concat("product_name", F.lit('\n"'), "product_name", F.lit('", and so on'))
    files.export_csv(r.products.withColumn("product_name", name), path)
    return split_csv.read_csv_split(r.spark, path, r.specs["products"].schema)


@query
def write_and_read_table(r: Retail) -> DataFrame:
    root = scratch_path(r.spark, "silver")
    files.write_table(r.order_items, f"{root}/order_items")
    return files.read_table(r.spark, root, "order_items")


@query
def publish_verified(r: Retail) -> DataFrame:
    root = scratch_path(r.spark, "bronze")
    rows = files.publish_verified(files.with_lineage(r.source("orders"), RUN_ID), f"{root}/orders")
    return (
        files.read_table(r.spark, root, "orders")
        .agg(F.count(F.lit(1)).alias("rows_found"), F.count_if(files.missing_lineage()).alias("unlabelled"))
        .withColumn("rows_published", F.lit(rows).cast("long"))
    )


@query
def layer_commits(r: Retail) -> DataFrame:
    """Rows of two commits of a layer; what a third writer has stored without a commit is in none of them."""
    root = scratch_path(r.spark, "layer")
    first = commits.Writer(r.spark, root)
    first.store(r.source("orders"), "orders")
    first.store(r.source("lineitem"), "lineitem")
    first.commit()
    second = commits.Writer(r.spark, root, replace=True)
    second.store(r.source("orders").where(F.col("o_orderstatus") == "F"), "orders")
    second.store(r.source("lineitem").where(F.col("l_linestatus") == "F"), "lineitem")
    third = commits.Writer(r.spark, root, replace=True)
    third.store(r.source("orders").limit(0), "orders")
    second.commit()
    counts = []
    for number in commits.numbers(r.spark, root):
        layer = commits.snapshot(r.spark, root, number)
        for name in sorted(layer.tables):
            rows = layer.read(name).agg(F.count(F.lit(1)).alias("n"))
            counts.append(rows.select(F.lit(number).alias("commit"), F.lit(name).alias("table"), "n"))
    return stack(counts)


@query
def with_lineage(r: Retail) -> DataFrame:
    return files.with_lineage(r.source("lineitem"), RUN_ID).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("ingestion_time").alias("timed"),
        F.count_if(F.col("source_file").contains("/lineitem.parquet")).alias("from_lineitem"),
    )


@query
def backfill_run_id(r: Retail) -> DataFrame:
    return files.backfill_run_id(r.source("orders").select("o_orderkey", "o_custkey"), RUN_ID)


@query
def bucket_sample(r: Retail) -> DataFrame:
    return sampling.bucket_sample(r.order_items, "order_id", 0.05)


@query
def export_csv(r: Retail) -> DataFrame:
    path = scratch_path(r.spark, "export")
    counts = kpi.orders_by_dow(r.orders)
    files.export_csv(counts, path)
    return files.read_csv_strict(r.spark, path, counts.schema)


@query
def product_catalog(r: Retail) -> DataFrame:
    return files.product_catalog(r.product_dim)


# --- data quality -----------------------------------------------------------------------------------------


# How to get each retail table; a query builds only those it asks for.
RETAIL_TABLES: dict[str, Callable[[Retail], DataFrame]] = {
    "aisles": lambda r: r.aisles,
    "departments": lambda r: r.departments,
    "products": lambda r: r.products,
    "orders": lambda r: r.stored_orders,
    "order_products_prior": lambda r: r.split_items("prior"),
    "order_products_train": lambda r: r.split_items("train"),
}


def retail_tables(r: Retail) -> dict[str, DataFrame]:
    return {name: build(r) for name, build in RETAIL_TABLES.items()}


def rules_on(r: Retail, tables: dict[str, list[str]]) -> DataFrame:
    """The named rules of several tables: `(table, rule, n)`."""
    found = []
    for table, names in tables.items():
        rules = {name: r.specs[table].rules[name] for name in names}
        found.append(labelled(quality.rule_profile(RETAIL_TABLES[table](r), rules), "table", table))
    return stack(found)


@query
def rule_positive_key(r: Retail) -> DataFrame:
    return rules_on(
        r,
        {
            "aisles": ["aisle_id"],
            "departments": ["department_id"],
            "products": ["product_id", "aisle_id", "department_id"],
            "orders": ["order_id", "user_id", "order_number"],
            "order_products_prior": ["order_id", "product_id", "add_to_cart_order"],
            "order_products_train": ["order_id", "product_id", "add_to_cart_order"],
        },
    )


@query
def rule_between(r: Retail) -> DataFrame:
    return rules_on(r, {"orders": ["order_dow", "order_hour_of_day"]})


@query
def rule_isin(r: Retail) -> DataFrame:
    items = {f"order_products_{split}": ["reordered"] for split in ("prior", "train")}
    return rules_on(r, {"orders": ["eval_set"], **items})


@query
def rule_range_or_nan(r: Retail) -> DataFrame:
    return rules_on(r, {"orders": ["days_since_prior_order"]})


@query
def rule_nonblank(r: Retail) -> DataFrame:
    return rules_on(r, {"products": ["product_name"], "aisles": ["aisle"], "departments": ["department"]})


@query
def rule_cross_column(r: Retail) -> DataFrame:
    return rules_on(r, {"orders": ["days_since_prior_order_consistency"]})


@query
def count_when(r: Retail) -> DataFrame:
    return r.source("lineitem").agg(
        checks.count_when(F.col("l_returnflag") == "R").alias("returned"),
        checks.count_when(checks.outside("l_quantity", 5, 45)).alias("unusual_quantity"),
        checks.count_when(F.col("l_linenumber") > 100).alias("long_orders"),
    )


@query
def null_profile(r: Retail) -> DataFrame:
    return quality.null_profile(r.orders, r.specs["orders"].columns)


@query
def duplicate_profile(r: Retail) -> DataFrame:
    return quality.duplicate_profile(r.source("lineitem"), ["l_orderkey", "l_linenumber"])


@query
def profile_table(r: Retail) -> DataFrame:
    return stack([quality.profile_table(df, r.specs[name]) for name, df in retail_tables(r).items()])


@query
def table_status(r: Retail) -> DataFrame:
    return stack(
        [
            quality.table_status(quality.profile_table(df, r.specs[name]), r.specs[name])
            for name, df in retail_tables(r).items()
        ]
    )


@query
def reconcile_rows(r: Retail) -> DataFrame:
    return stack(
        [
            quality.reconcile_rows(r.order_lines, r.silver_items, "order_items"),
            quality.reconcile_rows(
                r.silver_items, silver.order_items_enriched(r.silver_items, r.product_dim), "order_items_enriched"
            ),
            quality.reconcile_rows(r.source("lineitem"), r.order_lines, "order_lines"),
        ]
    )


@query
def lineage_null_rows(r: Retail) -> DataFrame:
    """As ingested, and with the source of the returned lines blanked and the run of early lines missing."""
    whole = files.with_lineage(r.source("lineitem"), RUN_ID)
    source = F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("source_file"))
    run = F.when(F.col("l_linenumber") > 1, F.col("run_id"))
    faulty = whole.withColumns({"source_file": source, "run_id": run})
    return stack(
        [labelled(quality.lineage_null_rows(df), "lines", name) for name, df in (("whole", whole), ("faulty", faulty))]
    )


@query
def orphan_count(r: Retail) -> DataFrame:
    def renamed(table: str, column: str) -> DataFrame:
        return r.source(table).select(F.col(column).alias("key"))

    relations = {
        "lineitem.l_orderkey": (renamed("lineitem", "l_orderkey"), renamed("orders", "o_orderkey")),
        "orders.o_orderkey": (renamed("orders", "o_orderkey"), renamed("lineitem", "l_orderkey")),
        "events.user_id": (renamed("events", "user_id"), renamed("customer", "c_custkey")),
        "customer.c_custkey": (renamed("customer", "c_custkey"), renamed("events", "user_id")),
    }
    return stack(
        [
            labelled(quality.orphan_count(child, parent, "key"), "relation", name)
            for name, (child, parent) in relations.items()
        ]
    )


@query
def invalid_baskets(r: Retail) -> DataFrame:
    return quality.invalid_baskets(r.baskets, min_size=2).select("order_id", "user_id", "basket_size")


@query
def single_target_per_user(r: Retail) -> DataFrame:
    return quality.single_target_per_user(recommend.ground_truth(r.stored_baskets, r.stored_orders))


@query
def target_after_context(r: Retail) -> DataFrame:
    """As built, and with target and context swapped, where every one is a fault."""
    numbers = "train_order_number", "context_order_number"
    swapped = r.contexts.select(*[F.col(a).alias(b) for a, b in zip(numbers, reversed(numbers))])
    return stack(
        [labelled(quality.target_after_context(df), "pairs", n) for n, df in (("built", r.contexts), ("swapped", swapped))]
    )


@query
def invalid_rules(r: Retail) -> DataFrame:
    """All mined rules against thresholds that only some of them reach."""
    return flat(quality.invalid_rules(r.mined.rules, 0.005, 0.15).select("antecedent", "consequent", "freq"))


@query
def invalid_itemsets(r: Retail) -> DataFrame:
    """Against the number of training baskets, and against the number of users as a too small limit."""
    users = r.pairs.count()
    found = [
        quality.invalid_itemsets(r.mined.itemsets, n).agg(F.count(F.lit(1)).alias("n")) for n in (r.mined.baskets, users)
    ]
    return stack([labelled(n, "limit", name) for n, name in zip(found, ("training", "users"))])


@query
def invalid_lookup(r: Retail) -> DataFrame:
    """As built, with seed and product swapped, and with the products of half the rules missing."""
    seed, product = "antecedent_product_id", "recommended_product_id"
    swapped = r.lookup.withColumns({seed: F.col(product), product: F.col(seed)})
    missing = r.lookup.withColumn(product, F.when(F.col(product) % 2 == 0, F.col(product)))
    frames = {"built": r.lookup, "swapped": swapped, "missing": missing}
    return stack(
        [labelled(quality.invalid_lookup(df).agg(F.count(F.lit(1)).alias("n")), "lookup", n) for n, df in frames.items()]
    )


@query
def kpi_reconciliation(r: Retail) -> DataFrame:
    orders, baskets = r.stored_orders, silver.baskets(r.silver_items, r.stored_orders)
    row = kpi.kpi_summary(orders, r.silver_items, baskets, r.stored_products)
    per_user = kpi.orders_per_user_histogram(orders)
    return quality.kpi_reconciliation(
        row,
        {
            "total_orders/hours": kpi.count_by(orders, "order_hour_of_day").agg(F.sum("count")),
            "total_orders/weekdays": kpi.count_by(orders, "order_dow").agg(F.sum("count")),
            "total_orders/users": per_user.agg(F.sum(F.col("orders_per_user") * F.col("user_count"))),
            "total_users/users": per_user.agg(F.sum("user_count")),
            "total_order_items/departments": kpi.reorder_by_department(r.silver_items, r.stored_products).agg(
                F.sum("item_count")
            ),
            "total_order_items/baskets": baskets.agg(F.sum("basket_size")),
            "observed_baskets/sizes": kpi.count_by(baskets, "basket_size").agg(F.sum("count")),
        },
    )


@query
def training_leakage(r: Retail) -> DataFrame:
    """For the training baskets, and for all baskets as the case that leaks."""
    return stack(
        [
            labelled(quality.training_leakage(df, r.stored_orders), "baskets", name)
            for name, df in (("training", r.stored_training), ("all", r.stored_baskets))
        ]
    )


@query
def weighted_rate_check(r: Retail) -> DataFrame:
    groups = kpi.reorder_by_department(r.silver_items, r.product_dim)
    recomputed = quality.weighted_rate(groups, "reordered_items", "item_count")
    return stack(
        [
            labelled(recomputed, "source", "departments"),
            labelled(r.silver_items.agg(F.avg("reordered").alias("rate")), "source", "items"),
        ]
    )


# --- dimensional model ------------------------------------------------------------------------------------


@query
def normalize(r: Retail) -> DataFrame:
    bronze = files.with_lineage(materialize(r.products, "products"), RUN_ID)
    return silver.normalize(bronze, r.specs["products"])


@query
def product_dim(r: Retail) -> DataFrame:
    return r.product_dim


@query
def order_items(r: Retail) -> DataFrame:
    return silver.order_items(r.split_items("prior"), r.split_items("train"))


@query
def order_items_enriched(r: Retail) -> DataFrame:
    return r.enriched


@query
def shop_orders(r: Retail) -> DataFrame:
    return r.orders


@query
def baskets(r: Retail) -> DataFrame:
    return flat(r.baskets)


@query
def department_baskets(r: Retail) -> DataFrame:
    return flat(silver.baskets(r.line_departments, r.orders, "department_id"))


@query
def fk_report(r: Retail) -> DataFrame:
    return silver.fk_report(retail_tables(r))


# --- key figures ------------------------------------------------------------------------------------------


@query
def kpi_orders(r: Retail) -> DataFrame:
    return kpi.kpi_orders(r.orders)


@query
def kpi_items(r: Retail) -> DataFrame:
    return kpi.kpi_items(r.order_items)


@query
def kpi_baskets(r: Retail) -> DataFrame:
    return kpi.kpi_baskets(r.baskets)


@query
def kpi_derived(r: Retail) -> DataFrame:
    orders, items = r.stored_orders, r.silver_items
    return kpi.kpi_derived(
        kpi.kpi_orders(orders), kpi.kpi_items(items), kpi.kpi_baskets(silver.baskets(items, orders)), r.products
    )


@query
def orders_by_hour(r: Retail) -> DataFrame:
    """Order dates carry no time of day, so the hours are those of the events."""
    return kpi.orders_by_hour(r.source("events").select(F.hour("ts").alias("hour")), "hour")


@query
def orders_by_dow(r: Retail) -> DataFrame:
    return kpi.orders_by_dow(r.orders)


@query
def top_products(r: Retail) -> DataFrame:
    return kpi.top_products(r.order_lines, r.product_dim)


@query
def top_departments(r: Retail) -> DataFrame:
    return kpi.top_departments(r.order_lines, r.product_dim)


@query
def top_aisles(r: Retail) -> DataFrame:
    return kpi.top_aisles(r.order_lines, r.product_dim)


@query
def basket_size_histogram(r: Retail) -> DataFrame:
    return kpi.basket_size_histogram(r.baskets)


@query
def reorder_by_department(r: Retail) -> DataFrame:
    return kpi.reorder_by_department(r.order_items, r.product_dim)


@query
def orders_per_user_histogram(r: Retail) -> DataFrame:
    return kpi.orders_per_user_histogram(r.orders)


@query
def peak_with_ties(r: Retail) -> DataFrame:
    """The weekday with most orders, and the basket size that is most frequent."""
    orders = r.stored_orders
    days = kpi.peak_with_ties(kpi.count_by(orders, "order_dow"), "order_dow")
    sizes = kpi.count_by(silver.baskets(r.raw_lines, orders), "basket_size")
    sizes = kpi.peak_with_ties(sizes, "basket_size")
    names = ["key", "count", "ties", "first_key"]
    return stack([labelled(days.toDF(*names), "of", "weekday"), labelled(sizes.toDF(*names), "of", "basket size")])


@query
def most_purchased(r: Retail) -> DataFrame:
    items, products = r.order_lines, r.stored_products
    names = ["id", "name", "count"]
    return stack(
        [
            labelled(kpi.most_purchased(items, products, key, name, kind).toDF(*names), "kind", kind)
            for kind, key, name in (
                ("product", "product_id", "product_name"),
                ("aisle", "aisle_id", "aisle"),
                ("department", "department_id", "department"),
            )
        ]
    )


@query
def kpi_summary(r: Retail) -> DataFrame:
    orders, items = r.stored_orders, r.silver_items
    return kpi.kpi_summary(orders, items, silver.baskets(items, orders), r.stored_products)


@query
def layer_row_counts(r: Retail) -> DataFrame:
    items, orders = r.silver_items, r.stored_orders
    parts = [r.split_items("prior"), r.split_items("train")]
    return kpi.layer_row_counts(
        [
            ("silver", "orders", [r.source("orders")], orders),
            ("silver", "products", [r.source("part")], r.stored_products),
            ("silver", "order_items", parts, items),
            ("silver", "order_items_enriched", [items], silver.order_items_enriched(items, r.stored_products)),
            ("silver", "baskets", [items], silver.baskets(items, orders)),
            ("gold", "training_baskets", [r.stored_baskets], r.stored_training),
            ("gold", "association_rules", [r.mined.rules], r.final_rules),
            ("gold", "recommendation_lookup", [r.final_rules], r.lookup),
            *[
                ("bronze", name, [r.source(name)], files.with_lineage(r.source(name), RUN_ID))
                for name in ("orders", "lineitem", "part")
            ],
        ]
    )


@query
def sales_cube(r: Retail) -> DataFrame:
    return kpi.sales_cube(r.silver_items, r.stored_orders, r.stored_products)


# --- itemsets and rules -----------------------------------------------------------------------------------


@query
def training_baskets(r: Retail) -> DataFrame:
    return flat(r.stored_training)


@query
def training_report(r: Retail) -> DataFrame:
    return mining.training_report(r.stored_baskets, r.stored_orders)


@query
def frequent_itemsets(r: Retail) -> DataFrame:
    return flat(mining.two_pass_itemsets(r.counted_training, min(GRID.supports)))


@query
def two_pass_itemsets(r: Retail) -> DataFrame:
    """At the lowest support of the layer builds."""
    return flat(mining.two_pass_itemsets(r.counted_training, min(LAYER_GRID.supports)))


@query
def growth_caps(r: Retail) -> DataFrame:
    return mining.growth_report(r.mined.itemsets, r.mined.rules)


@query
def association_rules(r: Retail) -> DataFrame:
    return flat(r.mined.rules.drop("freq"))


@query
def useful_rules(r: Retail) -> DataFrame:
    return flat(mining.useful_rules(r.mined.rules, min(GRID.confidences)).drop("freq"))


@query
def rule_metrics(r: Retail) -> DataFrame:
    metrics = mining.rule_metrics(r.mined.rules)
    return rounded(metrics, "avg_support", "avg_confidence", "avg_lift", "median_lift")


@query
def grid_metrics(r: Retail) -> DataFrame:
    metrics = mining.grid_metrics(r.mined.itemsets, r.mined.rules, r.mined.grid, r.mined.baskets)
    return rounded(metrics, "avg_support", "avg_confidence", "avg_lift", "median_lift")


@query
def config_rules(r: Retail) -> DataFrame:
    return flat(r.mined.config_rules().drop("freq"))


@query
def rule_names(r: Retail) -> DataFrame:
    return flat(r.final_rules.select("rule_id", "antecedent", "antecedent_names", "consequent_names"))


@query
def lift_histogram(r: Retail) -> DataFrame:
    return mining.lift_histogram(r.mined.rules)


@query
def confidence_lift_density(r: Retail) -> DataFrame:
    return rounded(mining.confidence_lift_density(r.mined.rules), "lift_bin")


@query
def top_rules(r: Retail) -> DataFrame:
    return mining.top_rules(r.final_rules).select("rank", "label", "lift", "support", "confidence", "rule_id")


@query
def filter_rules(r: Retail) -> DataFrame:
    return mining.filter_rules(r.final_rules, min_support=0.006, min_confidence=0.185, min_lift=1.05)


@query
def rule_labels(r: Retail) -> DataFrame:
    return r.final_rules.select("rule_id", rule_label().alias("label"))


# --- recommendation and evaluation ------------------------------------------------------------------------


@query
def latest_context(r: Retail) -> DataFrame:
    return flat(recommend.latest_context(r.stored_baskets, r.stored_orders))


@query
def ground_truth(r: Retail) -> DataFrame:
    return flat(recommend.ground_truth(r.stored_baskets, r.stored_orders))


@query
def eval_contexts(r: Retail) -> DataFrame:
    return flat(r.contexts)


@query
def recommendation_lookup(r: Retail) -> DataFrame:
    return flat(r.lookup)


@query
def match_rules(r: Retail) -> DataFrame:
    """Matches of all cells; each names the cells whose rules contain it."""
    index = r.rule_index
    found = recommend.with_rule(recommend.match_rules(r.pairs, index), index)
    cells = index.select("rule_rank", "config_ids")
    return flat(found.join(cells, "rule_rank").select("user_id", "rule_id", "product_id", "config_ids"))


@query
def exclude_owned(r: Retail) -> DataFrame:
    """The matches of all rules, before and after those with an owned product are dropped."""
    found = recommend.matched_rules(r.pairs, r.rule_index)
    kept = recommend.exclude_owned(found)
    count = [F.count(F.lit(1)).alias("matches"), F.countDistinct("user_id", "product_id").alias("offers")]
    return stack([labelled(df.agg(*count), "owned", name) for name, df in (("with", found), ("without", kept))])


@query
def best_rule_per_product(r: Retail) -> DataFrame:
    index = r.rule_index
    best = recommend.best_rule_per_product(recommend.match_rules(r.pairs, index), index)
    return recommend.with_rule(best, index).drop("rule_rank")


@query
def recommend_topk(r: Retail) -> DataFrame:
    return recommend.with_rule(r.predictions, r.rule_index).drop("rule_rank")


@query
def coverage_hits(r: Retail) -> DataFrame:
    return recommend.coverage_hits(r.predictions, r.pairs, [name for name, _, _ in r.mined.grid.cells])


def scored_grid(r: Retail) -> DataFrame:
    """Measured fit times differ from run to run; here they follow from the support, and one cell counts as failed."""
    metrics = r.mined.metrics().withColumns(
        {
            "fit_seconds": F.lit(FIT_SECONDS) / F.col("min_support"),
            "status": F.when(F.col("config_id") == config_id(*FAILED), "FAIL").otherwise(F.col("status")),
        }
    )
    covered = recommend.coverage_hits(r.predictions, r.pairs, [name for name, _, _ in r.mined.grid.cells])
    return recommend.selection_score(metrics, covered, TIMEOUT_SECONDS)


@query
def selection_score(r: Retail) -> DataFrame:
    kept = ["config_id", "status", "useful_rules", "coverage", "hitrate", "conditional_hitrate", "selection_score"]
    return rounded(scored_grid(r).select(*kept), "selection_score")


@query
def select_config(r: Retail) -> DataFrame:
    chosen = recommend.select_config(scored_grid(r))
    return rounded(chosen.select("config_id", "min_support", "min_confidence", "selection_score"), "selection_score")


@query
def user_evaluation(r: Retail) -> DataFrame:
    chosen = r.predictions.where(F.col("config_id") == config_id(*FINAL))
    return flat(recommend.user_evaluation(chosen, r.contexts))


@query
def recommend_baskets(r: Retail) -> DataFrame:
    return recommend.recommend_baskets(r.stored_baskets, r.lookup, r.department_names)


@query
def popularity_fallback(r: Retail) -> DataFrame:
    by_rule = recommend.baskets_with_rule(r.stored_baskets, r.lookup)
    return recommend.popularity_fallback(r.stored_baskets, by_rule, r.popular, r.department_names)


@query
def serve_baskets(r: Retail) -> DataFrame:
    return recommend.serve(r.stored_baskets, r.lookup, r.popular, r.department_names)


@query
def showcase_baskets(r: Retail) -> DataFrame:
    return flat(recommend.showcase_baskets(r.stored_baskets, r.lookup, r.department_names, n=20))


# --- single parts -----------------------------------------------------------------------------------------


@query
def product_itemsets(r: Retail) -> DataFrame:
    return flat(r.product_mined.itemsets)


@query
def product_rules(r: Retail) -> DataFrame:
    return flat(r.product_rules.drop("rule_id"))


@query
def product_recommend(r: Retail) -> DataFrame:
    """All observed baskets against the rules over single parts."""
    lookup = recommend.recommendation_lookup(r.product_rules)
    kept = ["order_id", "rank", "product_id", "product_name", "source_rule", "rule_id", "confidence", "lift", "support"]
    return recommend.recommend_baskets(r.stored_product_baskets, lookup, r.product_names).select(*kept)


# --- event streams ----------------------------------------------------------------------------------------


def streamed(r: Retail) -> DataFrame:
    """The table may be a file or a folder; a pattern serves both."""
    return events.event_stream(r.spark, f"{r.folder}/events.parque[t]")


def day_totals(r: Retail) -> DataFrame:
    """Streamed in one run; the stored result."""
    sink = scratch_path(r.spark, "totals")
    stream = events.windowed_totals(streamed(r))
    events.run_available(stream, sink, scratch_path(r.spark, "progress"))
    return events.latest(r.spark, sink, ["starts", "event_type"])


@query
def stream_windows(r: Retail) -> DataFrame:
    day = F.date_format("starts", "yyyy-MM-dd").alias("day")
    return day_totals(r).select(day, "event_type", "n", F.round("total", 4).alias("total"))


@query
def stream_late_rows(r: Retail) -> DataFrame:
    return events.late_rows(r.source("events"), day_totals(r))


@query
def stream_sessions(r: Retail) -> DataFrame:
    """The sessions that are over a day before the last event."""
    sink = scratch_path(r.spark, "sessions")
    found = events.sessions(streamed(r), "6 hours")
    events.run_available(found, sink, scratch_path(r.spark, "progress"), "append")
    moment = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return events.written(r.spark, sink).select("user_id", moment("starts"), moment("ends"), "n")


# --- time and versions ------------------------------------------------------------------------------------


def placed(r: Retail) -> DataFrame:
    return r.source("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("placed"), F.col("o_orderkey").alias("order_id"))


@query
def asof_orders(r: Retail) -> DataFrame:
    """Every event with the last order of its user."""
    seen = r.source("events").select("event_id", "user_id", "ts")
    return temporal.asof_join(seen, placed(r), "user_id", "ts", "placed", ["order_id"]).select("event_id", "order_id")


@query
def events_after_orders(r: Retail) -> DataFrame:
    """Events within 30 days of an order of their user."""
    seen = r.source("events").select("event_id", "user_id", "ts")
    return temporal.interval_join(placed(r), seen, "user_id", "placed", "ts", 30).select("order_id", "event_id")


def edited(r: Retail) -> DataFrame:
    """The lines without returned ones, those of one mode twice, others with another quantity."""
    lines = r.source("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    kept = lines.where("l_returnflag <> 'R'")
    more = F.when(F.col("l_partkey") % 10 == 1, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    return kept.withColumn("l_quantity", more).unionByName(kept.where("l_partkey % 10 = 2"))


@query
def row_changes(r: Retail) -> DataFrame:
    lines = r.source("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return changes.row_changes(lines, edited(r))


@query
def key_changes(r: Retail) -> DataFrame:
    lines = r.source("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return changes.key_changes(lines, edited(r), ["l_orderkey"])


# --- sketches ---------------------------------------------------------------------------------------------


@query
def distinct_users(r: Retail) -> DataFrame:
    """Distinct users per event type, merged from stored sketches per day, beside the exact numbers."""
    seen = r.source("events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    daily = materialize(sketches.distinct_sketches(seen, ["event_type", "day"], "user_id"), "sketches")
    errors = sketches.estimate_errors(daily, seen, ["event_type"], "user_id")
    # Six times the standard error.
    return errors.select("event_type", F.col("exact").alias("users"), (F.col("error") < 0.1).alias("near"))
