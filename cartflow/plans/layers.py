"""From CSV files to serving tables: bronze, silver and gold folders of Parquet tables.

Every step checks its input, stores all its tables, checks what was stored, and only then commits them in one step
(`sources.commits`); a failed check or a lost driver leaves the layer as it was. Without `replace` it refuses a layer that
has a commit. It reads the stored tables of the step before from one commit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartflow.operators import kpi, mining, quality, recommend, silver
from cartflow.operators.frames import stack
from cartflow.operators.mining import Grid
from cartflow.session import materialize, sized_shuffles
from cartflow.sources import commits, files
from cartflow.sources.specs import TableSpec, table_specs

# The parameter grid and the time that counts as a full penalty for a slow fit.
GRID = Grid(supports=(0.0005, 0.001, 0.002), confidences=(0.20, 0.30, 0.40))
TIMEOUT_SECONDS = 1200
SILVER_TABLES = ("orders", "products", "order_items", "order_items_enriched", "baskets")
GOLD_TABLES = (
    "kpi_summary",
    "association_rules",
    "frequent_itemsets",
    "recommendation_lookup",
    "product_catalog",
)


def _require_clean(profiles: dict[str, DataFrame], specs: dict[str, TableSpec]) -> None:
    """The verdicts are five rows per table; the failed ones are named in the error."""
    verdicts = stack([quality.table_status(profile, specs[name]) for name, profile in profiles.items()])
    failed = files.bounded_collect(verdicts.where(~F.col("passed")))
    if len(failed):
        raise ValueError("failed checks: " + ", ".join(failed["table"] + "." + failed["check"]))


def build_bronze(
    spark: SparkSession, raw: str, root: str, run_id: str, specs: dict[str, TableSpec] | None = None, replace: bool = False
) -> DataFrame:
    """Store all source files with lineage, profile what was stored, and commit only when every table passes.

    The text is parsed once; the profiles read the staged Parquet. Returns `(table, check, column, n)`.
    """
    specs = specs or table_specs()
    staging, profiles = commits.Writer(spark, root, replace), {}
    with sized_shuffles(spark, raw):
        for name, spec in specs.items():
            table = staging.store(files.ingest(spark, raw, spec, run_id), name)
            found = quality.profile_table(table.drop(*files.LINEAGE), spec)
            profiles[name] = materialize(found, f"profile_{name}")
        _require_clean(profiles, specs)
        staging.commit()
    return stack(list(profiles.values()))


def build_silver(
    spark: SparkSession, bronze: str, root: str, specs: dict[str, TableSpec] | None = None, replace: bool = False
) -> DataFrame:
    """The dimensional model. Broken references stop the build. Returns `(fk, n)`."""
    with sized_shuffles(spark, bronze):
        return _silver(committed(spark, bronze), commits.Writer(spark, root, replace), specs or table_specs())


def committed(spark: SparkSession, root: str) -> commits.Snapshot:
    found = commits.snapshot(spark, root)
    if found is None:
        raise FileNotFoundError(f"{root} has no commit")
    return found


def _silver(bronze: commits.Snapshot, staging: commits.Writer, specs: dict[str, TableSpec]) -> DataFrame:
    raw = {name: silver.normalize(bronze.read(name), spec) for name, spec in specs.items()}
    references = materialize(silver.fk_report(raw), "fk_report")
    broken = files.bounded_collect(references.where(F.col("n") > 0))
    if len(broken):
        raise ValueError("broken references: " + ", ".join(broken["fk"]))

    orders = staging.store(raw["orders"], "orders")
    products = staging.store(silver.product_dim(raw["products"], raw["aisles"], raw["departments"]), "products")
    items = staging.store(silver.order_items(raw["order_products_prior"], raw["order_products_train"]), "order_items")
    enriched = staging.store(silver.order_items_enriched(items, products), "order_items_enriched")
    baskets = staging.store(silver.baskets(items, orders), "baskets")
    lost = stack(
        [
            quality.reconcile_rows(raw["products"], products, "products"),
            quality.reconcile_rows(items, enriched, "order_items_enriched"),
        ]
    ).where(~F.col("ok"))
    if not lost.isEmpty() or not quality.invalid_baskets(baskets).isEmpty():
        raise ValueError("silver tables lost rows or hold invalid baskets")
    staging.commit()
    return references


@dataclass
class GoldReport:
    """`scored` has one row per grid cell, `selected` the chosen one, `rules` the metrics of its useful rules,
    `users` the evaluation per user."""

    scored: DataFrame
    selected: DataFrame
    rules: DataFrame
    users: DataFrame


def evaluate_grid(
    mined: mining.MinedGrid, contexts: DataFrame, k: int = recommend.TOP_K, timeout: float = TIMEOUT_SECONDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules, predictions and scores of all grid cells, each stored."""
    rules = materialize(mined.config_rules().drop("freq"), "config_rules")
    predictions = materialize(recommend.recommendations(contexts, recommend.index_rules(rules), k), "predictions")
    coverage = recommend.coverage_hits(predictions, contexts, [name for name, _, _ in mined.grid.cells])
    scored = materialize(recommend.selection_score(mined.metrics(), coverage, timeout), "scored_grid")
    return rules, predictions, scored


def build_gold(
    spark: SparkSession,
    silver_root: str,
    root: str,
    grid: Grid = GRID,
    partitions: int | None = None,
    replace: bool = False,
) -> GoldReport:
    """Key figures, the mined rules of the best grid cell, and what serving needs.

    The train split both selects the cell and measures it: an internal validation, not an independent test.
    """
    with sized_shuffles(spark, silver_root):
        return _gold(committed(spark, silver_root), commits.Writer(spark, root, replace), grid, partitions)


def _reconciled(row: DataFrame, orders: DataFrame, baskets: DataFrame, items: DataFrame) -> None:
    """The totals of the distributions must be those of the key figures."""
    per_user = kpi.orders_per_user_histogram(orders)
    totals = {
        "total_orders/hours": kpi.count_by(orders, "order_hour_of_day").agg(F.sum("count")),
        "total_orders/weekdays": kpi.count_by(orders, "order_dow").agg(F.sum("count")),
        "total_orders/users": per_user.agg(F.sum(F.col("orders_per_user") * F.col("user_count"))),
        "total_users/users": per_user.agg(F.sum("user_count")),
        "total_order_items/items": items.agg(F.count(F.lit(1))),
        "observed_baskets/sizes": kpi.count_by(baskets, "basket_size").agg(F.sum("count")),
    }
    wrong = files.bounded_collect(quality.kpi_reconciliation(row, totals).where(~F.col("ok")))
    if len(wrong):
        raise ValueError("key figures that do not add up: " + ", ".join(wrong["check"]))


def _gold(source: commits.Snapshot, staging: commits.Writer, grid: Grid, partitions: int | None) -> GoldReport:
    t = {name: source.read(name) for name in SILVER_TABLES}
    orders, baskets = t["orders"], t["baskets"]
    figures = staging.store(kpi.kpi_summary(orders, t["order_items"], baskets, t["products"]), "kpi_summary")
    _reconciled(figures, orders, baskets, t["order_items"])
    staging.store(files.product_catalog(t["products"]), "product_catalog")

    training = materialize(mining.training_baskets(baskets, orders, partitions=partitions), "training")
    mined = mining.mine_grid(mining.checked_training(training), grid, partitions=partitions, miner=mining.two_pass_itemsets)
    truth = recommend.ground_truth(baskets, orders)
    if not quality.single_target_per_user(truth).first()["ok"]:
        raise ValueError("a user has more than one train order")
    contexts = materialize(recommend.eval_contexts(truth, recommend.latest_context(baskets, orders)), "contexts")
    if contexts.isEmpty() or quality.target_after_context(contexts).first()["n"]:
        raise ValueError("no eligible users, or a target that does not follow its context")

    rules, predictions, scored = evaluate_grid(mined, contexts)
    selected = recommend.select_config(scored)
    chosen = selected.first()
    if chosen is None:
        raise ValueError("no usable configuration")
    mine = F.col("config_id") == chosen["config_id"]
    named = mining.rule_names(rules.where(mine).drop("config_id"), t["products"])
    final = staging.store(named, "association_rules", chosen["useful_rules"])
    level = mining.min_count(chosen["min_support"], mined.baskets)
    frequent = mined.itemsets.where(F.col("freq") >= level)
    staging.store(frequent, "frequent_itemsets", chosen["frequent_itemsets"])
    staging.store(recommend.recommendation_lookup(final), "recommendation_lookup")
    users = materialize(recommend.user_evaluation(predictions.where(mine), contexts), "user_evaluation")
    found = users.agg(F.count_if("covered").alias("covered"), F.count_if("hit").alias("hit")).first()
    if (found["covered"], found["hit"]) != (chosen["covered_users"], chosen["hit_users"]):
        raise ValueError("the evaluation per user differs from the chosen cell")
    return GoldReport(scored, selected, mining.rule_metrics(staging.commit().read("association_rules")), users)
