"""Source files to serving tables on a small CSV copy of the retail view."""

import os

import pytest
from pyspark.sql import functions as F

from cartflow.operators import kpi, quality, recommend
from cartflow.operators.mining import Grid
from cartflow.plans import layers
from cartflow.sources import commits, files
from cartflow.sources.specs import table_specs

SPECS = table_specs()
GRID = Grid((0.005, 0.01), (0.12, 0.18))


@pytest.fixture(scope="module")
def raw(retail, tmp_path_factory):
    """Departments act as products, so that rules exist; ids move up by one to be positive."""
    root = tmp_path_factory.mktemp("raw")

    def up(*columns):
        return [(F.col(c) + 1).alias(c) for c in columns]

    orders = retail.stored_orders
    items = retail.stored_baskets.select("order_id", F.posexplode("items").alias("pos", "product_id")).select(
        *up("order_id"), "product_id", (F.col("pos") + 1).alias("add_to_cart_order"), F.lit(0).alias("reordered")
    )
    split = orders.select(*up("order_id"), "eval_set")
    tables = {
        "aisles": retail.spark.createDataFrame([(1, "aisle, one")], "aisle_id int, aisle string"),
        "departments": retail.spark.createDataFrame([(1, "all")], "department_id int, department string"),
        "products": retail.departments.select(
            F.col("department_id").alias("product_id"),
            F.col("department").alias("product_name"),
            F.lit(1).alias("aisle_id"),
            F.lit(1).alias("department_id"),
        ),
        "orders": orders.select(*up("order_id", "user_id"), *orders.columns[2:]),
    }
    for name in ("prior", "train"):
        tables[f"order_products_{name}"] = items.join(
            split.where(F.col("eval_set") == name).select("order_id"), "order_id"
        )
    for name, df in tables.items():
        files.export_csv(df.select(SPECS[name].columns), str(root / SPECS[name].file))
    return str(root)


@pytest.fixture(scope="module")
def built(spark, raw, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    profile = layers.build_bronze(spark, raw, f"{root}/bronze", "run_1")
    references = layers.build_silver(spark, f"{root}/bronze", f"{root}/silver")
    return root, profile, references, layers.build_gold(spark, f"{root}/silver", f"{root}/gold", GRID, 8)


def test_bronze_holds_the_sources_with_lineage(spark, raw, built):
    for name, spec in SPECS.items():
        stored = commits.snapshot(spark, f"{built[0]}/bronze").read(name)
        assert stored.columns == [*spec.columns, *files.LINEAGE]
        assert stored.count() == files.read_source(spark, raw, spec).count() > 0
        assert stored.where(files.missing_lineage()).count() == 0
    assert built[1].where("check = 'invalid' AND n > 0").count() == 0


def test_bronze_refuses_to_overwrite(spark, raw, built):
    with pytest.raises(FileExistsError):
        layers.build_bronze(spark, raw, f"{built[0]}/bronze", "run_2")


def test_faulty_sources_publish_nothing(spark, raw, tmp_path):
    for spec in SPECS.values():
        df = files.read_source(spark, raw, spec)
        df = df.unionByName(df) if spec.name == "aisles" else df
        files.export_csv(df, str(tmp_path / "raw" / spec.file))
    with pytest.raises(ValueError, match="aisles.duplicate_keys"):
        layers.build_bronze(spark, str(tmp_path / "raw"), str(tmp_path / "bronze"), "run_1")
    assert commits.snapshot(spark, str(tmp_path / "bronze")) is None


def test_silver_keeps_all_rows(spark, built):
    t = {name: commits.snapshot(spark, f"{built[0]}/silver").read(name) for name in layers.SILVER_TABLES}
    assert {r.n for r in built[2].collect()} == {0}
    assert t["order_items"].count() == t["order_items_enriched"].count()
    assert t["baskets"].agg(F.sum("basket_size")).first()[0] == t["order_items"].count()
    assert quality.invalid_baskets(t["baskets"]).count() == 0


def test_gold_is_complete_and_consistent(spark, built):
    root, _, _, report = built
    gold = commits.snapshot(spark, f"{root}/gold")
    assert sorted(gold.tables) == sorted(layers.GOLD_TABLES) and gold.number == 1
    chosen = report.selected.first()
    assert report.scored.count() == 4
    assert chosen.selection_score == report.scored.agg(F.max("selection_score")).first()[0]
    rules = gold.read("association_rules")
    assert rules.count() == chosen.useful_rules == rules.select("rule_id").distinct().count()
    assert quality.invalid_rules(rules, chosen.min_support, chosen.min_confidence).count() == 0
    itemsets = gold.read("frequent_itemsets")
    assert itemsets.count() == chosen.frequent_itemsets
    assert quality.invalid_itemsets(itemsets, chosen.training_baskets).count() == 0
    lookup = gold.read("recommendation_lookup")
    assert quality.invalid_lookup(lookup).count() == 0
    assert lookup.select("rule_id").distinct().count() == rules.count()
    names = {r.product_id: r.product_name for r in gold.read("product_catalog").collect()}
    for r in rules.collect():
        assert [names[i] for i in r.antecedent] == r.antecedent_names
    totals = report.users.agg(
        F.count("*").alias("n"), F.count_if("covered").alias("covered"), F.count_if("hit").alias("hits")
    ).first()
    assert (totals.covered, totals.hits) == (chosen.covered_users, chosen.hit_users)
    assert totals.covered / totals.n == chosen.coverage


def test_gold_serves_observed_baskets(spark, built):
    root = built[0]
    baskets = commits.snapshot(spark, f"{root}/silver").read("baskets")
    items = commits.snapshot(spark, f"{root}/silver").read("order_items")
    products = commits.snapshot(spark, f"{root}/silver").read("products")
    lookup = commits.snapshot(spark, f"{root}/gold").read("recommendation_lookup")
    popular = kpi.top_products(items, products).select("product_id", "count")
    served = recommend.serve(baskets, lookup, popular, products.select("product_id", "product_name"))
    assert served.join(baskets, "order_id").where(F.array_contains("items", F.col("product_id"))).count() == 0
    assert served.groupBy("order_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("s")).where(
        "n > 5 OR s > 1"
    ).count() == 0
    assert served.select("order_id").distinct().count() == baskets.count()


def test_a_failing_check_publishes_no_gold(spark, built, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "target_after_context", lambda df: df.selectExpr("count(*) AS n"))
    with pytest.raises(ValueError, match="does not follow"):
        layers.build_gold(spark, f"{built[0]}/silver", str(tmp_path / "gold"), GRID, 8)
    assert commits.snapshot(spark, str(tmp_path / "gold")) is None


def test_a_crash_between_tables_leaves_the_layer_whole(spark, raw, tmp_path, monkeypatch):
    """The second run dies after some tables, or at the commit itself; readers see the first one, and a rerun succeeds."""
    root = str(tmp_path / "bronze")
    layers.build_bronze(spark, raw, root, "run_1")

    def runs():
        layer = commits.snapshot(spark, root)
        return layer.number, {r.run_id for name in SPECS for r in layer.read(name).select("run_id").distinct().collect()}

    write, calls = files.write_verified, []

    def dying(df, path, rows=None):
        calls.append(path)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return write(df, path, rows)

    with monkeypatch.context() as patch:
        patch.setattr(files, "write_verified", dying)
        with pytest.raises(RuntimeError):
            layers.build_bronze(spark, raw, root, "run_2", replace=True)
    assert runs() == (1, {"run_1"})
    with monkeypatch.context() as patch:
        patch.setattr(commits, "_move_to_free", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            layers.build_bronze(spark, raw, root, "run_3", replace=True)
    assert runs() == (1, {"run_1"})
    before = commits.snapshot(spark, root)
    layers.build_bronze(spark, raw, root, "run_4", replace=True)
    assert runs() == (2, {"run_4"})
    assert {r.run_id for r in before.read("orders").select("run_id").distinct().collect()} == {"run_1"}
    # What two failed runs and the first commit have left: three tables, all, all.
    assert commits.clean(spark, root) == 3 + 2 * len(SPECS)
    assert runs() == (2, {"run_4"}) and commits.numbers(spark, root) == [2]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    root, rows = str(tmp_path / "layer"), spark.range(3)
    first, second = commits.Writer(spark, root), commits.Writer(spark, root)
    first.store(rows, "t")
    second.store(rows.limit(1), "t")
    assert commits.snapshot(spark, root) is None
    first.commit()
    with pytest.raises(commits.CommitConflict):
        second.commit()
    assert commits.snapshot(spark, root).read("t").count() == 3
    with pytest.raises(FileExistsError):
        commits.Writer(spark, root)
    with pytest.raises(FileNotFoundError):
        commits.snapshot(spark, root, 2)
    with pytest.raises(FileNotFoundError):
        commits.snapshot(spark, root).read("u")
    assert os.listdir(tmp_path / "layer" / ".commits") != []
