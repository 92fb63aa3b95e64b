"""The registered queries again as SQL over the test tables, for comparison with another engine."""

from __future__ import annotations

import re

from cartflow.functions.baskets import config_id
from cartflow.operators.mining import MAX_ITEMSETS, MAX_RULES
from cartflow.operators.recommend import FALLBACK_NOTE, FROM_POPULARITY, FROM_RULE
from cartflow.plans.layers import GRID as LAYER_GRID
from cartflow.plans.queries import FAILED, FIT_SECONDS, TIMEOUT_SECONDS
from cartflow.plans.retail import FINAL, GRID, PRODUCT_BASKETS, PRODUCT_SHARE

LOW, LOW_CONFIDENCE = min(GRID.supports), min(GRID.confidences)
CELLS = ", ".join(
    f"('{name}', CAST({s} AS DOUBLE), CAST({c} AS DOUBLE))" for name, s, c in GRID.cells
)

DEPARTMENT = "(SELECT department FROM departments WHERE department_id = product_id) AS product_name"
# The same for itemsets of single parts.

def _subsets(baskets: str) -> str:
    """All non-empty subsets of every basket: itemsets of any size."""
    return f"""
        SELECT list_filter(items, lambda x, i: (m >> CAST(i - 1 AS INTEGER)) & 1 = 1) AS items
        FROM (SELECT items, unnest(range(1, 1 << len(items))) AS m FROM {baskets})"""


# Views in dependency order.
VIEWS = {
    "edited_lines": """
        SELECT l_orderkey, l_linenumber, l_partkey,
          l_quantity + CASE WHEN l_partkey % 10 = 1 THEN 1 ELSE 0 END AS l_quantity, l_returnflag
        FROM lineitem WHERE l_returnflag <> 'R'
        UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem
        WHERE l_returnflag <> 'R' AND l_partkey % 10 = 2""",
    "both_versions": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, -1 AS n FROM lineitem
        UNION ALL SELECT *, 1 AS n FROM edited_lines""",
    "order_lines": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, min(l_linenumber) AS add_to_cart_order
        FROM lineitem GROUP BY ALL""",
    "numbered": """
        SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS placed,
          CAST(row_number() OVER w AS INTEGER) AS order_number, lag(o_orderdate) OVER w AS previous
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "observed": """
        SELECT order_id, order_number = max(order_number) OVER u AND count(*) OVER u >= 2 AS is_last
        FROM numbered WHERE order_id IN (SELECT order_id FROM order_lines)
        WINDOW u AS (PARTITION BY user_id)""",
    "shop_orders": """
        SELECT n.order_id, n.user_id,
          CASE WHEN o.order_id IS NULL THEN 'test' WHEN o.is_last THEN 'train' ELSE 'prior' END AS eval_set,
          n.order_number, CAST(dayofweek(n.placed) AS INTEGER) AS order_dow,
          CAST(hour(n.placed) AS INTEGER) AS order_hour_of_day,
          CASE WHEN n.previous IS NOT NULL
            THEN CAST(least(date_diff('day', n.previous, n.placed), 30) AS DOUBLE) END AS days_since_prior_order
        FROM numbered n LEFT JOIN observed o USING (order_id)""",
    "split_items": """
        SELECT l.order_id, l.product_id, l.add_to_cart_order,
          CAST(o.order_number > min(o.order_number) OVER (PARTITION BY o.user_id, l.product_id) AS INTEGER)
            AS reordered, o.eval_set
        FROM order_lines l JOIN shop_orders o USING (order_id)""",
    "items": "SELECT * EXCLUDE (eval_set) FROM split_items",
    "aisles": "SELECT min(p_partkey) + 1 AS aisle_id, p_type AS aisle FROM part GROUP BY p_type",
    "departments": """
        SELECT DISTINCT CAST(substring(p_brand, 7, 3) AS BIGINT) AS department_id, p_brand AS department FROM part""",
    "products": """
        SELECT p_partkey AS product_id, p_name AS product_name, aisle_id,
          CAST(substring(p_brand, 7, 3) AS BIGINT) AS department_id
        FROM part JOIN aisles ON p_type = aisle""",
    "dim": "SELECT * FROM products JOIN aisles USING (aisle_id) JOIN departments USING (department_id)",
    "enriched": """
        SELECT product_id, order_id, add_to_cart_order, reordered, product_name, aisle_id, aisle, department_id,
          department
        FROM items JOIN dim USING (product_id)""",
    "product_baskets": """
        SELECT order_id, user_id, items, CAST(len(items) AS INTEGER) AS basket_size
        FROM (SELECT order_id, list_sort(list(DISTINCT product_id)) AS items FROM order_lines GROUP BY order_id)
        JOIN shop_orders USING (order_id)""",
    "line_departments": """
        SELECT order_id, product_id, CAST(department_id AS INTEGER) AS department_id
        FROM order_lines JOIN products USING (product_id)""",
    "dept_baskets": """
        SELECT order_id, user_id, items, CAST(len(items) AS INTEGER) AS basket_size
        FROM (SELECT order_id, list_sort(list(DISTINCT department_id)) AS items FROM line_departments
              GROUP BY order_id)
        JOIN shop_orders USING (order_id)""",
    "training": """
        SELECT b.order_id, b.user_id, b.items FROM dept_baskets b JOIN shop_orders o USING (order_id)
        WHERE o.eval_set = 'prior' AND len(b.items) >= 2""",
    "n": "SELECT count(*) AS n FROM training",
    "floor_count": f"SELECT ceil(CAST({LOW} AS DOUBLE) * n) AS least FROM n",
    "t": "SELECT order_id, unnest(items) AS item FROM training",
    "one": """
        SELECT item AS a, count(*) AS freq FROM t GROUP BY ALL HAVING count(*) >= (SELECT least FROM floor_count)""",
    "subsets": _subsets("training"),
    "itemsets": """
        SELECT items, count(*) AS freq FROM subsets GROUP BY ALL HAVING count(*) >= (SELECT least FROM floor_count)""",
    "sides": """
        SELECT list_filter(items, lambda x: x <> item) AS antecedent, item, freq
        FROM (SELECT items, freq, unnest(items) AS item FROM itemsets WHERE len(items) > 1)""",
    "rules": f"""
        SELECT s.antecedent, [s.item] AS consequent, s.freq / a.freq AS confidence,
          (s.freq / a.freq) / (c.freq / n.n) AS lift, s.freq / n.n AS support, s.freq AS freq
        FROM sides s JOIN itemsets a ON a.items = s.antecedent JOIN one c ON c.a = s.item CROSS JOIN n
        WHERE s.freq / a.freq >= {LOW_CONFIDENCE}""",
    "useful": """
        SELECT *, sha256('{"antecedent":[' || array_to_string(antecedent, ',') || '],"consequent":['
            || array_to_string(consequent, ',') || ']}') AS rule_id
        FROM rules WHERE lift > 1""",
    "grid": f"""
        SELECT c.*, ceil(c.min_support * n.n) AS least
        FROM (VALUES {CELLS}) c(config_id, min_support, min_confidence) CROSS JOIN n""",
    "cell_rules": """
        SELECT g.config_id, r.* FROM useful r JOIN grid g
        ON r.freq >= g.least AND r.confidence >= g.min_confidence""",
    "final": f"SELECT * FROM cell_rules WHERE config_id = '{config_id(*FINAL)}'",
    "named": """
        SELECT *, list_transform(antecedent, lambda x: 'Brand#' || x) AS antecedent_names,
          list_transform(consequent, lambda x: 'Brand#' || x) AS consequent_names
        FROM final""",
    "labels_of": """
        SELECT *, array_to_string(antecedent_names, ', ') || ' → ' || array_to_string(consequent_names, ', ')
          AS label
        FROM named""",
    "latest": """
        SELECT user_id, items AS context_items, order_id AS context_order_id, order_number AS context_order_number
        FROM (SELECT b.*, o.order_number,
                row_number() OVER (PARTITION BY b.user_id ORDER BY o.order_number DESC, b.order_id DESC) AS back
              FROM dept_baskets b JOIN shop_orders o USING (order_id) WHERE o.eval_set = 'prior')
        WHERE back = 1""",
    "truth": """
        SELECT b.user_id, b.items AS ground_truth, b.order_id AS train_order_id, o.order_number AS train_order_number
        FROM dept_baskets b JOIN shop_orders o USING (order_id) WHERE o.eval_set = 'train'""",
    "contexts": "SELECT * FROM truth JOIN latest USING (user_id)",
    "matches": """
        SELECT c.user_id, r.config_id, r.rule_id, r.consequent[1] AS product_id, r.confidence, r.lift, r.support
        FROM contexts c JOIN cell_rules r
        ON list_has_all(c.context_items, r.antecedent) AND NOT list_contains(c.context_items, r.consequent[1])""",
    "all_met": """
        SELECT c.user_id, r.consequent[1] AS product_id, list_contains(c.context_items, r.consequent[1]) AS is_owned
        FROM contexts c JOIN (SELECT DISTINCT antecedent, consequent FROM cell_rules) r
        ON list_has_all(c.context_items, r.antecedent)""",
    "best": """
        SELECT * EXCLUDE (place) FROM (
          SELECT *, row_number() OVER (PARTITION BY config_id, user_id, product_id
            ORDER BY confidence DESC, lift DESC, support DESC, rule_id) AS place FROM matches)
        WHERE place = 1""",
    "topk": """
        SELECT * FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY config_id, user_id
            ORDER BY confidence DESC, lift DESC, support DESC, product_id) AS INTEGER) AS rank FROM best)
        WHERE rank <= 5""",
    "lists": """
        SELECT config_id, user_id, list(product_id ORDER BY rank) AS recommendations FROM topk GROUP BY ALL""",
    "coverage": """
        SELECT config_id, covered_users, recommendation_count, hit_users, eligible_users,
          covered_users / eligible_users AS coverage, hit_users / eligible_users AS hitrate,
          hit_users / nullif(covered_users, 0) AS conditional_hitrate
        FROM (SELECT g.config_id, count(l.user_id) AS covered_users,
                CAST(coalesce(sum(len(recommendations)), 0) AS BIGINT) AS recommendation_count,
                count(*) FILTER (list_has_any(recommendations, ground_truth)) AS hit_users,
                (SELECT count(*) FROM contexts) AS eligible_users
              FROM grid g LEFT JOIN (lists l JOIN contexts USING (user_id)) ON l.config_id = g.config_id
              GROUP BY g.config_id)""",
    "rule_stats": """
        SELECT g.config_id, g.min_support, g.min_confidence,
          (SELECT count(*) FROM itemsets i WHERE i.freq >= g.least) AS frequent_itemsets,
          count(r.lift) AS association_rules, avg(r.support) AS avg_support, avg(r.confidence) AS avg_confidence,
          avg(r.lift) AS avg_lift, quantile_cont(r.lift, 0.5) AS median_lift,
          count(*) FILTER (r.lift > 1) AS rules_lift_gt_1, count(*) FILTER (r.lift > 1) AS useful_rules
        FROM grid g LEFT JOIN rules r ON r.freq >= g.least AND r.confidence >= g.min_confidence
        GROUP BY g.config_id, g.min_support, g.min_confidence, g.least""",
    "scored": f"""
        SELECT s.*, c.* EXCLUDE (config_id), {FIT_SECONDS} / CAST(s.min_support AS DOUBLE) AS fit_seconds,
          s.config_id <> '{config_id(*FAILED)}' AS mined,
          0.40 * coalesce(c.hitrate, 0) + 0.35 * coalesce(c.coverage, 0) + 0.10 * coalesce(s.avg_confidence, 0)
            + 0.10 * least(coalesce(s.median_lift, 0) / 5, 1) + 0.05 * least(s.useful_rules / 10000, 1)
            - 0.02 * least({FIT_SECONDS} / CAST(s.min_support AS DOUBLE) / {TIMEOUT_SECONDS}, 1) AS selection_score
        FROM rule_stats s LEFT JOIN coverage c USING (config_id)""",
    "served_matches": """
        SELECT b.order_id, r.rule_id, r.consequent[1] AS product_id, r.confidence, r.lift, r.support, r.label
        FROM dept_baskets b JOIN labels_of r
        ON list_has_all(b.items, r.antecedent) AND NOT list_contains(b.items, r.consequent[1])""",
    "served": f"""
        SELECT order_id, rank, product_id, {DEPARTMENT}, confidence AS score, '{FROM_RULE}' AS source, label AS source_rule, rule_id,
          support, confidence, lift, CAST(NULL AS BIGINT) AS purchase_count
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY order_id
                ORDER BY confidence DESC, lift DESC, support DESC, product_id) AS INTEGER) AS rank
              FROM (SELECT *, row_number() OVER (PARTITION BY order_id, product_id
                      ORDER BY confidence DESC, lift DESC, support DESC, rule_id) AS place FROM served_matches)
              WHERE place = 1)
        WHERE rank <= 5""",
    "popular": """
        SELECT department_id AS product_id, count(*) AS count FROM line_departments GROUP BY ALL
        ORDER BY count DESC, product_id LIMIT 20""",
    "fallback": f"""
        SELECT order_id, rank, product_id, {DEPARTMENT}, CAST(NULL AS DOUBLE) AS score, '{FROM_POPULARITY}' AS source,
          '{FALLBACK_NOTE}' AS source_rule, CAST(NULL AS VARCHAR) AS rule_id, CAST(NULL AS DOUBLE) AS support,
          CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS DOUBLE) AS lift, count AS purchase_count
        FROM (SELECT b.order_id, p.product_id, p.count, CAST(row_number() OVER (PARTITION BY b.order_id
                ORDER BY p.count DESC, p.product_id) AS INTEGER) AS rank
              FROM dept_baskets b CROSS JOIN popular p
              WHERE b.order_id NOT IN (SELECT order_id FROM served) AND NOT list_contains(b.items, p.product_id))
        WHERE rank <= 5""",
    "p_training": """
        SELECT b.items FROM product_baskets b JOIN shop_orders o USING (order_id)
        WHERE o.eval_set = 'prior' AND len(b.items) >= 2""",
    "p_n": "SELECT count(*) AS n FROM p_training",
    "p_subsets": _subsets("p_training"),
    "p_itemsets": f"""
        SELECT items, count(*) AS freq FROM p_subsets GROUP BY ALL
        HAVING count(*) >= (SELECT greatest({PRODUCT_BASKETS}, -(-n // {PRODUCT_SHARE})) FROM p_n)""",
    # One in so many baskets, rounded up as the query does; `//` alone cuts towards zero.
    "p_frequent": f"""
        SELECT items, count(*) AS freq FROM p_subsets GROUP BY ALL
        HAVING count(*) >= (SELECT greatest({PRODUCT_BASKETS}, (n + {PRODUCT_SHARE - 1}) // {PRODUCT_SHARE}) FROM p_n)""",
    "p_rules": """
        SELECT s.antecedent, [s.item] AS consequent, s.freq / a.freq AS confidence,
          (s.freq / a.freq) / (c.freq / p_n.n) AS lift, s.freq / p_n.n AS support
        FROM (SELECT list_filter(items, lambda x: x <> item) AS antecedent, item, freq
              FROM (SELECT items, freq, unnest(items) AS item FROM p_itemsets WHERE len(items) > 1)) s
        JOIN p_itemsets a ON a.items = s.antecedent JOIN p_itemsets c ON c.items = [s.item] CROSS JOIN p_n""",
    "p_named": """
        SELECT r.*, l.antecedent_names, [p.product_name] AS consequent_names
        FROM p_rules r JOIN products p ON p.product_id = consequent[1] JOIN (
          SELECT antecedent, list(product_name ORDER BY pos) AS antecedent_names
          FROM (SELECT antecedent, unnest(antecedent) AS product_id, generate_subscripts(antecedent, 1) AS pos
                FROM (SELECT DISTINCT antecedent FROM p_rules))
          JOIN products USING (product_id) GROUP BY antecedent) l USING (antecedent)
        WHERE lift > 1""",
    "p_labels": """
        SELECT *, array_to_string(antecedent_names, ', ') || ' → ' || consequent_names[1] AS label,
          sha256('{"antecedent":[' || array_to_string(antecedent, ',') || '],"consequent":['
            || array_to_string(consequent, ',') || ']}') AS rule_id FROM p_named""",
}


def with_views(body: str) -> str:
    """`body` preceded by the views it needs."""
    needed: set[str] = set()
    waiting = [body]
    while waiting:
        words = set(re.findall(r"[a-z_0-9]+", waiting.pop()))
        for name in words & VIEWS.keys() - needed:
            needed.add(name)
            waiting.append(VIEWS[name])
    if not needed:
        return body
    chosen = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    return f"WITH {chosen}\n{body}"


def _count(source: str, condition: str) -> str:
    return f"(SELECT count(*) FROM {source} WHERE {condition})"


def _rules(*checks: tuple[str, str, str, str]) -> str:
    """`(table, rule, source, condition)` to one row each."""
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{rule}' AS rule, {_count(source, condition)} AS n"
        for table, rule, source, condition in checks
    )


PRIOR = "(SELECT * FROM split_items WHERE eval_set = 'prior')"
TRAIN = "(SELECT * FROM split_items WHERE eval_set = 'train')"
CONSISTENCY = (
    "(order_number = 1 AND days_since_prior_order IS NOT NULL)"
    " OR (order_number > 1 AND days_since_prior_order IS NULL)"
)
PROFILES = {
    "aisles": ("aisles", {"aisle_id": "aisle_id < 1", "aisle": "trim(aisle) = ''"}, ["aisle_id"]),
    "departments": (
        "departments",
        {"department_id": "department_id < 1", "department": "trim(department) = ''"},
        ["department_id"],
    ),
    "products": (
        "products",
        {
            "product_id": "product_id < 1",
            "product_name": "trim(product_name) = ''",
            "aisle_id": "aisle_id < 1",
            "department_id": "department_id < 1",
        },
        ["product_id"],
    ),
    "orders": (
        "shop_orders",
        {
            "order_id": "order_id < 1",
            "user_id": "user_id < 1",
            "eval_set": "eval_set NOT IN ('prior', 'train', 'test')",
            "order_number": "order_number < 1",
            "order_dow": "order_dow NOT BETWEEN 0 AND 6",
            "order_hour_of_day": "order_hour_of_day NOT BETWEEN 0 AND 23",
            "days_since_prior_order": "days_since_prior_order NOT BETWEEN 0 AND 30",
            "days_since_prior_order_consistency": CONSISTENCY,
        },
        ["order_id"],
    ),
}
for _name, _source in (("prior", PRIOR), ("train", TRAIN)):
    PROFILES[f"order_products_{_name}"] = (
        _source,
        {
            "order_id": "order_id < 1",
            "product_id": "product_id < 1",
            "add_to_cart_order": "add_to_cart_order < 1",
            "reordered": "reordered NOT IN (0, 1)",
        },
        ["order_id", "product_id"],
    )


def _profile(table: str) -> str:
    """Schema is 0 except where the view holds ids or counters in another type than declared."""
    source, rules, keys = PROFILES[table]
    key = ", ".join(keys)
    label = ",".join(keys)
    repeats = f"(SELECT count(*) AS c FROM {source} GROUP BY {key} HAVING count(*) > 1)"
    rows = [("rows", "", f"(SELECT count(*) FROM {source})"), ("schema", "", "0")]
    rows += [("null", c, _count(source, f"{c} IS NULL")) for c in rules if not c.endswith("_consistency")]
    rows += [("invalid", c, _count(source, condition)) for c, condition in rules.items()]
    rows.append(("duplicate_groups", label, f"(SELECT count(*) FROM {repeats})"))
    rows.append(("duplicate_excess", label, f"(SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM {repeats})"))
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{check}' AS \"check\", '{column}' AS \"column\", CAST({n} AS BIGINT) AS n"
        for check, column, n in rows
    )


def _verdicts(table: str) -> str:
    source, rules, keys = PROFILES[table]
    columns = [c for c in rules if not c.startswith("days_since")]
    nulls = " OR ".join(f"{c} IS NULL" for c in columns)
    broken = " OR ".join(f"coalesce({condition}, false)" for condition in rules.values())
    verdicts = {
        "nonempty": f"(SELECT count(*) > 0 FROM {source})",
        "schema": "true",
        "required_nulls": f"NOT EXISTS (SELECT 1 FROM {source} WHERE {nulls})",
        "duplicate_keys": f"(SELECT count(*) = count(DISTINCT ({', '.join(keys)})) FROM {source})",
        "domains": f"NOT EXISTS (SELECT 1 FROM {source} WHERE {broken})",
    }
    verdicts["status"] = " AND ".join(verdicts.values())
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{check}' AS \"check\", {passed} AS passed"
        for check, passed in verdicts.items()
    )


def _orphans(relation: str, child: str, key: str, parent: str, parent_key: str) -> str:
    return (
        f"SELECT '{relation}' AS relation, count(*) AS n FROM {child} c"
        f" WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_key} = c.{key})"
    )


def _fk(name: str, body: str) -> str:
    return f"SELECT '{name}' AS fk, ({body}) AS n"


def _reconciled(name: str, left: str, right: str) -> str:
    return (
        f"SELECT '{name}' AS \"check\", CAST(({left}) AS BIGINT) AS left_value,"
        f" CAST(({right}) AS BIGINT) AS right_value, ({left}) = ({right}) AS ok"
    )


def _text(*columns: str) -> str:
    return ", ".join(f"array_to_string({c}, ',') AS {c}" for c in columns)


def _rows(stage: str, table: str, before: str, after: str) -> str:
    return (
        f"SELECT '{stage}' AS stage, '{table}' AS \"table\","
        f" (SELECT count(*) FROM {before}) AS rows_in, (SELECT count(*) FROM {after}) AS rows_out"
    )


def _top(kind: str, key: str, name: str) -> str:
    return (
        f"(SELECT '{kind}' AS kind, {key} AS id, {name} AS name, count(*) AS count FROM enriched"
        f" GROUP BY ALL ORDER BY count DESC, id LIMIT 1)"
    )


def _peak(label: str, key: str, source: str) -> str:
    counts = f"(SELECT {key} AS key, count(*) AS count FROM {source} GROUP BY ALL)"
    best = f"(SELECT * FROM {counts} QUALIFY rank() OVER (ORDER BY count DESC) = 1)"
    return (
        f"SELECT '{label}' AS \"of\", key, count, count(*) OVER () AS ties, min(key) OVER () AS first_key FROM {best}"
    )


ITEM_COLUMNS = "order_id, product_id, add_to_cart_order, reordered"
ROUND_METRICS = ", ".join(
    f"round({c}, 9) AS {c}" for c in ("avg_support", "avg_confidence", "avg_lift", "median_lift")
)
BODIES = {
    "read_csv_strict": "SELECT product_id, product_name, aisle_id, department_id FROM products",
    "read_csv_split": "SELECT * FROM shop_orders",
    "read_csv_records": """
        SELECT product_id, product_name || chr(10) || '"' || product_name || '", and so on' AS product_name, aisle_id,
          department_id FROM products""",
    "write_and_read_table": "SELECT * FROM items",
    "publish_verified": "SELECT count(*) AS rows_found, CAST(0 AS BIGINT) AS unlabelled, count(*) AS rows_published FROM orders",
    "layer_commits": """
        SELECT 1 AS commit, 'orders' AS table, count(*) AS n FROM orders UNION ALL
        SELECT 1, 'lineitem', count(*) FROM lineitem UNION ALL
        SELECT 2, 'orders', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL
        SELECT 2, 'lineitem', count(*) FROM lineitem WHERE l_linestatus = 'F'""",
    "with_lineage": "SELECT 'run_1' AS run_id, count(*) AS rows, count(*) AS timed, count(*) AS from_lineitem FROM lineitem",
    "backfill_run_id": "SELECT o_orderkey, o_custkey, 'run_1' AS run_id FROM orders",
    "bucket_sample": "SELECT * FROM items WHERE order_id % 10000 < 500",
    "export_csv": "SELECT order_dow, count(*) AS count FROM shop_orders GROUP BY ALL",
    "product_catalog": "SELECT product_id, product_name, department FROM dim",
    "rule_positive_key": _rules(
        *[
            (t, c, PROFILES[t][0], PROFILES[t][1][c])
            for t, columns in (
                ("aisles", ["aisle_id"]),
                ("departments", ["department_id"]),
                ("products", ["product_id", "aisle_id", "department_id"]),
            )
            for c in columns
        ],
        *[("orders", c, "shop_orders", f"{c} < 1") for c in ("order_id", "user_id", "order_number")],
        *[
            (f"order_products_{split}", c, source, f"{c} < 1")
            for split, source in (("prior", PRIOR), ("train", TRAIN))
            for c in ("order_id", "product_id", "add_to_cart_order")
        ],
    ),
    "rule_between": _rules(
        ("orders", "order_dow", "shop_orders", "order_dow NOT BETWEEN 0 AND 6"),
        ("orders", "order_hour_of_day", "shop_orders", "order_hour_of_day NOT BETWEEN 0 AND 23"),
    ),
    "rule_isin": _rules(
        ("orders", "eval_set", "shop_orders", "eval_set NOT IN ('prior', 'train', 'test')"),
        ("order_products_prior", "reordered", PRIOR, "reordered NOT IN (0, 1)"),
        ("order_products_train", "reordered", TRAIN, "reordered NOT IN (0, 1)"),
    ),
    "rule_range_or_nan": _rules(
        (
            "orders",
            "days_since_prior_order",
            "shop_orders",
            "days_since_prior_order NOT BETWEEN 0 AND 30 OR isnan(days_since_prior_order)",
        )
    ),
    "rule_nonblank": _rules(
        ("products", "product_name", "products", "trim(product_name) = ''"),
        ("aisles", "aisle", "aisles", "trim(aisle) = ''"),
        ("departments", "department", "departments", "trim(department) = ''"),
    ),
    "rule_cross_column": _rules(("orders", "days_since_prior_order_consistency", "shop_orders", CONSISTENCY)),
    "count_when": """
        SELECT count(*) FILTER (l_returnflag = 'R') AS returned,
          count(*) FILTER (l_quantity NOT BETWEEN 5 AND 45) AS unusual_quantity,
          count(*) FILTER (l_linenumber > 100) AS long_orders FROM lineitem""",
    "null_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM shop_orders"
        for c in PROFILES["orders"][1]
        if not c.endswith("_consistency")
    ),
    "duplicate_profile": """
        SELECT count(*) AS groups, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS excess
        FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
    "profile_table": " UNION ALL ".join(_profile(table) for table in PROFILES),
    "table_status": " UNION ALL ".join(_verdicts(t) for t in PROFILES),
    "reconcile_rows": " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", s.n AS source_rows, t.n AS target_rows, s.n = t.n AS ok"
        f" FROM (SELECT count(*) AS n FROM {a}) s, (SELECT count(*) AS n FROM {b}) t"
        for name, a, b in (
            ("order_items", "order_lines", "items"),
            ("order_items_enriched", "items", "enriched"),
            ("order_lines", "lineitem", "order_lines"),
        )
    ),
    "lineage_null_rows": """
        SELECT 'whole' AS lines, CAST(0 AS BIGINT) AS n UNION ALL
        SELECT 'faulty', count(*) FILTER (l_returnflag = 'R' OR l_linenumber <= 1) FROM lineitem""",
    "orphan_count": " UNION ALL ".join(
        _orphans(f"{child}.{key}", child, key, parent, parent_key)
        for child, key, parent, parent_key in (
            ("lineitem", "l_orderkey", "orders", "o_orderkey"),
            ("orders", "o_orderkey", "lineitem", "l_orderkey"),
            ("events", "user_id", "customer", "c_custkey"),
            ("customer", "c_custkey", "events", "user_id"),
        )
    ),
    "invalid_baskets": """
        SELECT order_id, user_id, basket_size FROM product_baskets WHERE basket_size < 2 OR list_contains(items, 0)""",
    "single_target_per_user": """
        SELECT count(*) AS targets, count(DISTINCT user_id) AS users, targets = users AS ok FROM truth""",
    "target_after_context": """
        SELECT 'built' AS pairs, count(*) FILTER (train_order_number <= context_order_number) AS n FROM contexts UNION ALL
        SELECT 'swapped', count(*) FILTER (context_order_number <= train_order_number) FROM contexts""",
    "invalid_rules": f"""
        SELECT {_text("antecedent", "consequent")}, freq FROM rules
        WHERE confidence < 0.15 OR support < 0.005 OR lift <= 1""",
    "invalid_itemsets": """
        SELECT 'training' AS "limit", count(*) FILTER (freq > (SELECT n FROM n)) AS n FROM itemsets UNION ALL
        SELECT 'users', count(*) FILTER (freq > (SELECT count(*) FROM contexts)) FROM itemsets""",
    "invalid_lookup": """
        SELECT 'built' AS lookup, count(*) FILTER (list_has_any(antecedent, consequent)) AS n FROM final UNION ALL
        SELECT 'swapped', CAST(coalesce(sum(len(antecedent)), 0) AS BIGINT) FROM final UNION ALL
        SELECT 'missing', CAST(coalesce(sum(len(antecedent)) FILTER (consequent[1] % 2 = 1), 0) AS BIGINT) FROM final""",
    "kpi_reconciliation": " UNION ALL ".join(
        _reconciled(name, left, right)
        for name, left, right in (
            ("total_orders/hours", "SELECT count(*) FROM orders", "SELECT count(*) FROM shop_orders"),
            ("total_orders/weekdays", "SELECT count(*) FROM orders", "SELECT count(order_dow) FROM shop_orders"),
            ("total_orders/users", "SELECT count(*) FROM orders", "SELECT count(user_id) FROM shop_orders"),
            (
                "total_users/users",
                "SELECT count(DISTINCT o_custkey) FROM orders",
                "SELECT count(DISTINCT user_id) FROM shop_orders",
            ),
            ("total_order_items/departments", "SELECT count(*) FROM items", "SELECT count(*) FROM enriched"),
            ("total_order_items/baskets", "SELECT count(*) FROM items", "SELECT sum(basket_size) FROM product_baskets"),
            (
                "observed_baskets/sizes",
                "SELECT count(DISTINCT order_id) FROM items",
                "SELECT count(*) FROM product_baskets",
            ),
        )
    ),
    "training_leakage": """
        SELECT 'training' AS baskets, count(*) AS n FROM training JOIN shop_orders USING (order_id)
        WHERE eval_set <> 'prior' UNION ALL
        SELECT 'all', count(*) FROM dept_baskets JOIN shop_orders USING (order_id) WHERE eval_set <> 'prior'""",
    "weighted_rate_check": """
        SELECT 'departments' AS source, sum(r) / sum(c) AS rate
        FROM (SELECT sum(reordered) AS r, count(*) AS c FROM enriched GROUP BY department_id) UNION ALL
        SELECT 'items', avg(reordered) FROM items""",
    "normalize": "SELECT * FROM products",
    "product_dim": "SELECT * FROM dim",
    "order_items": f"SELECT {ITEM_COLUMNS} FROM split_items WHERE eval_set IN ('prior', 'train')",
    "order_items_enriched": "SELECT * FROM enriched",
    "shop_orders": "SELECT * FROM shop_orders",
    "baskets": f"SELECT order_id, user_id, {_text('items')}, basket_size FROM product_baskets",
    "department_baskets": f"SELECT order_id, user_id, {_text('items')}, basket_size FROM dept_baskets",
    "fk_report": " UNION ALL ".join(
        [
            _fk("products.aisle_id", "SELECT count(*) FROM products WHERE aisle_id NOT IN (SELECT aisle_id FROM aisles)"),
            _fk(
                "products.department_id",
                "SELECT count(*) FROM products WHERE department_id NOT IN (SELECT department_id FROM departments)",
            ),
            _fk(
                "order_items.order_id",
                "SELECT count(*) FROM items WHERE order_id NOT IN (SELECT order_id FROM shop_orders)",
            ),
            _fk(
                "order_items.product_id",
                "SELECT count(*) FROM items WHERE product_id NOT IN (SELECT product_id FROM products)",
            ),
            _fk(
                "prior.eval_set",
                f"SELECT count(*) FROM {PRIOR} i JOIN shop_orders o USING (order_id) WHERE o.eval_set <> 'prior'",
            ),
            _fk(
                "train.eval_set",
                f"SELECT count(*) FROM {TRAIN} i JOIN shop_orders o USING (order_id) WHERE o.eval_set <> 'train'",
            ),
        ]
    ),
    "kpi_orders": """
        SELECT count(*) AS total_orders, count(DISTINCT user_id) AS total_users,
          avg(days_since_prior_order) AS avg_days_between_orders,
          count(days_since_prior_order) AS days_between_orders_observations FROM shop_orders""",
    "kpi_items": "SELECT count(*) AS total_order_items, avg(reordered) AS reorder_rate FROM items",
    "kpi_baskets": """
        SELECT count(*) AS observed_baskets, avg(basket_size) AS avg_basket_size,
          quantile_cont(basket_size, 0.5) AS median_basket_size,
          CAST(sum(basket_size) AS BIGINT) AS basket_item_total FROM product_baskets""",
    "kpi_derived": """
        SELECT (SELECT count(*) FROM products) AS total_products,
          (SELECT count(*) / count(DISTINCT user_id) FROM shop_orders) AS avg_orders_per_user,
          (SELECT count(*) FROM shop_orders) - (SELECT count(*) FROM product_baskets)
            AS orders_without_observed_items""",
    "orders_by_hour": "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count FROM events GROUP BY ALL",
    "orders_by_dow": "SELECT order_dow, count(*) AS count FROM shop_orders GROUP BY ALL",
    "top_products": """
        SELECT product_id, product_name, count(*) AS count FROM enriched GROUP BY ALL
        ORDER BY count DESC, product_id LIMIT 20""",
    "top_departments": """
        SELECT department_id, department, count(*) AS count FROM enriched GROUP BY ALL
        ORDER BY count DESC, department_id LIMIT 15""",
    "top_aisles": """
        SELECT aisle_id, aisle, count(*) AS count FROM enriched GROUP BY ALL
        ORDER BY count DESC, aisle_id LIMIT 20""",
    "basket_size_histogram": "SELECT basket_size, count(*) AS count FROM product_baskets GROUP BY ALL",
    "reorder_by_department": """
        SELECT department_id, department, count(*) AS item_count, CAST(sum(reordered) AS BIGINT) AS reordered_items,
          avg(reordered) AS reorder_rate, avg(reordered) * 100 AS reorder_percent
        FROM enriched GROUP BY ALL""",
    "orders_per_user_histogram": """
        SELECT orders_per_user, count(*) AS user_count
        FROM (SELECT count(*) AS orders_per_user FROM shop_orders GROUP BY user_id) GROUP BY ALL""",
    "peak_with_ties": _peak("weekday", "order_dow", "shop_orders")
    + " UNION ALL "
    + _peak("basket size", "basket_size", "product_baskets"),
    "most_purchased": " UNION ALL ".join(
        [
            _top("product", "product_id", "product_name"),
            _top("aisle", "aisle_id", "aisle"),
            _top("department", "department_id", "department"),
        ]
    ),
    "kpi_summary": """
        SELECT o.*, i.*, b.*, total_orders / total_users AS avg_orders_per_user,
          total_orders - observed_baskets AS orders_without_observed_items,
          (SELECT count(*) FROM products) AS total_products, h.*, d.*, p.*, a.*
        FROM (SELECT count(*) AS total_orders, count(DISTINCT user_id) AS total_users,
                avg(days_since_prior_order) AS avg_days_between_orders,
                count(days_since_prior_order) AS days_between_orders_observations FROM shop_orders) o,
          (SELECT count(*) AS total_order_items, avg(reordered) AS reorder_rate FROM items) i,
          (SELECT count(*) AS observed_baskets, avg(basket_size) AS avg_basket_size,
             quantile_cont(basket_size, 0.5) AS median_basket_size,
             CAST(sum(basket_size) AS BIGINT) AS basket_item_total FROM product_baskets) b,
          (SELECT order_hour_of_day AS peak_hour, count(*) AS peak_hour_orders FROM shop_orders GROUP BY ALL
             ORDER BY peak_hour_orders DESC, peak_hour LIMIT 1) h,
          (SELECT order_dow AS peak_order_dow, count(*) AS peak_day_orders FROM shop_orders GROUP BY ALL
             ORDER BY peak_day_orders DESC, peak_order_dow LIMIT 1) d,
          (SELECT product_id AS most_purchased_product_id, product_name AS most_purchased_product_name,
             count(*) AS most_purchased_product_count FROM enriched GROUP BY ALL
             ORDER BY most_purchased_product_count DESC, product_id LIMIT 1) p,
          (SELECT aisle_id AS most_purchased_aisle_id, aisle AS most_purchased_aisle_name,
             count(*) AS most_purchased_aisle_count FROM enriched GROUP BY ALL
             ORDER BY most_purchased_aisle_count DESC, aisle_id LIMIT 1) a""",
    "layer_row_counts": " UNION ALL ".join(
        [
            _rows("silver", "orders", "orders", "shop_orders"),
            _rows("silver", "products", "part", "dim"),
            _rows("silver", "order_items", "split_items", "items"),
            _rows("silver", "order_items_enriched", "items", "enriched"),
            _rows("silver", "baskets", "items", "product_baskets"),
            _rows("gold", "training_baskets", "dept_baskets", "training"),
            _rows("gold", "association_rules", "rules", "final"),
            _rows("gold", "recommendation_lookup", "final", "(SELECT unnest(antecedent) FROM final)"),
            *[_rows("bronze", name, name, name) for name in ("orders", "lineitem", "part")],
        ]
    ),
    "training_baskets": f"SELECT order_id, user_id, {_text('items')} FROM training",
    "training_report": """
        SELECT count(*) AS source_baskets, count(*) FILTER (eval_set = 'prior') AS prior_baskets,
          count(*) FILTER (eval_set = 'prior' AND len(items) >= 2) AS training_baskets,
          prior_baskets - training_baskets AS excluded_baskets
        FROM dept_baskets JOIN shop_orders USING (order_id)""",
    "frequent_itemsets": f"SELECT {_text('items')}, freq FROM itemsets",
    "two_pass_itemsets": f"""
        SELECT {_text('items')}, count(*) AS freq FROM subsets GROUP BY ALL
        HAVING count(*) >= (SELECT ceil(CAST({min(LAYER_GRID.supports)} AS DOUBLE) * n) FROM n)""",
    "growth_caps": f"""
        SELECT 'itemsets' AS result, count(*) AS n, CAST({MAX_ITEMSETS} AS BIGINT) AS cap,
          count(*) <= {MAX_ITEMSETS} AS within FROM itemsets UNION ALL
        SELECT 'rules', count(*), CAST({MAX_RULES} AS BIGINT), count(*) <= {MAX_RULES} FROM rules""",
    "association_rules": f"SELECT {_text('antecedent', 'consequent')}, confidence, lift, support FROM rules",
    "useful_rules": f"SELECT {_text('antecedent', 'consequent')}, confidence, lift, support, rule_id FROM useful",
    "rule_metrics": f"""
        SELECT association_rules, {ROUND_METRICS}, rules_lift_gt_1 FROM (
          SELECT count(*) AS association_rules, avg(support) AS avg_support, avg(confidence) AS avg_confidence,
            avg(lift) AS avg_lift, quantile_cont(lift, 0.5) AS median_lift,
            count(*) FILTER (lift > 1) AS rules_lift_gt_1 FROM rules)""",
    "grid_metrics": f"""
        SELECT config_id, min_support, min_confidence, frequent_itemsets, association_rules, {ROUND_METRICS},
          rules_lift_gt_1, useful_rules, (SELECT n FROM n) AS training_baskets FROM rule_stats""",
    "config_rules": f"""
        SELECT config_id, {_text('antecedent', 'consequent')}, confidence, lift, support, rule_id FROM cell_rules""",
    "rule_names": f"SELECT rule_id, {_text('antecedent', 'antecedent_names', 'consequent_names')} FROM named",
    "lift_histogram": """
        SELECT lift_bin, '[' || power_text(lift_bin) || ', ' || power_text(lift_bin + 1) || ')' AS interval, count
        FROM (SELECT CAST(floor(log2(lift)) AS INTEGER) AS lift_bin, count(*) AS count FROM rules GROUP BY ALL)""",
    "confidence_lift_density": """
        SELECT floor(confidence * 20) / 20 AS confidence_bin, floor(log2(lift) * 4) / 4 AS log2_lift_bin,
          count(*) AS rule_count, round(pow(2.0, floor(log2(lift) * 4) / 4), 9) AS lift_bin
        FROM rules GROUP BY ALL""",
    "top_rules": """
        SELECT rank, rank || '. ' || label AS label, lift, support, confidence, rule_id
        FROM (SELECT *, CAST(row_number() OVER (ORDER BY lift DESC, support DESC, rule_id) AS INTEGER) AS rank
              FROM labels_of WHERE support >= 0.001)
        WHERE rank <= 20""",
    "filter_rules": """
        SELECT label, support, confidence, lift, rule_id FROM labels_of
        WHERE support >= 0.006 AND confidence >= 0.185 AND lift >= 1.05""",
    "rule_labels": "SELECT rule_id, label FROM labels_of",
    "latest_context": f"SELECT user_id, {_text('context_items')}, context_order_id, context_order_number FROM latest",
    "ground_truth": f"SELECT user_id, {_text('ground_truth')}, train_order_id, train_order_number FROM truth",
    "eval_contexts": f"SELECT * REPLACE ({_text('ground_truth', 'context_items')}) FROM contexts",
    "recommendation_lookup": f"""
        SELECT rule_id, {_text('antecedent', 'consequent')}, confidence, lift, support,
          {_text('antecedent_names', 'consequent_names')}, CAST(len(antecedent) AS INTEGER) AS antecedent_size,
          unnest(antecedent) AS antecedent_product_id, consequent[1] AS recommended_product_id FROM named""",
    "match_rules": """
        SELECT user_id, rule_id, product_id, string_agg(config_id, ',' ORDER BY config_id) AS config_ids
        FROM matches GROUP BY ALL""",
    "exclude_owned": """
        SELECT 'with' AS owned, count(*) AS matches, count(DISTINCT (user_id, product_id)) AS offers FROM all_met UNION ALL
        SELECT 'without', count(*), count(DISTINCT (user_id, product_id)) FROM all_met WHERE NOT is_owned""",
    "best_rule_per_product": "SELECT * FROM best",
    "recommend_topk": "SELECT * FROM topk",
    "coverage_hits": "SELECT * FROM coverage",
    "selection_score": """
        SELECT config_id, CASE WHEN mined THEN 'PASS' ELSE 'FAIL' END AS status, useful_rules,
          CASE WHEN mined THEN coalesce(coverage, 0) END AS coverage, CASE WHEN mined THEN coalesce(hitrate, 0) END AS hitrate,
          CASE WHEN mined THEN coalesce(conditional_hitrate, 0) END AS conditional_hitrate,
          CASE WHEN mined THEN round(selection_score, 9) END AS selection_score FROM scored""",
    "select_config": """
        SELECT config_id, min_support, min_confidence, round(selection_score, 9) AS selection_score FROM scored
        WHERE mined AND useful_rules > 0 AND coverage > 0
        ORDER BY scored.selection_score DESC, hitrate DESC, fit_seconds, min_support DESC, min_confidence DESC, config_id LIMIT 1""",
    "user_evaluation": f"""
        SELECT c.* REPLACE ({_text('ground_truth', 'context_items')}),
          coalesce(array_to_string(recommendations, ','), '') AS recommendations,
          recommendations IS NOT NULL AS covered,
          coalesce(list_has_any(recommendations, c.ground_truth), false) AS hit
        FROM contexts c LEFT JOIN (SELECT * FROM lists WHERE config_id = '{config_id(*FINAL)}') l USING (user_id)""",
    "recommend_baskets": "SELECT * FROM served",
    "popularity_fallback": "SELECT * FROM fallback",
    "serve_baskets": "SELECT * FROM served UNION ALL SELECT * FROM fallback",
    "showcase_baskets": f"""
        SELECT order_id, {_text('items')}, array_to_string(list(product_id ORDER BY rank), ',') AS recommendations
        FROM dept_baskets JOIN served USING (order_id) WHERE basket_size <= 10
        GROUP BY order_id, items, basket_size HAVING count(*) = 5 ORDER BY basket_size, order_id LIMIT 20""",
    "product_itemsets": f"SELECT {_text('items')}, freq FROM p_frequent",
    "product_rules": f"""
        SELECT {_text('antecedent', 'consequent')}, confidence, lift, support,
          {_text('antecedent_names', 'consequent_names')} FROM p_named""",
    "product_recommend": """
        SELECT order_id, rank, product_id, product_name, label AS source_rule, rule_id, confidence, lift, support
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY order_id
                ORDER BY confidence DESC, lift DESC, support DESC, product_id) AS INTEGER) AS rank
              FROM (SELECT b.order_id, r.*, r.consequent[1] AS product_id, row_number() OVER (
                        PARTITION BY b.order_id, r.consequent[1]
                        ORDER BY r.confidence DESC, r.lift DESC, r.support DESC, r.rule_id) AS place
                    FROM product_baskets b JOIN p_labels r
                    ON list_has_all(b.items, r.antecedent) AND NOT list_contains(b.items, r.consequent[1]))
              WHERE place = 1)
        JOIN products USING (product_id) WHERE rank <= 5""",
    "stream_windows": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total
        FROM events GROUP BY ALL""",
    "stream_late_rows": "SELECT count(*) AS arrived, count(*) AS counted, CAST(0 AS BIGINT) AS late FROM events",
    "stream_sessions": """
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS starts,
          strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS ends, count(*) AS n
        FROM (SELECT *, sum(CASE WHEN ts - before < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (
                PARTITION BY user_id ORDER BY ts, event_id) AS session
              FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))
        GROUP BY user_id, session
        HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    "sales_cube": """
        SELECT department_id, aisle_id, order_dow, CAST(grouping_id(department_id, aisle_id, order_dow) AS INTEGER) AS level,
          count(*) AS items, CAST(sum(reordered) AS BIGINT) AS reordered_items
        FROM items JOIN shop_orders USING (order_id) JOIN products USING (product_id)
        GROUP BY CUBE (department_id, aisle_id, order_dow)""",
    "asof_orders": """
        SELECT event_id, max((o_orderdate, o_orderkey))[2] AS order_id
        FROM events LEFT JOIN orders ON user_id = o_custkey AND o_orderdate <= ts GROUP BY event_id""",
    "events_after_orders": """
        SELECT o_orderkey AS order_id, event_id FROM orders JOIN events
        ON user_id = o_custkey AND ts >= o_orderdate AND ts < o_orderdate + INTERVAL 30 DAY""",
    "row_changes": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, CAST(sum(n) AS BIGINT) AS times
        FROM both_versions GROUP BY ALL HAVING sum(n) <> 0""",
    "key_changes": """
        SELECT l_orderkey, CASE WHEN min(times) > 0 THEN 'added' WHEN max(times) < 0 THEN 'removed' ELSE 'changed' END AS change
        FROM (SELECT * EXCLUDE (n), sum(n) AS times FROM both_versions GROUP BY ALL HAVING sum(n) <> 0) GROUP BY l_orderkey""",
    "distinct_users": "SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY event_type",
}
POWER_TEXT = "CASE WHEN {0} >= 0 THEN CAST(CAST(pow(2.0, {0}) AS BIGINT) AS VARCHAR) ELSE CAST(pow(2.0, {0}) AS VARCHAR) END"


def oracle() -> dict[str, str]:
    found = {}
    for name, body in BODIES.items():
        body = re.sub(r"power_text\(([^)]*)\)", lambda m: POWER_TEXT.format(f"({m[1]})"), body)
        found[name] = with_views(body)
    return found
