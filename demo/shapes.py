"""Q01-Q25: the statement shapes of the evaluated workload, on the star schema, as plain Spark SQL."""

from pyspark.sql import functions as F

from demo.registry import query
from sqlcurate.operators.questions import not_in
from sqlcurate.sources.readers import register_database

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

# Name -> statement. The DuckDB statement is the same unless given in DUCK.
SHAPES = {
    "q01_project": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "q01_select_star": "SELECT * FROM customer",
    "q02_compare": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment != 'BUILDING'",
    "q03_and_or_between": """
        SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
        WHERE (l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R') OR l_discount > 0.09""",
    "q04_like": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%Ring%'",
    "q05_join": """
        SELECT o_orderkey, c_name FROM orders AS a JOIN customer AS b ON a.o_custkey = b.c_custkey WHERE a.o_orderstatus = 'P'""",
    "q06_join_three": """
        SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'""",
    "q06_join_five": """
        SELECT r_name, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "q07_self_join": """
        SELECT a.l_orderkey, count(*) AS n_pairs FROM lineitem AS a JOIN lineitem AS b
        ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_suppkey GROUP BY a.l_orderkey""",
    "q08_join_without_on": """
        SELECT DISTINCT s_name, n_name FROM supplier JOIN nation WHERE s_nationkey = n_nationkey
        AND s_acctbal < (SELECT avg(s_acctbal) FROM supplier)""",
    "q09_global_aggregate": "SELECT count(*) AS n, min(l_shipdate) AS first_ship, max(l_quantity) AS most FROM lineitem",
    "q10_aggregates": """
        SELECT count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total, round(avg(l_quantity), 6) AS mean, min(l_partkey) AS low, max(l_partkey) AS high
        FROM lineitem""",
    "q11_count_distinct": "SELECT count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem",
    "q12_group_by": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey",
    "q13_having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500",
    "q14_order_by": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
    "q15_order_by_aggregate": """
        SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY count(*) DESC, l_partkey""",
    "q16_top_one": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1",
    "q16_top_n": """
        SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 10""",
    "q17_distinct": "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem",
    "q18_union": """
        SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000""",
    "q19_intersect": """
        SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'""",
    "q20_except": """
        SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000""",
    "q21_in": "SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)",
    "q22_not_in": """
        SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
            (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000)
        AND (SELECT count(*) FROM orders WHERE o_custkey IS NULL AND o_orderstatus = 'F' AND o_totalprice > 200000) = 0""",
    "q22_not_in_literal": """
        SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN
            (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)""",
    "q23_scalar_subquery": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "q24_derived_table": """
        SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
        INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS both_states""",
    "q25_bare_column": """
        SELECT any_value(c_name) AS c_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey""",
    "q25_bare_beside_max": """
        SELECT max(o_orderkey) AS last_order, max_by(o_custkey, o_orderkey) AS last_customer, min_by(o_custkey, o_orderkey) AS first_customer FROM orders""",
}


def _shape(sql):
    return lambda spark, sf: register_database(spark, sf, TABLES).sql(sql)


# DuckDB wants a comma where Spark accepts a join without a condition.
DUCK = {"q08_join_without_on": SHAPES["q08_join_without_on"].replace("supplier JOIN nation", "supplier, nation")}

for _name, _sql in SHAPES.items():
    query(_name, DUCK.get(_name, _sql))(_shape(_sql))


NOT_IN = """
    SELECT 'plain' AS others, count(*) AS n FROM lineitem WHERE nullif(l_partkey % 5000, 7) NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)
    UNION ALL SELECT 'with null', count(*) FROM lineitem WHERE nullif(l_partkey % 5000, 7) NOT IN (SELECT nullif(o_custkey, 3) FROM orders)
    UNION ALL SELECT 'none', count(*) FROM lineitem WHERE nullif(l_partkey % 5000, 7) NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 0)"""


@query("q22_not_in_large", NOT_IN)
def q22_large(spark, sf):
    """NOT IN with nulls on either side, and without broadcasting the subquery."""
    lines, orders = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("lineitem", "orders"))
    keyed = lines.select(F.nullif(F.col("l_partkey") % 5000, F.lit(7)).alias("key"))
    others = {
        "plain": orders.filter("o_totalprice > 100000").select("o_custkey"),
        "with null": orders.select(F.nullif("o_custkey", F.lit(3))),
        "none": orders.filter("o_totalprice < 0").select("o_custkey"),
    }
    parts = [not_in(keyed, "key", some).agg(F.count("*").alias("n")).select(F.lit(name).alias("others"), "n") for name, some in others.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
