"""Queries over inferred schemas, synthetic rows, contracts, and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia import vocab
from custodia.functions import script as S
from custodia.operators import diff, synth
from custodia.operators import ordered_diff as ordered
from custodia.operators import reconcile as digest_tree
from custodia.operators import twin as twins
from custodia.plans.pii_queries import columns_sql
from custodia.plans.quality_queries import MERGED, UPDATES, customer_updates
from custodia.plans.registry import actual_type_sql, query, str_list
from custodia.session import fresh_path
from custodia.sources import writes
from custodia.sources.tables import SCHEMAS, Dataset
from custodia.sources.views import with_views


def type_sql(name: str, mode: str) -> str:
    branches = []
    for spark_type, words in vocab.TYPE_RULES:
        if mode == "reference":
            hit = " OR ".join(f"contains(lower({name}), '{w}')" for w in words)
        else:
            hit = f"list_has_any(string_split(lower({name}), '_'), {str_list([w.strip('_') for w in words])})"
        branches.append(f"WHEN {hit} THEN '{spark_type}'")
    return "CASE " + " ".join(branches) + " ELSE 'string' END"


@query(
    with_views(
        f"""
WITH named AS (SELECT script_id, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS position, unnest(cs) AS column_name
  FROM (SELECT script_id, {columns_sql('code')} AS cs FROM v_submissions)),
plain AS (SELECT script_id, p AS position, c AS column_name, t AS inferred_type
  FROM v_submissions, (VALUES {", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(vocab.DEFAULT_SCHEMA))}) AS d(p, c, t)
  WHERE script_id NOT IN (SELECT script_id FROM named))
SELECT 'token' AS mode, script_id, position, column_name, {type_sql('column_name', 'token')} AS inferred_type FROM named
UNION ALL
SELECT 'reference', script_id, position, column_name, {type_sql('column_name', 'reference')} FROM named
UNION ALL
SELECT m, plain.* FROM plain, (VALUES ('token'), ('reference')) AS modes(m)
""",
        "v_submissions",
    )
)
def infer_types(ds: Dataset) -> DataFrame:
    scripts = ds.view("v_submissions")
    return synth.infer_types(scripts, S.columns(F.col("code")), "script_id", modes=("token", "reference"))


def _fit_sql() -> str:
    parts = []
    for table, schema in SCHEMAS.items():
        for part in schema.split(","):
            c = part.strip().split(" ", 1)[0]
            t, actual = synth.type_by_name(c, "reference"), actual_type_sql(c)
            parts.append(
                f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{t}' AS inferred_type, {actual} AS actual_type, "
                f"'{t}' = {actual} AS same_type, count({c}) AS n_values FROM {table}"
            )
    return " UNION ALL ".join(parts)


@query(_fit_sql())
def infer_mismatch(ds: Dataset) -> DataFrame:
    """Inferred against the files' types of all tables, and the values each column holds."""
    parts = []
    for table in SCHEMAS:
        df = ds.as_written(table)
        parts.append(
            synth.type_fit(df, table, [(c, synth.type_by_name(c, "reference")) for c in df.columns])
        )
    return reduce(DataFrame.unionByName, parts)


@query(
    """
SELECT i + 1 AS c_custkey, 'synthetic_c_name_' || CAST(i AS STRING) AS c_name, CAST(i + 1 AS INTEGER) AS c_nationkey,
  i * CAST(1.5 AS DOUBLE) AS c_acctbal, 'synthetic_c_mktsegment_' || CAST(i AS STRING) AS c_mktsegment
FROM range((SELECT count(*) FROM customer)) AS r(i)
"""
)
def synthetic_rows(ds: Dataset) -> DataFrame:
    """A synthetic twin of the customer table: same schema, as many rows."""
    customer = ds.table("customer")
    schema = [(f.name, f.dataType.simpleString()) for f in customer.schema.fields]
    return synth.synthetic_rows(ds.spark, schema, customer.count())


@query(
    """
SELECT 'project' AS job, true AS passed, '' AS missing, '' AS wrong_type, '' AS runtime_error, '' AS error_message, count(*) AS rows_in, count(*) AS rows_out FROM lineitem
UNION ALL SELECT 'totals', false, 'currency', 'total', '', '', count(*), count(*) FROM lineitem
"""
)
def contract_check(ds: Dataset) -> DataFrame:
    """Two jobs on synthetic twins of the lines: one keeps its contract, one does not."""
    lines = ds.table("lineitem")
    schema = [(f.name, f.dataType.simpleString()) for f in lines.schema.fields]
    n = lines.count()

    def totals(df: DataFrame) -> DataFrame:
        return df.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"))

    contract = [("l_orderkey", "bigint"), ("total", "decimal(18,2)"), ("currency", "string")]
    kept = synth.contract_check(
        ds.spark,
        "project",
        lambda df: df.select("l_orderkey", "l_tax"),
        schema,
        n,
        [("l_orderkey", "bigint"), ("l_tax", "double")],
    )
    broken = synth.contract_check(ds.spark, "totals", totals, schema, n, contract)
    return kept.unionByName(broken)


# Versions with what a regular corpus lacks: repeated subjects, lines in another order, a closing break gone,
# an empty new text, subjects on one side only.
V_OLD = """
SELECT script_id, code FROM v_scripts WHERE script_id % 16 <> 5
UNION ALL SELECT script_id, code || '# second copy' || chr(10) FROM v_scripts WHERE script_id % 9 = 4
UNION ALL SELECT script_id, code FROM v_scripts WHERE script_id % 27 = 4
"""
V_NEW = r"""
SELECT script_id, CASE script_id % 8 WHEN 1 THEN regexp_replace(code, '^([^\n]*)\n([^\n]*)\n', '\2' || chr(10) || '\1' || chr(10))
    WHEN 3 THEN substr(code, 1, length(code) - 1) WHEN 6 THEN '' ELSE code END AS code
FROM v_scripts_v2 WHERE script_id % 16 <> 7
"""


def versions(ds: Dataset) -> tuple[DataFrame, DataFrame]:
    scripts, key, code = ds.view("v_scripts"), F.col("script_id"), F.col("code")
    old = (
        scripts.where(key % 16 != 5)
        .unionByName(scripts.where(key % 9 == 4).withColumn("code", F.concat(code, F.lit("# second copy\n"))))
        .unionByName(scripts.where(key % 27 == 4))
    )
    new = ds.view("v_scripts_v2").where(key % 16 != 7).select(
        "script_id",
        F.when(key % 8 == 1, F.regexp_replace(code, r"^([^\n]*)\n([^\n]*)\n", "$2\n$1\n"))
        .when(key % 8 == 3, F.expr("substr(code, 1, length(code) - 1)"))
        .when(key % 8 == 6, "")
        .otherwise(code)
        .alias("code"),
    )
    return old, new


LINES = r"CASE WHEN {c} = '' THEN CAST([] AS STRING[]) ELSE string_split(regexp_replace({c}, '\n$', ''), chr(10)) END"

CHANGES = f"""
WITH v_old AS ({V_OLD}), v_new AS ({V_NEW}),
texts AS (SELECT script_id, code, sum(o) AS o, sum(n) AS n FROM (SELECT script_id, code, 1 AS o, 0 AS n FROM v_old
    UNION ALL SELECT script_id, code, 0, 1 FROM v_new) GROUP BY ALL),
subjects AS (SELECT script_id, bool_or(o <> n) AND bool_or(n > 0 AND code <> '') AS changed FROM texts GROUP BY 1),
signed AS (
  SELECT script_id, unnest({LINES.format(c='code')}) AS line, 1 AS sign FROM v_new
  UNION ALL SELECT script_id, unnest({LINES.format(c='code')}), -1 FROM v_old),
net AS (SELECT script_id, line, CAST(sum(sign) AS BIGINT) AS net FROM signed JOIN subjects USING (script_id) WHERE changed GROUP BY ALL)
"""


@query(
    with_views(
        f"{CHANGES} SELECT script_id, CASE WHEN net > 0 THEN 'added' ELSE 'removed' END AS change, line, abs(net) AS n FROM net WHERE net <> 0",
        "v_scripts",
        "v_scripts_v2",
    )
)
def line_diff(ds: Dataset) -> DataFrame:
    return diff.line_diff(*versions(ds), "script_id", "code")


@query(
    with_views(
        f"""
{CHANGES} SELECT script_id, CAST(coalesce(sum(greatest(net, 0)), 0) AS BIGINT) AS added,
  CAST(coalesce(sum(greatest(-net, 0)), 0) AS BIGINT) AS removed, changed
FROM subjects LEFT JOIN net USING (script_id) GROUP BY script_id, changed
""",
        "v_scripts",
        "v_scripts_v2",
    )
)
def diff_counts(ds: Dataset) -> DataFrame:
    return diff.diff_counts(*versions(ds), "script_id", "code")


# Every line of these scripts is there once, so the lines that stay are a longest rising run of the common ones' places.
ORDERED = rf"""
WITH v_old AS ({V_OLD}), v_new AS ({V_NEW}),
pairs AS (
  SELECT script_id, regexp_extract_all(coalesce(any_value(o), ''), '[^\n]*\n|[^\n]+') AS o, regexp_extract_all(any_value(n), '[^\n]*\n|[^\n]+') AS n
  FROM (SELECT script_id, code AS o, NULL AS n FROM v_old UNION ALL SELECT script_id, NULL, code FROM v_new)
  GROUP BY script_id HAVING count(o) <= 1 AND count(n) = 1 AND any_value(n) <> '' AND coalesce(any_value(o), '') <> any_value(n)
), o AS (SELECT script_id, unnest(range(1, len(o) + 1)) AS i, unnest(o) AS line FROM pairs),
n AS (SELECT script_id, unnest(range(1, len(n) + 1)) AS j, unnest(n) AS line FROM pairs),
common AS (SELECT script_id, list([{{'v': j, 'i': i, 'size': 1}}] ORDER BY i) AS run FROM o JOIN n USING (script_id, line) GROUP BY script_id),
sized AS (
  SELECT script_id, list_reduce(run, lambda acc, x: list_append(acc, {{'v': x[1].v, 'i': x[1].i,
    'size': CAST(1 + coalesce(list_max(list_transform(list_filter(acc, lambda a: a.v < x[1].v), lambda a: a.size)), 0) AS INTEGER)}})) AS run FROM common
), traced AS (
  SELECT script_id, list_reduce(
    list_concat([[{{'v': CAST(0 AS BIGINT), 'i': CAST(1000000 AS BIGINT), 'size': 0}}]],
      list_transform(range(list_max(list_transform(run, lambda a: a.size)), 0, -1), lambda k: [{{'v': CAST(0 AS BIGINT), 'i': CAST(0 AS BIGINT), 'size': CAST(k AS INTEGER)}}])),
    lambda acc, x: list_append(acc, list_sort(list_filter(run, lambda a: a.size = x[1].size AND a.i < acc[len(acc)].i))[1])) AS kept FROM sized
), kept AS (SELECT script_id, x.i, x.v AS j FROM (SELECT script_id, unnest(kept[2:]) AS x FROM traced)),
steps AS (
  SELECT script_id, ' ' AS kind, line, row_number() OVER (PARTITION BY script_id ORDER BY i) AS g, 0 AS phase, i AS pos FROM o JOIN kept USING (script_id, i)
  UNION ALL SELECT script_id, '-', line, (SELECT count(*) FROM kept k WHERE k.script_id = o.script_id AND k.i < o.i), 1, i FROM o ANTI JOIN kept USING (script_id, i)
  UNION ALL SELECT script_id, '+', line, (SELECT count(*) FROM kept k WHERE k.script_id = n.script_id AND k.j < n.j), 2, j FROM n ANTI JOIN kept USING (script_id, j)
), placed AS (
  SELECT *, row_number() OVER w AS place, count(*) FILTER (WHERE kind <> '+') OVER w AS old_no, count(*) FILTER (WHERE kind <> '-') OVER w AS new_no
  FROM steps WINDOW w AS (PARTITION BY script_id ORDER BY g, phase, pos)
), near AS (
  SELECT p.* FROM placed p WHERE EXISTS (SELECT 1 FROM placed c WHERE c.script_id = p.script_id AND c.kind <> ' ' AND abs(c.place - p.place) <= 3)
), hunks AS (
  SELECT *, sum(CASE WHEN place - before = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY script_id ORDER BY place) AS hunk
  FROM (SELECT *, lag(place) OVER (PARTITION BY script_id ORDER BY place) AS before FROM near)
)
SELECT script_id, CAST(hunk AS INTEGER) AS hunk,
  '@@ -' || CASE WHEN count(*) FILTER (WHERE kind <> '+') = 0 THEN min(old_no) ELSE min(old_no) FILTER (WHERE kind <> '+') END || ',' || count(*) FILTER (WHERE kind <> '+')
  || ' +' || CASE WHEN count(*) FILTER (WHERE kind <> '-') = 0 THEN min(new_no) ELSE min(new_no) FILTER (WHERE kind <> '-') END || ',' || count(*) FILTER (WHERE kind <> '-') || ' @@' AS header,
  string_agg(kind || CASE WHEN ends_with(line, chr(10)) THEN line ELSE line || chr(10) || chr(92) || ' No newline at end of file' || chr(10) END, '' ORDER BY place) AS body
FROM hunks GROUP BY script_id, hunk"""


@query(with_views(ORDERED, "v_scripts", "v_scripts_v2"))
def ordered_diff(ds: Dataset) -> DataFrame:
    found = ordered.hunks(*versions(ds), "script_id", "code")
    return found.select("script_id", "hunk", "header", "body")


@query(
    f"""
WITH updates AS ({UPDATES.format(customer='customer')}), merged AS ({MERGED}),
new AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 1000000000000 ELSE c_custkey END AS c_custkey, c_name FROM merged),
o AS (SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name || '?' FROM customer WHERE c_custkey % 33 = 0),
n2 AS (SELECT * FROM new UNION ALL SELECT * FROM new WHERE c_custkey % 10 = 3),
ko AS (SELECT c_custkey, count(DISTINCT c_name) AS d, min(c_name) AS c_name FROM o GROUP BY 1),
kn AS (SELECT c_custkey, count(DISTINCT c_name) AS d, min(c_name) AS c_name FROM n2 GROUP BY 1)
SELECT coalesce(ko.c_custkey, kn.c_custkey) AS c_custkey,
  CASE WHEN ko.d > 1 OR kn.d > 1 THEN 'repeated' WHEN ko.c_custkey IS NULL THEN 'added' WHEN kn.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN ko.d = 1 AND kn.d = 1 THEN 'c_name' END AS columns
FROM ko FULL JOIN kn ON ko.c_custkey = kn.c_custkey
WHERE ko.d > 1 OR kn.d > 1 OR ko.c_custkey IS NULL OR kn.c_custkey IS NULL OR ko.c_name <> kn.c_name
"""
)
def keyed_diff(ds: Dataset) -> DataFrame:
    """The customers against their merged version, in which some have moved to other keys.

    Some old keys come twice with different rows, some new ones twice with equal rows.
    """
    customer, key = ds.table("customer"), F.col("c_custkey")
    merged = writes.merge_upsert(customer, customer_updates(ds), ["c_custkey"], [F.desc("v")])
    moved = merged.withColumn("c_custkey", F.when(key % 7 == 0, key + 1_000_000_000_000).otherwise(key))
    other = customer.where(key % 33 == 0).withColumn("c_name", F.concat("c_name", F.lit("?")))
    return diff.keyed_diff(customer.unionByName(other), moved.unionByName(moved.where(key % 10 == 3)), ["c_custkey"])


@query(
    with_views(
        """
SELECT * EXCLUDE (l, r), CASE WHEN l > r THEN 'left' ELSE 'right' END AS only_in, CAST(abs(l - r) AS BIGINT) AS copies
FROM (SELECT * EXCLUDE (l, r), sum(l) AS l, sum(r) AS r
      FROM (SELECT *, 1 AS l, 0 AS r FROM v_artifacts
            UNION ALL SELECT * REPLACE (CASE WHEN part_no % 13 = 0 THEN 'zip' ELSE artifact_type END AS artifact_type,
                CASE WHEN part_no % 17 = 0 THEN content || '!' ELSE content END AS content,
                CASE WHEN part_no % 19 = 0 THEN NULL ELSE created_at END AS created_at), 0, 1 FROM v_artifacts)
      GROUP BY ALL) WHERE l <> r
""",
        "v_artifacts",
    )
)
def table_diff(ds: Dataset) -> DataFrame:
    artifacts = ds.view("v_artifacts")
    part = F.col("part_no")
    right = artifacts.withColumns(
        {
            "artifact_type": F.when(part % 13 == 0, "zip").otherwise(F.col("artifact_type")),
            "content": F.when(part % 17 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")),
            "created_at": F.when(part % 19 != 0, F.col("created_at")),
        }
    )
    return diff.table_diff(artifacts, right)


REVISED_ORDERS = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 997 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 499 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 601 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM {orders} WHERE o_orderkey % 1009 <> 0
UNION ALL SELECT o_orderkey + 1000000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 811 = 0
"""


@query(
    f"""
WITH revised AS ({REVISED_ORDERS.format(orders='orders')})
SELECT coalesce(o.o_orderkey, r.o_orderkey) AS o_orderkey,
  CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN r.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN o.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL THEN concat_ws(',',
    CASE WHEN o.o_orderstatus IS DISTINCT FROM r.o_orderstatus THEN 'o_orderstatus' END,
    CASE WHEN o.o_totalprice IS DISTINCT FROM r.o_totalprice THEN 'o_totalprice' END,
    CASE WHEN o.o_orderpriority IS DISTINCT FROM r.o_orderpriority THEN 'o_orderpriority' END) END AS columns
FROM orders o FULL JOIN revised r ON o.o_orderkey = r.o_orderkey
WHERE o IS DISTINCT FROM r
"""
)
def reconcile(ds: Dataset) -> DataFrame:
    """Two written versions of the orders: folders whose digests are equal aren't read."""
    orders = ds.table("orders")
    paths = [fresh_path(ds.spark, "orders-version") for _ in range(2)]
    for path, version in zip(paths, (orders, ds.spark.sql(REVISED_ORDERS, orders=orders)), strict=True):
        digest_tree.write_digested(version, path, ["o_orderkey"])
    return digest_tree.reconcile_written(ds.spark, *paths, ["o_orderkey"])


TWIN_KEYS = {"c_custkey": "customer", "o_custkey": "customer", "o_orderkey": "order", "l_orderkey": "order", "c_nationkey": "nation"}


@query(
    """
SELECT 'customers with orders' AS measure, count(DISTINCT c_custkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey
UNION ALL SELECT 'customer rows joined', count(*) FROM customer JOIN orders ON c_custkey = o_custkey
UNION ALL SELECT 'order rows joined', count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT 'most lines of an order', max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)
UNION ALL SELECT 'keys that stay', 0
UNION ALL SELECT 'quantiles beyond the error of drawing', 0
"""
)
def synthetic_twin(ds: Dataset) -> DataFrame:
    """Customers, orders and lines as twins: they join like the originals, and prices keep their quantiles."""
    identities = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
    tables = {t: ds.table(t) for t in identities}
    made = {
        t: twins.twin(df, identities[t], {c: d for c, d in TWIN_KEYS.items() if c in df.columns}, "a secret") for t, df in tables.items()
    }
    customer, orders, lines = made.values()
    buyers = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"))

    def measure(name: str, df: DataFrame, value) -> DataFrame:
        return df.agg(value.cast("bigint").alias("n")).select(F.lit(name).alias("measure"), "n")

    shares, fine = [0.1, 0.25, 0.5, 0.75, 0.9], [k / 200 for k in range(201)]

    def quantiles(df: DataFrame, side: str, at: list[float]) -> DataFrame:
        table = F.percentile_approx("o_totalprice", F.array(*map(F.lit, at)), 10_000)
        return df.agg(table.alias("q"), F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))

    sides = quantiles(orders, "twin", shares).unionByName(quantiles(tables["orders"], "real", fine))
    both = sides.agg(*[F.max(F.when(F.col("side") == side, F.col("q"))).alias(side) for side in ("twin", "real")], F.max("n").alias("n"))
    # Where the twin's quantile lies among the real values, but for four times the error of drawing that many.
    ranks = F.transform("twin", lambda v: F.size(F.filter("real", lambda x: x <= v)) / len(fine))
    off = F.zip_with(ranks, F.array(*map(F.lit, shares)), lambda r, q: F.abs(r - q))
    far = F.filter(off, lambda d: d > 0.02 + 2 / F.sqrt(F.col("n")))
    parts = [
        measure("customers with orders", buyers, F.count_distinct("c_custkey")),
        measure("customer rows joined", buyers, F.count(F.lit(1))),
        measure("order rows joined", orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")), F.count(F.lit(1))),
        measure("most lines of an order", lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k")), F.max("k")),
        measure("keys that stay", orders.join(tables["orders"].select("o_orderkey"), "o_orderkey", "left_semi"), F.count(F.lit(1))),
        both.select(F.lit("quantiles beyond the error of drawing").alias("measure"), F.size(far).cast("bigint").alias("n")),
    ]
    return reduce(DataFrame.unionByName, parts)
