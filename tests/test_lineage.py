from __future__ import annotations

from collections import defaultdict

from custodia.operators import lineage
from tests.conftest import rows, scripts

CODE = '''"""spark.read.parquet("/doc")"""
# df.write.save("/comment")
a = (spark.read
     .option("x", "1")
     .format("csv")
     .load('/in/a'))
b = spark.table("db.b").select("email", 'name')
a.write.mode("append").partitionBy("email").saveAsTable("db.out")
b.writeTo("db.other")
'''


def test_endpoints(spark):
    star = 'spark.read.json("/j").select("*").write.parquet("/k")\n'
    found = rows(lineage.endpoints(scripts(spark, CODE, star, "x = 1\n", None, ""), "script_id"), "script_id")
    assert [r[0] for r in found] == [0, 1]
    assert (set(found[0][1]), set(found[0][2])) == ({"/in/a", "db.b"}, {"db.out", "db.other"})
    assert {"email", "name"} <= set(found[0][3]) and "db.b" not in found[0][3]
    assert found[1][1:] == (["/j"], ["/k"], ["*"])


def plain_closure(edges):
    named = {e for e in edges if e[0] != "*"}
    step = named | {(c, s, t) for c in {e[0] for e in named} for k, s, t in edges if k == "*"}
    onward = defaultdict(set)
    for c, s, t in step:
        onward[c, s].add(t)
    out = {}
    for c, s in list(onward):
        frontier, depth = {s}, 0
        while frontier:
            depth += 1
            frontier = {t for x in frontier for t in onward.get((c, x), ())} - {t for (k, o, t) in out if (k, o) == (c, s)}
            out.update({(c, s, t): depth for t in frontier})
    return sorted((*k, d) for k, d in out.items())


def test_closure_with_rings_and_stars(spark):
    edges = [("c", "a", "b"), ("c", "b", "d"), ("c", "d", "a"), ("e", "a", "z"), ("*", "z", "y"), ("*", "d", "y"), ("*", "y", "y"), ("f", "q", "r")]
    found = lineage.closure(spark.createDataFrame(edges, "column_name string, source string, sink string"))
    assert sorted(map(tuple, found.collect())) == plain_closure(edges)


def test_long_chain_and_nothing(spark):
    chain = [("c", f"t{i}", f"t{i + 1}") for i in range(12)]
    found = lineage.closure(spark.createDataFrame(chain, "column_name string, source string, sink string"))
    assert found.count() == 12 * 13 // 2 and found.agg({"distance": "max"}).first()[0] == 12
    assert lineage.column_lineage(scripts(spark, "x = 1\n"), "script_id").collect() == []
