"""What goes with a row: the closure of an erasure over declared foreign keys, of any depth, cycles included."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.session import fresh_path

DELETE, RETAIN = "delete", "retain"


@dataclass(frozen=True)
class ForeignKey:
    """child.column names parent.parent_column. With the action ``retain`` the child row stays, as in an append-only log."""

    child: str
    column: str
    parent: str
    parent_column: str
    action: str = DELETE


@dataclass(frozen=True)
class Table:
    rows: DataFrame
    key: tuple[str, ...]

    def row_key(self) -> Column:
        """The values of the key, each behind its length, so that no two keys read alike; a null is a lone dash."""
        if len(self.key) == 1:
            return F.col(self.key[0]).cast("string")
        texts = [F.col(c).cast("string") for c in self.key]
        return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _written(df: DataFrame) -> DataFrame:
    path = fresh_path(df.sparkSession, "erasure")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _in_order(tables: Mapping[str, Table], foreign_keys: Sequence[ForeignKey]) -> list[set[str]]:
    """The tables in groups, parents before children; those that name each other, over however many others, are one group."""
    above = {name: {k.parent for k in foreign_keys if k.child == name} for name in tables}
    for via in tables:
        for name in tables:
            if via in above[name]:
                above[name] |= above[via]
    groups: list[set[str]] = []
    for name in sorted(tables, key=lambda n: len(above[n] | {n})):
        if not any(name in g for g in groups):
            groups.append({name} | {other for other in above[name] if name in above[other]})
    return groups


def erasure_set(
    tables: Mapping[str, Table], foreign_keys: Sequence[ForeignKey], seeds: Mapping[str, DataFrame]
) -> DataFrame:
    """Rows (table_name, row_key, action, depth) that go with the seeds, each once; seeds have depth 0, others the least.

    ``seeds`` holds rows of the tables. Tables are taken parents first, so one that isn't in a ring of references is joined
    once with the rows that its foreign keys name, at all their depths. In a ring, a round joins the rows that the last one
    found with the children that name them and drops what is known; there are as many rounds as the longest
    chain of references in it has links. What is passed on is written to the shared folder, and only the depths it
    has reach the driver. A retained row passes nothing on, unless another way leads to its deletion. Null references name nothing.
    """
    referred = {name: sorted({k.parent_column for k in foreign_keys if k.parent == name}) for name in tables}

    def listed(name: str, rows: DataFrame, action: str, depth: Column) -> DataFrame:
        named = [F.col(c).alias(f"_refers_{c}") for c in referred[name]]
        return rows.select(tables[name].row_key().alias("row_key"), F.lit(action).alias("action"), *named, depth.alias("depth"))

    def children(k: ForeignKey, parents: DataFrame) -> DataFrame:
        """The child rows that name deleted ones of the parents, a level below the nearest."""
        named = parents.where(F.col("action") == DELETE).groupBy(F.col(f"_refers_{k.parent_column}").alias("_parent"))
        near = named.agg(F.min("depth").alias("_depth"))
        rows = tables[k.child].rows
        return listed(k.child, rows.join(near, rows[k.column] == near["_parent"]), k.action, F.col("_depth") + 1)

    def nearest(rows: DataFrame) -> DataFrame:
        """Of the hits of a row key those of the least depth, by action."""
        least = Window.partitionBy("row_key", "action")
        return rows.distinct().withColumn("_least", F.min("depth").over(least)).where("depth = _least").drop("_least")

    def in_ring(group: set[str], entering: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """All hits of the tables of a ring, by the depth at which they are found."""
        waiting = {name: _written(nearest(rows)) for name, rows in entering.items()}
        due = sorted({r["depth"] for rows in waiting.values() for r in rows.select("depth").distinct().collect()})
        known: dict[str, list[DataFrame]] = {name: [] for name in group}
        hits: dict[str, DataFrame] = {}
        depth = due[0] if due else 0
        while hits or due:
            if not hits:
                depth = due[0]
            if due and due[0] == depth:
                due.pop(0)
                for name, rows in waiting.items():
                    own = rows.where(F.col("depth") == depth)
                    hits[name] = hits[name].unionByName(own) if name in hits else own
            new: dict[str, DataFrame] = {}
            for name, rows in hits.items():
                fresh = rows.distinct()
                if known[name]:
                    # An action is new to a row if it isn't retained beside being deleted.
                    before = reduce(DataFrame.unionByName, known[name]).select(F.col("row_key").alias("_key"), F.col("action").alias("_action"))
                    same = fresh["row_key"].eqNullSafe(before["_key"]) & (
                        (before["_action"] == fresh["action"]) | (before["_action"] == DELETE)
                    )
                    fresh = fresh.join(before, same, "left_anti")
                fresh = _written(fresh)
                if fresh.limit(1).count():
                    known[name].append(fresh)
                    new[name] = fresh
            hits = {}
            for k in foreign_keys:
                if k.child in group and k.parent in new:
                    found = children(k, new[k.parent])
                    hits[k.child] = hits[k.child].unionByName(found) if k.child in hits else found
            depth += 1
        return {name: reduce(DataFrame.unionByName, rows) for name, rows in known.items() if rows}

    reached: dict[str, DataFrame] = {}
    for group in _in_order(tables, foreign_keys):
        entering = {name: listed(name, seeds[name], DELETE, F.lit(0)) for name in group if name in seeds}
        for k in foreign_keys:
            if k.child in group and k.parent not in group and k.parent in reached:
                found = children(k, reached[k.parent])
                entering[k.child] = entering[k.child].unionByName(found) if k.child in entering else found
        if any(k.child in group and k.parent in group for k in foreign_keys):
            reached.update(in_ring(group, entering))
        else:
            # What nothing refers to is read once, below; what is passed on is kept.
            reached.update({n: _written(nearest(rows)) if referred[n] else rows for n, rows in entering.items()})

    parts = [rows.select("row_key", "action", "depth", F.lit(name).alias("table_name")) for name, rows in reached.items()]
    if not parts:
        name, rows = next(iter(seeds.items()))
        parts = [listed(name, rows.limit(0), DELETE, F.lit(0)).select("row_key", "action", "depth", F.lit(name).alias("table_name"))]
    # "delete" is less than "retain": an action that deletes wins.
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("table_name", "row_key")
        .agg(F.min("action").alias("action"), F.min("depth").alias("depth"))
    )


def remaining(table: Table, name: str, erased: DataFrame) -> DataFrame:
    """The table's rows that the erasure leaves."""
    gone = erased.where((F.col("table_name") == name) & (F.col("action") == DELETE)).select(F.col("row_key").alias("_gone"))
    return table.rows.join(gone, table.row_key().eqNullSafe(gone["_gone"]), "left_anti")
