"""Helpers shared by the operators: lineage cuts, sorted-group iteration, unions."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as a word everywhere in this package: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a local one only where it is unset."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        jvm_dir = sc._jsc.sc().getCheckpointDir()
        if not jvm_dir.isDefined() and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = jvm_dir.get() if jvm_dir.isDefined() else tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(there)
    return there


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Compute df once: write it to a table in the shared folder and read it back.

    Unlike checkpoint() this forgets the plan's estimated sizes, which in loops
    of joins grow without bound; the files' own size takes their place.
    ``instead_of``: the table of the round before, which nothing reads any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if instead_of is not None:
        forget(instead_of)
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete the folders of tables from ``cut`` that nothing reads any more: all that was made from them has been written."""
    for t in tables:
        if path := getattr(t, "_cut_path", None):
            sc = t.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def many(df: DataFrame, least: int = 1) -> int:
    """Partitions for an exchange: the session's number of shuffle partitions."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows of an Arrow batch at most: Spark's 10,000 whole texts take hundreds of MB at both ends of the pipe.
ROWS_AT_ONCE = 1000


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver was started from elsewhere, and keep Arrow batches of whole texts small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ROWS_AT_ONCE:
        spark.conf.set(rows, ROWS_AT_ONCE)
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (top, env.get("PYTHONPATH"))))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly where there are fewer partitions than the cluster can work on."""
    ship(df.sparkSession)
    sc = df.sparkSession.sparkContext
    return df if df.rdd.getNumPartitions() >= sc.defaultParallelism else df.repartition(sc.defaultParallelism)


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or a field of a struct column where the name says ``column.field``."""
    if name in batch.schema.names:
        return batch.column(name)
    column, _, rest = name.partition(".")
    return pc.struct_field(batch.column(column), rest)


def grouped(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key side by side in one partition: the form that ``whole_groups`` reads."""
    ship(df.sparkSession)
    return df.repartition(many(df), key).sortWithinPartitions(key)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, least: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of about ``least`` rows that never part the rows of one key (input sorted by key)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        last = held[-1].column(key)[held[-1].num_rows - 1]
        t = pa.Table.from_batches(held)
        keys = t.column(key).to_numpy()
        start = int(np.searchsorted(keys, last.as_py(), side="left"))
        if start:
            yield t.slice(0, start)
            held = t.slice(start).combine_chunks().to_batches()
            rows = sum(b.num_rows for b in held)
    if rows:
        yield pa.Table.from_batches(held)


def group_numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the number of each row's group, and each group's first row."""
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.cumsum(new) - 1, np.flatnonzero(new)


def unions(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the links a-b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        la, lb = la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = label[label]
            if np.array_equal(nxt, label):
                break
            label = nxt


def most_alone(rows: DataFrame, total: int) -> int:
    """How many of the ``total`` rows one key may bring to a task: a quarter of a partition's mean, 256 at least."""
    return max(256, total // (4 * many(rows)))


def join_counted(rows: DataFrame, counted: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with ``counted``, a stored table that has one row per key and in ``n`` how many of the ``total`` rows (or more) bear it.

    A key with over ``most_alone`` rows isn't dealt to one task: there are at most
    4 x partitions of them, so that they are broadcast and their rows stay where they are.
    Where there is none, the plan is one join.
    """
    most = most_alone(rows, total)
    if counted.filter(F.col("n") > most).isEmpty():
        return rows.join(counted.drop("n"), key)
    hot = F.broadcast(counted.filter(F.col("n") > most).drop("n"))
    rest = counted.filter(F.col("n") <= most).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def beside_least(rows: DataFrame, total: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """rows (a, b) with m, the least of a and of all b that rows hold for that a; ``most``: rows of the most frequent a.

    Usually one exchange and a window. With keys too frequent for a task it is a join with the stored minima, which are returned to be deleted then.
    """
    if most <= most_alone(rows, total):
        return rows.withColumn("m", F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))), None
    least = cut(rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
    return join_counted(rows, least, "a", total), least


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b); root is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014),
    each a group minimum beside the group's rows. A round's links are written to the shared folder.
    Rounds are logarithmic in the number of nodes, and links never leave the
    cluster: the driver sees counts and a checksum.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = large = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        now = both.groupBy("a").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("s")).agg(F.sum("n").alias("n"), F.expr("bit_xor(s)").alias("s"), F.max("n").alias("most")).first()
        if not now["n"] or now == was:
            forget(large)
            return edges.selectExpr("a AS node", "b AS root")
        was = now
        found, least = beside_least(both, now["n"], now["most"])
        large = cut(found.filter("b > a").selectExpr("b AS a", "m AS b").distinct(), large)
        forget(least)
        there = large.groupBy("a").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
        found, least = beside_least(large, there["n"], there["most"])
        small = found.selectExpr("inline(array(named_struct('a', b, 'b', m), named_struct('a', a, 'b', m)))")
        edges = cut(small.filter("a <> b").distinct(), edges)
        forget(least)
    raise RuntimeError("links did not settle")


def linked(rows: DataFrame, alike, most: int) -> DataFrame:
    """(node, root) of what ``alike`` links, directly or through others, among the rows of each key; root is the smallest node.

    rows: key, node (once a key), and the columns that ``alike(table)`` reads; it
    returns a function that confirms pairs (i, j) of the table's row numbers.
    A task compares about ``most`` rows at once, whatever a key holds: a larger key is dealt
    into blocks that all get its first row. Where a key's blocks don't
    join into one component, every row outside its largest component then meets every
    other row, block by block, so no pair that could join two components is left out.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    large = cut(sizes.filter(F.col("n") > most))
    if large.isEmpty():
        return components(linked_blocks(rows.withColumn("label", F.col("node")), alike))
    half = max(1, most // 2)
    members = rows.join(large, "key")
    dealt = members.withColumn("part", F.expr(f"explode(IF(node = first, sequence(0L, n DIV {half}), array(pmod(xxhash64(node, key), n DIV {half} + 1))))"))
    dealt = dealt.withColumn("key", F.expr("xxhash64(key, part)")).drop("n", "first", "part")
    once = rows.join(large.select("key"), "key", "left_anti").unionByName(dealt).withColumn("label", F.col("node"))
    roots = cut(components(linked_blocks(once, alike)))
    placed = cut(members.select("key", "node", "n").join(roots, "node", "left").selectExpr("key", "node", "n", "coalesce(root, node) AS label"))
    counts = placed.groupBy("key", "label").agg(F.count("*").alias("c"))
    open_ = counts.groupBy("key").agg(F.expr("max_by(label, struct(c, label))").alias("main"), F.sum("c").alias("all"), F.max("c").alias("c")).filter("c < all").selectExpr("key", "main", "all - c AS others")
    open_ = cut(open_)
    if open_.isEmpty():
        forget(large, placed, open_)
        return roots
    met = placed.join(open_, "key").withColumn("i", F.expr(f"pmod(xxhash64(node, key, 1), others DIV {half} + 1)")).withColumn("j", F.expr(f"pmod(xxhash64(node, key, 2), n DIV {half} + 1)"))
    everyone = met.withColumn("i", F.expr(f"explode(sequence(0L, others DIV {half}))"))
    others = met.filter("label <> main").withColumn("j", F.expr(f"explode(sequence(0L, n DIV {half}))"))
    blocks = everyone.unionByName(others).selectExpr("key", "node", "label", "xxhash64(key, i, j) AS block").distinct()
    again = rows.join(blocks, ["key", "node"]).withColumn("key", F.col("block")).drop("block")
    out = components(roots.selectExpr("node AS a", "root AS b").unionByName(linked_blocks(again, alike)))
    forget(large, placed, open_, roots)
    return out


def linked_blocks(rows: DataFrame, alike, at_once: int = 1 << 16) -> DataFrame:
    """Links (a, b) that join what is alike in each key, as a spanning forest; pairs of one label are joined already.

    Pairs are made and compared ``at_once`` at a time: first every row with its key's first, then all that is not joined yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", 1 << 14):
            key = t.column("key").to_numpy()
            group, _ = group_numbers(key)
            several = np.flatnonzero(np.bincount(group)[group] > 1)
            if not several.size:
                continue
            t = t.take(several)
            group, root = group_numbers(key[several])
            node, n = t.column("node").to_numpy(), len(group)
            test, label = alike(t), np.arange(n)

            def join(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
                return unions(n, label[i], label[j])[label]

            for same in (t.column("label").to_numpy(), node):
                _, first, inverse = np.unique(same, return_index=True, return_inverse=True)
                label = join(np.arange(n), first[inverse], label)

            def compare(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                if not i.size:
                    return label
                ok = test(i, j)
                return join(i[ok], j[ok], label)

            for at in range(0, n, at_once):
                i = np.arange(at, min(n, at + at_once))
                label = compare(i, root[group[i]], label)
            apart = np.minimum.reduceat(label, root) != np.maximum.reduceat(label, root)
            before = np.where(apart[group], np.arange(n) - root[group], 0)
            ends = np.cumsum(before)
            s = 0
            while s < n:
                done = ends[s - 1] if s else 0
                e = max(s + 1, int(np.searchsorted(ends, done + at_once, side="right")))
                count = before[s:e]
                i = np.repeat(np.arange(s, e), count)
                j = root[group[i]] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
                for at in range(0, len(i), at_once):
                    label = compare(i[at : at + at_once], j[at : at + at_once], label)
                s = e
            least = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(least, label, np.minimum(node, t.column("label").to_numpy()))
            least = least[label]
            own = least != node
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(least[own])], names=["a", "b"])

    return grouped(rows, "key").mapInArrow(run, "a long, b long")
