"""Merkle manifest of a dataset, climbed by a recursive query.

Each row is a leaf. The leaves of one group stand in the order of their key; every ``FANOUT`` consecutive nodes
become their hash until one is left, the group's subroot; the subroots, in the order of the groups, become the
root in the same way. The levels are built one after the other and written as node rows: a row holds the digests
of its run of children, end to end, and the link to the run that it belongs to itself.

A proof climbs those rows: a recursive query starts at every leaf with the hash of what is there now, joins the run
that its link names, appends the run's other digests (a row for each level) and folds the hash into the run's place.
The climb ends at the root, whose link is null. Upper runs are met by many leaves, so their rows are repeated under
salts, never more often than a run has leaves, and no task receives all leaves of a group.

``H`` is the lowercase hex SHA-256 of its inputs end to end, digests as hex text; tables hold digests as 32 bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.llm.tables import small_side
from riskweave.operators.ranks import join_null_safe
from riskweave.session import materialise

FANOUT = 8
#: Leaves that meet one copy of a run; copies are shuffled at every level of the climb, so they should be few.
SHARED = 512
#: Number of the tree above the groups' trees, which are numbered from 0.
TOP = -1

CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree, idx, 0 AS step, folded, CAST('' AS BINARY) AS siblings, key, leaf, up_tree, up_level, up_idx, up_pos,
    CAST(pmod(xxhash64(tree, idx), up_salts) AS INT) AS salt
  FROM {leaves}
  UNION ALL
  SELECT c.tree, c.idx, c.step + 1,
    unhex(sha2(lower(hex(concat(substring(r.children, 1, 32 * c.up_pos), c.folded, substring(r.children, 32 * c.up_pos + 33)))), 256)),
    concat(substring(r.children, 1, 32 * c.up_pos), substring(r.children, 32 * c.up_pos + 33)),
    CAST(NULL AS {type}), CAST(NULL AS BINARY), r.up_tree, r.up_level, r.up_idx, r.up_pos,
    CAST(pmod(xxhash64(c.tree, c.idx), r.up_salts) AS INT)
  FROM climb c JOIN {runs} r ON c.up_tree = r.at_tree AND c.up_level = r.at_level AND c.up_idx = r.at_idx AND c.salt = r.at_salt
)
SELECT tree, idx, step, folded, siblings, key, leaf FROM climb
"""


def digest(*parts: Column) -> Column:
    """Binary SHA-256 of strings end to end."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_text(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def field(value: Column) -> Column:
    """A value as hashed into a leaf: ``-`` for null, else its byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place from 0 within the group, and ``n``, the group's size; nulls first.

    Rows are dealt by range, so a group of any size is spread; what ties in ``order`` also ties in the range and
    is told apart by a salt, so that one repeated row cannot fill a task.
    """
    dealt = rows.withColumn("_salt", F.rand(11)).repartitionByRange(_parts(rows), *groups, *order, "_salt")
    dealt = materialise(dealt.withColumn("_part", F.spark_partition_id()), "dealt")
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select(*groups, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order, "_salt"))
    placed = join_null_safe(dealt.withColumn("_place", place), sizes, [*groups, "_part"])
    return placed.withColumn("idx", F.col("_before") + F.col("_place") - 1).drop("_salt", "_part", "_before", "_place")


def _run_of(nodes: DataFrame) -> DataFrame:
    """Nodes ``(tree, idx, digest, n)`` of one level to the runs above them."""
    children = F.array_sort(F.collect_list(F.struct(F.col("idx"), F.col("digest"))))
    runs = nodes.groupBy("tree", "n", F.floor(F.col("idx") / FANOUT).alias("run")).agg(children.alias("c"))
    texts = F.array_join(F.transform("c", lambda x: F.hex(x["digest"])), "")
    return runs.select(
        "tree", F.col("run").alias("idx"), F.unhex(texts).alias("children"), F.unhex(F.sha2(F.lower(texts), 256)).alias("digest"), F.ceil(F.col("n") / FANOUT).alias("n")
    )


def _built(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level, from 1, and the last node ``(tree, digest)`` of each tree."""
    levels, ends, current = [], [nodes.where("n = 1").select("tree", "digest")], nodes
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        current = materialise(_run_of(current.where("n > 1").select("tree", "idx", "digest", "n")), name)
        levels.append(current)
        ends.append(current.where("n = 1").select("tree", "digest"))
        most = -(-most // FANOUT)
    return levels, reduce(DataFrame.unionByName, ends)


def _salts(level: int, most: int) -> int:
    """Copies of a run of this level: one for every ``SHARED`` leaves below it."""
    return min(max(1, FANOUT**level // SHARED), most)


def _links(level: int, many: bool, salts: int) -> list[Column]:
    """The run that a node of this level belongs to: in its own tree, or above it if it is the tree's last."""
    last = F.col("n") == 1
    top = F.lit(TOP) if many else F.lit(None)
    above = F.when(~last, F.col("tree")).otherwise(F.when(F.col("tree") != TOP, top))
    # A run of level k has at most FANOUT ** k leaves below it; a run of the top tree may have any number.
    below = _salts(level + 1, salts)
    own_top = F.when(F.col("tree") == TOP, F.lit(salts)).otherwise(F.lit(below))
    return [
        above.cast("int").alias("up_tree"),
        F.when(~last, F.lit(level + 1)).otherwise(F.lit(1)).alias("up_level"),
        F.floor(F.when(~last, F.col("idx")).otherwise(F.col("tree")) / FANOUT).alias("up_idx"),
        (F.when(~last, F.col("idx")).otherwise(F.col("tree")) % FANOUT).cast("int").alias("up_pos"),
        F.when(~last, own_top).otherwise(F.lit(salts)).alias("up_salts"),
    ]


def manifest(leaves: DataFrame, group: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(leaves, runs, roots)`` as written tables.

    ``leaves`` has ``leaf`` (32 bytes) beside the group, the key and any other column, and gains ``tree``, ``idx`` and
    links; a null group is a group and comes first, as a null key does; rows that tie in key and leaf are leaves of
    their own. ``runs`` has ``children`` and ``digest`` by ``(tree, level, idx)`` with links; ``roots`` has
    ``(tree, subroot, root)``. An empty table has no root.
    """
    spark = leaves.sparkSession
    salts = 4 * _parts(leaves)
    placed = materialise(numbered(leaves, [group], [key, "leaf"]), "leaves")
    trees = numbered(placed.select(group).distinct(), [], [group]).select(F.col(group), F.col("idx").cast("int").alias("tree"))
    trees = materialise(trees, "trees")
    placed = materialise(join_null_safe(placed, small_side(trees, 256), [group]), "leaves")
    levels, subroots = _built(placed.select("tree", "idx", F.col("leaf").alias("digest"), "n"), "runs")
    subroots = materialise(subroots.withColumnRenamed("digest", "subroot"), "subroots")
    n_trees = trees.count()
    above = subroots.select(F.lit(TOP).alias("tree"), F.col("tree").cast("long").alias("idx"), F.col("subroot").alias("digest"), F.lit(n_trees).cast("long").alias("n"))
    top_levels, top = _built(above, "top_runs")
    roots = subroots.crossJoin(F.broadcast(top.select(F.col("digest").alias("root"))))  # one row

    many = n_trees > 1
    rows = [(k, levels[k - 1]) for k in range(1, len(levels) + 1)] + [(k, top_levels[k - 1]) for k in range(1, len(top_levels) + 1)]
    runs = [r.select(F.col("tree").alias("at_tree"), F.lit(k).alias("at_level"), F.col("idx").alias("at_idx"), "children", "digest", *_links(k, many, salts), F.lit(_salts(k, salts)).alias("own_salts")) for k, r in rows]
    empty = "at_tree int, at_level int, at_idx long, children binary, digest binary, up_tree int, up_level int, up_idx long, up_pos int, up_salts int, own_salts int"
    runs = reduce(DataFrame.unionByName, runs) if runs else spark.createDataFrame([], empty)
    runs = runs.withColumn("own_salts", F.when(F.col("at_tree") == TOP, F.lit(salts)).otherwise(F.col("own_salts")))
    return placed.select("*", *_links(0, many, salts)), materialise(runs, "manifest"), roots


def proofs(leaves: DataFrame, runs: DataFrame, roots: DataFrame, key: str, now: str) -> DataFrame:
    """``(key, leaf, subroot, root, proof_sha256, folded_root, verified)``, hex, for each leaf.

    ``now`` names the column with the digest of what is there now; it is folded with the manifest's siblings.
    """
    spark = leaves.sparkSession
    # The recursion makes a row for each leaf and level; the default limit on rows is for loops without an end.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    salted = runs.select("*", F.explode(F.sequence(F.lit(0), F.col("own_salts") - 1)).alias("at_salt")).drop("own_salts", "digest")
    start = leaves.select("tree", "idx", F.col(now).alias("folded"), F.col(key).alias("key"), "leaf", "up_tree", "up_level", "up_idx", "up_pos", "up_salts")
    statement = CLIMB.replace("{type}", start.schema["key"].dataType.simpleString())
    climbed = spark.sql(statement, leaves=start, runs=salted)
    folded = climbed.groupBy("tree", "idx").agg(
        F.max("key").alias("key"),
        F.max("leaf").alias("leaf"),
        F.max_by("folded", "step").alias("folded"),
        F.array_sort(F.collect_list(F.struct("step", "siblings"))).alias("s"),
    )
    siblings = F.array_join(F.transform("s", lambda x: hex_text(x["siblings"])), "")
    out = folded.join(small_side(roots, 96), "tree")
    return out.select(
        F.col("key").alias(key),
        hex_text(F.col("leaf")).alias("leaf"),
        hex_text(F.col("subroot")).alias("subroot"),
        hex_text(F.col("root")).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        hex_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
