"""Nearest neighbours by multi-index hashing over learned, rotated binary codes.

A rotation is learned on a bounded sample (principal axes, then iterative quantisation) and gives every vector
a code of ``BITS`` bits. The code is cut into substrings, each indexed: a cell is one value of one substring.
By the pigeonhole principle a code within Hamming radius r has a substring within r // substrings of the
query's; so a query probes, for each substring, the cells that close, and finds every code within r. Each hit
is reported by the first substring that proves it, then ranked by its float distance.

Cells with the same first bits are a Spark group, as many groups as the codes fill blocks; fuller groups are cut
into blocks on both sides, so a task never holds more than about ``BLOCK`` codes against ``BLOCK`` queries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskweave.session import materialise

BITS = 64
#: Rows the rotation and the radius are learned on, those with the least hash of their id.
SAMPLE = 8192
#: Share of a sample's true neighbours that the radius must cover. The sample is sparser than the whole, so
#: its neighbours are farther and the share reached on the whole is higher.
COVER = 0.95
BLOCK = 4096


@dataclass
class Coder:
    mean: np.ndarray
    turn: np.ndarray  # dimension x bits
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        bits = (vectors - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _sizes(bits: int, parts: int) -> list[tuple[int, int]]:
    """First bit and width of each substring."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return list(zip(edges[:-1], np.diff(edges).tolist()))


def learn(sample: np.ndarray, k: int, rounds: int = 30) -> Coder:
    """Rotation by iterative quantisation, and the radius that covers the sample's own neighbours."""
    rng = np.random.default_rng(11)
    mean = sample.mean(axis=0)
    centred = sample - mean
    dim = sample.shape[1]
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes.T
    if axes.shape[1] < BITS:  # fewer axes than bits: random directions for the rest
        axes = np.hstack([axes, rng.normal(size=(dim, BITS - axes.shape[1])) / math.sqrt(dim)])
    projected = centred @ axes[:, :BITS]
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
        turn = (u @ v).T
    coder = Coder(mean, axes[:, :BITS] @ turn, BITS)
    codes = coder.codes(sample)
    queries = np.arange(0, len(sample), max(1, len(sample) // 256))
    found = []
    for q in queries:
        near = np.argsort(((sample - sample[q]) ** 2).sum(axis=1), kind="stable")[1 : k + 1]
        found.append(np.bitwise_count(codes[near] ^ codes[q]))
    found = np.concatenate(found) if found else np.zeros(0)
    if len(found):
        coder.radius = int(np.quantile(found, COVER, method="higher"))
    return coder


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def usable(vector: str = "embedding") -> F.Column:
    """Neither null, zero nor holding null or non-finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def search(
    vectors: DataFrame, is_query: F.Column, row_id: str = "vec_id", vector: str = "embedding", k: int = 10
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its ``k`` nearest other rows found, by Euclidean distance.

    Ties go to the smaller id. Rows with an unusable vector, a null id or another length than most take no part.
    Rows of one id count as one (that with the least vector). Rows of equal vectors share a code and a place in the index; their ``k + 1``
    least ids stand for them, which is all that an answer of ``k`` can hold. Queries that find fewer than ``k``
    rows within the radius search all codes. Fewer candidates than ``k`` give fewer rows.
    """
    rows = vectors.where(usable(vector) & F.col(row_id).isNotNull()).select(
        F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return empty
    rows = rows.where(F.size("v") == size.n)
    sample = _vectors(rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["v"])
    coder = learn(sample, k)

    @F.pandas_udf("long")
    def code_of(v: pd.Series) -> pd.Series:
        return pd.Series(coder.codes(_vectors(v)).view(np.int64))

    once = W.partitionBy("id").orderBy("v")
    coded = rows.withColumn("n", F.row_number().over(once)).where("n = 1").withColumn("code", code_of("v")).select("id", "v", "q", "code")
    coded = materialise(coded, "codes")
    least = W.partitionBy("code", "v").orderBy("id")
    members = coded.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    classes = materialise(
        members.groupBy("code", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("code", "v", "ids", F.element_at("ids", 1).alias("id")), "classes"
    )
    total = classes.count()
    width = min(16, max(6, round(math.log2(max(total, 1) / 128))))
    parts = math.ceil(BITS / width)
    queries = materialise(coded.where("q").select(F.col("id").alias("query"), "v", "code"), "queries")
    found = materialise(_probe(classes, queries, parts, coder.radius, k), "found")
    enough = found.groupBy("query").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > k).select("query")
    rest = materialise(queries.join(enough, "query", "left_anti"), "rest")
    found = found.join(enough, "query", "left_semi").unionByName(_probe(classes, rest, 1, BITS, k))
    nearest = W.partitionBy("query").orderBy("distance", "id")
    top = found.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)
    ranked = top.select("query", "distance", F.explode("ids").alias("other")).where("other <> query")
    order = W.partitionBy("query").orderBy("distance", "other")
    return (
        ranked.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("vec_id"), F.col("distance").alias("score"))
    )


def _flips(width: int, most: int) -> np.ndarray:
    values = np.arange(1 << width, dtype=np.uint32)
    return values[np.bitwise_count(values) <= most].astype(np.int64)


def _probe(classes: DataFrame, queries: DataFrame, parts: int, radius: int, k: int) -> DataFrame:
    """``(query, id, ids, distance)``: the ``k + 1`` nearest classes of each query and group, of all within the radius.

    With one part the cells are the values of the first bits and all of them are probed: the exact search.
    """
    everything = parts == 1
    sizes = [(0, 6)] if everything else _sizes(BITS, parts)
    near = 6 if everything else radius // parts
    # Cells that share their first bits make a group, of about a block of codes.
    lead = max(0, min(6 if everything else min(w for _, w in sizes), math.ceil(math.log2(max(classes.count(), 1) / BLOCK))))

    def values_of(codes: np.ndarray) -> np.ndarray:
        return np.stack([((codes >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in sizes], axis=1)

    def of_codes(frames):
        for f in frames:
            if len(f):
                values = values_of(f["code"].to_numpy().view(np.uint64))
                for part, (_, w) in enumerate(sizes):
                    yield f.assign(part=part, cell=values[:, part] >> (w - lead))

    def of_queries(frames):
        for f in frames:
            if len(f):
                values = values_of(f["code"].to_numpy().view(np.uint64))
                for part, (_, w) in enumerate(sizes):
                    firsts = np.unique(_flips(w, near) >> (w - lead))
                    cell = (values[:, part] >> (w - lead))[:, None] ^ firsts[None, :]
                    picked = f.loc[f.index.repeat(len(firsts))]
                    yield picked.assign(part=part, cell=cell.reshape(-1))

    vec = "v array<double>"
    index = classes.select("code", "v", "ids", "id").mapInPandas(of_codes, f"code long, {vec}, ids array<long>, id long, part int, cell long")
    asked = queries.select("query", "v", "code").mapInPandas(of_queries, f"query long, {vec}, code long, part int, cell long")
    # Blocks: as many as the fullest cells of a part need, known from counts per cell.
    per_cell = index.groupBy("part", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    per_query_cell = asked.select("part", "cell").groupBy("part", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qblocks"))
    shape = materialise(per_cell.join(per_query_cell, ["part", "cell"]), "cells")
    codes_in = index.join(shape, ["part", "cell"]).select(
        "part", "cell", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)).alias("qblock"), "code", "v", "ids", "id"
    )
    asked_in = asked.join(shape, ["part", "cell"]).select(
        "part", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query"), "qblocks").cast("int").alias("qblock"), "query", "v", "code"
    )

    def compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        part, first = int(key[0]), int(key[1])
        out = []
        if len(left) and len(right):
            at, w = sizes[part]
            value = values_of(left["code"].to_numpy().view(np.uint64))[:, part]
            left = left.iloc[np.argsort(value, kind="stable")]
            value = np.sort(value)
            starts = np.searchsorted(value, np.arange((1 << w) + 1))
            x, cx, ids = _vectors(left["v"]), left["code"].to_numpy().view(np.uint64), left["id"].to_numpy()
            members = left["ids"].to_numpy()
            masks = _flips(w, near)
            asked_codes = right["code"].to_numpy().view(np.uint64)
            own = values_of(asked_codes)[:, part]
            for query, v, code, cell in zip(right["query"], right["v"], asked_codes, own):
                probes = masks ^ cell
                probes = probes[probes >> (w - lead) == first]
                low, size = starts[probes], starts[probes + 1] - starts[probes]
                hit = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
                diff = cx[hit] ^ code
                ok = np.bitwise_count(diff) <= radius
                for start, width in sizes[:part]:  # an earlier part has reported it
                    ok &= np.bitwise_count((diff >> np.uint64(start)) & np.uint64((1 << width) - 1)) > near
                hit = hit[ok]
                if len(hit):
                    d = np.sqrt(((x[hit] - np.asarray(v, np.float64)) ** 2).sum(axis=1))
                    for i in np.lexsort((ids[hit], d))[: k + 1]:
                        out.append((query, int(ids[hit[i]]), members[hit[i]], float(d[i])))
        return pd.DataFrame(out, columns=["query", "id", "ids", "distance"])

    keys = ["part", "cell", "block", "qblock"]
    return codes_in.groupBy(*keys).cogroup(asked_in.groupBy(*keys)).applyInPandas(compare, "query long, id long, ids array<long>, distance double")
