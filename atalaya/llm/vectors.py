"""Embedding near-duplicates by sorted projection passes.

1. Equal vectors form a class; everything below works on one vector per class.
2. Each pass concatenates the signs of random projections to a key, orders all vectors by it and
   compares each with the `window` vectors before it. Cosines are computed in double precision.
   A task returns, for the links it found, each vector with the smallest one it hangs together with.
3. The components of all passes together are formed by distributed rounds.
4. Whatever the passes missed is found exactly: all vectors are dealt to groups of about `TILE`, every two groups are
   compared, and links between different components join them. The passes only make these links few; the number of
   comparisons grows with the square of the distinct vectors.
5. Links are counted inside components. Vectors within half the angle around their component's mean are
   linked with each other without being compared. All others, in blocks, are compared with
   every vector of their component, so large components lose no link and emit no pairs.

Defined results: a vector that is null, empty, zero, or holds null or non-finite numbers links with nothing
and is its own component; vectors of different length never link; rows that repeat link with each other;
a null id counts as the smallest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.llm.blocks import compare_open
from atalaya.llm.frames import partitions_of, small_batches
from atalaya.operators.graph import connected_components
from atalaya.runtime import materialize

COSINE = 0.95
PASSES = 12
BITS = 32
WINDOW = 64
#: Vectors of a component that share one comparison block, on either side.
BLOCK = 512
CHUNK = 2048
#: Vectors of a group in the comparison of all with all, and rows of it that are compared at once.
TILE, STRIP = 4096, 512
_NULL_ID = -(1 << 63)


def prepared(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, a never-null id, and the vector in doubles, null where it can't link."""
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    usable = F.forall(vector, number) & F.exists(vector, lambda x: x != 0)
    vec_id = F.col(f"`{id_column}`").cast("long")
    return vectors.select(
        vec_id.alias("vec_id"), F.coalesce(vec_id, F.lit(_NULL_ID)).alias("_id"), F.when(usable, vector).alias("vector")
    )


def equal_classes(rows: DataFrame) -> DataFrame:
    """One row per distinct vector: its smallest id and how many rows have it."""
    return rows.where(F.col("vector").isNotNull()).groupBy("vector").agg(
        F.min("_id").alias("class_id"), F.count(F.lit(1)).alias("times")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of one length, as rows."""
    flat = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def projection_keys(classes: DataFrame, passes: int, bits: int, seed: int) -> DataFrame:
    """Each class once per pass, with the signs of `bits` random projections as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.asarray(batch.column(2))
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                if size not in planes:
                    planes[size] = np.random.default_rng((seed, size)).standard_normal((size, passes * bits))
                signs = (_matrix(part.column(1)) @ planes[size] > 0).reshape(len(part), passes, bits)
                keys = signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                for which in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), which, np.int32)), pa.array(keys[:, which]), *part.columns],
                        ["pass", "key", "class_id", "vector", "size"],
                    )

    rows = classes.select("class_id", "vector", F.size("vector").alias("size"))
    return rows.mapInArrow(run, "pass int, key long, class_id long, vector array<double>, size int")


def smallest_linked(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position that each of n positions hangs together with through the links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            return label


def window_links(keyed: DataFrame, cosine: float, window: int) -> DataFrame:
    """Pairs (u, v) that hang together through links inside windows of the sorted order."""
    ordered = keyed.repartitionByRange(partitions_of(keyed.sparkSession), "pass", "size", "key", "class_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            whole = np.asarray(batch.column(0)).astype(np.int64) << 32 | np.asarray(batch.column(4))
            for which in np.unique(whole).tolist():
                part = batch.filter(pa.array(whole == which))
                ids, rows = np.asarray(part.column(2)), _matrix(part.column(3))
                if which in held:
                    ids, rows = np.concatenate([held[which][0], ids]), np.concatenate([held[which][1], rows])
                held = {which: (ids[-window:], rows[-window:])}
                left, right = [], []
                for step in range(1, min(window, len(ids) - 1) + 1):
                    hit = np.flatnonzero(np.einsum("ij,ij->i", rows[step:], rows[:-step]) >= cosine)
                    left.append(hit)
                    right.append(hit + step)
                if left:
                    label = smallest_linked(len(ids), np.concatenate(left), np.concatenate(right))
                    linked = np.flatnonzero(label != np.arange(len(ids)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], ["u", "v"])

    sorted_ = ordered.sortWithinPartitions("pass", "size", "key", "class_id")
    return sorted_.mapInArrow(run, "u long, v long")


_PACKED = "size int, a int, b int, side int, components binary, vectors binary"


def _packed_groups(members: DataFrame, groups: int) -> DataFrame:
    """Vectors packed by group, once for each pair (a, b) of groups that theirs is part of; side tells which one it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, group = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            for size, own in np.unique(np.stack([sizes, group], 1), axis=0).tolist():
                part = batch.filter(pa.array((sizes == size) & (group == own)))
                data = (np.asarray(part.column(0)).astype("<i8").tobytes(), _matrix(part.column(1)).astype("<f8").tobytes())
                for other in range(groups):
                    a, b, side = (own, other, 0) if own <= other else (other, own, 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], pa.int32()) for x in (size, a, b, side)] + [pa.array([x], pa.binary()) for x in data],
                        [f.split()[0] for f in _PACKED.split(", ")],
                    )

    group = F.pmod(F.xxhash64("class_id"), F.lit(groups)).cast("int")
    return members.select("component", "vector", F.size("vector").alias("size"), group.alias("group")).mapInArrow(run, _PACKED)


def links_across(members: DataFrame, cosine: float, count: int) -> DataFrame:
    """Pairs (u, v) of components that hang together through a link, from all pairs of vectors; members: class_id, component, vector."""
    groups = max(1, -(-count // TILE))
    strip = STRIP

    def sides(part: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
        components = np.frombuffer(b"".join(part["components"]), "<i8")
        return components, np.frombuffer(b"".join(part["vectors"]), "<f8").reshape(-1, size)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        size, same = int(part["size"].iloc[0]), part["a"].iloc[0] == part["b"].iloc[0]
        left = sides(part[part["side"] == 0], size)
        right = left if same else sides(part[part["side"] == 1], size)
        names, place = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True)
        u, v = place[: len(left[0])], place[len(left[0]) :]
        label = np.arange(len(names))
        for low in range(0, len(u), strip):
            i, j = np.nonzero(left[1][low : low + strip] @ right[1].T >= cosine)
            i, j = label[u[low + i]], label[v[j]]
            apart = i != j
            if apart.any():
                # Labels found so far stand for their components, so a link counts once.
                label = smallest_linked(len(names), i[apart], j[apart])[label]
        linked = np.flatnonzero(label != np.arange(len(names)))
        return pd.DataFrame({"u": names[linked], "v": names[label[linked]]})

    return _packed_groups(members, groups).groupBy("size", "a", "b").applyInPandas(run, "u long, v long")


_COUNT = "class_id long, links long"


def _count_block(unsettled: pd.DataFrame, members: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of the unsettled vectors with all members, and of settled members with the unsettled."""
    if unsettled.empty or members.empty:
        return pd.DataFrame({"class_id": [], "links": []}, dtype=np.int64)
    u, m = (np.stack(x["vector"].to_numpy()) for x in (unsettled, members))
    linked = u @ m.T >= cosine
    linked &= unsettled["component"].to_numpy()[:, None] == members["component"].to_numpy()
    linked &= unsettled["class_id"].to_numpy()[:, None] != members["class_id"].to_numpy()
    forth = linked @ members["times"].to_numpy()
    settled = ~members["open"].to_numpy()
    back = unsettled["times"].to_numpy() @ linked[:, settled]
    return pd.DataFrame({
        "class_id": np.concatenate([unsettled["class_id"].to_numpy(), members["class_id"].to_numpy()[settled]]),
        "links": np.concatenate([forth, back]),
    })


def links_in_components(members: DataFrame, cosine: float) -> DataFrame:
    """class_id and its number of linked rows of other classes; members: component, class_id, times, vector."""
    unit = members.withColumn("vector", F.transform("vector", lambda x: x / F.array_max(F.transform("vector", F.abs))))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    unit = unit.withColumn("vector", F.transform("vector", lambda x: x / norm))
    means = unit.groupBy("component").agg(
        vector_to_array(Summarizer.mean(array_to_vector("vector"))).alias("mean")
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # Half the angle, a little less, so that rounding can't settle a pair below the limit.
    half = math.cos(math.acos(cosine) / 2 - 1e-9)
    near = dot("mean", "vector") >= half * F.sqrt(dot("mean", "mean"))
    placed = materialize(unit.join(means, "component").withColumn("settled", near).drop("mean"), "members")
    sizes = placed.groupBy("component").agg(F.sum(F.when(F.col("settled"), F.col("times")).otherwise(0)).alias("settled_rows"))
    counted = compare_open(
        placed.select("component", "class_id", "times", "vector", (~F.col("settled")).alias("open")), "component", "class_id",
        lambda u, m: _count_block(u, m, cosine), _COUNT, block=BLOCK, chunk=CHUNK, rows=placed.count(),
    ).groupBy("class_id").agg(F.sum("links").alias("compared"))
    settled = F.when(F.col("settled"), F.col("settled_rows") - F.col("times")).otherwise(0)
    return (
        placed.select("component", "class_id", "times", "settled").join(sizes.select("component", "settled_rows"), "component")
        .join(counted, "class_id", "left")
        .select("class_id", "component", (settled + F.coalesce("compared", F.lit(0))).alias("links"))
    )


def _components(pairs: DataFrame) -> DataFrame:
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return connected_components(ids, pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")))


def near_vectors(
    vectors: DataFrame,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    cosine: float = COSINE,
    passes: int = PASSES,
    bits: int = BITS,
    window: int = WINDOW,
    seed: int = 8,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = prepared(vectors, id_column, vector_column)
    classes = materialize(equal_classes(rows), "classes")
    pairs = materialize(window_links(projection_keys(classes, passes, bits, seed), cosine, window), "near")
    found = _components(pairs)
    placed = classes.join(found.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "class_id"))
    found = _components(pairs.unionByName(materialize(links_across(placed, cosine, classes.count()), "across")))
    members = classes.join(found.select(F.col("id").alias("class_id"), "component"), "class_id")
    linked = links_in_components(members, cosine)
    # Only vectors that repeat or link need a look-up; all others are alone.
    known = classes.join(linked, "class_id", "left").where((F.col("times") > 1) | F.col("component").isNotNull()).select(
        F.col("vector").alias("_vector"), F.coalesce("component", "class_id").alias("component"),
        (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    component = F.coalesce("component", "_id")
    out = rows.join(known, F.col("vector") == F.col("_vector"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component != _NULL_ID, component).alias("component_id"), (component == F.col("_id")).alias("kept"),
    )
    return out


