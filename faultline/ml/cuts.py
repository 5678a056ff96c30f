"""A fitted forest as forests of fewer or shorter trees: trees are drawn alike, so the first of them are a forest, and a tree cut at a depth is one that was grown no further."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.sources.shared import new_path


def stored_nodes(model: RandomForestClassificationModel, df: DataFrame) -> dict[str, np.ndarray]:
    """The nodes of all trees, one tree after the other, by the table that Spark saves a model as; a model is on the driver whole. Children are places in the arrays, -1 for none."""
    path = new_path(df.sparkSession, "forest")
    model.write().save(path)
    node = F.col("nodeData")
    share = F.try_divide(node["impurityStats"][1], node["impurityStats"][0] + node["impurityStats"][1])
    columns = {"id": node["id"], "left": node["leftChild"], "right": node["rightChild"], "at": node["split"]["featureIndex"], "most": F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)), "prediction": node["prediction"], "share": share}
    table = df.sparkSession.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), *[c.alias(k) for k, c in columns.items()]).toArrow()
    found = {k: table.column(k).to_numpy() for k in table.column_names}
    order = np.lexsort((found["id"], found["tree"]))
    found = {k: v[order] for k, v in found.items()}
    roots = np.nonzero(found["id"] == 0)[0]
    first = np.repeat(roots, np.diff([*roots, len(order)]))
    for side in ("left", "right"):
        found[side] = np.where(found[side] >= 0, found[side] + first, -1)
    return found | {"roots": roots}


def ends_at(nodes: dict[str, np.ndarray], depth: int) -> np.ndarray:
    """Which nodes are leaves in trees cut at depth. Like Spark, two leaves of one parent and the same prediction become one."""
    left, right, prediction, ends = nodes["left"], nodes["right"], nodes["prediction"], nodes["left"] < 0
    levels = [nodes["roots"]]
    while len(levels) <= depth and len(inner := levels[-1][left[levels[-1]] >= 0]):
        levels.append(np.concatenate([left[inner], right[inner]]))
    if len(levels) > depth:
        ends[levels.pop()] = True
    for level in reversed(levels):
        inner = level[left[level] >= 0]
        a, b = left[inner], right[inner]
        ends[inner] |= ends[a] & ends[b] & (prediction[a] == prediction[b])
    return ends


def shares(nodes: dict[str, np.ndarray], ends: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of positives in the leaf of each row of x and each tree."""
    place, row = np.tile(nodes["roots"], (len(x), 1)), np.arange(len(x))[:, None]
    while not ends[place].all():
        lower = x[row, np.maximum(nodes["at"][place], 0)] <= nodes["most"][place]
        place = np.where(ends[place], place, np.where(lower, nodes["left"][place], nodes["right"][place]))
    return nodes["share"][place]


def cut_scores(model: RandomForestClassificationModel, rows: DataFrame, features: list[str], sizes: list[int], depths: list[int]) -> DataFrame:
    """rows' columns, numTrees, maxDepth, score: the rows' scores by the forest's first trees of each size, cut at each depth."""
    nodes = stored_nodes(model, rows)
    ends = {d: ends_at(nodes, d) for d in depths}
    columns = rows.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.stack([part.column(f).to_numpy().astype(float) for f in features], axis=1)
                for depth, leaves in ends.items():
                    votes = np.cumsum(shares(nodes, leaves, x), axis=1)
                    for size in sizes:
                        own = [pa.array(np.full(part.num_rows, v, np.int32)) for v in (size, depth)]
                        yield pa.RecordBatch.from_arrays([*part.columns, *own, pa.array(votes[:, size - 1] / size)], names=[*columns, "numTrees", "maxDepth", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(scored, f"{schema}, numTrees int, maxDepth int, score double").withColumn("score", F.bround("score", 10))
