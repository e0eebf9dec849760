"""Hard negatives by an inverted multi-index: exact windows of inner products, certified by cell bounds.

Vectors are dealt to shards of bounded size. In a shard each half of the vectors has a codebook of its own; a row's two
codes name its cell. For an anchor, the bound of a code is its half's inner product with the centre plus the half's
length times the radius of the code's members; the bound of a cell is the sum of its two. A heap visits the cells of
the two sorted code lists by falling bound, and stops once no row of an unvisited cell can change the answer: when the
bound is below the last row held of every window, or below the window itself.

Two rounds. The first finds the best rows of the anchor's label, shard by shard, and merges them; their scores
open the windows of the second, which finds the best rows of other labels inside each. Anchors are dealt to blocks, and
a task meets one shard with one block, so neither side grows beyond its bound. No row is left out and no search ends
before it is certified, so the result is that of a full scan.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillmeter.llm.common import col
from rillmeter.llm.tokens import ragged
from rillmeter.session import materialise

#: Rows of a shard, anchors of a block, and shards that a smaller table is cut into if they still hold LEAST rows.
SHARD_ROWS, BLOCK_ANCHORS, SPREAD, LEAST = 1 << 16, 1 << 15, 64, 4096
#: Rows for each cell, most codes of a half, rows a codebook is fitted on, and rounds of the fit.
CELL_ROWS, MOST_CODES, FIT_ROWS, FIT_ROUNDS = 64, 32, 2048, 6
#: Rows scored at first; each further gulp is four times as large.
GULP = 512


def _codes(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (half @ centres.T), axis=1)


def codebook(half: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres (k-means on at most FIT_ROWS evenly spaced rows), every row's code, and each code's radius."""
    fit = half[np.linspace(0, len(half) - 1, min(len(half), FIT_ROWS)).astype(np.int64)]
    centres = fit[np.linspace(0, len(fit) - 1, codes).astype(np.int64)].copy()
    for _ in range(FIT_ROUNDS):
        code = _codes(fit, centres)
        count = np.bincount(code, minlength=codes)
        total = np.zeros_like(centres)
        np.add.at(total, code, fit)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    code = _codes(half, centres)
    away = np.sqrt(np.maximum(((half - centres[code]) ** 2).sum(1), 0))
    radius = np.zeros(codes)
    np.maximum.at(radius, code, away)
    return centres, code, radius


class Cells:
    """The multi-index of one shard: rows sorted by cell."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        n, d = vectors.shape
        self.cut = d // 2
        self.codes = int(np.clip(np.sqrt(n / CELL_ROWS), 1, MOST_CODES))
        (self.left, i, self.left_radius), (self.right, j, self.right_radius) = (
            codebook(half, self.codes) for half in (vectors[:, : self.cut], vectors[:, self.cut :])
        )
        cell = i * self.codes + j
        order = np.lexsort((ids, cell))
        self.vectors, self.ids, self.labels = vectors[order], ids[order], labels[order]
        self.size = np.bincount(cell, minlength=self.codes**2)
        self.start = np.cumsum(self.size) - self.size

    def _bounds(self, half: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
        near, reach = centres @ half, np.sqrt(half @ half) * radius
        return near + reach + 1e-9 * (np.abs(near) + reach) + 1e-6  # above any rounding of either term

    def gulps(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Row numbers of the cells visited, and the bound of every row still to come."""
        u = self._bounds(anchor[: self.cut], self.left, self.left_radius)
        v = self._bounds(anchor[self.cut :], self.right, self.right_radius)
        by_u, by_v = np.argsort(-u), np.argsort(-v)
        su, sv, size = u[by_u].tolist(), v[by_v].tolist(), self.size
        heap, cells, held, gulp = [(-su[0] - sv[0], 0, 0)], [], 0, GULP
        while heap:
            _, x, y = heapq.heappop(heap)
            if y + 1 < self.codes:
                heapq.heappush(heap, (-su[x] - sv[y + 1], x, y + 1))
            if y == 0 and x + 1 < self.codes:
                heapq.heappush(heap, (-su[x + 1] - sv[0], x + 1, 0))
            cell = by_u[x] * self.codes + by_v[y]
            if size[cell]:
                cells.append(cell)
                held += size[cell]
            if held >= gulp or not heap and cells:
                at = np.array(cells)
                yield ragged(self.start[at], size[at]), -heap[0][0] if heap else -np.inf
                cells, held, gulp = [], 0, gulp * 4

    def best(self, anchor: np.ndarray, own: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best rows of ``label`` other than ``own``: by score, then id."""
        score, ids = np.zeros(0), np.zeros(0, np.int64)
        for rows, bound in self.gulps(anchor):
            rows = rows[(self.labels[rows] == label) & (self.ids[rows] != own)]
            score, ids = _first(np.concatenate([score, self.vectors[rows] @ anchor]), np.concatenate([ids, self.ids[rows]]), k)
            if len(score) == k and bound < score[-1]:
                break
        return score, ids

    def windows(self, anchor: np.ndarray, label: int, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Scores and ids of the k best rows of another label in each window ``low`` to ``high``."""
        held = [(np.zeros(0), np.zeros(0, np.int64))] * len(low)
        for rows, bound in self.gulps(anchor):
            rows = rows[self.labels[rows] != label]
            score = self.vectors[rows] @ anchor
            some = (score >= low.min()) & (score <= high.max())
            score, ids = score[some], self.ids[rows[some]]
            for w, (s, i) in enumerate(held):
                inside = (score >= low[w]) & (score <= high[w])
                if inside.any():
                    held[w] = _first(np.concatenate([s, score[inside]]), np.concatenate([i, ids[inside]]), k)
            if all(bound < low[w] or len(s) == k and bound < s[-1] for w, (s, _) in enumerate(held)):
                break
        return held


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(score) > 8 * k:  # only what reaches the k-th score
        some = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, ids = score[some], ids[some]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def _matrix(table: pa.Table) -> np.ndarray:
    column = table["vector"].combine_chunks()
    values = np.frombuffer(b"".join(column.to_pylist()), np.int64)
    return values.reshape(len(column), -1).astype(np.float64) if len(values) else np.zeros((len(column), 0))


def _exact(x: np.ndarray, y: np.ndarray) -> None:
    """Whole numbers below 2**53 are exact in double precision; beyond, a score would be rounded."""
    top = lambda m: float(np.sqrt((m * m).sum(1).max())) if m.size else 0.0
    if top(x) * top(y) >= 2**53:
        raise ValueError("vectors too long: inner products of 2**53 and more")


def _positives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    out = {name: [] for name in ("anchor", "score", "id")}
    if rows.num_rows and anchors.num_rows:
        x, a = _matrix(rows), _matrix(anchors)
        _exact(x, a)
        cells = Cells(x, rows["vec_id"].to_numpy(), rows["label"].to_numpy())
        for number, own, label, vector in zip(anchors["anchor"].to_numpy(), anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), a):
            score, ids = cells.best(vector, own, label, k)
            out["anchor"] += [int(number)] * len(ids)
            out["score"] += score.astype(np.int64).tolist()
            out["id"] += ids.tolist()
    return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})


def _negatives(rows: pa.Table, anchors: pa.Table, k: int, low: int, high: int) -> pa.Table:
    out = {name: [] for name in ("anchor", "place", "score", "id")}
    if rows.num_rows and anchors.num_rows:
        x, a = _matrix(rows), _matrix(anchors)
        _exact(x, a)
        cells = Cells(x, rows["vec_id"].to_numpy(), rows["label"].to_numpy())
        for i, vector in enumerate(a):
            opened = np.array(anchors["scores"][i].as_py(), np.float64)
            # whole scores with low * p <= 100 * n <= high * p
            bottom, top = np.ceil(low * opened / 100), np.floor(high * opened / 100)
            found = cells.windows(vector, anchors["label"][i].as_py(), bottom, top, k)
            for place, (score, ids) in enumerate(found):
                out["anchor"] += [anchors["anchor"][i].as_py()] * len(ids)
                out["place"] += [place] * len(ids)
                out["score"] += score.astype(np.int64).tolist()
                out["id"] += ids.tolist()
    return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """(vec_id, label, n, vector): components as floor(scale * x), for rows that take part."""
    x = col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.where(x.isNotNull() & col(label_col).isNotNull() & col(id_col).isNotNull() & ~bad).select(
        col(id_col).cast("long").alias("vec_id"), col(label_col).cast("long").alias("label"), F.size(x).alias("n"),
        F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("vector"),
    )


def _binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, sizes = batch["vector"].flatten().to_numpy(), np.diff(batch["vector"].offsets.to_numpy())
        ends = np.cumsum(sizes)
        packed = [values[e - s : e].tobytes() for s, e in zip(sizes, ends)]
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["n"], pa.array(packed, pa.binary())], names=["vec_id", "label", "n", "vector"])


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``is_anchor`` (a
    condition on vec_id and label) holds.

    A score is the whole inner product of floor(scale * x). An anchor's positives are its first ``positives`` rows of the
    same label and another vec_id; the negatives of each are the first ``negatives`` rows of another label with low% to high% of its
    score; higher scores come first, then smaller ids. Rows with a null id, label, vector or component or a component
    that is not finite take no part; vectors of different lengths do not meet; an empty vector scores 0. Rows that repeat a vec_id each
    count. A result that doubles cannot hold exactly (2**53 and more) raises.
    """
    whole = whole_vectors(vectors, id_col, vector_col, label_col, scale)
    packed = whole.mapInArrow(_binary, "vec_id long, label long, n int, vector binary")
    rows = materialise(packed.withColumn("row", F.monotonically_increasing_id()), "vectors")
    total, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(is_anchor, 1))).first()
    shards = max(-(-total // shard_rows), min(SPREAD, total // LEAST), 1)
    blocks = max(-(-asked // block_anchors), 1)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    index = rows.select("vec_id", "label", "n", "vector", dealt("row", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    anchors = rows.where(is_anchor).select(F.col("row").alias("anchor"), "vec_id", "label", "n", "vector", dealt("row", blocks).alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    key = ["n", "shard", "block"]

    def meet(asking: DataFrame, search, schema: str) -> DataFrame:
        return index.groupBy(*key).cogroup(asking.select("*", every).groupBy(*key)).applyInArrow(search, schema)

    def first(found: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
        return materialise(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)

    near = first(meet(anchors, lambda r, a: _positives(r, a, positives), "anchor long, score long, id long"), ["anchor"], positives, "positives")
    opened = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))  # at most ``positives``
    asking = materialise(anchors.join(opened, "anchor").withColumn("scores", F.col("p.score")), "asking")
    found = meet(asking.drop("p"), lambda r, a: _negatives(r, a, negatives, low, high), "anchor long, place long, score long, id long")
    chosen = first(found, ["anchor", "place"], negatives, "negatives")
    named = asking.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("place", "p"))
    return chosen.join(named, ["anchor", "place"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
