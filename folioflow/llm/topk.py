"""Exact top-k by inner product: M-trees over metric shards, searched best first.

Vectors become integers, floor(256 * x). An extra coordinate makes all vectors equally long, so that a larger inner product
is a smaller Euclidean distance. Rows go to the nearest of some pivots (a bounded sample; a pivot's rows beyond
`SHARD_ROWS` are dealt to several shards). Each shard gets an M-tree: pages of at most `PAGE` entries, routing nodes with
covering radii, and every entry's distance to its parent. A query first goes down to its nearest page for a bound; then the
queries of a block go through the tree together, each only into nodes that its bound leaves open. Entries whose stored
parent distance already rules them out by the triangle inequality are not computed.
Scores are integers and decide ties exactly; bounds in floating point have slack.

A query first searches its nearest shard. The k-th score found there then rules out shards by their pivots' distances and
radii, and bounds the search of the others. Trees travel as rows, a page of entries each, and meet blocks of at most
`BLOCK_ROWS` queries by an equi-join on (shard, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import materialize, refuse, table

SHARD_ROWS, BLOCK_ROWS, PAGE, FANOUT, K, SCALE = 8192, 4096, 64, 16, 5, 256
#: At most so many pivots are drawn, from at most so many rows; rows of a stored page of a shard.
PIVOTS, SAMPLE_ROWS, STORED = 1024, 20_000, 256
SLACK = 1e-7


class MTree:
    """Bulk-loaded tree; node = (pivot, radius, parent distance, children or None, entries or None)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, page: int = PAGE, fanout: int = FANOUT):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.norms = (self.points * self.points).sum(axis=1)
        # sums below 2**53 are exact in double precision, whose products are much faster
        top = int(np.abs(self.points).max()) if self.points.size else 0
        self.table = self.points.astype(float) if top * top * self.points.shape[1] < 2**52 else self.points
        self.square = int(self.norms.max()) if len(ids) else 0
        self.extra = np.sqrt((self.square - self.norms).astype(float))
        self.page, self.fanout = page, fanout
        self.computed = 0
        self.root = self._build(np.arange(len(ids)), None) if len(ids) else None

    def _distances(self, a: int, b: np.ndarray) -> np.ndarray:
        d = self.norms[a] + self.norms[b] - 2 * (self.points[b] @ self.points[a])
        return np.sqrt(np.maximum(0.0, d + (self.extra[a] - self.extra[b]) ** 2))

    def _build(self, at: np.ndarray, parent: int | None):
        centre = self.points[at].mean(axis=0)
        pivot = int(at[np.argmin(((self.points[at] - centre) ** 2).sum(axis=1))])
        d = self._distances(pivot, at)
        up = float(self._distances(pivot, np.array([parent]))[0]) if parent is not None else 0.0
        radius = float(d.max())
        if len(at) <= self.page:
            # sorted by parent distance, so the entries that a bound leaves over are one slice of a page
            at = at[np.argsort(d, kind="stable")]
            return pivot, radius, up, None, (self.ids[at], np.sort(d, kind="stable"), self.table[at])
        fan = min(self.fanout, -(-len(at) // self.page) + 1)
        if radius > 0:
            # a few entries spread evenly over the distances attract the rest
            spread = at[np.argsort(d, kind="stable")][np.linspace(0, len(at) - 1, fan).astype(np.int64)]
            who = np.stack([self._distances(int(x), at) for x in spread]).argmin(axis=0)
        if radius == 0 or (who == who[0]).all():  # all (nearly) alike: pages by place
            who = np.arange(len(at)) // -(-len(at) // fan)
        kids = [self._build(at[who == k], pivot) for k in np.unique(who)]
        arrays = (np.array([x[0] for x in kids]), np.array([x[1] for x in kids]), np.array([x[2] for x in kids]))
        return pivot, radius, up, (arrays, kids), None

    def search(self, query: np.ndarray, own: int | None, k: int = K, known: int | None = None) -> list[tuple[int, int]]:
        """`search_all` for one query."""
        return self.search_all(query[None], [own], k, [known])[0]

    def search_all(self, queries: np.ndarray, own: list[int | None], k: int = K, known: list[int | None] | None = None) -> list[list[tuple[int, int]]]:
        """For each query (score, id) of the k best, best first, without its row `own`; ids are places in `keys` from 0, whose order breaks ties.

        known: scores that k rows elsewhere reach, so that lower ones need not be found. Each query first goes down to its nearest
        page for a bound. Then every node is visited once, by those queries together whose bounds do not rule it out.
        """
        if self.root is None or not len(queries):
            return [[] for _ in queries]
        top = int(np.abs(self.points).max(initial=0)) * queries.shape[1]
        base = (queries * queries).sum(axis=1).astype(float) + self.square
        small = self.table.dtype == float and int(np.abs(queries).max(initial=0)) * top < 2**52
        table, probe = (self.table, queries.astype(float)) if small else (self.points, queries)
        none = -np.inf if small else np.iinfo(np.int64).min + 1
        last = np.iinfo(np.int64).max
        best, best_ids = np.full((len(queries), k), none, probe.dtype), np.full((len(queries), k), last)
        floor, limit = np.full(len(queries), none, probe.dtype), np.full(len(queries), np.inf)
        mine = np.array([-1 if x is None else x for x in own], np.int64)

        def bounded(at: np.ndarray, scores: np.ndarray, exact: bool = True) -> None:
            """k rows reach these scores."""
            found = np.sqrt(np.maximum(0.0, base[at] - 2.0 * scores))
            limit[at] = np.minimum(limit[at], found + SLACK * (1 + found))
            if exact:
                floor[at] = np.maximum(floor[at], scores)

        told = np.array([i for i, x in enumerate(known or []) if x is not None], np.int64)
        if len(told):
            bounded(told, np.array([known[i] for i in told.tolist()], probe.dtype), small)

        def to(points: np.ndarray, at: np.ndarray) -> np.ndarray:
            self.computed += len(points) * len(at)
            return np.sqrt(np.maximum(0.0, base[at, None] - 2.0 * (probe[at] @ table[points].T)))

        def scores_of(leaf: tuple, at: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Ids and scores of the entries that the stored distances do not rule out for all queries."""
            ids, stored, page = leaf
            low, high = np.searchsorted(stored, [float((away - limit[at]).min()), float((away + limit[at]).max())])
            ids, page = ids[low : high + 1], page[low : high + 1]
            self.computed += len(ids) * len(at)
            scores = probe[at] @ (page if small else page.astype(np.int64)).T
            scores[mine[at, None] == ids] = none
            return ids, scores

        everyone = np.arange(len(queries))
        start = to(np.array([self.root[0]]), everyone)[:, 0]
        down = [(everyone, start, self.root)]
        while down:
            at, away, (_, _, _, inner, leaf) = down.pop()
            if leaf is not None:
                scores = scores_of(leaf, at, away)[1]
                if scores.shape[1] >= k:
                    kth = np.partition(scores, -k, axis=1)[:, -k]
                    bounded(at[kth > none], kth[kth > none])
                continue
            (pivots, radii, _), kids = inner
            d = to(pivots, at)
            nearest = np.maximum(0.0, d - radii).argmin(axis=1)
            down += [(at[nearest == i], d[nearest == i, i], kids[i]) for i in np.unique(nearest).tolist()]
        nodes = [(everyone, start, self.root)]
        while nodes:
            at, away, (_, radius, _, inner, leaf) = nodes.pop()
            live = away - radius <= limit[at]
            at, away = at[live], away[live]
            if not len(at):
                continue
            if leaf is not None:
                ids, scores = scores_of(leaf, at, away)
                good = (scores >= floor[at, None]) & (scores > none)
                some = np.flatnonzero(good.any(axis=1))
                if not len(some):
                    continue
                at, good = at[some], good[some]
                both = np.concatenate([best[at], np.where(good, scores[some], none)], axis=1)
                both_ids = np.concatenate([best_ids[at], np.where(good, ids, last)], axis=1)
                first = np.lexsort((both_ids, -both))[:, :k]
                best[at], best_ids[at] = np.take_along_axis(both, first, 1), np.take_along_axis(both_ids, first, 1)
                full = best_ids[at, -1] != last
                bounded(at[full], best[at[full], -1])
                continue
            (pivots, radii, ups), kids = inner
            near = np.abs(away[:, None] - ups) - radii <= limit[at, None]
            asked = np.flatnonzero(near.any(axis=0))
            d = to(pivots[asked], at)
            low = np.maximum(0.0, d - radii[asked])
            # the child that is nearest to most comes first, so it is pushed last
            for i in np.argsort(-low.mean(axis=0), kind="stable").tolist():
                to_child = near[:, asked[i]] & (low[:, i] <= limit[at])
                if to_child.any():
                    nodes.append((at[to_child], d[to_child, i], kids[asked[i]]))
        return [[(int(s), i) for s, i in zip(*x, strict=True) if i != last] for x in zip(best.tolist(), best_ids.tolist(), strict=True)]


def _ints(column) -> np.ndarray:
    return np.floor(SCALE * np.stack([np.asarray(x, np.float64) for x in column])).astype(np.int64)


def lengthened(points: np.ndarray, square: int) -> np.ndarray:
    """Points with the coordinate that makes all equally long."""
    norms = (points * points).sum(axis=1)
    return np.column_stack([points.astype(float), np.sqrt(np.maximum(0, square - norms).astype(float))])


class Pivots:
    """Centres of the shards of one width: every row belongs to the nearest."""

    def __init__(self, points: np.ndarray, square: int):
        self.square, self.points = square, lengthened(points, square)

    def away(self, points: np.ndarray, is_query: bool) -> np.ndarray:
        """Distances to all pivots, in float64; a query's own extra coordinate is 0, which ranks rows by inner product."""
        x = np.column_stack([points.astype(float), np.zeros(len(points))]) if is_query else lengthened(points, self.square)
        d = (x * x).sum(axis=1)[:, None] + (self.points**2).sum(axis=1) - 2 * x @ self.points.T
        return np.sqrt(np.maximum(0.0, d))


def _nearest(pivots):
    @F.arrow_udf("struct<pivot: int, away: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            at, away = np.zeros(len(column), np.int32), np.zeros(len(column))
            rows = column.to_pylist()
            for width in {len(x) for x in rows}:
                own = [i for i, x in enumerate(rows) if len(x) == width]
                d = pivots.value[width].away(_ints([rows[i] for i in own]), False)
                at[own], away[own] = d.argmin(axis=1), d.min(axis=1)
            yield pa.StructArray.from_arrays([pa.array(at), pa.array(away)], ["pivot", "away"])

    return run


def _shards_of(pivots, shards, k: int, nearest: bool):
    """Per query its nearest shard, or the others that a known score does not rule out; shards: width -> (pivot, shard, radius)."""

    def run(batches):
        for batch in batches:
            out: list[list[int]] = []
            known = batch.column("known").to_pylist() if not nearest else [None] * len(batch)
            for x, low in zip(batch.column("embedding").to_pylist(), known, strict=True):
                q = _ints([x])
                of, number, radius = shards.value[len(x)]
                d = pivots.value[len(x)].away(q, True)[0][of]
                first = int(np.lexsort((number, d))[0])
                if nearest:
                    out.append([int(number[first])])
                    continue
                keep = np.arange(len(of)) != first
                if low is not None:
                    limit = float(np.sqrt(max(0.0, float((q * q).sum()) + pivots.value[len(x)].square - 2.0 * low)))
                    keep &= d - radius <= limit + SLACK * (1 + limit)
                out.append(number[keep].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "shards"])

    return run


def _search(k: int):
    def run(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(pages) and len(asked):
            keys = np.concatenate([np.asarray(x, np.int64) for x in pages["rows"]])
            ids = np.concatenate([np.asarray(x, np.int64) for x in pages["ids"]])
            points = np.concatenate([np.frombuffer(x, np.int64).reshape(len(r), -1) for x, r in zip(pages["points"], pages["rows"], strict=True)])
            order = np.lexsort((keys, ids))  # a row's place in this order breaks ties
            keys, ids = keys[order], ids[order]
            place = {r: i for i, r in enumerate(keys.tolist())}
            tree = MTree(np.arange(len(keys)), points[order])
            own, known = [place.get(r) for r in asked["row"].tolist()], [None if pd.isna(x) else int(x) for x in asked["known"]]
            for row, found in zip(asked["row"].tolist(), tree.search_all(_ints(asked["embedding"]), own, k, known), strict=True):
                out += [(row, int(ids[i]), int(keys[i]), s) for s, i in found]
        return pd.DataFrame(out, columns=["row", "vec_id", "found", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, width): rows whose vectors have no null or non-finite component."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return kept.withColumn("embedding", x).withColumn("width", F.size("embedding"))


def _page_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [pdf.iloc[a : a + STORED] for a in range(0, len(pdf), STORED)]
    return pd.DataFrame(
        {
            "shard": [p["shard"].iloc[0] for p in parts], "rows": [p["row"].tolist() for p in parts], "ids": [p["vec_id"].tolist() for p in parts],
            "points": [_ints(p["embedding"]).tobytes() for p in parts],
        }
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest integer inner product, ties to the lesser vec_id.

    Candidates are all rows but the query's own, so rows of one vec_id are each a candidate and each a query; vectors that
    are null, or hold null or non-finite components, and rows without vec_id take no part; vectors of other lengths do
    not meet. With fewer candidates than k all are returned; an empty table gives an empty result. Other columns are ignored; the
    names `width` and `row` are refused.
    """
    refuse(vectors, "width", "row")
    spark = vectors.sparkSession
    rows = usable(vectors).select("vec_id", "embedding", "width", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    value = F.transform("embedding", lambda v: F.floor(v * SCALE))
    square = F.aggregate(value, F.lit(0).cast("long"), lambda s, v: s + v * v)
    widths = rows.where("width > 0").groupBy("width").agg(F.count("*").alias("n"), F.max(square).alias("square")).collect()
    total = sum(w["n"] for w in widths)
    schema = "query_id long, rank int, vec_id long, score long"
    if not total:
        return spark.createDataFrame([], schema)
    drawn = rows.where("width > 0").orderBy(F.xxhash64("row"), "row").select("width", "embedding").limit(SAMPLE_ROWS).toPandas()
    pivots = {}
    for w in widths:
        sample = drawn[drawn["width"] == w["width"]]["embedding"]
        count = min(PIVOTS, max(1, w["n"] // SHARD_ROWS), max(1, len(sample)))
        pivots[w["width"]] = Pivots(_ints(list(sample[:count])) if len(sample) else np.zeros((1, w["width"]), np.int64), w["square"])
    shared = spark.sparkContext.broadcast(pivots)
    placed = materialize(rows.where("width > 0").withColumn("p", _nearest(shared)("embedding")).select("vec_id", "embedding", "width", "asks", "row", "p.*"))
    sizes = placed.groupBy("width", "pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("width", "pivot").collect()
    numbered, shards, at = [], {}, 0
    for s in sizes:  # a row for each pivot, of which there are at most PIVOTS for a width
        parts = -(-s["n"] // SHARD_ROWS)
        numbered.append((s["width"], s["pivot"], at, parts))
        shards.setdefault(s["width"], []).extend((s["pivot"], at + i, s["radius"]) for i in range(parts))
        at += parts
    shards = {w: (np.array([x[0] for x in v]), np.array([x[1] for x in v], np.int32), np.array([x[2] for x in v])) for w, v in shards.items()}
    told = spark.sparkContext.broadcast(shards)
    of = spark.createDataFrame(numbered, "width int, pivot int, first int, parts int")
    shard = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int")
    stored = placed.join(of, ["width", "pivot"]).select("vec_id", "embedding", "row", shard.alias("shard"))
    pages = materialize(stored.groupBy("shard").applyInPandas(_page_rows, "shard int, rows array<long>, ids array<long>, points binary"))
    asked = placed.where("asks").select("row", F.col("vec_id").alias("query_id"), "embedding", F.lit(None).cast("long").alias("known"))

    def searched(queries: DataFrame) -> DataFrame:
        each = queries.withColumn("shard", F.explode("shards")).drop("shards")
        blocks = materialize(each.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))
        each = each.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
        spread = pages.join(blocks.withColumnRenamed("blocks", "copies"), "shard").withColumn("block", F.explode(F.expr("sequence(0, copies - 1)"))).drop("copies")
        found = spread.groupBy("shard", "block").cogroup(each.groupBy("shard", "block")).applyInPandas(_search(k), "row long, vec_id long, found long, score long")
        return materialize(found)

    reach = "row long, query_id long, embedding array<double>, known long, shards array<int>"
    first = searched(asked.mapInArrow(_shards_of(shared, told, k, True), reach))
    worst = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("known"))
    rest = asked.drop("known").join(worst, "row", "left").select("row", "query_id", "embedding", "known")
    second = searched(materialize(rest.mapInArrow(_shards_of(shared, told, k, False), reach)))
    by = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "found")
    best = first.unionByName(second).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.join(asked.select("row", "query_id"), "row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
