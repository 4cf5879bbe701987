"""Near-duplicate vectors by robust-pruned graphs on overlapping cluster shards.

Method. Vectors are assigned to their nearest cluster and to others that are nearly as near, so shards overlap.
On each shard a flat graph is built: the nearest neighbours of a node, pruned so that a neighbour that lies
closer to a kept one goes (with a slack factor). A vector's adjacency lists from all of its shards are united. A
range-expanding greedy search starts at the medoids of the connected parts of the shard's graph and of its groups of near copies, follows the best
nodes, and goes on through all nodes inside the range. Found pairs are verified in double precision. The recall is
audited against all rows for a bounded set of vectors. Where it falls short, shards are compared block by block without
a graph, and clusters overlap more until it is high enough or no link can be missing.

Equal vectors are folded first. A cluster of many vectors is split into pieces of bounded size: each has its own graph, and blocks of
the cluster's vectors search every piece, so no task holds a whole cluster. Tasks return counts and
a spanning forest of what they link, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from emberfield.llm.components import connected
from emberfield.session import materialize

#: Vectors of a graph, about, and of a block of searching vectors.
PIECE = 1500
#: Most clusters (their centres are broadcast), and vectors per cluster wanted.
MAX_CLUSTERS = 4096
CLUSTER = 1000
#: Vectors that the centres are fitted on.
FIT_VECTORS = 20_000
#: Candidates of a node, neighbours kept, and the slack of pruning.
CANDIDATES, DEGREE, SLACK = 64, 24, 1.2
#: Best nodes followed on the way into the range.
BEAM = 24
#: Most tasks of a step.
MAX_TASKS = 4000
#: Vectors of the audit, and the recall asked for.
AUDITED, RECALL = 500, 0.99


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means centres of unit vectors; the first ones are taken evenly from the sample."""
    out = sample[np.linspace(0, len(sample) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ out.T, axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        out[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return out


def shards(vectors: np.ndarray, middle: np.ndarray, overlap: int, margin: float) -> list[np.ndarray]:
    """Clusters of each vector: the nearest, and up to ``overlap`` whose angle is at most ``margin`` larger."""
    near = vectors @ middle.T
    take = min(overlap, near.shape[1])
    top = np.argsort(-near, axis=1, kind="stable")[:, :take]
    angle = np.arccos(np.clip(np.take_along_axis(near, top, axis=1), -1, 1))
    keep = angle <= angle[:, :1] + margin
    return [np.sort(t[k]) for t, k in zip(top, keep)]


def robust_graph(x: np.ndarray, candidates: int = CANDIDATES, degree: int = DEGREE, slack: float = SLACK) -> list[np.ndarray]:
    """Adjacency lists of unit vectors by robust pruning, with reverse links."""
    n = len(x)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    take = min(candidates, n - 1)
    if take < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    top = np.argpartition(-near, take - 1, axis=1)[:, :take]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)
    out = []
    for i in range(n):
        own = top[i]
        mutual = 1 - near[own[:, None], own[None, :]]
        np.fill_diagonal(mutual, 0)
        far = 1 - near[i, own]
        left = np.ones(take, bool)
        kept = []
        for j in range(take):
            if left[j]:
                kept.append(own[j])
                if len(kept) == degree:
                    break
                left &= slack * mutual[j] > far
        out.append(np.array(kept, np.int64))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(out):
        for j in own:
            back[j].append(i)
    # Reverse links make every node of a connected part reachable; all of them stay, at most DEGREE per node on average.
    return [np.union1d(own, np.array(some, np.int64)) for own, some in zip(out, back)]


def _medoids(x: np.ndarray, src: np.ndarray, dst: np.ndarray, least: int) -> np.ndarray:
    """The node next to the mean of all, of every connected part with ``least`` nodes or more."""
    n = len(x)
    part = np.arange(n)
    while True:
        low = part.copy()
        np.minimum.at(low, src, part[dst])
        np.minimum.at(low, dst, part[src])
        low = low[low]
        if (low == part).all():
            break
        part = low
    order = np.lexsort((-(x @ x.mean(axis=0)), part))
    _, first, size = np.unique(part[order], return_index=True, return_counts=True)
    return order[first[size >= least]]


def entries(x: np.ndarray, links: list[np.ndarray], low: float) -> np.ndarray:
    """Where searches enter a graph: the medoids of its connected parts and of what links inside the range connect.

    The lists of a large group of near copies name the group alone, so that only others' links lead there,
    and a search whose best nodes are in one such group would never see the next one.
    """
    if not len(x):
        return np.zeros(0, np.int64)
    src, dst = np.repeat(np.arange(len(x)), [len(v) for v in links]), np.concatenate(links)
    near = np.einsum("ij,ij->i", x[src], x[dst]) >= low
    return np.union1d(_medoids(x, src, dst, 1), _medoids(x, src[near], dst[near], 2))


def range_search(x: np.ndarray, links: list[np.ndarray], queries: np.ndarray, low: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with cosine >= low that a search from the entries reaches.

    All queries advance together: in each round every query expands its newly seen nodes that are
    inside the range or among its best ``beam``.
    """
    n, q = len(x), len(queries)
    ends = np.concatenate(([0], np.cumsum([len(v) for v in links])))
    flat = np.concatenate(links) if n else np.zeros(0, np.int64)
    seen = np.zeros((q, n), bool)
    near = np.full((q, n), -2.0)
    take = min(beam, n)
    start = entries(x, links, low)
    near[:, start] = queries @ x[start].T
    seen[:, start] = True
    worst = np.partition(near, n - take, axis=1)[:, n - take] if n else np.zeros(q)
    todo_q, at = np.nonzero((near[:, start] >= low) | (near[:, start] >= worst[:, None]))
    todo_n = start[at]
    while len(todo_q):
        lengths = ends[todo_n + 1] - ends[todo_n]
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(ends[todo_n], lengths)
        pair = np.unique(np.repeat(todo_q, lengths) * n + flat[at])
        pair = pair[~seen.ravel()[pair]]
        if not len(pair):
            break
        new_q, new_n = pair // n, pair % n
        value = np.einsum("ij,ij->i", queries[new_q], x[new_n])
        seen[new_q, new_n] = True
        near[new_q, new_n] = value
        some = np.unique(new_q)
        worst = np.full(q, -2.0)
        worst[some] = np.partition(near[some], n - take, axis=1)[:, n - take]
        go = (value >= low) | (value >= worst[new_q])
        todo_q, todo_n = new_q[go], new_n[go]
    return np.nonzero(near >= low)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _padded(lists: pd.Series, fill: int) -> np.ndarray:
    """Short lists as rows of a matrix."""
    out = np.full((len(lists), max(map(len, lists))), fill, np.int64)
    for row, own in zip(out, lists):
        row[: len(own)] = own
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the same components as all pairs."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[up] if up in parent else up
        return v

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _build(piece: pd.DataFrame) -> pd.DataFrame:
    piece = piece.sort_values("vec_id", ignore_index=True)
    ids = piece["vec_id"].to_numpy()
    links = robust_graph(unit(_matrix(piece["vector"])))
    return pd.DataFrame({"vec_id": ids, "links": [ids[own] for own in links]})


def _search(low: float, compare: bool):
    """Search the graph of a piece with a block of its cluster's vectors, or compare the two without it."""

    def run(key: tuple, index: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = {"vec_id": [], "found": [], "other": []}
        cluster = key[0]
        if len(index) and len(block):
            index = index.sort_values("vec_id", ignore_index=True)
            ids = index["vec_id"].to_numpy()
            x, y = unit(_matrix(index["vector"])), unit(_matrix(block["vector"]))
            if compare:
                q, n = np.nonzero(y @ x.T >= low - 1e-9)
            else:
                # United lists name nodes of other shards too; here those of this piece count.
                links = []
                for own in index["links"]:
                    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                    links.append(np.unique(at[ids[at] == own]))
                q, n = range_search(x, links, y, low - 1e-9)
            # Verification in double precision, and each pair in one cluster of the two only.
            exact = np.einsum("ij,ij->i", y[q], x[n]) >= low
            q, n = q[exact], n[exact]
            mine, theirs = _padded(block["clusters"], -1)[q], _padded(index["clusters"], -2)[n]
            other = ids[n]
            me = block["vec_id"].to_numpy()[q]
            shared = np.full(len(q), 1 << 30)
            for k in range(mine.shape[1]):
                shared = np.minimum(shared, np.where((theirs == mine[:, k : k + 1]).any(axis=1), mine[:, k], 1 << 30))
            use = (shared == cluster) & (me != other)
            q, n, me, other = q[use], n[use], me[use], other[use]
            weight = np.bincount(q, index["weight"].to_numpy()[n], len(block)).astype(np.int64)
            for i in np.flatnonzero(weight):
                out["vec_id"].append(int(block["vec_id"].iloc[i]))
                out["found"].append(int(weight[i]))
                out["other"].append(None)
            for a, b in _forest(me, other):
                out["vec_id"].append(a)
                out["found"].append(0)
                out["other"].append(b)
        return pd.DataFrame({"vec_id": pd.Series(out["vec_id"], dtype="int64"), "found": pd.Series(out["found"], dtype="int64"), "other": pd.Series(out["other"], dtype="Int64")})

    return run


def _assign(batches: Iterator[pd.DataFrame], middle, overlap: int, margin: float) -> Iterator[pd.DataFrame]:
    for frame in batches:
        if len(frame):
            yield frame.assign(clusters=shards(unit(_matrix(frame["vector"])), middle.value, overlap, margin))


def _searched(folded: DataFrame, middle, low: float, overlap: int, margin: float, compare: bool) -> DataFrame:
    sharded = materialize(
        folded.mapInPandas(
            lambda it: _assign(it, middle, overlap, margin), "vec_id long, weight long, vector array<double>, clusters array<int>"
        ),
        "vector-shards",
    )
    member = sharded.withColumn("cluster", F.explode("clusters"))
    # Sizes of the clusters, at most MAX_CLUSTERS rows.
    pieces = member.groupBy("cluster").count().select("cluster", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    graphs, searches = pieces.agg(F.sum("pieces"), F.sum(F.col("pieces") * F.col("pieces"))).first()
    # Groups are work, not bytes: they get partitions of their own, up to a bound.
    graphs, searches = (max(1, min(MAX_TASKS, int(n or 0))) for n in (graphs, searches))
    placed = member.join(F.broadcast(pieces), "cluster")
    indexed = placed.withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int"))
    if compare:
        linked = indexed.withColumn("links", F.lit(None).cast("array<long>"))
    else:
        lists = materialize(
            indexed.select("cluster", "piece", "vec_id", "vector")
            .repartition(graphs, "cluster", "piece")
            .groupBy("cluster", "piece")
            .applyInPandas(_build, "vec_id long, links array<long>")
            .groupBy("vec_id")
            .agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links")),
            "vector-links",
        )
        linked = indexed.join(lists, "vec_id")
    block = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("pieces")).cast("int"))
    span = lambda f: f.withColumn("pair", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    left = span(linked).select("cluster", "piece", F.col("pair").alias("block"), "vec_id", "weight", "vector", "clusters", "links")
    right = span(block).select("cluster", F.col("pair").alias("piece"), "block", "vec_id", "vector", "clusters")
    # Fresh column names keep the two uses of the table apart.
    right = right.toDF(*right.columns)
    keys = ["cluster", "piece", "block"]
    return (
        left.repartition(searches, *keys)
        .groupBy(*keys)
        .cogroup(right.repartition(searches, *keys).groupBy(*keys))
        .applyInPandas(_search(low, compare), "vec_id long, found long, other long")
    )


def _recall(folded: DataFrame, counts: DataFrame, low: float) -> float:
    """Share of the links of a bounded set of vectors that were found; all rows are compared, in blocks.

    The lowest of: the share of all these links, and the mean share per vector among vectors with 1, 2 to 3,
    4 to 7 links and so on. So a large group does not hide what small ones lack.
    """
    spark = folded.sparkSession
    asked = folded.orderBy(F.xxhash64("vec_id", F.lit("audit")), "vec_id").limit(AUDITED).select("vec_id", "vector").toPandas()
    if not len(asked):
        return 1.0
    shared = spark.sparkContext.broadcast((asked["vec_id"].to_numpy(), unit(_matrix(asked["vector"]))))

    def exact(batches):
        ids, q = shared.value
        total = np.zeros(len(ids))
        for frame in batches:
            if len(frame):
                near = (q @ unit(_matrix(frame["vector"])).T >= low) & (ids[:, None] != frame["vec_id"].to_numpy()[None, :])
                total += near @ frame["weight"].to_numpy()
        yield pd.DataFrame({"vec_id": ids, "true": total.astype(np.int64)})

    truth = folded.mapInPandas(exact, "vec_id long, true long").groupBy("vec_id").agg(F.sum("true").alias("true"))
    found = F.coalesce("found", F.lit(0))
    strata = (
        truth.join(counts, "vec_id", "left")
        .where(F.col("true") > 0)
        .groupBy(F.floor(F.log2(F.col("true"))).alias("size"))
        .agg(F.sum("true").alias("true"), F.sum(found).alias("found"), F.avg(found / F.col("true")).alias("mean"))
    )
    row = strata.agg(F.sum("true"), F.sum("found"), F.min("mean")).first()
    return 1.0 if not row[0] else min(row[1] / row[0], row[2])


def near_duplicates(vectors: DataFrame, low: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector; links have cosine >= low.

    ``vectors`` has ``vec_id`` and ``embedding`` (array of numbers); other columns are ignored. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing, as do rows without vec_id; so do vectors
    of different lengths with each other (each length is searched on its own). Rows of one vec_id are taken as separate vectors that share
    the row's node: give unique ids. Component: the smallest vec_id reachable.
    """
    spark = vectors.sparkSession
    embedding = F.col("embedding").cast("array<double>")
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate(embedding, F.lit(0.0), lambda s, x: s + x * x)
    table = vectors.select(F.col("vec_id").cast("long"), embedding.alias("vector"), bad.alias("bad"), square.alias("square"))
    usable = table.where("vec_id is not null and vector is not null and not bad and square > 0 and square < double('infinity')")
    # Vectors of the same values are one; a hash finds them, and their members are kept by id.
    digest = F.md5(F.to_json("vector"))
    members = materialize(usable.select("vec_id", "vector", digest.alias("digest")), "vector-members")
    heads = members.groupBy("digest").agg(F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("weight"))
    # The head's row carries the values: joined by digest and id, so copies do not meet in one task.
    folded = materialize(
        members.join(heads, (members.digest == heads.digest) & (members.vec_id == heads["head"]))
        .select("vec_id", "weight", "vector").dropDuplicates(["vec_id"]),
        "vector-folded",
    )
    results, links = [], []
    for (size,) in folded.select(F.size("vector")).distinct().collect():
        own = folded.where(F.size("vector") == size)
        total = own.count()
        count = int(min(MAX_CLUSTERS, max(1, total // CLUSTER)))
        fit = own.orderBy(F.xxhash64("vec_id", F.lit("fit")), "vec_id").limit(min(FIT_VECTORS, 40 * count + 100)).select("vector").toPandas()
        middle = spark.sparkContext.broadcast(centres(unit(_matrix(fit["vector"])), min(count, len(fit))))
        overlap, margin, compare = 2, 0.15, False
        # A vector is at most twice the range's angle farther from a partner's nearest centre than from its own.
        enough = 2 * float(np.arccos(np.clip(low, -1, 1)))
        while True:
            found = materialize(_searched(own, middle, low, overlap, margin, compare), "vector-found")
            counts = found.groupBy("vec_id").agg(F.sum("found").alias("found"))
            whole = compare and overlap >= count and (count == 1 or margin >= enough)
            if whole or _recall(own, counts, low) >= RECALL:
                break
            overlap, margin, compare = 2 * overlap, 2 * margin, True
        results.append(counts)
        links.append(found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    none = spark.createDataFrame([], "vec_id long, found long")
    counts = none
    for frame in results:
        counts = counts.union(frame)
    linked = heads.join(members.select("digest", "vec_id"), "digest").select(F.col("head").alias("a"), F.col("vec_id").alias("b"), "weight")
    every = linked.select("a", "b")
    for frame in links:
        every = every.union(frame)
    groups = connected(every, "vector-components").withColumnsRenamed({"node": "vec_id", "component": "component_id"})
    per = linked.select(F.col("b").alias("vec_id"), "a", "weight").join(counts.withColumnRenamed("vec_id", "a"), "a", "left").select(
        "vec_id", (F.col("weight") - 1 + F.coalesce("found", F.lit(0))).cast("long").alias("n_links")
    ).dropDuplicates(["vec_id"])
    return (
        table.select("vec_id")
        .join(per, "vec_id", "left")
        .join(groups, "vec_id", "left")
        .select(
            "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
