"""Embedding near-dedup by an inverted multi-index.

Two independent codebooks, one per vector half, span a grid of cells; every vector is filed under
its nearest centroid of either half. Cells are visited in the order of the sum of their two half
distances by a heap walking outwards from the nearest cell, and every vector of a visited cell is
verified by its exact cosine.

The walk has two levels, so that vectors move once per group of cells and not once per cell.
Neighbouring centroids of each half are grouped, and pairs of groups are regions of some thousand
vectors. A walk over regions, by their nearest cells, names the regions that a vector has to be
sent to; there it visits the cells within the same distance sum. Regions and the vectors that
visit them are split into blocks of bounded size.

A link is found if a walk from either of its ends comes to the other, and counts at both ends. The
walk stops where the target recall is met in every band of cosines from the link threshold up: for
made neighbours of probe vectors at the lower end of each band, and for the true links of the
probes, found against every row, with equal weight for each probe, so that a large tight group
does not decide alone. The largest of these distance sums ends every walk. (A stop that can be
proved to miss nothing, by the distance to a cell's border, visits nine cells in ten in 64
dimensions, so it is not used.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import components, query, ship, table
from newsloom.session import materialize

COSINE = 0.9
#: The share of links to find in each band, of true links and of made neighbours.
RECALL = 0.999
#: Bands of cosines from the link threshold to 1, and neighbours made per probe and band.
BANDS = 4
MADE = 64
#: The codebooks are fitted on this many vectors at most and have this many centroids at most.
FIT_ROWS = 16_384
MOST_CENTROIDS = 2_048
CELL_ROWS = 64
#: Vectors compared with all rows to find where walks may stop, and the steps sums are counted in.
PROBES = 256
GRAIN = 1 / 2_048
#: Vectors that one task compares with as many others, and rows of them in one matrix product.
BLOCK = 16_384
TILE = 2_048


def k_means(rows, centroids: int, rounds: int = 8, seed: int = 1):
    """Distinct centroids of the rows, as many as asked for at most."""
    import numpy as np

    rng = np.random.default_rng(seed)
    book = rows[rng.choice(len(rows), min(centroids, len(rows)), replace=False)]
    for _ in range(rounds):
        near = (rows @ book.T * 2 - (book * book).sum(1)).argmax(1)
        for c in range(len(book)):
            own = rows[near == c]
            if len(own):
                book[c] = own.mean(0)
    return np.unique(book, axis=0)


def fit_codebooks(sample, centroids: int):
    """Two arrays of centroids by k-means, each on its half of unit vectors."""
    import numpy as np

    return [k_means(half, centroids, seed=1 + h) for h, half in enumerate(np.array_split(sample, 2, axis=1))]


def half_distances(half, book):
    """(nearest centroid, squared distance to each centroid beyond the nearest one's) per row."""
    import numpy as np

    dist = (half * half).sum(1)[:, None] - 2 * half @ book.T + (book * book).sum(1)
    near = dist.argmin(1)
    return near, np.maximum(dist - dist[np.arange(len(dist)), near][:, None], 0)


def nearest_cells(one, two, limit: float):
    """Cells (i, j) in ascending order of one[i] + two[j], up to ``limit``: the multi-sequence walk."""
    import heapq

    import numpy as np

    order1, order2 = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, seen = [(one[order1[0]] + two[order2[0]], 0, 0)], {(0, 0)}
    while heap:
        total, a, b = heapq.heappop(heap)
        if total > limit:
            return
        yield int(order1[a]), int(order2[b])
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(order1) and y < len(order2) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (one[order1[x]] + two[order2[y]], x, y))


def unit_rows(raw):
    """Rows in double precision at length 1, and which rows can link at all."""
    import numpy as np

    good = np.isfinite(raw).all(axis=1)
    size = np.sqrt((np.where(good[:, None], raw, 0) ** 2).sum(axis=1))
    good &= (size > 0) & np.isfinite(size)
    return raw / np.where(good, size, 1)[:, None], good


def matrix(column):
    """Arrow list column of equally long rows as a matrix of doubles; rows of one number get a zero."""
    import numpy as np

    if not len(column):
        return np.empty((0, 2))
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows if rows.shape[1] > 1 else np.hstack([rows, np.zeros_like(rows)])


def as_numbers(vectors: DataFrame):
    """The embedding as stored if it holds floats, which are exact in half the bytes; as doubles otherwise."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    return F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")


def linkable(vectors: DataFrame) -> tuple[DataFrame, list[int]]:
    """(id, v, copies): distinct usable vectors, each under the smallest vec_id that has it; and their lengths.

    Usable vectors are not empty or zero and have no null or non-finite component.
    """
    usable = vectors.filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    ).select(F.col("vec_id").cast("bigint").alias("vec_id"), as_numbers(vectors).alias("v"))
    inf = F.lit(float("inf"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    usable = usable.filter(finite & F.exists("v", lambda x: x != 0))
    once = usable.groupBy("v").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies"))
    once = materialize(once, "vectors")
    # A row per length of vectors, of which a table has few.
    lengths = once.select(F.size("v").alias("n")).distinct().orderBy("n").collect()
    return once, [r["n"] for r in lengths]


def made_neighbours(probes, cosine: float, seed: int = 2):
    """One random unit vector per probe at the given cosine."""
    import numpy as np

    way = np.random.default_rng(seed).normal(size=probes.shape)
    way -= (way * probes).sum(1)[:, None] * probes
    way /= np.maximum(np.sqrt((way * way).sum(1)), 1e-12)[:, None]
    return cosine * probes + (1 - cosine * cosine) ** 0.5 * way


def band_limit(found: list[tuple[int, int, int]], recall: float) -> int:
    """The step within which ``recall`` of the links (probe, step, n) lie, if every probe weighs the same."""
    of, at = {}, {}
    for probe, _, n in found:
        of[probe] = of.get(probe, 0) + n
    for probe, step, n in found:
        at[step] = at.get(step, 0.0) + n / of[probe]
    upto = 0.0
    for step in sorted(at):
        upto += at[step]
        if upto >= recall * len(of) - 1e-9:
            return step
    return 0


def stop_at(ready: DataFrame, probes, books, cosine: float, recall: float) -> float:
    """The distance sum that ends a walk: within it lie ``recall`` of the links of every band of cosines.

    The sum of a link is the smaller one of the walks from its two ends.
    """
    import numpy as np

    half = books[0].shape[1]
    wide = (1 - cosine) / BANDS

    def placed(rows):
        """Nearest centroids and distances beyond them, per half."""
        return [half_distances(x, k) for x, k in zip((rows[:, :half], rows[:, half:]), books, strict=True)]

    def reach(one, p, two, q):
        """Sums at which walks between rows ``p`` of one and ``q`` of two come to the other's cell."""
        there = sum(one[h][1][p, two[h][0][q]] for h in (0, 1))
        return np.minimum(there, sum(two[h][1][q, one[h][0][p]] for h in (0, 1)))

    own = placed(probes)

    def count(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            unit, _ = unit_rows(matrix(b.column(0)))
            like = unit @ probes.T
            row, probe = np.nonzero((like >= cosine) & (like < 1 - 1e-12))
            near = np.unique(row)
            steps = np.ceil(reach(own, probe, placed(unit[near]), np.searchsorted(near, row)) / GRAIN).astype(np.int64)
            bands = np.minimum((like[row, probe] - cosine) / max(wide, 1e-12), BANDS - 1).astype(np.int64)
            keys, n = np.unique(np.stack([bands, probe, steps]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in keys), pa.array(n.astype(np.int64))], names=["band", "probe", "step", "n"])

    limits, everyone = [0.0], np.arange(len(probes))
    for band in range(BANDS):
        made = [reach(own, everyone, placed(made_neighbours(probes, cosine + band * wide, 2 + k)), everyone) for k in range(MADE)]
        limits.append(float(np.quantile(made, recall)))
    # At most one row per band, probe and step of a sum that cannot exceed 8.
    found = ready.select("v").mapInArrow(count, "band bigint, probe bigint, step bigint, n bigint")
    found = found.groupBy("band", "probe", "step").agg(F.sum("n").alias("n")).collect()
    for band in range(BANDS):
        limits.append(GRAIN * band_limit([(r["probe"], r["step"], r["n"]) for r in found if r["band"] == band], recall))
    return max(limits) + GRAIN


def joined_labels(a, b):
    """(nodes, labels): the least node that each is connected with by the links a[k] to b[k]."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[u], low[v])
        new = low.copy()
        for end in (u, v, low[u], low[v]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def tile_labels(linked, q, m):
    """The least id that each row (ids ``q``) and column (ids ``m``) is connected with, by rounds over the tile."""
    import numpy as np

    top = np.iinfo(np.int64).max
    low = q
    while True:
        across = np.minimum(m, np.where(linked, low[:, None], top).min(axis=0))
        new = np.minimum(low, np.where(linked, across[None, :], top).min(axis=1))
        if (new == low).all():
            return low, across
        low = new


def verified_links(q, one, q_copies, m, two, m_copies, books, limit: float, cosine: float):
    """(id, n, to) of the links between unit rows ``one`` (ids ``q``) and the members ``two`` (ids ``m``).

    Each row of ``one`` meets the cells of ``two`` that its walk visits. A link counts for the row; for
    the member too, unless the member's own walk comes to the row's cell and counts it there. ``to`` is
    the least id that a node is connected with here.
    """
    import numpy as np

    half = books[0].shape[1]

    def placed(rows):
        (i, beyond1), (j, beyond2) = (half_distances(x, k) for x, k in zip((rows[:, :half], rows[:, half:]), books, strict=True))
        return i, j, beyond1, beyond2

    cell = np.concatenate([np.empty((0, 2), np.int64)] + [np.stack(placed(two[s : s + TILE])[:2], axis=1) for s in range(0, len(two), TILE)])
    order = np.lexsort((cell[:, 1], cell[:, 0]))
    m, two, m_copies, cell = m[order], two[order], m_copies[order], cell[order]
    starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)]) if len(m) else []
    bounds = [(s, min(s + TILE, e)) for f, e in zip(starts, [*starts[1:], len(m)], strict=True) for s in range(f, e, TILE)]
    n_q, n_m, met = np.zeros(len(q), np.int64), np.zeros(len(m), np.int64), np.zeros(len(m), bool)
    ends = [np.empty((2, 0), np.int64)]
    for t in range(0, len(q), TILE):
        rows = one[t : t + TILE]
        i, j, beyond1, beyond2 = placed(rows)
        for s, e in bounds:
            visiting = np.flatnonzero(beyond1[:, cell[s, 0]] + beyond2[:, cell[s, 1]] <= limit)
            linked = rows[visiting] @ two[s:e].T >= cosine
            if not linked.any():
                continue
            linked &= q[t + visiting][:, None] != m[s:e][None, :]
            has, got = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            if not len(has):
                continue
            linked, visiting, got = linked[np.ix_(has, got)], visiting[has], s + got
            at = t + visiting
            n_q[at] += linked @ m_copies[got]
            _, _, back1, back2 = placed(two[got])
            back = back1[:, i[visiting]] + back2[:, j[visiting]] <= limit
            n_m[got] += (linked.T & ~back) @ q_copies[at]
            met[got] = True
            low, across = tile_labels(linked, q[at], m[got])
            ends.append(np.stack([np.r_[q[at], m[got]], np.r_[low, across]]))
    nodes, labels = joined_labels(*np.concatenate(ends, axis=1))
    has = n_q > 0
    ids = np.r_[q[has], m[met]]
    return ids, np.r_[n_q[has], n_m[met]], labels[np.searchsorted(nodes, ids)]


def links_of(ready: DataFrame, cosine: float, recall: float) -> DataFrame:
    """(id, n, to) of vectors of one length: links counted in parts, and edges that span the components.

    A task compares two blocks of bounded size by matrix products and returns counts and a spanning
    forest of the links, never the pairs.
    """
    import numpy as np

    total = ready.count()
    sample = ready.orderBy(F.xxhash64("id")).limit(FIT_ROWS).select("v").toArrow().column(0).combine_chunks()
    fitted, _ = unit_rows(matrix(sample))
    books = fit_codebooks(fitted, int(min(MOST_CENTROIDS, max(1, (total / CELL_ROWS) ** 0.5))))
    half = books[0].shape[1]
    limit = stop_at(ready, fitted[:PROBES], books, cosine, recall)
    side = int(np.ceil((total / BLOCK) ** 0.5))
    groups = [half_distances(book, k_means(book, side))[0] for book in books]

    def placed(rows):
        unit, _ = unit_rows(matrix(rows))
        return [half_distances(x, k) for x, k in zip((unit[:, :half], unit[:, half:]), books, strict=True)]

    def file_under(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                i, j = (near for near, _ in placed(b.column(1)))
                region = pa.array((groups[0][i] * side + groups[1][j]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns, region], names=["id", "v", "copies", "region"])

    kind = ready.schema["v"].dataType.simpleString()
    filed = ready.select("id", "v", "copies").mapInArrow(file_under, f"id bigint, v {kind}, copies bigint, region int")
    filed = materialize(filed, "filed-vectors")

    def walk(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            # The distance to a group of centroids is that to its nearest one; groups may be empty.
            least = []
            for (_, beyond), group in zip(placed(b.column(1)), groups, strict=True):
                near = np.full((len(beyond), side), np.inf)
                for g in np.unique(group):
                    near[:, g] = beyond[:, group == g].min(axis=1)
                least.append(near)
            at, regions = [], []
            for r, (one, two) in enumerate(zip(*least, strict=True)):
                own = [i * side + j for i, j in nearest_cells(one, two, limit)]
                regions += own
                at += [r] * len(own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(regions, pa.int32())], names=["id", "visit"])

    visits = materialize(filed.select("id", "v").mapInArrow(walk, "id bigint, visit int"), "visits")
    more = ((F.count("*") - 1) / BLOCK).cast("int")
    split = filed.groupBy("region").agg(more.alias("blocks")).join(
        visits.groupBy(F.col("visit").alias("_v")).agg(more.alias("parts")), F.col("region") == F.col("_v")
    )
    split = materialize(split.select(F.col("region").alias("_r"), "blocks", "parts"), "region-sizes")
    # Vectors that visit a region are dealt to parts, its members to blocks; every part meets every block.
    pair = ["region", "block", "part"]
    block = F.pmod(F.xxhash64("id"), F.col("blocks") + 1).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts") + 1).cast("int")
    every = lambda last: F.explode(F.sequence(F.lit(0), F.col(last)))
    rows = visits.join(split, F.col("visit") == F.col("_r")).join(
        filed.select(F.col("id").alias("_i"), "v", "copies"), F.col("id") == F.col("_i")
    ).select(F.col("visit").alias("region"), every("blocks").alias("block"), part.alias("part"), "id", "v", "copies")
    held = filed.join(split, F.col("region") == F.col("_r")).select("region", block.alias("block"), every("parts").alias("part"), "id", "v", "copies")

    def compare(key, left, right):
        import pyarrow as pa

        def columns(t):
            return t["id"].combine_chunks().to_numpy(), unit_rows(matrix(t["v"].combine_chunks()))[0], t["copies"].combine_chunks().to_numpy()

        out = [()] * 3
        if left.num_rows and right.num_rows:
            out = verified_links(*columns(left), *columns(right), books, limit, cosine)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("id", "n", "to"), out, strict=True)})

    return rows.groupBy(*pair).cogroup(held.toDF(*held.columns).groupBy(*pair)).applyInArrow(compare, "id bigint, n bigint, to bigint")


def near_links(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(counts, edges): n_links per distinct vector (id, copies, n), and links (a, b) that span the components.

    Vectors of each length have a grid of their own.
    """
    once, lengths = linkable(vectors)
    found = once.sparkSession.createDataFrame([], "id bigint, n bigint, to bigint")
    for n in lengths:
        found = found.unionByName(links_of(once.filter(F.size("v") == n), cosine, recall))
    found = materialize(found, "vector-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    edges = found.filter("id != to").select(F.col("id").alias("a"), F.col("to").alias("b")).distinct()
    return once.join(counts.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"), "left").select(
        "id", "v", "copies", F.coalesce("n", F.lit(0)).alias("n")
    ), edges


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Equal vectors are one class with links among its copies. Null, empty and zero vectors, those
    with null or non-finite components link with nothing and are kept; vectors link with those of
    their own length.
    Rows that repeat a vec_id and its vector are one vector; a vec_id with several vectors has the
    links of each row's own vector. A null vec_id has no component. An empty table gives an empty
    result. A link that a walk from either end comes to is counted at both.
    """
    classes, edges = near_links(vectors, cosine, recall)
    classes = materialize(classes, "vector-classes")
    found = components(edges, "vectors")
    rooted = classes.join(found.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"), "left").select(
        F.col("v").alias("_v"), (F.col("n") + F.col("copies") - 1).alias("_n"), F.coalesce("component_id", "id").alias("_c")
    )
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), as_numbers(vectors).alias("v"))
    known = F.col("vec_id").isNotNull() & (F.col("v") == F.col("_v"))
    out = rows.join(rooted, known, "left").select(
        "vec_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("_c", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
WITH RECURSIVE d AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM d
      WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r(id, root) AS (SELECT vec_id, vec_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT d.vec_id, coalesce(max(l.n), 0) AS n_links, min(r.root) AS component_id, d.vec_id = min(r.root) AS kept
FROM d JOIN r ON r.id = d.vec_id LEFT JOIN l ON l.a = d.vec_id GROUP BY d.vec_id
"""


@query("op1_multi_index_dedup", SQL)
def op1(spark, sf):
    return near_duplicates(table(spark, sf, "embeddings"))


ship(__name__)
