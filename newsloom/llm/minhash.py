"""MinHash near-dedup by a multi-index Hamming join.

A document's word shingles give a signature of 64 symbols of 16 bits. Two signatures at a distance
of at most 25 symbols agree, by the pigeonhole rule, in at least one of 13 chunks up to one error
(thirteen chunks with two errors each would make 26). So each chunk is filed once for each of its
four or five symbols, with that symbol left open, and every pair within the distance shares a key.

Documents with equal sets are one class from the start. Members of a key are compared with each
other, on four bits of each symbol: what differs there differs in full, so no pair within the
distance is lost and chance neighbours fall away before anything is connected. A key with more
members than ``HEAVY`` connects all of them unchecked, which adds candidates and changes no link.
What is connected is a cluster; inside it, blocks of bounded size meet block by block, so that a
large cluster is many tasks. All pairs of two blocks are compared by signature, near ones by their
full sets, and a block pair returns a forest of its links: pairs are never rows.
A pair at similarity 0.8 exceeds the distance with a probability of about 1.3e-4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import components, query, ship, table
from newsloom.session import materialize

SYMBOLS = 64
CHUNKS = 13
DISTANCE = 25
SHINGLE = 5
PERCENT = 80
#: Documents of a cluster that one task compares with as many others.
BLOCK = 512
#: Members of a key that are compared with each other; more are connected unchecked.
HEAVY = 256
WORDS = ["w0", "w1", "w2", "w3"]


def shingle_set(text: str | None, size: int) -> set[bytes]:
    """Distinct word shingles; fewer words than ``size`` make one shingle, no words none."""
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def shingle_hashes(text: str | None, size: int):
    """Sorted 64-bit hashes of the shingles."""
    import numpy as np
    import xxhash

    found = shingle_set(text, size)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    hashes.sort()
    return hashes


def minima(hashes):
    """The signature: low 16 bits of the least of each of 64 permuted hash values."""
    import numpy as np

    rng = np.random.default_rng(20)
    odd = rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = (hashes[at : at + 4096, None] ^ flip) * odd
        mixed ^= mixed >> np.uint64(29)
        np.minimum(least, (mixed * odd).min(axis=0), out=least)
    return least.astype(np.uint16)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, sig): set size, 128-bit hash of the whole set, signature."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            n, hi, lo, sig = [], [], [], []
            for text in b.column(1):
                hashes = shingle_hashes(text.as_py(), shingle)
                both = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8")
                n.append(len(hashes))
                hi.append(both[0])
                lo.append(both[1])
                sig.append(minima(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "hi", "lo", "sig"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, hi bigint, lo bigint, sig binary"
    )


def chunk_keys(reps: DataFrame) -> DataFrame:
    """(key, id, w0 to w3): every chunk with each symbol left open, and four bits of each symbol of the signature.

    A key is a 64-bit mix of chunk, place and symbols; keys that meet by chance add candidates only.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        odd, parts = np.uint64(0x9E3779B97F4A7C15), np.array_split(np.arange(SYMBOLS), CHUNKS)
        for b in batches:
            if not b.num_rows:
                continue
            symbols = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
            keys = np.empty((len(symbols), SYMBOLS), np.uint64)
            for chunk in parts:
                for open_ in chunk:
                    key = np.full(len(symbols), open_ + 1, np.uint64) * odd
                    for i in chunk[chunk != open_]:
                        key = (key ^ symbols[:, i]) * odd
                        key ^= key >> np.uint64(29)
                    keys[:, open_] = key
            shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
            bits = ((symbols & np.uint64(15)).reshape(-1, SYMBOLS // 16, 16) << shifts).sum(axis=2, dtype=np.uint64)
            ids, bits = b.column(0).to_numpy(), bits.view(np.int64)
            columns = [keys.view(np.int64).ravel(), *(np.repeat(x, SYMBOLS) for x in (ids, *bits.T))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "id", *WORDS])

    return reps.select("id", "sig").mapInArrow(run, "key bigint, id bigint, " + ", ".join(f"{w} bigint" for w in WORDS))


def connected(n: int, rows, cols):
    """The smallest of ``n`` rows that the links between ``rows`` and ``cols`` reach from each."""
    import numpy as np

    root = np.arange(n)
    while len(rows) and (root[rows] != root[cols]).any():
        low = np.minimum(root[rows], root[cols])
        for side in (rows, cols):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
    return root


def key_links(keys: DataFrame) -> DataFrame:
    """(a, b): members of a key connected by pairs whose signatures may be within ``DISTANCE``, as stars.

    Rows of a key lie together in one partition; a key is at most ``HEAVY`` rows, so few are held.
    """

    def near(key, ids, bits):
        import numpy as np

        ones, spots, at, step = np.uint64(0x1111111111111111), [], np.arange(len(key)), 1
        while len(at := at[at + step < len(key)]) and len(at := at[key[at] == key[at + step]]):
            differ = np.zeros(len(at), np.int64)
            for word in bits:
                x = word[at] ^ word[at + step]
                x |= x >> np.uint64(1)
                differ += np.bitwise_count((x | x >> np.uint64(2)) & ones)
            spots.append((at[differ <= DISTANCE], step))
            step += 1
        rows = np.concatenate([x for x, _ in spots]) if spots else np.empty(0, np.int64)
        cols = np.concatenate([x + d for x, d in spots]) if spots else rows
        root = connected(len(key), rows, cols)
        moved = np.flatnonzero(root != np.arange(len(key)))
        return ids[root[moved]], ids[moved]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(columns):
            key, ids, *bits = columns
            return pa.RecordBatch.from_arrays([pa.array(x) for x in near(key, ids, [x.view(np.uint64) for x in bits])], names=["a", "b"])

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [c.to_numpy() for c in b.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            held = [c[cut:] for c in columns]
            yield out([c[:cut] for c in columns])
        if held is not None:
            yield out(held)

    return keys.select("key", "id", *WORDS).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def candidate_links(reps: DataFrame) -> DataFrame:
    """(a, b): what connects all classes whose signatures are within ``DISTANCE``, and few others."""
    keys = chunk_keys(reps)
    heavy = keys.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY).select("_k")
    heavy = materialize(heavy, "minhash-heavy")
    light = key_links(keys.join(heavy, F.col("key") == F.col("_k"), "left_anti"))
    crowd = materialize(keys.join(heavy, F.col("key") == F.col("_k")).select("key", "id"), "minhash-crowds")
    least = crowd.groupBy(F.col("key").alias("_k")).agg(F.min("id").alias("a"))
    crowd = crowd.join(least, F.col("key") == F.col("_k")).select("a", F.col("id").alias("b")).filter("a != b")
    return light.unionByName(crowd).distinct()


def signature_distances(one, two):
    """Matrix of the number of symbols that differ."""
    import numpy as np

    out = np.zeros((len(one), len(two)), np.int16)
    for i in range(SYMBOLS):
        out += one[:, i][:, None] != two[:, i][None, :]
    return out


def shared_counts(one: list, two: list, pairs):
    """Sizes of the intersections of the sorted hash arrays at ``pairs`` (rows of one, rows of two)."""
    import numpy as np

    rows, cols = pairs
    codes, flat = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    each = sum(len(one[i]) + len(two[j]) for i, j in zip(rows[:64], cols[:64], strict=True)) / max(1, len(rows[:64]))
    # Whichever is less work: pair by pair, or all pairs of the block as a product of 0/1 matrices.
    if len(rows) * each * 30 < len(codes) * (len(one) * len(two) / 5 + len(one) + len(two)):
        return np.array([len(np.intersect1d(one[i], two[j], assume_unique=True)) for i, j in zip(rows, cols, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    total, wide = np.zeros((len(one), len(two)), np.float64), 8192
    for at in range(0, len(codes), wide):
        lo, hi = np.searchsorted(flat, [at, at + wide])
        has = np.zeros((len(one) + len(two), wide), np.float32)
        has[owner[lo:hi], flat[lo:hi] - at] = 1
        total += has[: len(one)] @ has[len(one) :].T
    return total[rows, cols].astype(np.int64)


def spanning(pairs):
    """Pairs of a forest that connects what ``pairs`` connect."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield a, b


def block_links(blocks: DataFrame, percent: int, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) from rows (cluster, low, high, block, id, sig, hashes): two blocks of a cluster a group.

    All pairs of a group meet by their signatures; those within ``distance`` are confirmed on their
    full sets. A group returns a forest of its links, not the links.
    """

    def compare(table):
        import numpy as np
        import pyarrow as pa

        block, low, high = (table[c].to_numpy() for c in ("block", "low", "high"))
        ids = table["id"].to_numpy()
        sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        lists = table["hashes"].combine_chunks()
        flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        near = signature_distances(sigs[left], sigs[right]) <= distance
        near &= ids[left][:, None] < ids[right][None, :] if low[0] == high[0] else ids[left][:, None] != ids[right][None, :]
        size = np.diff(ends)
        n, m = size[left][:, None], size[right][None, :]
        near &= np.minimum(n, m) * 100 >= percent * np.maximum(n, m)
        rows, cols = np.nonzero(near)
        links = []
        if len(rows):
            sets = [[flat[ends[i] : ends[i + 1]] for i in side] for side in (left, right)]
            both = shared_counts(*sets, (rows, cols))
            like = 100 * both >= percent * (size[left][rows] + size[right][cols] - both)
            links = list(spanning(zip(ids[left[rows[like]]].tolist(), ids[right[cols[like]]].tolist(), strict=True)))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.groupBy("cluster", "low", "high").applyInArrow(compare, "a bigint, b bigint")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(set, hashes): the classes and full sets of all texts of the documents in ``ids`` (doc)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            found = [shingle_hashes(t.as_py(), shingle) for t in b.column(1)]
            own = [np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), "<i8")[0] for x in found]
            offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["set", "hashes"]
            )

    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text").join(ids, "doc", "left_semi")
    return wanted.mapInArrow(run, "set bigint, hashes array<bigint>")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked if their shingle sets have ``percent`` % in common; component_id is the
    smallest doc_id that links reach. Null, empty and wordless texts have no shingles and no
    links. Rows that repeat a doc_id are one document linked by any of its texts. A null doc_id
    gets a null component and is kept. An empty table gives an empty result.
    """
    signed = materialize(signatures(docs, shingle), "minhash-signatures")
    named = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # A class goes by half of its set's 128-bit hash, not by a doc_id, which may stand on several texts.
    classes = named.groupBy(F.col("hi").alias("id")).agg(F.min("doc_id").alias("doc"), F.max("sig").alias("sig"))
    classes = materialize(classes, "minhash-classes")
    reps = classes.select("id", "sig")
    candidates = candidate_links(reps)
    clusters = components(candidates, "minhash-candidates").withColumnRenamed("component_id", "cluster")
    clusters = materialize(clusters, "minhash-clusters")
    sizes = clusters.groupBy(F.col("cluster").alias("_c")).agg((F.floor((F.count("*") - 1) / BLOCK)).cast("int").alias("last"))
    placed = clusters.join(sizes, F.col("cluster") == F.col("_c")).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("last") + 1).cast("int")
    )
    holders = classes.join(clusters.select("id"), "id", "left_semi").select("doc").distinct()
    sets = full_sets(docs, holders, shingle).dropDuplicates(["set"]).withColumnRenamed("set", "id")
    full = materialize(sets.join(reps, "id"), "minhash-sets")
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    blocks = placed.select(F.col("id").alias("_i"), "cluster", "block", other).join(full, F.col("_i") == F.col("id")).select(
        "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "sig", "hashes"
    )
    links = materialize(block_links(blocks, percent), "minhash-links")
    # A document with several texts links their classes.
    several = named.groupBy("doc_id").agg(F.min("hi").alias("a"), F.max("hi").alias("z")).filter("a != z")
    own = named.join(several.select(F.col("doc_id").alias("_d"), "a"), F.col("doc_id") == F.col("_d")).select("a", F.col("hi").alias("b"))
    links = links.unionByName(own.filter("a != b").distinct())
    found = materialize(components(links, "minhash"), "minhash-components")
    of = found.withColumnRenamed("id", "_id")
    rooted = classes.join(of, F.col("id") == F.col("_id"), "left").select("id", "doc", F.coalesce("component_id", "id").alias("part"))
    least = rooted.groupBy(F.col("part").alias("_p")).agg(F.min("doc").alias("_c"))
    rooted = rooted.join(least, F.col("part") == F.col("_p")).select(F.col("id").alias("_h"), "_c")
    out = signed.join(rooted, (F.col("hi") == F.col("_h")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id."""
    gone = near_duplicates(docs, shingle, percent).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [1] ELSE range(1, len(ws)) END) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS sh FROM p),
n AS (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
c AS (SELECT doc_id, n, array_agg(sh ORDER BY f, sh) AS shs FROM (SELECT s.*, count(*) OVER (PARTITION BY sh) AS f FROM s) JOIN n USING (doc_id) GROUP BY doc_id, n),
pre AS (SELECT doc_id, n, unnest(shs[1:n - CAST(ceil(n * 0.8) AS BIGINT) + 1]) AS sh FROM c),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM pre x JOIN pre y ON x.sh = y.sh AND x.doc_id < y.doc_id
         WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
both_ AS (SELECT a, b, na, nb, count(*) AS k FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.sh = x.sh GROUP BY a, b, na, nb),
e AS (SELECT a, b FROM both_ WHERE 100 * k >= 80 * (na + nb - k)),
link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN link l ON l.a = r.id WHERE r.root < l.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id, n.doc_id = min(r.root) AS kept
FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n
"""


@query("op4_minhash_dedup", SQL)
def op4(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), shingle=2)


ship(__name__)
