"""Repeated passages by sparse suffix arrays.

Positions are chosen by content: of every 41 consecutive ten-word grams the one with the least
hash is kept. A passage of 50 words holds 41 grams, so wherever it stands the same one of its
positions is kept. Only the suffixes at kept positions whose gram occurs in several documents are
sorted, once by the words to their right and once by the words to their left read backwards.
Neighbours in either order are compared, and each match is extended to the left and right of the
gram; matches of 50 words or more are merged into passages per document.

Suffixes that share a passage only in part to the right and in part to the left of the gram need
not be neighbours in either order. The sorts tell how far each suffix agrees with any other
document on either side; where the windows of 50 words within that reach are not all in passages
found, an exact step groups those windows of the gram by their hashes.

Both sorts are range sorts that break ties by document, so a passage that a third of the documents
share is spread over many partitions, and neighbours across partition borders are compared apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from newsloom.llm.common import query, ship, table
from newsloom.session import materialize

MIN_WORDS = 50
GRAM = 10


def word_hashes(words: list[bytes], known: dict[bytes, int]):
    """64-bit hashes of the words; ``known`` remembers them across texts."""
    import numpy as np
    import xxhash

    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def gram_hashes(hashes, gram: int):
    """A mixed polynomial hash of every run of ``gram`` words."""
    import numpy as np

    base = np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(len(hashes) - gram + 1, np.uint64)
    for i in range(gram):
        out = out * base + hashes[i : i + len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def sliding(values, width: int, pick):
    """``pick`` (minimum or maximum) over every window of ``width``, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(grams, width: int):
    """Positions that hold the least value of some window of ``width``; one window if there are fewer."""
    import numpy as np

    width = min(width, len(grams))
    least = sliding(grams, width, np.minimum)
    top = np.iinfo(np.uint64).min
    padded = np.concatenate([np.full(width - 1, top, np.uint64), least, np.full(width - 1, top, np.uint64)])
    return np.flatnonzero(sliding(padded, width, np.maximum) == grams)


def chosen_positions(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, hi, lo, n_words, grams, places) of documents long enough to hold a passage."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        known: dict[bytes, int] = {}
        for b in batches:
            rows = []
            if len(known) > 300_000:
                known.clear()
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                if len(words) < min_words or doc is None:
                    continue
                hashes = word_hashes(words, known)
                found = gram_hashes(hashes, gram)
                at = minimisers(found, min_words - gram + 1)
                both = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8")
                rows.append((doc, both[0], both[1], len(words), found[at].view(np.int64), at.astype(np.int32)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=["doc_id", "hi", "lo", "n_words", "grams", "places"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, hi bigint, lo bigint, n_words bigint, grams array<bigint>, places array<int>"
    )


def contexts(docs: DataFrame, wanted: DataFrame, min_words: int, gram: int) -> DataFrame:
    """(gram, doc_id, place, right, left): 32-bit word hashes beside the gram, left ones read backwards.

    ``wanted`` has (doc_id, spots array<struct<place, gram>>). As many words as a passage needs
    are enough on either side: longer matches are the union of those around their own positions.
    """
    reach = min_words - gram

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known: dict[bytes, int] = {}
        for b in batches:
            if len(known) > 300_000:
                known.clear()
            for doc, text, spots in zip(*(b.column(i) for i in range(3)), strict=True):
                words = (text.as_py() or "").encode().split()
                short = (word_hashes(words, known) >> np.uint64(32)).astype(">u4")
                back = short[::-1]
                n, doc, spots = len(words), doc.as_py(), spots.as_py()
                at = [s["place"] for s in spots]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s["gram"] for s in spots], pa.int64()), pa.array([doc] * len(at), pa.int64()),
                        pa.array(at, pa.int32()),
                        pa.array([short[p + gram : p + gram + reach].tobytes() for p in at], pa.binary()),
                        pa.array([back[n - p : n - p + reach].tobytes() for p in at], pa.binary()),
                    ],
                    names=["gram", "doc_id", "place", "right", "left"],
                )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    joined = texts.join(wanted.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"))
    return joined.select("doc_id", "text", "spots").mapInArrow(
        run, "gram bigint, doc_id bigint, place int, right binary, left binary"
    )


def common_words(a: bytes, b: bytes) -> int:
    """How many four-byte words two strings share from the start."""
    if a == b:
        return len(a) // 4
    low, high = 0, min(len(a), len(b)) // 4
    while low < high:
        mid = (low + high + 1) // 2
        if a[: 4 * mid] == b[: 4 * mid]:
            low = mid
        else:
            high = mid - 1
    return low


def spans_of(x: tuple, y: tuple, min_words: int, gram: int):
    """The match of two suffixes (gram, doc, place, right, left), as a span in each document."""
    if x[0] != y[0] or x[1] == y[1]:
        return
    right = gram + common_words(x[3], y[3])
    left = common_words(x[4], y[4])
    if left + right >= min_words:
        yield x[1], x[2] - left, x[2] + right, y[1]
        yield y[1], y[2] - left, y[2] + right, x[1]


def neighbour_spans(suffixes: DataFrame, side: str, min_words: int, gram: int) -> DataFrame:
    """(doc_id, start, end, other) from neighbours in the order of (gram, ``side``), and (doc_id, place, agree).

    The latter is how many words a suffix shares on that side with any other document; suffixes in
    the first and last run of a partition have all words of a passage, as their neighbours are elsewhere.
    """
    schema = "part int, edge int, tip boolean, gram bigint, doc_id bigint, place int, right binary, left binary, start int, end int, other bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first_run, leading, current = [], True, []
        words = 3 if side == "right" else 4

        def agreeing(agree, x, y):
            if x[0] == y[0] and x[1] != y[1]:
                n = common_words(x[words], y[words])
                for z in (x, y):
                    agree[z[1], z[2]] = max(n, agree.get((z[1], z[2]), 0))

        def table_of(spans, edges, agree):
            rows = [(part, -1, None, None, d, p, None, None, n, None, None) for (d, p), n in agree.items()]
            rows += [(part, 0, None, None, d, None, None, None, s, e, o) for d, s, e, o in spans]
            rows += [(part, edge, tip, *x, None, None, None) for edge, tip, x in edges]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            spans, agree = set(), {}
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                # ``current``: the latest rows of one gram and document; the next other document meets them all.
                if current and (current[-1][0], current[-1][1]) != (row[0], row[1]):
                    if leading:
                        first_run, leading = current, False
                    last = current[-1]
                    for x in current:
                        spans.update(spans_of(x, row, min_words, gram))
                        agreeing(agree, x, row)
                    before, current = last, [row]
                else:
                    if current and not leading:
                        spans.update(spans_of(before, row, min_words, gram))
                        agreeing(agree, before, row)
                    current.append(row)
            yield table_of(spans, [], agree)
        if current:
            if leading:
                first_run = current
            ends = [(1, x is first_run[0], x) for x in first_run] + [(2, x is current[-1], x) for x in current]
            yield table_of([], ends, {(x[1], x[2]): min_words - gram for _, _, x in ends})

    order = ["gram", side, "doc_id", "place"]
    placed = suffixes.select("gram", "doc_id", "place", "right", "left")
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(placed.mapInArrow(run, schema), f"suffixes-{side}")

    # The last run of a partition meets the first row of the next, the first run the last row before it.
    edges = found.filter("edge > 0")
    parts = edges.select("part").distinct().withColumn("to", F.lead("part").over(Window.orderBy("part")))
    ends = edges.filter("edge = 2").join(parts, "part").select(F.col("to").alias("_p"), F.col("tip").alias("_x"), *[F.col(c).alias(f"x_{c}") for c in SUFFIX])
    starts = edges.filter("edge = 1").select(F.col("part").alias("_q"), F.col("tip").alias("_y"), *[F.col(c).alias(f"y_{c}") for c in SUFFIX])
    across = ends.join(starts, (F.col("_p") == F.col("_q")) & (F.col("x_gram") == F.col("y_gram")) & (F.col("_x") | F.col("_y"))).drop("_p", "_q", "_x", "_y")

    def meet(batches):
        import pyarrow as pa

        for b in batches:
            spans = set()
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans.update(spans_of(row[:5], row[5:], min_words, gram))
            cols = list(zip(*spans, strict=True)) if spans else [()] * 4
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "end", "other"])

    bridged = across.mapInArrow(meet, "doc_id bigint, start int, end int, other bigint")
    agree = found.filter("edge = -1").select("doc_id", "place", F.col("start").alias("agree"))
    return found.filter("edge = 0").select("doc_id", "start", "end", "other").unionByName(bridged), agree


SUFFIX = ("gram", "doc_id", "place", "right", "left")


def window_spans(suffixes: DataFrame, right: DataFrame, left: DataFrame, found: DataFrame, min_words: int, gram: int) -> DataFrame:
    """(doc_id, start, end, other): windows of ``min_words`` words that other documents have, where merged spans leave any open.

    ``right`` and ``left`` have (doc_id, place, agree), which bound the windows that can be shared at
    all. A suffix is open if its windows in bounds are not all in one span. Every suffix of its gram is
    compared with it, by the least and greatest document of each window; only windows of open suffixes
    come back as rows, as those of the others are in spans already.
    """
    reach = min_words - gram
    zero = F.lit(0)
    both = right.select("doc_id", "place", F.col("agree").alias("r"), zero.alias("l")).unionByName(
        left.select("doc_id", "place", zero.alias("r"), F.col("agree").alias("l"))
    )
    both = both.groupBy(F.col("doc_id").alias("_d"), F.col("place").alias("_p")).agg(F.max("r").alias("r"), F.max("l").alias("l"))
    covered = found.groupBy(F.col("doc_id").alias("_e")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    inside = F.exists("spans", lambda s: (s["start_word"] <= F.col("_p") - F.col("l")) & (s["end_word"] >= F.col("_p") + gram + F.col("r")))
    in_reach = both.filter(F.col("r") + F.col("l") >= reach).join(covered, F.col("_d") == F.col("_e"), "left").select(
        "_d", "_p", "r", "l", (~F.coalesce(inside, F.lit(False))).alias("open")
    )
    # Decided on numbers alone; the words beside a gram are fetched only where its gram has an open suffix.
    placed = suffixes.select(F.col("gram").alias("_g"), "doc_id", "place").distinct().join(
        in_reach, (F.col("doc_id") == F.col("_d")) & (F.col("place") == F.col("_p"))
    )
    placed = materialize(placed.select("_g", "_d", "_p", "r", "l", "open"), "suffixes-in-reach")
    grams = placed.filter("open").select(F.col("_g").alias("_o")).distinct()
    undecided = materialize(placed.join(grams, F.col("_g") == F.col("_o"), "left_semi"), "suffixes-undecided")
    here = (F.col("gram") == F.col("_g")) & (F.col("doc_id") == F.col("_d")) & (F.col("place") == F.col("_p"))

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            ends, rows = {}, []
            for g, doc, place, after, before, r, l, is_open in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k in range(max(0, reach - min(r, len(after) // 4)), min(l, reach, len(before) // 4) + 1):
                    key = g, xxhash.xxh3_64_intdigest(before[: 4 * k] + b"|" + after[: 4 * (reach - k)], k) - 2**63
                    low, high = ends.get(key, (doc, doc))
                    ends[key] = min(low, doc), max(high, doc)
                    if is_open:
                        rows.append((*key, None, None, doc, place - k))
            rows += [(*key, *pair, None, None) for key, pair in ends.items()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64()] * 5 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["gram", "h", "a", "z", "doc_id", "start"])

    windows = suffixes.join(undecided, here).select(*SUFFIX, "r", "l", "open").mapInArrow(
        run, "gram bigint, h bigint, a bigint, z bigint, doc_id bigint, start int"
    )
    windows = materialize(windows, "suffix-windows")
    shared = windows.filter("a IS NOT NULL").groupBy(F.col("gram").alias("_g"), F.col("h").alias("_h")).agg(
        F.min("a").alias("low"), F.max("z").alias("high")
    ).filter("low != high")
    wanted = windows.filter("a IS NULL").select("gram", "h", "doc_id", "start").distinct()
    return wanted.join(shared, (F.col("gram") == F.col("_g")) & (F.col("h") == F.col("_h"))).select(
        "doc_id", "start", (F.col("start") + min_words).cast("int").alias("end"),
        F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other"),
    )


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document as one, with the smallest other document."""
    grouped = spans.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "other"))).alias("spans")
    )

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out, spans = [], b.column(1)
            first = spans.offsets[0].as_py() if len(spans) else 0
            fields = [f.to_pylist() for f in spans.flatten().flatten()]
            ends = [o - first for o in spans.offsets.to_pylist()]
            for row, doc in enumerate(b.column(0).to_pylist()):
                low = None
                for k in range(ends[row], ends[row + 1]):
                    start, end, other = fields[0][k], fields[1][k], fields[2][k]
                    if low is not None and start <= high:
                        high, least = max(high, end), min(least, other)
                    else:
                        if low is not None:
                            out.append((doc, low, high, least))
                        low, high, least = start, end, other
                out.append((doc, low, high, least))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start_word", "end_word", "other_doc_id"])

    return grouped.mapInArrow(run, "doc_id bigint, start_word bigint, end_word bigint, other_doc_id bigint")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, other_doc_id): passages that other documents repeat.

    A row is a longest run of words, end exclusive, covered by matches of ``min_words`` words or
    more with other documents; other_doc_id is the smallest of the documents it was matched with.
    Documents whose words are all equal are one class: each copy has one row over its whole text.
    Null, empty and short texts have no rows, nor has a null doc_id; rows that repeat a doc_id are
    one document and not copies of each other. An empty table gives an empty result.
    """
    chosen = materialize(chosen_positions(docs, min_words, gram), "suffix-positions")
    classes = chosen.groupBy("hi", "lo").agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.max("n_words").alias("n_words")
    )
    classes = materialize(classes, "suffix-classes")
    reps = classes.select(F.col("rep").alias("_r")).distinct()
    spots = chosen.join(reps, F.col("doc_id") == F.col("_r"), "left_semi").select(
        "doc_id", F.explode(F.arrays_zip(F.col("places").alias("place"), F.col("grams").alias("gram"))).alias("s")
    ).select("doc_id", "s.place", "s.gram")
    shared = spots.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a != z")
    wanted = spots.join(shared.select(F.col("gram").alias("_g")), F.col("gram") == F.col("_g")).groupBy("doc_id").agg(
        F.collect_set(F.struct("place", "gram")).alias("spots")
    )
    suffixes = materialize(contexts(docs, wanted, min_words, gram), "suffixes")
    (one, right), (two, left) = (neighbour_spans(suffixes, side, min_words, gram) for side in ("right", "left"))
    found = materialize(merged(one.unionByName(two)), "suffix-spans")
    spans = found.select("doc_id", F.col("start_word").cast("int").alias("start"), F.col("end_word").cast("int").alias("end"), F.col("other_doc_id").alias("other"))
    own = merged(spans.unionByName(window_spans(suffixes, right, left, found, min_words, gram)))
    copied = classes.filter("rep != last")
    members = chosen.select("doc_id", "hi", "lo").join(
        copied.select(F.col("hi").alias("_h"), F.col("lo").alias("_l"), "rep", "last", "n_words"),
        (F.col("hi") == F.col("_h")) & (F.col("lo") == F.col("_l")),
    )
    whole = members.select(
        "doc_id", F.lit(0).cast("bigint").alias("start_word"), F.col("n_words").alias("end_word"),
        F.when(F.col("doc_id") == F.col("rep"), F.col("last")).otherwise(F.col("rep")).alias("other_doc_id"),
    ).distinct()
    single = own.join(copied.select(F.col("rep").alias("_r")), F.col("doc_id") == F.col("_r"), "left_anti")
    return single.unionByName(whole).select(
        "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id"
    )


@query("op5_suffix_dedup")
def op5(spark, sf):
    return repeated_passages(table(spark, sf, "documents"))


ship(__name__)
