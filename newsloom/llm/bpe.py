"""Byte-level BPE encoding and decoding.

Text is split by the vocabulary's pattern in the JVM. Of the distinct words of a block of documents
those that are a piece as a whole take its id, which their own merges end in; the others are folded
with higher-order functions: each word is an array of byte ids, and step by step the adjacent pair
with the lowest rank, the leftmost first, becomes one id until no pair has a rank. The rank map is
literal arrays addressed by the two ids. Blocks travel with their documents inside one stage, so no
text is shuffled and no vocabulary of the whole corpus is ever held. Decoding concatenates the binary
pieces of the ids.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.llm.common import query, ship, table
from newsloom.session import arrow_batches, materialize

#: Any rank is below; what a lookup gives for a pair without rank is not.
NONE = 65536
#: The fold is quadratic in a word's length; longer words are merged over a heap, by the same rule.
FOLD_BYTES = 128
#: Words whose ids are put together at once; what that takes is several arrays of 8 bytes an id.
PIECE_WORDS = 250_000

# The pattern's white space in full, as Java's \s is ASCII only.
SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def java_pattern(pattern: str) -> str:
    r"""The split pattern with \s and \S spelled out for Java."""
    return (
        pattern.replace(r"[^\s\p{L}\p{N}]", "[^" + SPACE + r"\p{L}\p{N}]")
        .replace(r"\s+(?!\S)", "[" + SPACE + "]+(?![^" + SPACE + "])")
        .replace(r"|\s+", "|[" + SPACE + "]+")
    )


def read_ranks(path: str) -> list[bytes]:
    """The pieces in rank order; a piece's id is its rank."""
    with open(path, "rb") as lines:
        pieces = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, lines))
    assert [r for r, _ in pieces] == list(range(len(pieces)))
    return [p for _, p in pieces]


def pair_ranks(pieces: list[bytes]) -> dict[tuple[int, int], int]:
    """Every pair of pieces that together are a piece, with the rank of that."""
    ids = {p: i for i, p in enumerate(pieces)}
    return {
        (ids[p[:k]], ids[p[k:]]): i
        for i, p in enumerate(pieces)
        for k in range(1, len(p))
        if p[:k] in ids and p[k:] in ids
    }


def placed_pairs(pairs: dict[tuple[int, int], int], ids: int) -> tuple[list[int], list[int]]:
    """(shift per first id, packed pair and rank per slot): the pair table without collisions.

    The slot of a pair is the shift of its first id plus the second id, and holds the first id and the
    rank. The ids with most pairs choose their shifts first; each slot has one pair at most.
    """
    import numpy as np

    rows: dict[int, list[tuple[int, int]]] = {}
    for (one, two), rank in pairs.items():
        rows.setdefault(one, []).append((two, rank))
    shift, packed = [0] * ids, np.full(4 * ids + 4 * len(pairs), (ids + 1) << 17, np.int64)
    free = np.ones(len(packed), bool)
    span, start, top = np.arange(64)[:, None], 0, ids
    for one in sorted((x for x in rows if len(rows[x]) > 1), key=lambda x: (-len(rows[x]), x)):
        seconds, ranks = np.array(rows[one], np.int64).T
        at = start
        while not (fits := free[at + span + seconds].all(axis=1)).any():
            at += 64
        shift[one] = at + int(np.argmax(fits))
        slots = shift[one] + seconds
        free[slots], packed[slots] = False, (one << 17) + ranks
        top = max(top, int(slots.max()) + 1)
        start = (start + 40503) % (ids + len(pairs))
    # Ids of one pair fill the gaps from ``ids`` on, where no shift is negative.
    single = [one for one in rows if len(rows[one]) == 1]
    for one, slot in zip(single, (ids + np.flatnonzero(free[ids:])[: len(single)]).tolist(), strict=True):
        (two, rank), = rows[one]
        shift[one], packed[slot], top = slot - two, (one << 17) + rank, max(top, slot + 1)
    return shift, packed[:top].tolist()


@lru_cache(maxsize=2)
def placed(pieces: tuple[bytes, ...]) -> tuple[list[int], list[int]]:
    """The pair table of a vocabulary, made once."""
    return placed_pairs(pair_ranks(list(pieces)), len(pieces) + 1)


def literal(values: list[int], kind: str) -> Column:
    """A constant array of ``kind``."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), f"array<{kind}>")


class Ranks:
    """The rank map as literals of a bounded size: one entry per pair of pieces that has a rank, or little more."""

    def __init__(self, pieces: list[bytes]):
        own = {p: i for i, p in enumerate(pieces)}
        shift, packed = placed(tuple(pieces))
        self.shift, self.packed = literal(shift, "int"), literal(packed, "bigint")
        self.bytes = literal([own[bytes([i])] for i in range(256)], "int")
        #: An id before every word; it has no pair.
        self.edge = F.lit(len(pieces))

    def lookup(self, body) -> Column:
        """``body(of)`` with the literals bound once, as every use of one is a copy in each task.

        of(one, two) is the pair's rank; NONE or more if it has none, null if there is no pair. A slot of
        another first id differs in the bits above the rank, so the difference is out of range.
        """

        def bound(shift: Column, packed: Column) -> Column:
            return body(lambda one, two: F.abs(F.get(packed, F.get(shift, one) + two) - F.shiftleft(one.cast("bigint"), 17)))

        return let(self.shift, lambda shift: let(self.packed, lambda packed: bound(shift, packed)))


def fold_word(word: Column, ranks: Ranks) -> Column:
    """array<int>: the ids of a word of at least one byte.

    The fold carries the ids, after ``edge``, and the rank of each with its right neighbour. A merge puts
    the new id in place of two and looks up its two new neighbourhoods only.
    """

    def merge(s: Column, low: Column, of) -> Column:
        ids, own = s["ids"], s["ranks"]
        return let(F.array_position(own, low).cast("int"), lambda at: F.struct(
            F.concat(F.slice(ids, 1, at - 1), F.array(low.cast("int")), F.slice(ids, at + 2, FOLD_BYTES)).alias("ids"),
            F.concat(
                F.slice(own, 1, at - 2),
                F.array(of(F.get(ids, at - 2), low.cast("int")), of(low.cast("int"), F.get(ids, at + 1))),
                F.slice(own, at + 2, FOLD_BYTES),
            ).alias("ranks"),
        ))

    chars = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
    start = F.concat(F.array(ranks.edge), F.transform(chars, lambda c: F.get(ranks.bytes, F.ascii(c))))
    step = lambda of: lambda s, _: let(F.array_min(s["ranks"]), lambda low: F.when(low < NONE, merge(s, low, of)).otherwise(s))
    return ranks.lookup(lambda of: let(start, lambda ids: F.aggregate(
        F.slice(ids, 3, FOLD_BYTES),
        F.struct(ids.alias("ids"), F.transform(ids, lambda x, i: of(x, F.get(ids, i + 1))).alias("ranks")),
        step(of),
        lambda s: F.slice(s["ids"], 2, FOLD_BYTES),
    )))


def merge_long(word: bytes, ids: dict[bytes, int]) -> list[int]:
    """The same merges over a heap of candidate pairs, for words too long for the fold."""
    import heapq

    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(at):
        nxt = end[at]
        if nxt < n and (rank := ids.get(word[at : end[nxt]])) is not None:
            heapq.heappush(heap, (rank, at, nxt, end[nxt]))

    for at in range(n):
        offer(at)
    while heap:
        _, at, mid, stop = heapq.heappop(heap)
        if not alive[at] or end[at] != mid or not alive[mid] or end[mid] != stop:
            continue
        alive[mid] = False
        end[at] = stop
        if stop < n:
            before[stop] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    out, at = [], 0
    while at < n:
        out.append(ids[word[at : end[at]]])
        at = end[at]
    return out


def gather(starts, sizes, values):
    """The concatenation of values[start : start + size] over all entries."""
    import numpy as np

    total = np.cumsum(sizes)
    shift = np.repeat(starts - (total - sizes), sizes)
    return values[shift + np.arange(len(shift))]


def pieces_of(offsets, at: int, end: int, most: int = PIECE_WORDS):
    """Runs of the documents ``at`` to ``end`` of about ``most`` words, or of one document."""
    import numpy as np

    cuts = np.searchsorted(offsets[at : end + 1], np.arange(offsets[at] + most, offsets[end], most)) + at
    bounds = sorted({at, *cuts.tolist(), end})
    return list(zip(bounds, bounds[1:], strict=False))


def concatenated(ids, pieces: list[bytes]):
    """The bytes of each list of ``ids``, null for null."""
    import numpy as np

    sizes = np.array([len(p) for p in pieces], np.int64)
    starts, values = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(pieces), np.uint8)
    flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    for known, i, j in zip(ids.is_valid().to_pylist(), offsets, offsets[1:], strict=False):
        yield gather(starts[flat[i:j]], sizes[flat[i:j]], values).tobytes() if known else None


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with the column ids (array<int>) in place of text.

    A null or empty text has no ids. Repeated rows are encoded each; an empty table gives an empty
    result; further columns pass through, but for one named ids.
    """
    return encoded_as(docs, path, pattern, "ids array<int>", lambda ids: [ids])


def split_words(pattern: str, text: Column) -> Column:
    """array<string>: the matches of the pattern."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def encoded_as(docs: DataFrame, path: str, pattern: str, schema: str, finish) -> DataFrame:
    """As ``encode``, with what ``finish`` makes of an Arrow array of id lists in place of ids."""
    import pyarrow as pa

    pieces = read_ranks(path)
    whole_words = pa.array(pieces, pa.binary())
    names = [f.split()[0] for f in schema.split(", ")]
    rest = [c for c in docs.columns if c not in ("text", *names)]
    carried = docs.select(F.struct(*rest).alias("row"), split_words(pattern, F.col("text")).alias("words"))
    row = carried.schema["row"].dataType.simpleString()

    def distinct(batches):
        """Each block's distinct words on its first row, every row its word numbers.

        A whole piece is settled by its id; the others have -1 and are in the block.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            coded = lists.flatten().dictionary_encode()
            numbers = pa.ListArray.from_arrays(lists.offsets, coded.indices.cast(pa.int32()))
            first = np.zeros(b.num_rows + 1, np.int32)
            first[1:] = len(coded.dictionary)
            at = pa.compute.index_in(coded.dictionary.cast(pa.binary()), value_set=whole_words)
            whole = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
            other = coded.dictionary.filter(pa.array(whole == -1))
            settled = pa.ListArray.from_arrays(pa.array(first), pa.array(whole))
            block = pa.ListArray.from_arrays(pa.array(np.minimum(first, len(other))), other)
            starts = pa.array(np.arange(b.num_rows) == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), numbers, settled, block, starts], names=["row", "numbers", "settled", "block", "starts"])

    blocks = carried.mapInArrow(distinct, f"row {row}, numbers array<int>, settled array<int>, block array<string>, starts boolean")
    ranks = Ranks(pieces)
    folded = F.transform("block", lambda w: F.when(F.octet_length(w) <= FOLD_BYTES, fold_word(w, ranks)))
    long_words = F.filter("block", lambda w: F.octet_length(w) > FOLD_BYTES)
    blocks = blocks.select("row", "numbers", "settled", "starts", folded.alias("folded"), long_words.alias("long"))

    def assemble(batches):
        """Puts each document's ids together from the ids of its block's words."""
        import numpy as np
        import pyarrow as pa

        starts = sizes = values = own = None
        for b in batches:
            if not b.num_rows:
                continue
            numbers, heads = b.column(1), np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
            flat, offsets = numbers.values.to_numpy(zero_copy_only=False), numbers.offsets.to_numpy()
            ends = [*heads[heads > 0].tolist(), b.num_rows]
            at, parts = 0, []
            for end in ends:
                if at in heads:
                    words, whole = b.column(4)[at].values, b.column(2)[at].values.to_numpy(zero_copy_only=False)
                    found = words.to_pylist() if words.null_count else None
                    if found is None:
                        flat_ids = words.flatten().to_numpy(zero_copy_only=False)
                        lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    else:
                        own = own or {p: i for i, p in enumerate(pieces)}
                        spare = iter(b.column(5)[at].as_py())
                        found = [x if x is not None else merge_long(next(spare).encode(), own) for x in found]
                        lengths = np.array([len(x) for x in found], np.int64)
                        flat_ids = np.array([y for x in found for y in x], np.int32)
                    sizes = np.ones(len(whole), np.int64)
                    sizes[whole < 0] = lengths
                    starts, values = np.cumsum(sizes) - sizes, np.repeat(whole, sizes)
                    values[values < 0] = flat_ids
                for i, j in pieces_of(offsets, at, end):
                    picked = flat[offsets[i] : offsets[j]]
                    lengths = sizes[picked]
                    ids = gather(starts[picked], lengths, values)
                    upto = np.r_[0, np.cumsum(lengths)]
                    doc_ends = upto[offsets[i : j + 1] - offsets[i]].astype(np.int32)
                    made = pa.ListArray.from_arrays(pa.array(doc_ends), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *finish(made)], names=["row", *names])
                at = end

    return blocks.mapInArrow(assemble, f"row {row}, {schema}").select("row.*", *names)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the column bytes (binary): the concatenated pieces of ``ids``. Null ids give null."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    pieces = read_ranks(path)
    names = encoded.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = pa.array(concatenated(b.column(names.index("ids")), pieces), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*names, "bytes"])

    schema = StructType([*encoded.schema.fields, StructField("bytes", BinaryType())])
    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """Encodes and decodes: the columns of ``docs`` without text, n_tokens and two digests.

    Ids are digested as little-endian unsigned 32-bit integers, and decoded, where they are put together.
    With ``block_bytes`` the result is written at once, from blocks of that size; small ones take less memory
    and fold more words again.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pieces = read_ranks(path)

    def finish(ids):
        import hashlib

        import numpy as np
        import pyarrow as pa

        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        coded = [hashlib.sha256(flat[i:j].tobytes()).hexdigest() for i, j in zip(offsets, offsets[1:], strict=False)]
        decoded = [hashlib.sha256(x).hexdigest() for x in concatenated(ids, pieces)]
        return [pa.array(np.diff(offsets), pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    encoded = encoded_as(docs, path, public_tokenizers.PATTERN, schema, finish)
    if block_bytes is None:
        return encoded
    with arrow_batches(docs.sparkSession, block_bytes):
        return materialize(encoded, "round-trip")


@query("op3_byte_bpe")
def op3(spark, sf):
    return round_trip(table(spark, sf, "documents").select("doc_id", "text"))


ship(__name__)
