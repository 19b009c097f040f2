"""Token-id shards with a minimal perfect hash index.

File format, three Parquet tables in one folder:

* ``starts``: shard, start (ids of all shards before it).
* ``shards``: shard, n_ids, payload (the raw ids of its documents one
  after the other, little-endian unsigned 16 bits; larger vocabularies are refused), entries (key, offset, n per document, in
  ids). Shards follow ascending doc_id and are bounded in ids and in documents.
* ``index``: one row per hash bucket of keys: seeds (one displacement per group of keys), prints
  (a 32-bit fingerprint per slot), places (shard, offset, n per slot), tied. A key's bucket, group and
  slot follow from its hash and the group's seed, and every slot is taken by exactly one hash: a
  lookup reads one row, compares one fingerprint and has the place. Keys that share all 64 bits of
  their hash are in ``tied``, with a second hash to tell them apart.

A key is the doc_id and, for repeated ids, its number among them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from newsloom.llm.common import query, ship, table
from newsloom.llm.mixing import prefix_sums
from newsloom.session import scratch_path

SHARD_IDS = 500_000
SHARD_DOCS = 10_000
BUCKET_KEYS = 2_000
GROUP_KEYS = 4
#: Words and pieces a worker remembers before it starts anew.
REMEMBERED = 350_000

WORKER: dict = {}


def piece_encoder(tokenizer_json: str):
    """ids(text) by the tokenizers library, remembering words.

    White space never reaches the merges of this kind of vocabulary, so a text is encoded word by
    word. A new word of plain letters is split like the vocabulary's pattern does, and new pieces
    go to the library's model; any other word goes through the whole tokenizer. So does a text that
    holds the string of a special token, which the library turns into that token.
    """
    import array
    import json
    import string

    import regex
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(tokenizer_json)
    spec = json.loads(tokenizer_json)
    special = [t["content"] for t in spec["added_tokens"] if not t["normalized"]]
    folded = [t["content"].lower() for t in spec["added_tokens"] if t["normalized"]]
    split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    shown = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    model = whole.model
    words: dict[bytes, bytes] = {}
    pieces: dict[str, bytes] = {}
    plain = regex.compile("[\x00-\u024f]*").fullmatch

    def piece_ids(piece):
        ids = pieces.get(piece)
        if ids is None:
            seen = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(shown)
            ids = array.array("H", [t.id for t in model.tokenize(seen)]).tobytes()
            if len(pieces) >= REMEMBERED:
                pieces.clear()
            pieces[piece] = ids
        return ids

    def word_ids(word):
        text = word.decode()
        # Below U+0250 composition changes nothing and lower case is letter by letter.
        if not (text.isascii() or plain(text)):
            return array.array("H", whole.encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower()
        bare = text.rstrip(string.punctuation)
        if bare.isalpha():
            # Letters and then punctuation: the pattern makes one piece of either.
            end = text[len(bare) :]
            return piece_ids(bare) + piece_ids(end) if end else piece_ids(bare)
        return b"".join([piece_ids(p) for p in split.findall(text)])

    def encode(text):
        if any(t in text for t in special) or (folded and any(t in text.lower() for t in folded)):
            return array.array("H", whole.encode(text, add_special_tokens=False).ids).tobytes()
        found = text.encode().split()
        out = list(map(words.get, found))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    w = found[i]
                    ids = words.get(w)
                    if ids is None:
                        if len(words) >= REMEMBERED * 2:
                            words.clear()
                        ids = words[w] = word_ids(w)
                    out[i] = ids
        return b"".join(out)

    return encode


def id_bounds(docs: DataFrame) -> list[int]:
    """Ids that cut the table into about as many equal ranges as a shuffle has partitions."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return []
    return sorted(set(docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), shares, 10 * parts)).first()[0] or []))


def encoded(docs: DataFrame, tokenizer_json: str, end_id: int, bounds: list[int]) -> DataFrame:
    """(doc_id, raw, n, part): the ids of the whole text and the end id, 16 bits each, and the range of the doc_id."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        if "encode" not in WORKER:
            WORKER["encode"] = piece_encoder(tokenizer_json)
        last = np.array([end_id], "<u2").tobytes()
        for b in batches:
            raw = [WORKER["encode"](t.as_py() or "") + last for t in b.column(1)]
            ids = b.column(0).fill_null(-(2**63)).to_numpy()
            part = np.searchsorted(np.array(bounds, np.int64), ids, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(raw, pa.binary()), pa.array([len(r) // 2 for r in raw], pa.int64()), pa.array(part)],
                names=["doc_id", "raw", "n", "part"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, raw binary, n bigint, part int"
    )


ENTRY = "struct<doc_id:bigint,nth:int,offset:bigint,n:bigint>"


@dataclass
class TokenStore:
    """A written store: its folder and the number of buckets of its index."""

    path: str
    buckets: int

    def shards(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/shards")

    def starts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/starts")

    def index(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/index")


def pack(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """Shards from (doc_id, raw, n) rows: dealt out by ranges of doc_id, sorted, and packed as each partition streams by.

    ``bounds`` are the ranges' lower ends, from the ids alone. (A range repartition of the encoded
    rows would encode every text twice, once for its sample.)
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        made, seen = 0, (object(), 0)
        entries, raws, ids = [], [], 0

        def shard():
            return pa.RecordBatch.from_pylist(
                [{"shard": (part << 32) + made, "n_ids": ids, "payload": b"".join(raws), "entries": entries}], schema=schema
            )

        entry = pa.struct([("doc_id", pa.int64()), ("nth", pa.int32()), ("offset", pa.int64()), ("n", pa.int64())])
        schema = pa.schema([("shard", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("entries", pa.list_(entry))])
        for b in batches:
            for doc, raw, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if raws and (ids + n > SHARD_IDS or len(entries) >= SHARD_DOCS):
                    yield shard()
                    made, entries, raws, ids = made + 1, [], [], 0
                seen = (doc, seen[1] + 1) if seen[0] == doc else (doc, 0)
                entries.append({"doc_id": doc, "nth": seen[1], "offset": ids, "n": n})
                raws.append(raw)
                ids += n
        if raws:
            yield shard()

    placed = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "raw").drop("part")
    return placed.mapInArrow(run, f"shard bigint, n_ids bigint, payload binary, entries array<{ENTRY}>")


def key_hash(doc_id: Column, nth: Column) -> Column:
    return F.xxhash64(doc_id, nth)


def second_hash(doc_id: Column, nth: Column) -> Column:
    return F.xxhash64(F.lit("second"), doc_id, nth)


def bucket_of(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def mixed(h, seed):
    """64 mixed bits of a hash and a seed, both numpy unsigned."""
    import numpy as np

    x = (h ^ (np.atleast_1d(seed) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def groups_of(h, n: int):
    import numpy as np

    return (mixed(h, np.uint64(0)) % np.uint64(max(1, n // GROUP_KEYS))).astype(np.int64)


def slots_of(h, seeds, n: int):
    import numpy as np

    return (mixed(h, seeds.astype(np.uint64) + np.uint64(1)) % np.uint64(n)).astype(np.int64)


def fingerprints(h):
    import numpy as np

    return (mixed(h, np.uint64(0xFFFFFFFF)) >> np.uint64(32)).astype(np.uint32)


def place_keys(hashes):
    """Seeds per group so that the n distinct hashes take the slots 0 to n - 1, each one once.

    The largest groups choose first: a group tries seeds until all its keys land on free slots.
    """
    import numpy as np

    n = len(hashes)
    group = groups_of(hashes, n)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=max(1, n // GROUP_KEYS))
    ends = np.cumsum(sizes)
    seeds, free = np.zeros(len(sizes), np.uint32), np.ones(n, bool)
    tries = np.arange(256, dtype=np.uint64)
    for g in np.argsort(-sizes, kind="stable"):
        if not sizes[g]:
            break
        own = hashes[order[ends[g] - sizes[g] : ends[g]]]
        at = np.uint64(0)
        while True:
            slots = slots_of(own[None, :], (tries + at)[:, None], n)
            fits = free[slots].all(axis=1)
            if sizes[g] > 1:
                ranked = np.sort(slots, axis=1)
                fits &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if fits.any():
                won = int(np.argmax(fits))
                seeds[g] = won + int(at)
                free[slots[won]] = False
                break
            at += np.uint64(len(tries))
    return seeds


PLACE = "struct<shard:bigint,offset:bigint,n:bigint>"


def build_index(entries: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n_keys, seeds, prints, shards, offsets, sizes, tied) from (doc_id, nth, shard, offset, n).

    ``n_keys`` counts distinct hashes; ``tied`` has five 64-bit numbers for each key whose hash another
    one has too: both hashes, shard, offset, n.
    """

    def build(pdf):
        import numpy as np
        import pandas as pd

        h, first, many = np.unique(pdf["h"].to_numpy().astype(np.uint64), return_index=True, return_counts=True)
        seeds = place_keys(h)
        slot = slots_of(h, seeds[groups_of(h, len(h))], len(h))
        back = np.empty(len(h), np.int64)
        back[slot] = np.arange(len(h))
        column = lambda name: pdf[name].to_numpy()[first[back]].astype("<i8").tobytes()
        tied = pdf[np.isin(pdf["h"].to_numpy().astype(np.uint64), h[many > 1])]
        return pd.DataFrame({
            "bucket": pdf["bucket"].iloc[:1], "n_keys": [len(h)],
            "seeds": [seeds.astype("<u4").tobytes()], "prints": [fingerprints(h)[back].astype("<u4").tobytes()],
            "shards": [column("shard")], "offsets": [column("offset")], "sizes": [column("n")],
            "tied": [tied[["h", "h2", "shard", "offset", "n"]].to_numpy().astype("<i8").tobytes()],
        })

    h = key_hash(F.col("doc_id"), F.col("nth"))
    h2 = second_hash(F.col("doc_id"), F.col("nth"))
    keyed = entries.select(h.alias("h"), h2.alias("h2"), "shard", "offset", "n").withColumn("bucket", bucket_of(F.col("h"), buckets))
    return keyed.groupBy("bucket").applyInPandas(
        build, "bucket int, n_keys bigint, seeds binary, prints binary, shards binary, offsets binary, sizes binary, tied binary"
    )


def write_store(rows: DataFrame, path: str, bounds: list[int]) -> TokenStore:
    """Writes encoded rows as a store. Equal doc_ids are numbered from 0 and all kept."""
    spark = rows.sparkSession
    pack(rows, bounds).write.option("compression", "none").parquet(f"{path}/shards")
    light = spark.read.parquet(f"{path}/shards").select("shard", "n_ids").withColumn("_all", F.lit(0))
    prefix_sums(light, "_all", ["shard"], "n_ids", "start").select("shard", "start").write.parquet(f"{path}/starts")
    each = spark.read.parquet(f"{path}/shards").select("shard", F.explode("entries").alias("e")).select("shard", "e.*")
    count = each.count()
    store = TokenStore(path, 1 + count // BUCKET_KEYS)
    build_index(each, store.buckets).write.option("compression", "none").parquet(f"{path}/index")
    return store


def lookup(spark: SparkSession, store: TokenStore, keys: DataFrame) -> DataFrame:
    """(doc_id, nth, shard, offset, n) of the keys (doc_id, nth) that the index knows.

    Keys meet their bucket's row; a slot whose fingerprint differs means the key is unknown. Hashes
    that several keys have are looked up by their second hash.
    """

    def find(keys, index):
        import numpy as np

        if not len(keys) or not len(index):
            return keys.iloc[:0].assign(shard=0, offset=0, n=0)[["doc_id", "nth", "shard", "offset", "n"]]
        row = index.iloc[0]
        h = keys["h"].to_numpy().astype(np.uint64)
        seeds = np.frombuffer(row["seeds"], "<u4")
        slot = slots_of(h, seeds[groups_of(h, row["n_keys"])], row["n_keys"])
        known = np.frombuffer(row["prints"], "<u4")[slot] == fingerprints(h)
        value = lambda name: np.frombuffer(row[name], "<i8")[slot]
        places = np.stack([value("shards"), value("offsets"), value("sizes")], axis=1)
        tied = np.frombuffer(row["tied"], "<i8").reshape(-1, 5)
        if len(tied):
            place = {(a, b): rest for a, b, *rest in tied.tolist()}
            known = known.copy()
            for i in np.flatnonzero(np.isin(keys["h"].to_numpy(), tied[:, 0])):
                own = place.get((int(keys["h"].iloc[i]), int(keys["h2"].iloc[i])))
                known[i] = own is not None
                places[i] = own or 0
        found = keys.assign(shard=places[:, 0], offset=places[:, 1], n=places[:, 2])
        return found.loc[known, ["doc_id", "nth", "shard", "offset", "n"]]

    h = key_hash(F.col("doc_id"), F.col("nth"))
    asked = keys.select("doc_id", F.col("nth").cast("int").alias("nth")).withColumn("h", h)
    asked = asked.withColumn("h2", second_hash(F.col("doc_id"), F.col("nth")))
    asked = asked.withColumn("bucket", bucket_of(F.col("h"), store.buckets))
    return asked.groupBy("bucket").cogroup(store.index(spark).groupBy("bucket")).applyInPandas(
        find, "doc_id bigint, nth int, shard bigint, offset bigint, n bigint"
    )


def read_ids(spark: SparkSession, store: TokenStore, places: DataFrame) -> DataFrame:
    """(doc_id, nth, start, n, raw): the ids at the places found, each shard read once.

    The places of one shard, at most its number of documents, meet its payload; both are bounded.
    """
    starts = store.starts(spark).withColumnRenamed("shard", "_t")
    grouped = places.groupBy(F.col("shard").alias("_s")).agg(
        F.collect_list(F.struct("doc_id", "nth", "offset", "n")).alias("asked")
    ).join(starts, F.col("_s") == F.col("_t"))
    shards = store.shards(spark).select("shard", "payload")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for start, payload, asked in zip(*(b.column(i) for i in range(3)), strict=True):
                raw, base, rows = payload.as_py(), start.as_py(), asked.as_py()
                at = [r["offset"] for r in rows]
                n = [r["n"] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["nth"] for r in rows], pa.int32()),
                        pa.array([base + o for o in at], pa.int64()), pa.array(n, pa.int64()),
                        pa.array([raw[2 * o : 2 * (o + k)] for o, k in zip(at, n, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "nth", "start", "n", "raw"],
                )

    return shards.join(grouped, F.col("shard") == F.col("_s")).select("start", "payload", "asked").mapInArrow(
        run, "doc_id bigint, nth int, start bigint, n bigint, raw binary"
    )


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> TokenStore:
    """Encodes whole texts, appends ``end_id`` and writes the store at ``path``.

    Null and empty texts have the end id alone. Rows that repeat a doc_id are all stored; a null
    doc_id is a key like any other and comes first. An empty table gives an empty store.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    bounds = id_bounds(docs)
    return write_store(encoded(docs, tokenizer_json, end_id, bounds), path, bounds)


@query("op6_token_store")
def op6(spark, sf):
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    store = tokenise(docs, public_tokenizers.path("word_bpe_49k.json"), 2, scratch_path(spark, "token-store"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lit(0))) - 1
    keys = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).withColumn("nth", nth)
    ids = read_ids(spark, store, lookup(spark, store, keys))

    def checksum(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            crc = [zlib.crc32(np.frombuffer(r.as_py(), "<u2").astype("<u4").tobytes()) for r in b.column(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return ids.select("doc_id", "start", "n", "raw").mapInArrow(
        checksum, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


ship(__name__)
