"""MinHash, embeddings and suffixes against brute force, with their edge cases."""

import random
from collections import defaultdict

import numpy as np
import pytest

from newsloom.llm import minhash, multi_index, suffixes

DOCS = "doc_id long, text string, extra string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def edited(rng, words, share):
    return [rng.choice("qrstuv") + w if rng.random() < share else w for w in words]


def near_corpus(rng):
    """Originals, chains of edits, copies, and the awkward texts."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, at = [], 0
    for _ in range(25):
        words = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.choice([1, 1, 3, 8])):
            rows.append((at, " ".join(words)))
            words, at = edited(rng, words, rng.choice([0, 0.02, 0.06, 0.12])), at + 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \t"), (at + 3, "one"), (at + 4, "ONE "), (at + 5, "one two"), (at + 6, "É one"), (at + 7, "é one")]
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_equals_brute_force(spark, size):
    rows = near_corpus(random.Random(size))
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for a in ids for b in ids
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = roots(ids, links)
    assert len(set(want.values())) < len(ids) - 20
    got = minhash.near_duplicates(frame(spark, rows), shingle=size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in ids
    }
    left = minhash.one_of_each(frame(spark, rows), shingle=size)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(want.values()))
    assert left.columns == ["doc_id", "text", "extra"]


def test_minhash_repeated_rows_null_ids_and_nothing(spark):
    text = "a b c d e f g h i j"
    got = minhash.near_duplicates(frame(spark, [(3, text), (3, text), (None, text), (5, text)])).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted(
        [(3, 3, True), (3, 3, True), (None, None, True), (5, 3, False)], key=str
    )
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_every_pair_within_the_distance_shares_a_key(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**16, minhash.SYMBOLS).astype(np.uint16)
    sigs = [base]
    for i in range(60):
        other = base.copy()
        at = rng.permutation(minhash.SYMBOLS)[: minhash.DISTANCE]
        other[at] += rng.integers(1, 2**16, len(at)).astype(np.uint16)
        sigs.append(other)
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "id long, sig binary")
    keys = defaultdict(set)
    for r in minhash.chunk_keys(df).collect():
        keys[r["id"]].add(r["key"])
    assert all(keys[0] & keys[i] for i in range(1, 61))


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_multi_index_meets_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    data = [b + rng.normal(size=16) * s for b in base for s in (0, 0.02, 0.1, 0.12, 0.15)] + list(rng.normal(size=(200, 16)))
    data = np.array(data, dtype=np.float32)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(data)]
    rows += [(1000, rows[7][1], 1), (1001, [2 * x for x in rows[7][1]], 1)]
    bad = [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] + [1.0] * 15, 0), (2004, [float("inf")] + [1.0] * 15, 0), (2005, [], 0)]
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v, _ in rows}
    ids = sorted(unit)
    every = np.array([unit[i] for i in ids])
    like = every @ every.T >= 0.9
    links = {(ids[a], ids[b]) for a, b in zip(*np.nonzero(like)) if a != b}
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(vectors_of(spark, rows + bad)).collect()}
    assert sorted(got) == sorted(ids + [b[0] for b in bad])
    found = sum(r["n_links"] for r in got.values())
    assert 0.9 * len(links) <= found <= len(links)
    for i in ids:
        assert got[i]["n_links"] <= sum(a == i for a, _ in links)
    whole = roots(ids, links)
    agree = np.mean([got[i]["component_id"] == whole[i] for i in ids])
    assert agree >= 0.9
    for b in bad:
        r = got[b[0]]
        assert (r["n_links"], r["component_id"], r["kept"]) == (0, b[0], True)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_multi_index_of_nothing(spark):
    assert multi_index.near_duplicates(vectors_of(spark, [])).count() == 0
    one = multi_index.near_duplicates(vectors_of(spark, [(1, None, 0), (2, [1.0, 0.0], 0)])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["kept"]) for r in one) == [(1, 0, True), (2, 0, True)]


def test_multi_index_in_small_blocks_and_of_several_lengths(spark, monkeypatch):
    """Many regions, blocks and tiles give the links of one; each length of vectors has its own grid."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 12))
    tight = base[0] + rng.normal(size=(90, 12)) * 0.01
    data = np.vstack([base + rng.normal(size=base.shape) * s for s in (0, 0.05, 0.1)] + [tight]).astype(np.float32)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(data)]
    rows += [(500 + i, [float(x)], 0) for i, x in enumerate((2, -3, 5, -0.5))]
    rows += [(600, [1.0, 0.0, 0.0], 0), (601, [3.0, 0.1, 0.0], 0), (602, [0.0, 1.0, 0.0], 0)]
    state = lambda: sorted(tuple(r) for r in multi_index.near_duplicates(vectors_of(spark, rows)).collect())
    whole = state()
    monkeypatch.setattr(multi_index, "BLOCK", 30)
    monkeypatch.setattr(multi_index, "TILE", 16)
    assert state() == whole
    got = {r[0]: r[1:3] for r in whole}
    assert [got[i] for i in (500, 501, 502, 503)] == [(1, 500), (1, 501), (1, 500), (1, 501)]
    assert [got[i] for i in (600, 601, 602)] == [(1, 600), (1, 600), (0, 602)]
    assert got[130][0] >= 85


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(0)
    one, two = rng.random(7), rng.random(9)
    cells = list(multi_index.nearest_cells(one, two, 1.1))
    sums = [one[i] + two[j] for i, j in cells]
    assert sums == sorted(sums)
    assert set(cells) == {(i, j) for i in range(7) for j in range(9) if one[i] + two[j] <= 1.1}


def passages_by_hand(rows, n):
    words = {i: (t or "").encode().split() for i, t in rows}
    seen = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].add(i)
    out = set()
    for i, w in words.items():
        open_ = None
        for k in range(len(w) - n + 1):
            if len(seen[tuple(w[k : k + n])]) > 1:
                if open_ and k <= open_[1]:
                    open_[1] = k + n
                else:
                    if open_:
                        out.add((i, *open_))
                    open_ = [k, k + n]
        if open_:
            out.add((i, *open_))
    return out


def test_passages_equal_brute_force(spark):
    rng = random.Random(8)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]
    shared = [fresh(n) for n in (49, 50, 51, 64, 90, 130, 260)]
    rows = []
    for i in range(60):
        text = fresh(rng.randint(0, 150))
        for p in rng.sample(shared, rng.randint(0, 3)):
            text += p + fresh(rng.randint(1, 60))
        rows.append((i, " ".join(text)))
    twice = fresh(80)
    rows += [(100, " ".join(twice + fresh(3) + twice)), (101, None), (102, ""), (103, "  "), (104, rows[3][1]), (105, rows[3][1])]
    rows += [(106, " ".join(fresh(70))), (None, rows[5][1])]
    got = suffixes.repeated_passages(frame(spark, rows)).collect()
    want = passages_by_hand([r for r in rows if r[0] is not None], 50)
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == want
    assert all(r["n_words"] == r["end_word"] - r["start_word"] >= 50 and r["other_doc_id"] != r["doc_id"] for r in got)
    assert len(got) == len(want)


def test_passages_across_many_partitions(spark):
    """A passage that most documents share, in more partitions than it has positions."""
    rng = random.Random(2)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]
    common = fresh(60)
    rows = [(i, " ".join(fresh(i % 9) + common + fresh(i % 5))) for i in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = suffixes.repeated_passages(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} >= {(i, a, b) for i, a, b in passages_by_hand(rows, 50)}


def test_passages_of_nothing(spark):
    assert suffixes.repeated_passages(frame(spark, [])).count() == 0


def links_found(spark, data):
    """Links found, and true ones, per vector."""
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.asarray(data, np.float32))]
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in multi_index.near_duplicates(vectors_of(spark, rows)).collect()}
    return np.array([got[i] for i in range(len(rows))]), want


@pytest.mark.parametrize("hot", [0, 2000])
def test_multi_index_finds_links_near_the_threshold(spark, hot):
    """Links at cosines of 0.90 to 0.91 among random vectors, alone and beside a tight group of a third."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(2000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    way = rng.normal(size=base.shape)
    way -= (way * base).sum(1)[:, None] * base
    way /= np.linalg.norm(way, axis=1)[:, None]
    data = np.vstack([base, 0.905 * base + (1 - 0.905**2) ** 0.5 * way, base[0] + rng.normal(size=(hot, 64)) * 0.002])
    got, want = links_found(spark, data)
    assert (got <= want).all()
    some = np.arange(1, 2000)
    assert want[some].sum() >= 1999
    assert got[some].sum() >= 0.99 * want[some].sum()
    assert (got == want).mean() >= 0.98


def test_passages_shared_in_part_and_edited_copies_equal_brute_force(spark):
    """A whole passage among many that have only its first or last words, and copies with single words changed."""
    rng = random.Random(21)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]
    rows = []
    for p in [fresh(60) for _ in range(4)]:
        for i in range(75):
            part = p if i % 9 == 0 else p[:44] if i % 2 else p[16:]
            rows.append((len(rows), " ".join(fresh(rng.randint(0, 12)) + part + fresh(rng.randint(0, 12)))))
        for _ in range(6):
            lo = rng.randint(0, 8)
            rows.append((len(rows), " ".join(fresh(3) + p[lo : lo + 52] + fresh(3))))
    for _ in range(4):
        text = fresh(200)
        for _ in range(25):
            rows.append((len(rows), " ".join(edited(rng, text, 0.02))))
    rng.shuffle(rows)
    got = suffixes.repeated_passages(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == passages_by_hand(rows, 50)
    words = {i: t.encode().split() for i, t in rows}
    runs = {i: {tuple(w[k : k + 50]) for k in range(len(w) - 49)} for i, w in words.items()}
    for r in got:
        own = words[r["doc_id"]][r["start_word"] : r["end_word"]]
        assert any(tuple(own[k : k + 50]) in runs[r["other_doc_id"]] for k in range(len(own) - 49))


def test_minhash_of_a_doc_id_with_two_texts(spark):
    """Each class is confirmed on its own text's set, and a document links the classes of all its texts."""
    rng = random.Random(31)
    text = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    rows = []
    for k in range(0, 200, 20):
        one, two = text(80), text(90)
        rows += [(k + 3, " ".join(one)), (k + 3, " ".join(two))]
        rows += [(k + 5, " ".join([*one[:-1], "other"])), (k + 6, " ".join([*two[:-1], "other"])), (k + 1, " ".join(two)), (k + 9, " ".join(text(70)))]
    got = minhash.near_duplicates(frame(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        k = r["doc_id"] % 20
        assert r["component_id"] == r["doc_id"] - k + (9 if k == 9 else 1)
        assert r["kept"] == (k in (1, 9))
