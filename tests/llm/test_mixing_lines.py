"""Mixing and line dedup: contracts on small rows, edge cases, incremental state."""

import hashlib
import random
from collections import defaultdict

import pytest

from newsloom.llm import line_dedup, mixing
from newsloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_components_of_a_long_chain_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 130)] + [(500, 400)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)} | {400: 400, 500: 400}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def targets(sizes):
    """Shares resharing the excess until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
        open_ -= full


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "ä", "z", None])) for i in range(300)]
    rows += [(900, None, "a"), (901, "", "b"), (902, " \t\n", None), (5, rows[5][1], rows[5][2])]
    got = mixing.mix(docs_of(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_mixed_documents_repeat_whole_rows(spark):
    rows = [(i, "x " * (i % 7 + 1), "ab"[i % 2]) for i in range(80)] + [(3, "x " * 4, "b")] * 2
    docs = docs_of(spark, rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
    want = targets({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"})
    assert all(abs(words[s] - want[s]) <= 7 for s in want)


def test_mix_of_nothing(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert mixing.mix(docs_of(spark, [(1, "", "a"), (2, None, None)])).selectExpr("sum(taken)").first()[0] == 0


def cut_by_hand(rows):
    def key(line):
        core = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in core)

    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


LINES = [
    (4, "A shared LINE here\nown line number four\n\nshort", "s"),
    (2, "  a shared line here\t\nown line number two\na Shared line here", "s"),
    (9, "a shared line here", "s"), (7, None, "s"), (8, "", "s"), (6, "ÄÄÄÄÄÄÄÄÄÄ\nx", "s"), (5, "ÄÄÄÄÄÄÄÄÄÄ", "s"), (3, "ääääääääää", "s"),
]


def kept(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept").collect())


def test_lines_as_by_hand(spark):
    docs = docs_of(spark, LINES)
    assert kept(line_dedup.cut_lines(docs, line_dedup.open_store(docs))) == cut_by_hand(LINES)


def test_lines_of_many_documents(spark):
    rng = random.Random(1)
    pool = [f"a common line {i} of the corpus" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.3 else f"own line {i} {k} here" for k in range(6)), "s") for i in range(400)]
    docs = docs_of(spark, rows)
    assert kept(line_dedup.cut_lines(docs, line_dedup.open_store(docs))) == cut_by_hand(rows)


def test_insert_and_delete_are_reversible(spark):
    one, two = LINES[:4], LINES[4:] + [(1, "own line number two\na shared line here", "s")]
    first = line_dedup.open_store(docs_of(spark, one))
    both = line_dedup.insert(first, docs_of(spark, two))
    everything = docs_of(spark, one + two)
    assert kept(line_dedup.cut_lines(everything, both)) == cut_by_hand(one + two)
    back = line_dedup.delete(both, spark.createDataFrame([(i,) for i, *_ in two], "doc_id long"))
    assert kept(line_dedup.cut_lines(docs_of(spark, one), back)) == cut_by_hand(one)
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, first.refs.collect()))
    grown = line_dedup.insert(line_dedup.empty_store(spark, 3), docs_of(spark, one))
    assert kept(line_dedup.cut_lines(docs_of(spark, one), grown)) == cut_by_hand(one)


def test_lines_of_nothing_and_extra_columns(spark):
    docs = docs_of(spark, [])
    assert line_dedup.cut_lines(docs, line_dedup.open_store(docs)).count() == 0
    from pyspark.sql import functions as F

    wide = docs_of(spark, LINES).withColumn("hi", F.lit(1)).withColumn("key", F.lit("k")).withColumn("n", F.lit(None).cast("int"))
    assert kept(line_dedup.cut_lines(wide, line_dedup.open_store(wide))) == cut_by_hand(LINES)


def test_cuckoo_filter_has_no_false_negatives_and_forgets():
    import numpy as np

    rng = np.random.default_rng(0)
    keys = [int(x) for x in rng.integers(0, 2**63, 5000, dtype=np.uint64)]
    made = line_dedup.Cuckoo.of(keys)
    ask = lambda some: line_dedup.Cuckoo.ask(made.dump(), np.array(some, np.uint64))
    assert ask(keys).all()
    others = [int(x) for x in rng.integers(0, 2**63, 5000, dtype=np.uint64)]
    assert ask(others).mean() < 0.01
    for k in keys[:2500]:
        assert made.remove(k)
    assert ask(keys[2500:]).all()
    assert ask(keys[:2500]).mean() < 0.01
    assert made.dump() == line_dedup.Cuckoo.load(made.dump()).dump()


def test_kept_digest_matches_text(spark):
    docs = docs_of(spark, LINES)
    cut = line_dedup.cut_lines(docs, line_dedup.open_store(docs))
    from pyspark.sql import functions as F

    for r in cut.select("kept", F.sha2("kept", 256).alias("h")).collect():
        assert r["h"] == hashlib.sha256(r["kept"].encode()).hexdigest()
