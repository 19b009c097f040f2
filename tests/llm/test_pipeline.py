"""The pipeline, stage by stage and whole, against plain Python on the same rows."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from llm.test_duplicates import roots, shingles  # noqa: E402
from llm.test_mixing_lines import cut_by_hand, targets  # noqa: E402
from llm.test_texts import PROSE, labelled, tiktoken_ids  # noqa: E402
from newsloom.llm import language_id  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    rows = []
    for i in range(90):
        lang = rng.choice(list(PROSE))
        words = [rng.choice(PROSE[lang].split()) + rng.choice(["", "", "s", "en"]) + str(rng.randint(0, 9)) * rng.randint(0, 1) for _ in range(rng.randint(20, 80))]
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        if rng.random() < 0.4:
            lines.append("This line stands in many documents of the corpus")
        rows.append((i, "\n".join(lines), lang, rng.choice(["a", "b", "c", None])))
    for i in range(12):
        words = rows[i][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words), rows[i][2], "d"))
    rows += [(300, rows[7][1], "en", "a"), (301, None, "en", "b"), (302, "", None, "b"), (303, "12 -- 34", "de", "c")]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


def by_hand(rows):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    cut = {i: kept for i, _, _, kept in cut_by_hand([r[:2] for r in rows])}
    rows = [(i, cut[i], lang, s) for i, _, lang, s, _ in rows]
    sets = {i: shingles(t, 5) for i, t, *_ in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    root = roots(sets, links)
    rows = [r for r in rows if root[r[0]] == r[0]]
    size = {r[0]: len(r[1].encode().split()) for r in rows}
    of = defaultdict(int)
    for r in rows:
        of[r[3]] += size[r[0]]
    copies = Counter()
    for s, target in targets(of).items():
        budget, before = round(target), 0
        epochs, rest = divmod(budget, of[s]) if of[s] else (0, 0)
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
            copies[r[0]] = epochs + (before + size[r[0]] // 2 < rest)
            before += size[r[0]]
    out = []
    for r, ids in zip(rows, tiktoken_ids([r[1] for r in rows]), strict=True):
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        row = (r[0], r[2], r[3], len(r[1]), len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest())
        out += [row] * copies[r[0]]
    return sorted(out, key=str)


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)


def test_stages_return_documents(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixture", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_columns_named_like_internal_ones_survive(spark):
    names = ["kept", "score", "ids", "row", "_row", "_id", "size", "hi", "key", "document", "n_lines", "lang_pred", "cluster", "number", "target"]
    docs = spark.createDataFrame(corpus()[:30], DOCS)
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_pipeline_over_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_drops_what_the_network_rejects(spark):
    """Letters in no known language go, by the network's own score; clean documents stay, with no label to learn from too."""
    rng = random.Random(5)
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s in labelled(600, 3)]
    noise = [base64.b64encode(rng.randbytes(600)).decode() for _ in range(20)]
    noise += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900)) for _ in range(20)]
    rows += [(10_000 + i, t, None, "n", len(t)) for i, t in enumerate(noise)] + [(20_000, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()}
    assert kept >= set(range(600))
    assert len([i for i in kept if i >= 10_000]) <= 2
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, bare, "").collect()}
    assert kept == {r[0] for r in rows} - {20_000}


def test_thresholds_come_from_every_held_out_document(spark):
    """One language, more documents than any bound, and the low scores last in the order of ids' hashes."""
    import zlib

    held = [i for i in range(14_000) if zlib.crc32(str(i).encode()) % 4 == 2]
    held.sort(key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    text = {i: "x" * (10 if k % 3 else 100) for k, i in enumerate(held)}
    score = {i: 0.9 if k < 2_000 else 0.3 + k / 100_000 for k, i in enumerate(held)}
    rows = [(i, text[i], "en", "en", score[i]) for i in held]
    rows += [(held[0], "x" * 10, "de", "en", 0.01), (held[1], "x" * 10, None, "en", 0.01), (held[2], None, "en", "en", 0.01)]
    rows += [(i, "x" * 10, "en", "en", 0.02) for i in range(100) if i not in text]
    predicted = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(5)
    got = language_id.thresholds(predicted, language_id.Network(["de", "en"], {}))
    low = lambda own: language_id.SLACK * sorted(own)[int(language_id.LOW_SHARE * (len(own) - 1))]
    short, long = ([score[i] for i in held if len(text[i]) == n] for n in (10, 100))
    least = min(low(short), low(long), low(list(score.values())))
    assert got == [low(short), low(long), least, least]
