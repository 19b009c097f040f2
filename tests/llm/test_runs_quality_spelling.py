"""Periodic runs, quality rules and spelling variants against plain Python, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.llm import periodic_runs, quality, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Periodic runs


def plain_runs(w, least=6, power=4):
    """Every stretch of equal words q apart, kept if it is long enough and has no smaller period."""
    out = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, t = i, j + q
            if j > i and t - s >= max(least, power * q):
                if not any(all(w[k] == w[k + d] for k in range(s, t - d)) for d in range(1, q)):
                    out.append((s, t - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    out = []
    while len(out) < rng.choice([5, 30, 90, 250]):
        unit = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(1, 6))]
        piece = unit * rng.choice([1, 1, 2, 4, 5, 9])
        piece = piece[: rng.randrange(1, len(piece) + 1)] * rng.choice([1, 1, 2, 4])
        out += piece
    return out


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        w = repetitive(rng)
        assert periodic_runs.runs_of(w) == plain_runs(w), w


def test_runs_of_long_regular_texts():
    assert periodic_runs.runs_of(["a"] * 50_000) == [(0, 50_000, 1)]
    unit = [str(i) for i in range(700)]
    assert periodic_runs.runs_of(["x", *unit * 6, "y"]) == [(1, 4200, 700)]
    got = periodic_runs.runs_of((["a"] * 100 + ["b"]) * 40)
    assert (0, 4040, 101) in got and sum(q == 1 for _, _, q in got) == 40


def test_grammar_derives_the_text():
    rng = random.Random(5)
    for _ in range(200):
        w = repetitive(rng)
        g = periodic_runs.Grammar(w, 10)

        def expand(x):
            return [x] if x < 10 else expand(g.left[x - 10]) + expand(g.right[x - 10])

        assert [y for x in g.symbols for y in expand(x)] == w
        pairs = Counter()
        last = None
        for i, p in enumerate(zip(g.symbols, g.symbols[1:])):
            if p != last:
                pairs[p] += 1
                last = p
            else:
                last = None
        assert not pairs or max(pairs.values()) < periodic_runs.USES


def test_runs_query_equals_plain_python(spark, tmp_path):
    rng = random.Random(11)
    texts = [(i, " ".join(map(str, repetitive(rng)))) for i in range(300)]
    texts += [(300, None), (301, ""), (302, "  \n"), (303, "é é " * 20), (5, texts[5][1])]
    docs_of(spark, texts).withColumn("runs", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic_runs.op11(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in texts:
        w = words_in(t)
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = plain_runs(w)
        top = max(runs, key=lambda r: (r[1] * 10**6 // r[2], -r[0], -r[2])) if runs else None
        drop = {k for s, n_, q in runs for k in range(s + q, s + n_)}
        kept = " ".join(x for k, x in enumerate(w) if k not in drop)
        digest = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs)
        end = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (digest, kept)]
        want.append((i, len(runs), *end, *sha))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 50


def test_runs_of_nothing(spark):
    assert periodic_runs.find_runs(docs_of(spark, [])).count() == 0
    null_id = docs_of(spark, [(None, "a " * 10)])
    row = periodic_runs.find_runs(null_id, periodic_runs.plant_period).first()
    assert row["doc_id"] is None and row["collapsed"] == "a" and row["n_words"] == 10
    with pytest.raises(ValueError):
        periodic_runs.runs_of(["a"] * 9, power=3)


# Quality rules


def plain_counts(t):
    w = words_in(t)
    seen, places = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if seen[tuple(w[k : k + 3])] > 1:
            places |= {k, k + 1, k + 2}
    lines = [x for x in (t or "").split("\n") if x.strip(SPACE)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(places)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bé", "c😀", "d#", "e"]) for _ in range(n)) for n in (1, 2, 3, 4, 5, 60, 400)]
    texts += ["\n".join(rng.choice(["x y", "x y ", " ", "z"]) for _ in range(30)), None, "", " \t\n", "\x0b\x0c", "a b"]
    texts += [" ".join(f"word{i}" for i in range(80)), " ".join(f"word{i} ###" for i in range(80)), "THIS IS LOUD " * 3]
    return list(enumerate(texts))


def test_counts_equal_plain_python(spark, odd_texts):
    rows = quality.measured(docs_of(spark, odd_texts).withColumn("words", F.lit(1))).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["row"]["doc_id"]: tuple(r[c] for c in names) for r in rows}
    assert got == {i: plain_counts(t) for i, t in odd_texts}


def test_order_follows_rejections_per_cost(spark):
    docs = docs_of(spark, [(i, "a b c " * 5) for i in range(90)])
    dear = quality.Rule("dear", lambda: F.size(F.filter(F.sequence(F.lit(0), F.lit(20_000)), lambda x: x % 7 == 8)) > 0)
    some = [dear, quality.Rule("few", lambda: F.col("row.doc_id") < 9), quality.Rule("many", lambda: F.col("row.doc_id") < 60)]
    order = quality.estimate(docs, some)
    by_name = {e.rule.name: e for e in order}
    assert order[-1].rule.name == "dear" and by_name["dear"].rejects == 0.0
    assert by_name["dear"].cost > max(by_name["many"].cost, by_name["few"].cost)
    assert order[0].rejects == pytest.approx({"many": 60 / 90, "few": 9 / 90}[order[0].rule.name])


def test_the_order_never_changes_what_is_kept(spark, odd_texts):
    docs = docs_of(spark, odd_texts)
    rows = quality.measured(docs)
    verdicts = set()
    for seed in range(3):
        order = [quality.Estimate(r, 1.0, 0.0) for r in random.Random(seed).sample(quality.rules(), len(quality.rules()))]
        kept = rows.filter(quality.first_failed(order).isNull()).select("row.doc_id").collect()
        verdicts.add(tuple(sorted(r[0] for r in kept)))
    assert len(verdicts) == 1
    judged = {r["row"]["doc_id"]: r for r in quality.judge(docs, base=quality.few_or_repeated).collect()}
    assert judged[13]["kept"] and judged[14]["failed_rule"] == "symbols" and judged[8]["failed_rule"] == "base"


def test_a_rejected_row_is_not_asked_further(spark):
    docs = docs_of(spark, [(1, "a b"), (2, "c d")])
    boom = quality.Rule("boom", lambda: F.when(F.col("row.doc_id") == 1, F.raise_error(F.lit("asked"))).otherwise(F.lit(False)).cast("boolean"))
    order = [quality.Estimate(quality.Rule("first", lambda: F.col("row.doc_id") == 1), 1.0, 0.5), quality.Estimate(boom, 1.0, 0.0)]
    got = quality.measured(docs).select("row.doc_id", quality.first_failed(order).alias("f")).collect()
    assert {tuple(r) for r in got} == {(1, "first"), (2, None)}


def test_quality_of_nothing_and_no_python_in_the_plan(spark, odd_texts):
    assert quality.judge(docs_of(spark, [])).count() == 0
    plan = quality.judge(docs_of(spark, odd_texts))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = max(a, b, key=len), min(a, b, key=len)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(v):
    near = {w: [x for x in v if one_edit(w, x)] for w in v}

    def form(w):
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        return best if best and v[best] >= 10 * v[w] else None

    def root(w):
        return root(form(w)) if form(w) else w

    return {w: (form(w), root(w), v[w], len(near[w]), v[form(w)] if form(w) else None) for w in v}


@pytest.mark.parametrize("letters,symbols", [("ab", 8), ("abcdeé", 8), ("ab÷z", 3), ("abc", 1)])
def test_variants_equal_brute_force(spark, letters, symbols):
    rng = random.Random(len(letters) + symbols)
    v = {}
    for _ in range(500):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 11)))
        v[w] = rng.choice([2, 3, 10, 20, 30, 200, 2000, 30000])
    got = spelling.variants(spark.createDataFrame(list(v.items()), "word string, n long"), symbols=symbols)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain_variants(v)


def test_a_group_in_several_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 7)
    monkeypatch.setattr(spelling, "BLOCK", 20)
    rng = random.Random(4)
    v = {"same" + "".join(rng.choice("abc") for _ in range(4)): rng.randrange(2, 90) for _ in range(120)}
    got = spelling.variants(spark.createDataFrame(list(v.items()), "word string, n long"))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain_variants(v)


def test_roots_follow_long_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(18)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {f"w{i}": "w18" for i in range(18)}


def test_spelling_query_equals_plain_python(spark, tmp_path):
    rng = random.Random(6)
    base = ["international", "Übergröße", "straightforward", "caractère", "Knowledge", "shorter", "tiny", "a" * 40]
    texts = [(i, " ".join(rng.choice(base) + rng.choice(["", "", "s", ".", "-x"]) for _ in range(40))) for i in range(150)]
    texts += [(900, None), (901, ""), (902, "1234 5678"), (3, texts[3][1]), (None, "knowledge Knowledge knowledge")]
    docs_of(spark, texts).withColumn("word", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    v = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = {r[0]: tuple(r)[1:] for r in spelling.op13(spark, str(tmp_path)).collect()}
    assert got == plain_variants(v) and any(x[0] for x in got.values())


def test_spelling_of_nothing(spark):
    assert spelling.variants(spelling.word_counts(docs_of(spark, []))).count() == 0
