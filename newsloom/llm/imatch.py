"""I-Match document fingerprints, in DataFrame functions only.

The lexicon is every term whose document frequency lies in a band, so neither near-ubiquitous
words nor one-off ones count. Documents with equal term sets count once. Where a large group of near
copies puts its shared terms above the band, or a document has few terms in it for another reason,
the document's own rarest terms stand in: the band is widened for it in fixed steps. The band's terms are split at random into disjoint sub-lexicons; for
each, a document's terms are sorted and hashed as one. An edit changes only the sub-lexicons whose
terms it touches, so the share of equal hashes tells how alike two documents are.

A sub-lexicon that kept a fixed share of terms would hold hundreds of terms of a long document
and survive no edit. So sub-lexicons come thinned by powers of two, and a document uses the two
neighbouring powers that leave it a few terms each; documents are compared at a power both have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.llm.common import query, table
from newsloom.operators.ranking import with_position
from newsloom.session import materialize

LEXICONS = 12
#: Terms of a document per sub-lexicon, at least, before the next power of two is used.
TERMS = 1.5
#: The band: terms of at least so many documents and at most this share of them.
LEAST_DOCS = 2
MOST_SHARE = 0.1
#: A document with less than this share of its terms in the band takes the first of the steps that holds as much:
#: terms below the band as well, then terms up to each of these shares of the documents, at last all terms.
ENOUGH = 0.25
WIDER = (0.2, 0.4, 0.8)
ALL = len(WIDER) + 2
MASK = 0xFFFFFF


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def document_frequencies(docs: DataFrame) -> tuple[DataFrame, int]:
    """(h, df) over distinct term sets, and their number; counts combine on the map side.

    Terms are counted over all rows, and once less for every further row with the same set, so that
    only rows which stand for several are looked up.
    """
    terms = docs.select("row", term_hashes(F.col("text")).alias("terms"))
    sets = terms.select("row", F.xxhash64(F.array_sort("terms")).alias("set")).groupBy("set").agg(
        F.count("*").alias("n"), F.min("row").alias("row")
    )
    sets = materialize(sets, "imatch-sets")
    several = sets.filter("n > 1").select(F.col("row").alias("_r"), (F.lit(1) - F.col("n")).alias("weight"))
    less = docs.join(several, F.col("row") == F.col("_r")).select("row", "weight", term_hashes(F.col("text")).alias("terms"))
    less = less.dropDuplicates(["row"]).select("weight", F.explode("terms").alias("h"))
    each = terms.select(F.lit(1).cast("bigint").alias("weight"), F.explode("terms").alias("h"))
    counted = each.unionByName(less).groupBy("h").agg(F.sum("weight").alias("df"))
    return counted, sets.count()


def steps(frequencies: DataFrame, documents: int, least: int = LEAST_DOCS, share: float = MOST_SHARE) -> DataFrame:
    """(h, step) of terms of at least ``least`` documents; the lexicon is those of step 0.

    They are the band of document frequencies, which is a band of idf = ln(documents / df). Steps
    2 and on are the terms above it, by the shares of ``WIDER``; step 1 is for terms below it.
    """
    df = F.col("df")
    step = F.when(df <= max(float(least), share * documents), 0)
    for i, wide in enumerate(WIDER, 2):
        step = step.when(df <= wide * documents, i)
    return frequencies.filter(df >= least).select("h", step.otherwise(ALL).alias("step"))


def rare_terms(terms: Column) -> Column:
    """Sorted hashes of the (step, h) of a document that its sub-lexicons are made from."""
    out = terms
    for last in range(ALL - 1, -1, -1):
        low = 2 if last > 1 else 0
        own = F.filter(terms, lambda x: (x["step"] == 0) | x["step"].between(low, last))  # noqa: B023
        out = F.when((F.size(own) > 0) & (F.size(own) >= ENOUGH * F.size(terms)), own).otherwise(out)
    return F.array_sort(F.transform(out, lambda x: x["h"]))


def power(hashes: Column) -> Column:
    """How often the lexicons are halved for a document with these terms."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.size(hashes), F.lit(1)) / (LEXICONS * TERMS)))).cast("int")


def thinned(h: Column, level: Column) -> Column:
    """Whether a term is in the lexicons of a level; those of the next level are among them."""
    return F.pmod(F.shiftright(h, 16), F.pow(F.lit(2.0), level).cast("bigint")) == 0


def sub_hashes(terms: Column, level: Column) -> Column:
    """One 24-bit hash per sub-lexicon of a level from sorted term hashes; null where there is no term."""
    own = F.filter(terms, lambda h: thinned(h, level))
    return let(own, lambda o: F.transform(
        F.sequence(F.lit(0), F.lit(LEXICONS - 1)),
        lambda k: let(F.filter(o, lambda h: F.pmod(h, F.lit(LEXICONS)) == k), lambda s: F.when(
            F.size(s) > 0, F.xxhash64(s).bitwiseAND(F.lit(MASK)).cast("int")
        )),
    ))


def fingerprint(terms: Column, level: Column, whole: Column) -> Column:
    """struct(level, near, far, whole): the hashes of two levels; ``whole`` stands in if there is no term."""
    return F.struct(
        level.alias("level"), sub_hashes(terms, level).alias("near"), sub_hashes(terms, level + 1).alias("far"),
        whole.alias("whole"),
    )


def has_terms(fp: Column) -> Column:
    return F.exists(fp["near"], lambda s: s.isNotNull())


def written(fp: Column) -> Column:
    """The fingerprint as a string."""
    code = lambda s: F.coalesce(F.lpad(F.hex(s), 6, "0"), F.lit("-"))
    slots = F.array_join(F.transform(F.concat(fp["near"], fp["far"]), code), ".")
    return F.when(has_terms(fp), F.concat_ws(":", fp["level"], slots)).otherwise(F.concat(F.lit("w:"), F.hex(fp["whole"])))


def share_equal(a: Column, b: Column) -> Column:
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda x: x))
    return F.when(either > 0, equal / either).otherwise(F.lit(0.0))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of equal hashes at the levels both have; 1 for equal fingerprints."""
    both = has_terms(a) & has_terms(b)
    return (
        F.when(~both, (written(a) == written(b)).cast("double"))
        .when(a["level"] == b["level"], share_equal(F.concat(a["near"], a["far"]), F.concat(b["near"], b["far"])))
        .when(a["level"] == b["level"] + 1, share_equal(a["near"], b["far"]))
        .when(a["level"] + 1 == b["level"], share_equal(a["far"], b["near"]))
        .otherwise(F.lit(0.0))
    )


def with_neighbours(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_chars, next_row, prev_row, prev_chars) per distinct row, in the order of doc_id.

    The last row's next is the first. Positions come from a range sort of the ids alone.
    """
    light = docs.select("row", "doc_id", F.length("text").cast("bigint").alias("n_chars")).distinct()
    placed = with_position(light, [], [F.col("doc_id").asc_nulls_first(), F.col("row").asc()])
    placed = materialize(placed, "imatch-order")
    total = placed.count()
    after = (F.col("position") % max(1, total) + 1).alias("_at")
    nexts = placed.select(F.col("position").alias("_at"), F.col("row").alias("next_row"))
    befores = placed.select(after, F.col("row").alias("prev_row"), F.col("n_chars").alias("prev_chars"))
    return placed.withColumn("_at", after).join(nexts, "_at").drop("_at").join(
        befores, F.col("position") == F.col("_at")
    ).drop("_at", "position")


def fingerprints(docs: DataFrame, least: int = LEAST_DOCS, share: float = MOST_SHARE) -> DataFrame:
    """doc_id, row, n_chars, edited_sha256, next_row, fp, edited_fp per row of ``docs``.

    The edited text is the text whose last quarter is replaced by the next document's first
    characters. A null text counts as empty; a text without a term gets one hash for its fingerprint. Rows with equal doc_id and text are one document in the
    order and get a row each; a null doc_id comes first. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    order = materialize(with_neighbours(rows), "imatch-neighbours")
    lexicon = materialize(steps(*document_frequencies(rows), least, share), "imatch-lexicon")
    # The text is shuffled once, by row; the heads of next documents come to it.
    texts = rows.select(F.col("row").alias("_r"), "text")
    placed = order.join(texts, F.col("row") == F.col("_r"))
    quarter = lambda n: F.floor(n / 4).cast("int")
    heads = placed.select(F.col("prev_row").alias("_p"), F.substring("text", F.lit(1), quarter(F.col("prev_chars"))).alias("head"))
    heads = heads.dropDuplicates(["_p"])
    n = F.col("n_chars")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - quarter(n)).cast("int")), F.col("head"))
    pair = placed.join(heads, F.col("row") == F.col("_p")).select(
        "row", "doc_id", "n_chars", "next_row", F.sha2(edited, 256).alias("edited_sha256"),
        term_hashes(F.col("text")).alias("a"), term_hashes(edited).alias("b"),
    )
    some = lambda x: F.filter(x, lambda h: thinned(h, power(F.col(x))))
    drawn = pair.select(
        "row", "doc_id", "n_chars", "next_row", "edited_sha256",
        power(F.col("a")).alias("level_a"), power(F.col("b")).alias("level_b"),
        F.xxhash64(F.array_sort("a")).alias("whole_a"), F.xxhash64(F.array_sort("b")).alias("whole_b"),
        some("a").alias("a"), some("b").alias("b"),
    )
    drawn = materialize(drawn, "imatch-drawn")
    marked = F.transform(F.array_union("a", "b"), lambda h: F.struct(
        h.alias("h"), F.array_contains("a", h).alias("in_a"), F.array_contains("b", h).alias("in_b")
    ))
    terms = drawn.select("row", "a", "b").dropDuplicates(["row"]).select("row", F.explode(marked).alias("t")).select("row", "t.*")
    known = terms.join(lexicon.withColumnRenamed("h", "_h"), F.col("h") == F.col("_h"), "left")
    term = F.struct(F.coalesce("step", F.lit(1)).alias("step"), "h")
    of = lambda side: F.collect_list(F.when(F.col(f"in_{side}"), term)).alias(f"terms_{side}")
    known = known.groupBy(F.col("row").alias("_r")).agg(of("a"), of("b"))
    known = known.select("_r", *[rare_terms(F.col(x)).alias(x) for x in ("terms_a", "terms_b")])
    none = F.array().cast("array<bigint>")
    fp = lambda s: fingerprint(F.coalesce(f"terms_{s}", none), F.col(f"level_{s}"), F.col(f"whole_{s}"))
    return drawn.drop("a", "b").join(known, F.col("row") == F.col("_r"), "left").select(
        "doc_id", "row", "n_chars", "edited_sha256", "next_row", fp("a").alias("fp"), fp("b").alias("edited_fp")
    )


def compare_neighbours(docs: DataFrame, **how) -> DataFrame:
    """Fingerprints as strings, and how alike each is to its edited text's and to the next document's."""
    made = materialize(fingerprints(docs, **how), "imatch-fingerprints")
    nexts = made.select(F.col("row").alias("_r"), F.col("fp").alias("next_fp")).dropDuplicates(["_r"])
    return made.join(nexts, F.col("next_row") == F.col("_r")).select(
        "doc_id", "n_chars", "edited_sha256",
        written(F.col("fp")).alias("fingerprint"), written(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


@query("op8_imatch")
def op8(spark, sf):
    return compare_neighbours(table(spark, sf, "documents"))
