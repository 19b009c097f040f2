"""Hand-made picks, labels, the source registry and the date window of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.functions.text import strip, words
from newsloom.schema import BUCKETS, CATEGORIES, GIST_MAX_WORDS

BLANK_FIELD = "_no response_"


def form_fields(body: Column) -> Column:
    """"### Field" sections of a form as MAP<label, value>; a repeated label keeps its last value."""
    sections = F.filter(
        F.split(F.concat(F.lit("\n"), body), r"\n(?=###\s)"), lambda s: s.rlike(r"^###\s+\S")
    )
    pairs = F.transform(
        sections,
        lambda s: F.struct(
            F.lower(strip(F.regexp_extract(s, r"^###\s+([^\n]*)", 1))).alias("key"),
            strip(F.regexp_extract(s, r"(?s)^[^\n]*\n?(.*)$", 1)).alias("value"),
        ),
    )

    def last_of_each(all_pairs: Column) -> Column:
        tagged = F.transform(
            all_pairs,
            lambda p, i: F.struct(
                p["key"].alias("key"),
                F.when(F.lower(p["value"]) == BLANK_FIELD, "").otherwise(p["value"]).alias("value"),
                F.exists(
                    F.slice(all_pairs, i + 2, F.size(all_pairs)), lambda q: q["key"] == p["key"]
                ).alias("again"),
            ),
        )
        return F.filter(tagged, lambda p: ~p["again"])

    latest = let(pairs, last_of_each)
    return F.map_from_entries(F.transform(latest, lambda p: F.struct(p["key"], p["value"])))


def pick_items(forms: DataFrame, now: Column) -> DataFrame:
    """Pick forms as items, with the reason a form cannot become one.

    ``forms``: pick_id, body. A pick carries no author. A blank date means today.
    """

    def field(name: str) -> Column:
        return F.coalesce(F.col("_f")[name], F.lit(""))

    parsed = forms.withColumn("_f", form_fields(F.col("body"))).select(
        "pick_id",
        field("headline").alias("title"),
        field("link").alias("url"),
        field("outlet").alias("source_name"),
        field("why it matters").alias("gist"),
        field("industry beat").alias("beat"),
        field("category").alias("_category"),
        field("published").alias("_published"),
    )
    category = F.lit(None).cast("string")
    for name in CATEGORIES:
        category = F.when(F.lower("_category") == name.lower(), name).otherwise(category)
    when = F.when(F.col("_published") == "", now.cast("timestamp")).otherwise(F.try_to_timestamp("_published"))
    missing = F.array_compact(
        F.array(
            F.when(F.col("title") == "", "a headline"),
            F.when(F.col("url") == "", "a link"),
            F.when(F.col("source_name") == "", "an outlet"),
        )
    )
    length = F.size(words(F.col("gist")))
    return (
        parsed.withColumn("category", category)
        .withColumn("published_at", when)
        .withColumn("author", F.lit(None).cast("string"))
        .withColumn(
            "reject_reason",
            F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
            .when(~F.col("url").rlike(r"^https?://\S+$"), "unusable link")
            .when(length > GIST_MAX_WORDS, F.concat(F.lit("gist of "), length, F.lit(" words")))
            .when(F.col("published_at").isNull(), "unreadable date")
            .when(F.col("category").isNull(), "unknown category"),
        )
        .drop("_category", "_published")
    )


def load_labels(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Labels with bucket names folded and checked, and whether the item is one that was asked about.

    ``problem`` is null for a usable label. Callers stop on any problem (`require_clean`) or route
    them aside.
    """
    bucket = F.lower(strip(F.col("bucket")))
    asked = known.select("uid").distinct().withColumn("_known", F.lit(True))
    return (
        raw.withColumn("bucket", bucket)
        .join(asked, "uid", "left")
        .withColumn(
            "problem",
            F.when(~F.coalesce(F.col("bucket").isin(BUCKETS), F.lit(False)), "unknown bucket").when(
                F.col("_known").isNull(), "labelled but not in the item set"
            ),
        )
        .drop("_known")
    )


def require_clean(rows: DataFrame, problem: str = "problem") -> DataFrame:
    """Fail the job on the first row with a problem."""
    return rows.filter(F.assert_true(F.col(problem).isNull(), F.col(problem)).isNull()).drop(problem)


def registry_problems(registry: DataFrame) -> DataFrame:
    """Source ids registered more than once."""
    return registry.groupBy("source_id").agg(F.count("*").alias("copies")).filter("copies > 1")


def enabled_sources(registry: DataFrame) -> DataFrame:
    return registry.filter(F.coalesce("enabled", F.lit(True)))


def query_window(now: Column, days: int = 21) -> Column:
    """First day a source query asks for; wider than the publish window."""
    return F.date_sub(now.cast("date"), days)
