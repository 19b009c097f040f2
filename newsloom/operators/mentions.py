"""Entities named in texts, and who owns them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import materialize

_PIECE = r"(?U)\w+\W*"
_TAIL = r"(?U)\W+$"


def _core(alias: Column) -> Column:
    return F.regexp_replace(F.lower(alias), r"(?U)^\W+|\W+$", "")


def _runs(texts: DataFrame, key: str, text: str, firsts: DataFrame, longest: int) -> DataFrame:
    """Word runs of up to ``longest`` words that start with a word some alias starts with.

    A piece is a word with what separates it from the next one, so a run is spelled exactly as in
    the text. Each position is exploded beside its next pieces; only positions whose word begins
    an alias are kept before any run is put together.
    """
    pieces = F.regexp_extract_all(F.lower(text), F.lit(_PIECE), F.lit(0))
    ahead = [
        F.slice(F.col("_pieces"), F.lit(n), F.greatest(F.size("_pieces") - n + 1, F.lit(0))).alias(f"p{n}")
        for n in range(1, longest + 1)
    ]
    placed = (
        texts.select(key, pieces.alias("_pieces"))
        .select(key, F.inline(F.arrays_zip(*ahead)))
        .withColumn("first", F.regexp_replace("p1", _TAIL, ""))
        .join(firsts, "first", "left_semi")
    )
    runs = [F.col("first")]
    for n in range(2, longest + 1):
        head = [F.col(f"p{i}") for i in range(1, n)]
        runs.append(F.concat(*head, F.regexp_replace(f"p{n}", _TAIL, "")))
    return placed.select(key, F.explode(F.array(*runs)).alias("core")).filter("core IS NOT NULL")


def mentions(texts: DataFrame, aliases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Entities whose alias stands in a text between word boundaries, whatever its case.

    ``aliases``: entity_id, alias. Each entity is named once per text with its longest alias;
    ``mention_rank`` puts longer aliases first. Only listed aliases match, never a parent.

    Word runs of the text meet aliases in an equality join, so no text is tested against every
    alias. The boundary test is run only for aliases that begin or end with a non-word character.
    """
    known = aliases.select("entity_id", "alias", _core(F.col("alias")).alias("core")).filter("core <> ''")
    known = materialize(known.withColumn("_edge", F.lower("alias") != F.col("core")), "aliases")
    width = F.size(F.regexp_extract_all("core", F.lit(r"(?U)\w+"), F.lit(0)))
    longest, edges = known.agg(F.max(width), F.max(F.col("_edge").cast("int"))).first()
    firsts = known.select(F.regexp_extract("core", r"(?U)^\w+", 0).alias("first")).distinct()
    hits = _runs(texts, key, text, firsts, longest or 1).join(known, "core")
    if edges:
        boundary = F.concat(
            F.lit(r"(?iU)(?<!\w)\Q"), F.replace("alias", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)")
        )
        plain = hits.filter(~F.col("_edge"))
        checked = (
            hits.filter("_edge")
            .distinct()
            .join(texts.select(key, F.col(text).alias("_text")), key)
            .filter(F.rlike("_text", boundary))
            .drop("_text")
        )
        hits = plain.unionByName(checked)
    best = hits.groupBy(key, "entity_id").agg(
        F.max_by("alias", F.struct(F.length("alias"), F.col("alias"))).alias("alias")
    )
    order = Window.partitionBy(key).orderBy(F.length("alias").desc(), "entity_id")
    return best.withColumn("mention_rank", F.row_number().over(order))


def ownership_chains(entities: DataFrame) -> DataFrame:
    """Every (entity, owner above it) pair with its distance; distance 0 is the entity itself.

    ``entities``: entity_id, parent. Chains double in length every round: whoever stands at the
    end of a chain of length 2^k brings the chain above it along, so the number of jobs grows with
    the logarithm of the deepest one. An entity has one parent, so once an owner comes up again
    only known owners follow: keeping each owner's smallest distance makes cycles finite.
    """
    ids = entities.select(F.col("entity_id").alias("owner"))
    own = entities.select("entity_id", F.col("entity_id").alias("owner"), F.lit(0).alias("distance"))
    up = entities.filter(F.col("parent").isNotNull() & (F.col("parent") != F.col("entity_id"))).select(
        "entity_id", F.col("parent").alias("owner"), F.lit(1).alias("distance")
    )
    chains, rows, reach = materialize(own.unionByName(up.join(ids, "owner", "left_semi")).distinct(), "ownership"), 0, 1
    while chains.count() > rows:
        rows = chains.count()
        ends = chains.filter(F.col("distance") == reach).select("entity_id", F.col("owner").alias("_end"))
        above = chains.filter("distance > 0").select(
            F.col("entity_id").alias("_end"), "owner", (F.col("distance") + reach).alias("distance")
        )
        longer = chains.unionByName(ends.join(above, "_end").select("entity_id", "owner", "distance"))
        chains = materialize(longer.groupBy("entity_id", "owner").agg(F.min("distance").alias("distance")), "ownership")
        reach *= 2
    return chains


def ownership_statements(entities: DataFrame) -> DataFrame:
    """One line per entity naming what stands above it, in the vocabulary of the relation.

    ``entities``: entity_id, name, kind, parent, ticker.
    """
    owners = entities.select(F.col("entity_id").alias("owner"), F.col("name").alias("_owner_name"), "kind")
    label = F.when(F.col("kind") == "sponsor", "portfolio company of ").otherwise("parent: ")
    line = F.struct(
        F.col("distance"),
        F.when(F.col("distance") == 0, F.col("_owner_name"))
        .otherwise(F.concat(label, F.col("_owner_name")))
        .alias("part"),
    )
    told = (
        ownership_chains(entities)
        .join(owners, "owner")
        .groupBy("entity_id")
        .agg(F.sort_array(F.collect_list(line)).alias("_parts"))
    )
    statement = F.array_join(F.transform("_parts", lambda p: p["part"]), " — ")
    return told.join(entities.select("entity_id", "name", "ticker"), "entity_id").select(
        "entity_id",
        F.when(
            (F.size("_parts") == 1) & F.col("ticker").isNotNull(),
            F.concat("name", F.lit(" — shareholder-owned, "), "ticker"),
        )
        .otherwise(statement)
        .alias("statement"),
    )
