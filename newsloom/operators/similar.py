"""Ordered collapse of near-duplicate headlines.

Items are visited in order. An item joins the first kept earlier item whose content-word set
overlaps its own by at least the threshold, where overlap is the shared part of the smaller set;
otherwise it is kept. Items with fewer than three words are always kept but can absorb later
ones. The result depends on the order, so it is neither connected components nor clustering.

How the same result is reached in parallel:

1. Equal word sets are collapsed first. A later copy can neither be kept nor lead anything its
   first copy would not, so only first copies take part, however many copies exist.
2. Undecided sets are cut into blocks by order. A block is taken as large as its candidate count,
   computed from token counts before anything is joined, stays within a budget; so a group of
   near copies is met through a few early members instead of through all its pairs.
3. Inside a block, pairs come from a prefix join: words are sorted rare first, and two sets can
   only reach the threshold if one of the first ``n - ceil(threshold * n) + 1`` words of the
   smaller set is in the larger. Frequent words are salted.
4. A few rounds decide the block: a set with a kept earlier neighbour is merged, one whose
   earlier neighbours are all merged is kept. What is still open then is shortened: a set with one
   open neighbour has the opposite fate of it, so chains of such sets point at their ends by doubling.
5. Kept sets of the block then remove their neighbours from everything undecided after the
   block. Members of a large group of near copies leave here, one row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import may_fold, with_word_set, word_set
from newsloom.session import materialize

SIMILARITY_THRESHOLD = 0.40
MIN_WORDS = 3
#: Jobs of two plain rounds before chains are shortened; most blocks end within them.
PLAIN_JOBS = 3


@dataclass(frozen=True)
class BlockBudget:
    """Bounds on the work of one block; they change the number of blocks, never the result."""

    pairs_per_set: int = 50  # candidates allowed per undecided set
    floor: int = 2_000  # a block of this many sets is always taken
    salt_rows: int = 200_000  # rows of one word that one task may get


def overlap(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / F.least(F.size(a), F.size(b))


def _prefix_length(n: Column, threshold: float) -> Column:
    return n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1


def _exploded(sets: DataFrame, prefix: str, threshold: float, smaller: bool) -> DataFrame:
    """One row per (set, word): the prefix words for the smaller side, all words for the larger."""
    picked = F.slice(F.col("words"), F.lit(1), _prefix_length(F.size("words"), threshold)) if smaller else F.col("words")
    return sets.select(
        F.col("rep").alias(f"{prefix}_rep"),
        F.transform("words", lambda w: w["token"]).alias(f"{prefix}_tokens"),
        F.explode(picked).alias("_w"),
    ).select(
        f"{prefix}_rep",
        f"{prefix}_tokens",
        F.col("_w.token").alias("token"),
        F.col("_w.df").alias("_df"),
    )


def _matches(small: DataFrame, large: DataFrame, threshold: float, budget: BlockBudget) -> DataFrame:
    """Pairs (small set, large set) at or over the threshold, each exactly once."""
    salts = F.ceil(F.col("_df") / F.lit(budget.salt_rows)).cast("int")
    left = _exploded(small, "s", threshold, True).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    right = _exploded(large, "l", threshold, False)
    right = right.withColumn("salt", F.pmod(F.xxhash64("l_rep"), salts).cast("int")).drop("_df")
    sizes = F.struct(F.size("s_tokens"), F.col("s_rep")) < F.struct(F.size("l_tokens"), F.col("l_rep"))
    shared = F.array_intersect("s_tokens", "l_tokens")
    return (
        left.drop("_df")
        .join(right, ["token", "salt"])
        .filter(
            sizes
            & (F.get(shared, F.lit(0)) == F.col("token"))
            & (F.size(shared) / F.size("s_tokens") >= threshold)
        )
        .select("s_rep", "l_rep")
    )


def _edges_within(sets: DataFrame, threshold: float, budget: BlockBudget) -> DataFrame:
    """Early → late edges inside one block; short sets never merge, so none ends in one."""
    pairs = _matches(sets, sets, threshold, budget)
    edges = pairs.select(
        F.least("s_rep", "l_rep").alias("early"), F.greatest("s_rep", "l_rep").alias("late")
    )
    short = sets.filter(F.size("words") < MIN_WORDS).select(F.col("rep").alias("late"))
    return edges.join(short, "late", "left_anti")


def _edges_between(kept: DataFrame, rest: DataFrame, threshold: float, budget: BlockBudget) -> DataFrame:
    targets = rest.filter(F.size("words") >= MIN_WORDS)
    a = _matches(kept, targets, threshold, budget).select(
        F.col("s_rep").alias("early"), F.col("l_rep").alias("late")
    )
    b = _matches(targets, kept, threshold, budget).select(
        F.col("l_rep").alias("early"), F.col("s_rep").alias("late")
    )
    return a.union(b)


def _decide(block: DataFrame, edges: DataFrame) -> DataFrame:
    """Status of every set of a block: 1 kept, 2 merged."""
    later = edges.select(F.col("late").alias("rep")).distinct().withColumn("_open", F.lit(True))
    status = materialize(
        block.select("rep")
        .join(later, "rep", "left")
        .select("rep", F.when(F.col("_open"), 0).otherwise(1).alias("status")),
        "collapse-status",
    )
    for _ in range(PLAIN_JOBS):
        if status.filter("status = 0").isEmpty():
            return status
        # Two rounds to a job: the second reads the first inside one plan.
        status = materialize(_round(_round(status, edges), edges), "collapse-status")
    return _decide_chains(status, edges.select("late", "early", F.lit(0).alias("flip")))


def _decide_chains(status: DataFrame, edges: DataFrame) -> DataFrame:
    """Status as `_decide` gives it, however long chains are.

    An edge (late, early, flip) blocks ``late`` if early is kept, or with ``flip`` if it is not. A set is
    kept if nothing blocks it. One with a single open edge follows its neighbour's fate, so edges to
    it become edges to what it follows, itself found by doubling: a chain takes a logarithmic
    number of jobs. Edges to one set with and without flip block for certain.
    """
    while not status.filter("status = 0").isEmpty():
        fate = status.select(F.col("rep").alias("early"), F.col("status").alias("_s"))
        open_ = status.filter("status = 0").select(F.col("rep").alias("late"))
        blocks = F.when(F.col("_s") != 0, (F.col("_s") == 1).cast("int").bitwiseXOR(F.col("flip")))
        seen = materialize(
            edges.join(open_, "late").join(fate, "early").select("late", "early", "flip", blocks.alias("blocks")),
            "collapse-seen",
        )
        both = (
            seen.filter(F.col("blocks").isNull()).groupBy("late", "early")
            .agg((F.min("flip") != F.max("flip")).alias("_b")).filter("_b").select("late").distinct()
            .withColumn("_both", F.lit(True))
        )
        news = (
            seen.groupBy("late")
            .agg(F.max(F.coalesce("blocks", F.lit(0))).alias("_k"), F.max(F.col("blocks").isNull()).alias("_u"))
            .join(both, "late", "left")
            .withColumnRenamed("late", "rep")
        )
        status = materialize(
            status.join(news, "rep", "left").select(
                "rep",
                F.when(F.col("status") != 0, F.col("status"))
                .when((F.col("_k") == 1) | F.col("_both"), 2)
                .when(F.col("_u"), 0)
                .otherwise(1)
                .alias("status"),
            ),
            "collapse-status",
        )
        still = status.filter("status = 0").select(F.col("rep").alias("late"))
        left = materialize(seen.filter(F.col("blocks").isNull()).join(still, "late").select("late", "early", "flip"), "collapse-open")
        follows = _follow(
            left.groupBy("late").agg(F.count("*").alias("_n"), F.first("early").alias("head"), F.first("flip").alias("flip"))
            .filter("_n = 1")
            .select(F.col("late").alias("rep"), "head", F.col("flip").bitwiseXOR(F.lit(1)).alias("turn"))
        )
        edges = materialize(
            left.join(follows.withColumnRenamed("rep", "early"), "early", "left")
            .select("late", F.coalesce("head", "early").alias("early"), F.col("flip").bitwiseXOR(F.coalesce("turn", F.lit(0))).alias("flip"))
            .distinct(),
            "collapse-shortened",
        )
    return status


def _follow(follows: DataFrame) -> DataFrame:
    """(rep, head, turn): heads that follow nothing themselves; kept(rep) is kept(head), turned over if turn is 1."""
    follows = materialize(follows, "collapse-follow")
    while True:
        further = follows.select(F.col("rep").alias("_r"), F.col("head").alias("_h"), F.col("turn").alias("_t"))
        joined = follows.join(further, F.col("head") == F.col("_r"), "left")
        if joined.filter(F.col("_r").isNotNull()).isEmpty():
            return follows
        follows = materialize(
            joined.select("rep", F.coalesce("_h", "head").alias("head"), F.col("turn").bitwiseXOR(F.coalesce("_t", F.lit(0))).alias("turn")),
            "collapse-follow",
        )


def _round(status: DataFrame, edges: DataFrame) -> DataFrame:
    early = status.select(F.col("rep").alias("early"), F.col("status").alias("_s"))
    news = (
        edges.join(early, "early")
        .groupBy(F.col("late").alias("rep"))
        .agg(F.max((F.col("_s") == 1).cast("int")).alias("_k"), F.max((F.col("_s") == 0).cast("int")).alias("_u"))
    )
    return status.join(news, "rep", "left").select(
        "rep",
        F.when(F.col("status") != 0, F.col("status"))
        .when(F.col("_k") == 1, 2)
        .when(F.col("_u") == 1, 0)
        .otherwise(1)
        .alias("status"),
    )


def _block_end(rest: DataFrame, threshold: float, budget: BlockBudget) -> tuple[int | None, bool]:
    """The last order value of the next block, and whether the block takes all that is left."""
    total, high = rest.agg(F.count("*"), F.max("rep")).first()
    if total <= budget.floor:
        return high, True
    shares = [1.0]
    while shares[-1] / 4 * total > budget.floor:
        shares.append(shares[-1] / 4)
    shares.append(budget.floor / total)
    cuts = rest.select(F.percentile_approx("rep", shares, 100_000)).first()[0]
    cuts[0] = high
    counted = None
    for smaller, name in ((True, "p"), (False, "a")):
        per_token = (
            _exploded(rest, "s", threshold, smaller)
            .groupBy("token")
            .agg(*[F.count_if(F.col("s_rep") <= c).alias(f"{name}{i}") for i, c in enumerate(cuts)])
        )
        counted = per_token if counted is None else counted.join(per_token, "token")
    costs = counted.agg(
        *[F.sum(F.col(f"p{i}").cast("double") * F.col(f"a{i}")) for i in range(len(cuts))]
    ).first()
    for cut, cost in zip(cuts, costs):
        if (cost or 0) <= budget.pairs_per_set * total:
            return cut, cut == high
    return cuts[-1], cuts[-1] == high


def collapse_sets(sets: DataFrame, threshold: float, budget: BlockBudget) -> DataFrame:
    """Decide distinct word sets. ``sets``: rep BIGINT, words ARRAY<STRUCT<df, token>> rare first.

    Returns rep, leader: null for a kept set.
    """
    rest = materialize(sets, "collapse-sets")
    out = rest.limit(0).select("rep", F.lit(None).cast("bigint").alias("leader"))
    last = False
    while not last:
        end, last = _block_end(rest, threshold, budget)
        if end is None:
            break
        block = rest if last else rest.filter(F.col("rep") <= end)
        edges = materialize(_edges_within(block, threshold, budget), "collapse-edges")
        status = _decide(block, edges)
        kept = status.filter("status = 1").select("rep")
        inside = (
            edges.join(kept.withColumnRenamed("rep", "early"), "early")
            .groupBy(F.col("late").alias("rep"))
            .agg(F.min("early").alias("leader"))
        )
        out = out.union(status.join(inside, "rep", "left").select("rep", "leader"))
        if last:
            break
        after = rest.filter(F.col("rep") > end)
        removed = materialize(
            _edges_between(block.join(kept, "rep"), after, threshold, budget)
            .groupBy(F.col("late").alias("rep"))
            .agg(F.min("early").alias("leader")),
            "collapse-removed",
        )
        out = out.union(removed)
        rest = materialize(after.join(removed, "rep", "left_anti"), "collapse-rest")
    return out


def word_sets(tokens: DataFrame) -> DataFrame:
    """Distinct word sets with their first position, words sorted rare first.

    ``tokens``: position BIGINT, tokens ARRAY<STRING> (sorted).
    """
    sets = tokens.filter(F.size("tokens") > 0).groupBy("tokens").agg(F.min("position").alias("rep"))
    exploded = sets.select("rep", F.explode("tokens").alias("token"))
    counts = exploded.groupBy("token").agg(F.count("*").alias("df"))
    return (
        exploded.join(counts, "token")
        .groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("words"))
    )


def _fingerprints(items: DataFrame, position: str, title: str) -> DataFrame:
    """position, tokens. Titles that need Unicode folding are set aside first, so that the input is
    read once and Python runs only if there are any."""
    text = F.col(title)
    staged = materialize(
        items.select(
            F.col(position).alias("position"),
            F.when(~may_fold(text), word_set(text)).alias("tokens"),
            F.when(may_fold(text), text).alias("_pending"),
        ),
        "collapse-titles",
    )
    plain = staged.filter("_pending IS NULL").select("position", "tokens")
    pending = staged.filter("_pending IS NOT NULL")
    if not pending.limit(1).count():
        return plain
    return plain.unionByName(with_word_set(pending.drop("tokens"), "_pending").select("position", "tokens"))


def collapse_similar(
    items: DataFrame,
    position: str = "seq",
    title: str = "title",
    threshold: float = SIMILARITY_THRESHOLD,
    budget: BlockBudget = BlockBudget(),
) -> DataFrame:
    """Decide every item: position, leader (null when kept).

    ``position`` is a unique BIGINT giving the order of visits.
    """
    tokens = _fingerprints(items, position, title)
    return spread(tokens, collapse_sets(word_sets(tokens), threshold, budget), position)


def spread(tokens: DataFrame, decided: DataFrame, position: str) -> DataFrame:
    """Decisions on distinct word sets (rep, leader) handed to every item: position, leader."""
    firsts = (
        tokens.filter(F.size("tokens") >= MIN_WORDS)
        .groupBy("tokens")
        .agg(F.min("position").alias("rep"))
        .join(decided, "rep")
        .select("tokens", "rep", F.coalesce("leader", "rep").alias("_head"))
    )
    return tokens.join(firsts, "tokens", "left").select(
        F.col("position").alias(position),
        F.when(F.col("_head") != F.col("position"), F.col("_head")).alias("leader"),
    )


def merge_counts(decided: DataFrame, position: str = "seq") -> DataFrame:
    """How many items each kept one stands for besides itself; only where there are any."""
    return (
        decided.filter(F.col("leader").isNotNull())
        .groupBy(F.col("leader").alias(position))
        .agg(F.count("*").alias("similar"))
    )


def kept_with_counts(items: DataFrame, decided: DataFrame, position: str = "seq") -> DataFrame:
    """The kept items with their merge count (null where nothing merged)."""
    decided = materialize(decided, "collapse-decided")
    kept = decided.filter(F.col("leader").isNull()).select(position)
    return items.join(kept, position).join(merge_counts(decided, position), position, "left")
