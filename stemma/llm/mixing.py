"""Mixing sources to target weights by hierarchical budgeting.

Documents hang from the leaves of a tree (domain, language, source). A token budget flows from the root
to the leaves. Among siblings it is split by their weights; a child whose subtree cannot supply its
share gets all it has, and what is missing goes to its siblings by their weights. Because a node's
supply is that of its whole subtree, a shortage is made up by siblings first and reaches the parent's
siblings only if the subtree as a whole falls short. A leaf supplies each document at most
`max_epochs` times.

A leaf that got x of its T tokens gives x // T whole epochs and a prefix of one more: documents in the
order of md5(seed, epoch, doc_id), as long as their tokens together stay within x % T. The end of that
prefix is found without ordering a leaf in one task: tokens are summed over ranges of the order first,
and only the range that holds the end (about `RANGE_ROWS` documents of a leaf) is ordered by a window.
Whole texts never move: every document compares its own order with its leaf's end.

The table of leaves is an aggregate; it travels to the tasks only below `SMALL_ROWS` counted rows and
is joined by shuffle beyond that, where adaptive execution splits a hot leaf.

Defined results: a null or empty level value is the leaf ''; documents without words (or text) take no
part; rows that repeat a doc_id stand together in the order, so they are taken or left together; an
empty table or a budget of 0 selects nothing; other columns are passed on, except that columns named
as a level are replaced by its value and one named `epoch` by the epoch (from 0).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.tables import attach
from stemma.session import cut_lineage

RANGE_ROWS = 500
_BITS = 52


def count_words(text: Column) -> Column:
    """Runs of characters other than ASCII blanks; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def _weight(level: Column, weights: dict[str, int]) -> Column:
    return reduce(lambda c, kv: F.when(level == kv[0], F.lit(kv[1])).otherwise(c), weights.items(), F.lit(1)).cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split `budget` among the nodes of a parent by `w`, none above its `cap`; adds `x`."""
    group = Window.partitionBy(*parent)
    order = group.orderBy(F.col("cap") / F.col("w"), name)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    big = lambda c: c.cast("decimal(19,0)")
    left, weight = F.col("budget") - (F.sum("cap").over(upto) - F.col("cap")), F.sum("w").over(group) - F.sum("w").over(upto) + F.col("w")
    full = F.when(big(F.col("cap")) * big(weight) <= big(left) * big(F.col("w")), 1).otherwise(0)
    nodes = nodes.withColumn("fits", full).withColumn("full", F.min("fits").over(upto) == 1)
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(group)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(group)
    part = F.expr("CAST(floor(CAST(rest AS DECIMAL(19,0)) * CAST(w AS DECIMAL(19,0)) / CAST(open_w AS DECIMAL(19,0))) AS BIGINT)")
    # floor of a decimal quotient could be rounded up just below an integer, hence the exact correction
    exact = F.when(big(F.col("part")) * big(F.col("open_w")) > big(F.col("rest")) * big(F.col("w")), F.col("part") - 1).otherwise(F.col("part"))
    nodes = (
        nodes.withColumn("rest", rest)
        .withColumn("open_w", open_w)
        .withColumn("part", F.when(~F.col("full"), part))
        .withColumn("part", exact)
        .withColumn("spare", F.col("rest") - F.sum("part").over(group))
        .withColumn("nth", F.sum(F.when(F.col("full"), 0).otherwise(1)).over(upto))
    )
    x = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("part") + F.when(F.col("nth") <= F.col("spare"), 1).otherwise(0)))
    return nodes.withColumn("x", x).drop("fits", "full", "rest", "open_w", "part", "spare", "nth", "budget", "w")


def allocate(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """(levels..., tokens) to the same with `x`, the tokens each leaf contributes.

    `weights` maps each level, outermost first, to the positive integer weights of its values (1 where
    none is given). `budget` is an expression over `tokens` summed over all leaves.
    """
    levels = list(weights)
    if any(w <= 0 for level in weights.values() for w in level.values()):
        raise ValueError("weights must be positive")
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"))
    root = F.lit(total.select(F.least(budget, F.col("cap")).cast("long")).first()[0])
    given = None
    for k, level in enumerate(levels):
        parent, path = levels[:k], levels[: k + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(F.col(level), weights[level]))
        nodes = nodes.join(given, parent) if parent else nodes.withColumn("budget", root)
        given = _share(nodes, parent, level).select(*path, F.col("x").alias("budget"))
    return leaves.join(given.withColumnRenamed("budget", "x"), levels).drop("cap")


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in the order of an epoch, a number of 52 bits."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, _BITS // 4), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]],
    budget: Column,
    *,
    max_epochs: int = 2,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The documents of the mixture, one row per document and epoch, with the level values and `epoch`.

    `budget` is an expression over `tokens`, the number of words of all documents.
    """
    names = list(levels)
    placed = docs.withColumns({k: F.coalesce(c.cast("string"), F.lit("")) for k, c in levels.items()})
    narrow = cut_lineage(placed.select(F.col(doc_id).alias("_id"), *names, count_words(F.col(text)).alias("tokens")).where("tokens > 0"))
    leaves = narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    share = cut_lineage(
        allocate(leaves, weights, budget, max_epochs)
        .where("x > 0")
        .select(
            *names,
            F.expr("x DIV tokens").cast("int").alias("whole"),
            (F.col("x") % F.col("tokens")).alias("rest"),
            F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / RANGE_ROWS))).cast("int").alias("bits"),
        )
    )
    key = _key(seed, F.col("whole"), F.col("_id"))
    keyed = attach(narrow, share.where("rest > 0"), names).withColumn("key", key).withColumn("range", F.expr(f"shiftright(key, {_BITS} - bits)"))
    sums = keyed.groupBy(*names, "range", "rest").agg(F.sum("tokens").alias("s"))
    before = F.sum("s").over(Window.partitionBy(*names).orderBy("range")) - F.col("s")
    last = sums.withColumn("before", before).where("before <= rest AND rest < before + s").select(*names, "range", "before")
    run = F.sum("tokens").over(Window.partitionBy(*names).orderBy("key", "_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ends = (
        attach(keyed, cut_lineage(last), [*names, "range"])
        .withColumn("run", run + F.col("before"))
        .groupBy(*names)
        .agg(F.max(F.when(F.col("run") <= F.col("rest"), F.struct("key", "_id"))).alias("end"), F.min("range").alias("range"))
    )
    plan = cut_lineage(share.join(ends, names, "left").select(*names, F.struct("whole", "rest", "bits", "end", "range").alias("_plan")))
    mine = _key(seed, F.col("_plan.whole"), F.col(doc_id))
    within = F.when(F.col("_plan.end").isNotNull(), F.struct(F.col("_mine").alias("key"), F.col(doc_id).alias("_id")) <= F.col("_plan.end")).otherwise(
        F.expr(f"shiftright(_mine, {_BITS} - _plan.bits) < _plan.range")
    )
    extra = F.when((F.col("_plan.rest") > 0) & F.coalesce(within, F.lit(False)), 1).otherwise(0)
    keep = [c for c in placed.columns if c != "epoch"]
    return (
        attach(placed.where(F.col(text).rlike("[^ \\t-\\r]")), plan, names)
        .withColumn("_mine", mine)
        .withColumn("_copies", F.col("_plan.whole") + extra)
        .where("_copies > 0")
        .select(*keep, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("epoch"))
    )
