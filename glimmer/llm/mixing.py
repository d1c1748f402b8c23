"""Operator 1, mixing sources to target weights: budgets down a domain-language-source tree.

The whole budget starts at the root. A node shares its budget among its children by their weights; a child
never gets more than its subtree holds (its tokens times the epochs allowed), and what it can't use goes to
its siblings by their weights, in one closed form (children by capacity over weight, running sums). Only what
a whole family can't use ever reaches its parent's siblings, since a family's capacity is what its parent
is capped at. Each leaf then takes whole epochs and, of one more epoch, the longest prefix of a seeded order that
fits its rest.

How it scales. The tree's tables have a row per source, found by a partial aggregation. The prefix isn't a
sort of the leaf: ids are dealt by the first digits of their seeded digest into 4096 slots, slots are summed,
and only the slot in which the budget ends is looked into. A text only meets its leaf's row.

Tokens are words, the maximal runs of characters other than space and 0x09-0x0D, so that all is native SQL.
Defined results: a null text has no tokens; a null language or source is the empty name; rows that share an id
share a place in the order and are taken or left together; an empty table or budget gives no rows; a weight of
zero or less takes a subtree out; a node without a weight has weight 1; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glimmer.llm.shared import SPACE, settled

PATH = ("domain", "lang", "source")
#: Digits of the digest that choose a slot: 16 to that power slots for each leaf.
SLOT_DIGITS = 3
#: A plan of more leaves than this isn't broadcast.
MOST_LEAVES = 20_000


@dataclass(frozen=True)
class Mix:
    """weights: by path, as in "web", "web/en", "web/en/src0". budget: a share of all tokens, in thousandths."""

    weights: dict[str, int] = field(default_factory=dict)
    budget_permille: int = 600
    epochs: int = 2
    seed: int = 17
    domains: tuple[tuple[str, str], ...] = (("web", "src0"), ("reference", "src[1-9]"))
    other_domain: str = "community"

    def domain(self, source: Column) -> Column:
        """The domain of the first pattern that the whole source name matches."""
        out = F.lit(self.other_domain)
        for name, pattern in reversed(self.domains):
            out = F.when(source.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
        return out


PRODUCTION = Mix({"web": 3, "reference": 4, "community": 3, "web/en": 4, "web/de": 2, "web/fr": 2, "web/es": 2, "reference/en": 5, "community/en": 5, "reference/en/src1": 2, "community/en/src10": 3})


def n_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def _names(mix: Mix, lang_col: str, source_col: str) -> dict[str, Column]:
    source = F.coalesce(F.col(source_col), F.lit(""))
    return {"domain": mix.domain(source), "lang": F.coalesce(F.col(lang_col), F.lit("")), "source": source}


def _weight(mix: Mix, path: Column) -> Column:
    if not mix.weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for k in sorted(mix.weights) for x in (k, mix.weights[k])])
    return F.coalesce(F.try_element_at(table, path), F.lit(1)).cast("long")


def _shared_out(nodes: DataFrame, parent: tuple[str, ...], name: str) -> DataFrame:
    """Adds budget to nodes (capacity, weight) out of their parent's column `given`, shortages to siblings."""
    nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0).cast("long"))).withColumn("weight", F.greatest("weight", F.lit(1).cast("long")))
    family = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = family.orderBy(F.col("capacity") / F.col("weight"), name).rowsBetween(W.unboundedPreceding, -1)
    given = F.least(F.col("given"), F.sum("capacity").over(family))
    before = F.coalesce(F.sum("capacity").over(order), F.lit(0))
    weights = F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    nodes = nodes.withColumn("given", given).withColumn("full", F.col("capacity") * weights <= (F.col("given") - before) * F.col("weight"))
    used = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(F.lit(0).cast("long"))).over(family)
    open_weight = F.sum(F.when(F.col("full"), F.lit(0).cast("long")).otherwise(F.col("weight"))).over(family)
    return nodes.withColumns({"used": used, "open": open_weight}).withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(F.expr("(given - used) * weight div nullif(open, 0)")))).drop("full", "used", "open", "given", "capacity", "weight")


def leaf_budgets(leaves: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """(domain, lang, source, tokens, budget) for leaves (domain, lang, source, tokens)."""
    total = leaves.agg(F.floor(F.expr(f"coalesce(sum(tokens), 0) * {mix.budget_permille} div 1000")).cast("long").alias("given"))
    capacity = leaves.withColumn("capacity", F.col("tokens") * mix.epochs)
    out = None
    for depth in range(len(PATH)):
        path, parent = PATH[: depth + 1], PATH[:depth]
        nodes = capacity.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(mix, F.concat_ws("/", *path)))
        # The root's budget is one row; a family's is its parent's row.
        nodes = nodes.join(out.withColumnRenamed("budget", "given"), list(parent)) if parent else nodes.join(F.broadcast(total))
        out = _shared_out(nodes, parent, path[-1]).select(*path, "budget")
    return leaves.join(out, list(PATH))


def _place(mix: Mix, epoch: Column, key: Column) -> Column:
    """The digest that orders an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), key.cast("string")).cast("binary"))


def leaf_plan(rows: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """For rows (domain, lang, source, id, tokens): each leaf's whole epochs and, for one more, the last place taken."""
    leaves = settled(rows.groupBy(*PATH).agg(F.sum("tokens").cast("long").alias("tokens")))
    few = leaves.count() <= MOST_LEAVES
    fit = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    budgets = leaf_budgets(leaves, mix).select(*PATH, "tokens", "budget", F.coalesce(F.expr("budget div nullif(tokens, 0)"), F.lit(0)).cast("long").alias("whole"))
    budgets = settled(budgets.select(*PATH, "budget", "whole", (F.col("budget") - F.col("whole") * F.col("tokens")).alias("rest")))
    placed = rows.join(fit(budgets.where("rest > 0")), list(PATH)).withColumn("place", _place(mix, F.col("whole"), F.col("id"))).withColumn("slot", F.substring("place", 1, SLOT_DIGITS))
    slots = placed.groupBy(*PATH, "slot").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(W.partitionBy(*PATH).orderBy("slot"))
    ends = settled(slots.withColumn("upto", upto).where("upto > rest AND upto - n <= rest").select(*PATH, "slot", (F.col("rest") - F.col("upto") + F.col("n")).alias("left")))
    inside = placed.join(fit(ends), [*PATH, "slot"]).groupBy(*PATH, "slot", "place").agg(F.sum("tokens").alias("n"), F.first("left").alias("left"))
    inside = inside.withColumn("upto", F.sum("n").over(W.partitionBy(*PATH).orderBy("place"))).where("upto <= left")
    last = inside.groupBy(*PATH).agg(F.max("place").alias("last"))
    plan = budgets.join(ends.select(*PATH, "slot"), list(PATH), "left").join(last, list(PATH), "left")
    # A slot's digits alone come before every place inside it.
    return settled(plan.select(*PATH, "budget", "whole", F.coalesce("last", "slot", F.lit("")).alias("last")))


def mix_sources(docs: DataFrame, mix: Mix = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each epoch in which a row is taken: id, the columns in keep, domain, lang, source, n_tokens, epoch."""
    names = _names(mix, lang_col, source_col)
    measured = docs.select(F.col(id_col).alias("id"), n_tokens(F.col(text_col)).alias("tokens"), *[c.alias(f"__{k}") for k, c in names.items()])
    rows = settled(measured.select(*[F.col(f"__{k}").alias(k) for k in PATH], "id", "tokens"))
    plan = leaf_plan(rows, mix)
    plan = F.broadcast(plan) if plan.count() <= MOST_LEAVES else plan
    if keep:
        taken = docs.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)], n_tokens(F.col(text_col)).alias("__tokens"), *[c.alias(f"__{k}") for k, c in names.items()])
    else:
        taken = rows.select(F.col("id").alias("__id"), F.col("tokens").alias("__tokens"), *[F.col(k).alias(f"__{k}") for k in PATH])
    met = taken.join(plan, [F.col(f"__{k}") == F.col(k) for k in PATH])
    more = F.col("whole") + (_place(mix, F.col("whole"), F.col("__id")) <= F.col("last")).cast("long")
    met = met.withColumn("__n", more).where("__n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return met.select(F.col("__id").alias(id_col), *[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)], *[c for c in PATH if c not in keep], F.col("__tokens").alias("n_tokens"), "epoch")
