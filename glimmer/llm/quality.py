"""Operator 7, quality rules: a ledger of rule bits and measurements, and policies applied to it.

Every rule is evaluated once per document, in one pass without a shuffle, on whole texts. The ledger
keeps a bit for each rule that failed and the numbers it was judged on; a policy is a named, versioned
mask over those bits, so that changing a policy or asking what each rule costs never reads a text again.

Defined results: a null text is an empty one (no words, so `too_few_words` fails); repeated rows are
judged each on their own; an empty table gives an empty ledger; a null id is kept as it is; columns of the
input other than the id and those in keep are left out, so that no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.shared import SPACE

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition holds; conditions only read measurements, in whole numbers."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a policy of an older version must keep its meaning.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "5 * n_symbols > n_words"),
    Rule(3, "word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words"),
    Rule(4, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(5, "shouting", "2 * n_upper > word_chars"),
    Rule(6, "no_words", "n_words = 0"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[x] for x in set(self.rules))


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("prose", 1, (*BASE.rules, "symbols", "word_length")),
    Policy("prose", 2, (*BASE.rules, "symbols", "word_length", "duplicate_lines", "shouting")),
    # For a corpus: short texts may be good ones.
    Policy("corpus", 1, ("no_words", "repeated_windows", "symbols", "word_length", "duplicate_lines", "shouting")),
)
CURRENT, CORPUS = POLICIES[2:]


def _measured(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), *keep, text.alias("__text"))
    rows = rows.withColumns({"__w": F.array_remove(F.split("__text", SPACE), ""), "__lines": F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    # Windows of three words as (hash, place), sorted, so that equal ones stand side by side.
    rows = rows.withColumn("__w3", F.transform(F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i"))))
    rows = rows.withColumn("__s", F.sort_array("__w3"))
    twice = lambda x, k: (x["h"] == F.get("__s", k - 1)["h"]) | (x["h"] == F.get("__s", k + 1)["h"])
    rows = rows.withColumn("__p", F.sort_array(F.transform(F.filter("__s", twice), lambda x: x["i"])))
    covered = F.transform("__p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("__p", k + 1) - x, F.lit(3))).cast("long"))
    without = lambda pattern: F.length("__text") - F.length(F.regexp_replace("__text", pattern, ""))
    return rows.select(
        F.col(id_col),
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        without("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        without("[A-Z]+").cast("long").alias("n_upper"),
        "__text",
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The id, the columns in keep, every measurement, and failed_bits (long): one bit per failed rule.

    Two windows of three words count as equal if their 64-bit hashes are; only windows of the same text
    are compared. `__text`, the text judged, comes last for callers that go on with it; it costs nothing
    where it is not selected.
    """
    bits: Column = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    # Zero, but not deterministic: a filter on the ledger must not be pushed below, where it would repeat the
    # measurements' expressions for every reference to them.
    barrier = F.shiftright(F.monotonically_increasing_id(), 63)
    return _measured(docs, id_col, text_col, keep).withColumn("failed_bits", bits.bitwiseOR(barrier))


def failed(policy: Policy) -> Column:
    """Whether a rule of the policy failed, from the ledger's bits."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def judge(rows: DataFrame, policy: Policy = CURRENT, base: Policy = BASE) -> DataFrame:
    """The ledger with base_failed and kept: base's rules go first, then those of the policy."""
    return rows.withColumns({"base_failed": failed(base), "kept": ~failed(base) & ~failed(policy)})


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents kept, failing the rule, failing it alone, and kept
    if the rule were dropped. Works on the histogram of bit patterns, at most 2 to the number of rules."""
    patterns = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p.name, p.version, r.name, p.mask, 1 << r.bit) for p in policies for r in rules if (1 << r.bit) & p.mask]
    table = F.array(*[F.struct(F.lit(a).alias("policy"), F.lit(b).alias("version"), F.lit(c).alias("rule"), F.lit(d).cast("long").alias("mask"), F.lit(e).cast("long").alias("bit")) for a, b, c, d, e in cases])
    rowed = patterns.select("failed_bits", "n", F.explode(table).alias("c")).select("failed_bits", "n", "c.*").withColumn("left", F.col("failed_bits").bitwiseAND(F.col("mask")))
    count = lambda where, name: F.sum(F.when(where, F.col("n")).otherwise(F.lit(0).cast("long"))).alias(name)
    return rowed.groupBy("policy", "version", "rule").agg(
        count(F.col("left") == 0, "n_kept"),
        count(F.col("left").bitwiseAND(F.col("bit")) != 0, "n_failed"),
        count(F.col("left") == F.col("bit"), "n_failed_alone"),
        count(F.col("left").bitwiseAND(F.bitwise_not("bit")) == 0, "n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of docs, all columns as they were, that the policy keeps."""
    judged = ledger(docs.withColumn("__row", F.struct(*docs.columns)), keep=("__row",))
    return judged.where(~failed(policy)).select("__row.*")
