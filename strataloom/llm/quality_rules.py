"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once per document. The ledger row holds the
measurements and one integer whose bit r is set when rule r fails. A policy is a
named, versioned mask over those bits, so changing a policy or asking what a
rule contributes (an ablation) is bit arithmetic over the ledger, never another
pass over the texts.

Null and empty texts have no words: all measurements are 0 and ``few_words``
fails. Repeated rows get a row each. Very long texts are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_stats import COUNTS, with_counts


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true."""

    bit: int
    name: str
    fails: str


#: Integer arithmetic only, so that no verdict hangs on rounding.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_words"),
    Rule(4, "short_words", "n_words > 0 AND 10 * word_chars < 18 * n_words"),
    Rule(5, "long_words", "n_words > 0 AND word_chars > 20 * n_words"),
)
BASE_MASK = 0b11

#: Versioned policies. A version is never edited; a change gets a new name.
POLICIES = {"base-1": BASE_MASK, "web-1": 0b000111, "web-2": 0b111111}


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, the five measurements, fail_bits long) of every row; no shuffle."""
    bits: Column = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return with_counts(docs, id_column, text_column, wide=False).withColumn("fail_bits", bits)


def passes(mask: int, bits: str = "fail_bits") -> Column:
    """Whether a ledger row has no failure among the mask's rules."""
    return F.col(bits).bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """The ledger with ``kept`` under a versioned policy."""
    return rows.withColumn("kept", passes(POLICIES[version]))


def ablations(rows: DataFrame, version: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, n_failed, n_only): rows a rule fails, and rows it alone rejects under a policy.

    One aggregation over masked bits; its groups are at most 2**len(rules).
    """
    mask = POLICIES[version]
    masked = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    used = [r for r in rules if mask >> r.bit & 1]
    sums = masked.agg(
        *(F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0, F.col("n"))), F.lit(0)).alias(f"a{r.bit}") for r in used),
        *(F.coalesce(F.sum(F.when(F.col("bits") == 1 << r.bit, F.col("n"))), F.lit(0)).alias(f"o{r.bit}") for r in used),
    )
    return sums.select(F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"a{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only")) for r in used))).alias("x")).select("x.*")


def digest(docs: DataFrame, version: str = "web-2") -> DataFrame:
    """The ledger with the base verdict and the policy's verdict, one row per document."""
    return apply_policy(ledger(docs), version).select(
        "doc_id", *COUNTS[:5], (~passes(BASE_MASK)).alias("base_failed"), (passes(BASE_MASK) & F.col("kept")).alias("kept"), "fail_bits"
    )
