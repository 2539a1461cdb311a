"""Unions of label lists.

Labels of a fixed vocabulary are bits: a list becomes a number, lists are united by ``bit_or``,
and the map side holds one number per key whatever the lists are.  Labels outside the vocabulary
are taken out of their lists and made distinct before they meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import lookup

WORD_BITS = 62


@dataclass(frozen=True)
class Labels:
    """A vocabulary; ``closed`` says that lists hold no other labels."""

    vocabulary: Sequence[str]
    closed: bool = False
    words: list[list[str]] = field(init=False)

    def __post_init__(self):
        known = sorted(set(self.vocabulary))
        object.__setattr__(self, "words", [known[i:i + WORD_BITS] for i in range(0, len(known), WORD_BITS)])

    def known(self, value: Column) -> Column:
        """Aggregate: the vocabulary's labels in any list of the group, sorted."""
        parts = []
        for word in self.words:
            bit = {label: 1 << i for i, label in enumerate(word)}
            bits = F.aggregate(value, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(F.coalesce(lookup(x, bit).cast("bigint"), F.lit(0).cast("bigint"))))
            united = F.coalesce(F.bit_or(bits), F.lit(0).cast("bigint"))
            parts.append(F.array_compact(F.array(*[F.when(F.getbit(united, F.lit(i)) == 1, F.lit(label)) for i, label in enumerate(word)])))
        return F.array_sort(F.concat(*parts)) if parts else F.array().cast("array<string>")

    def others(self, value: Column) -> Column:
        """The labels of one list that the vocabulary does not hold."""
        present = F.coalesce(F.array_compact(value), F.array().cast("array<string>"))
        every = [label for word in self.words for label in word]
        return F.filter(present, lambda x: ~x.isin(every)) if every else present


def other_labels(df: DataFrame, keys: Sequence[str], name: str, labels: Labels, out: str) -> DataFrame:
    """Per key the labels outside the vocabulary, sorted; keys without any are left out."""
    apart = df.select(*keys, F.explode(labels.others(F.col(name))).alias("__label")).distinct()
    return apart.groupBy(*keys).agg(F.array_sort(F.collect_list("__label")).alias(out))


def union_of_labels(df: DataFrame, keys: Sequence[str], names: dict[str, Labels], *more: Column) -> DataFrame:
    """One row per key (nulls are keys too): the union of each list column, sorted, and further aggregates."""
    out = df.groupBy(*keys).agg(*[labels.known(F.col(name)).alias(name) for name, labels in names.items()], *more)
    for name, labels in names.items():
        if not labels.closed:
            out = with_others(out, other_labels(df, keys, name, labels, "__others"), keys, name)
    return out


def with_others(out: DataFrame, others: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    right = others.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__others")
    same = None
    for k in keys:
        eq = out[k].eqNullSafe(right[f"__k_{k}"])
        same = eq if same is None else same & eq
    both = F.when(F.col("__others").isNull(), F.col(name)).otherwise(F.array_sort(F.concat(name, F.coalesce("__others", F.array().cast("array<string>")))))
    return out.join(right, same, "left").withColumn(name, both).drop("__others", *[f"__k_{k}" for k in keys])
