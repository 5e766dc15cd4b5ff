"""Least fixpoints of joins: rules applied to what is new, until nothing is."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import SENT, merging, settled

#: Rounds after which the rows found so far are written together, so that a long chain keeps a short plan.
FOLD = 8


def fixpoint(seed: DataFrame, rules: Callable[[DataFrame], DataFrame], keys: list[str] | None = None) -> DataFrame:
    """seed and all that rules derive from it, rules from new rows only (semi-naive); a row whose keys are known is not new, so cycles end.

    Each round's new rows are written to the shared folder. Rounds are as many as the longest derivation has steps; what a round moves follows its
    new rows: where they are few they go to the known ones, which stay where they are."""
    keys = keys or seed.columns
    first = delta = settled(seed.dropDuplicates(keys))
    more: list[DataFrame] = []
    while not delta.isEmpty():
        fresh = settled(rules(delta).select(*seed.columns).dropDuplicates(keys))
        n = fresh.count()
        if not n:
            break
        known = reduce(DataFrame.unionByName, [first, *more]).select(*keys)
        if n <= SENT:
            # known rows differ from each other, so that no more than n of them can be met again
            known = F.broadcast(known.join(F.broadcast(fresh.select(*keys)), keys, "left_semi"))
        delta = settled(fresh.join(known if n <= SENT else merging(known), keys, "left_anti").select(*seed.columns))
        more.append(delta)
        if len(more) > FOLD:
            more = [settled(reduce(DataFrame.unionByName, more))]
    return merging(reduce(DataFrame.unionByName, [first, *more]))
