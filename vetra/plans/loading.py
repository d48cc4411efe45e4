"""The evaluation's load of a manifest as one plan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.operators import checks, lineage
from vetra.operators.metrics import LABELS, label_heads
from vetra.operators.plan_lineage import must_not_read

# What of a held-out row may be read, and the other splits.
CROSSING = ("content_group_key", "recommended_content_split")
SPLITS = ("train", "validation")


class Loaded(NamedTuple):
    """train and validation rows, each with its five heads' labels; the faults found; the groups that cross splits; and the counts."""

    train: DataFrame
    validation: DataFrame
    faults: DataFrame
    crossings: DataFrame
    summary: DataFrame


def load(manifest: DataFrame, held: str = "test") -> Loaded:
    """Isolates the held-out rows, validates the rest, looks for groups across splits, and gives each row its heads' labels; lazily, from one table.

    Of held-out rows only the group and the split are read: must_not_read() proves it of the plan of the crossings. Faults are rows (rule, key, detail), not an exception, so that all are
    told; checks.gate() or a count decides. The labels fail for a dataset or label outside the contract.
    """
    isolated, rest = checks.isolation_split(manifest, CROSSING[1], held, list(CROSSING))
    held_rows = lineage.strict_crossings(isolated, *CROSSING, held)
    others = [c for c in manifest.columns if c not in CROSSING]
    found = must_not_read(lineage.crossings(rest.select(*CROSSING).unionByName(held_rows), *CROSSING), others)
    faults = checks.violations(
        rest, ["dataset", "sample_id"], ["content_group_key", "sample_id"], {"dataset": tuple(LABELS), "recommended_content_split": SPLITS}, {"eligible": F.lower(F.col("training_eligible").cast("string")) == "true"},
    )
    heads = label_heads(rest)
    part = lambda s: heads.where(F.col(CROSSING[1]) == s)
    counted = manifest.groupBy(CROSSING[1]).agg(F.count("*").alias("row_count"), F.count_distinct("content_group_key").alias("group_count"))
    return Loaded(part(SPLITS[0]), part(SPLITS[1]), faults, found, counted)
