"""Lineage walks against walking by hand: several predecessors, lost ones, circles, other runs."""

import random

from rowwarden.operators import lineage

SCHEMA = "event_id string, kind string, quality_run_id string, predecessor_ids array<string>"
KINDS = ("quality_report", "candidate_proposal", "plan_compiled", "evaluation", "approval_review", "human_approved", "apply_succeeded")


def plain(rows):
    out = []
    level = [(e, e, r, k, 0) for e, k, r, _ in rows if k == "quality_report"]
    while level and level[0][4] < lineage.CHAIN_LENGTH:
        out += level
        level = [(root, e, run, k, depth + 1) for root, above, run, _, depth in level for e, k, r, before in rows
                 for p in before if p == above and r == run]
    return sorted((root, run, e, k, depth) for root, e, run, k, depth in out)


def test_walks_equal_plain(spark):
    rng = random.Random(3)
    rows = []
    for run in ("a", "b"):
        stages = [[f"{run}0"]] + [[f"{run}{n}-{i}" for i in range(5)] for n in range(1, 7)]
        for n, names in enumerate(stages):
            for name in names:
                before = rng.sample(stages[n - 1], min(len(stages[n - 1]), rng.randint(0, 2))) if n else []
                rows.append((name, KINDS[n], run, before + (rng.choices(["lost", "b0"], k=rng.randint(0, 1)) if n else [])))
    rows += [("c1", "evaluation", "a", ["c2"]), ("c2", "evaluation", "a", ["c1", "a0"]), ("none", "plan_compiled", "a", [])]
    found = lineage.walk_runs(spark.createDataFrame(rows, SCHEMA))
    want = plain(rows)
    assert len(want) > 30 and max(row[4] for row in want) == 6
    assert sorted((r.root_id, r.quality_run_id, r.event_id, r.kind, r.depth) for r in found.collect()) == want


def test_nothing_to_walk(spark):
    assert lineage.walk_runs(spark.createDataFrame([], SCHEMA)).count() == 0
