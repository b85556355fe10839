"""Packing in a session of many shuffle partitions: its small table of ranks isn't dealt over a file each."""

import random
from collections import defaultdict
from pathlib import Path

import pytest

MANY = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.mark.parametrize("threshold", ["256k", "-1"])
def test_files_follow_the_tasks_not_the_shuffle_partitions(spark, threshold):
    from sigspark.llm import op3_packing
    from sigspark.llm.common import shared_folder

    rng = random.Random(7)
    rows = [(i, "word " * rng.randrange(600)) for i in range(2000)]
    settings = MANY | {"spark.sql.autoBroadcastJoinThreshold": threshold}
    old = {k: spark.conf.get(k, None) for k in settings}
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.rglob("part-*.parquet"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = op3_packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(12)).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    made = set(folder.rglob("part-*.parquet")) - before
    assert len([p for p in made if "/pieces/" in str(p)]) <= 12
    assert len([p for p in made if "/ranks/" in str(p)]) <= 8
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(r["doc_id"] for r in got) == list(range(2000))
    total = 0
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert total == sum(t.count("word") + 1 for _, t in rows) and len(used) <= 1.02 * total / 4096 + 2
