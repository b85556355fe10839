"""op4: what lies on disk while the blocks are made, and the runs that sites of a dish share."""

from pathlib import Path

import numpy as np
import pytest

from sigspark.llm import common, op4_lm
from sigspark.llm import pitman_yor as P


class Enough(Exception):
    pass


def test_pairs_lie_in_the_blocks_only(spark, monkeypatch):
    """Tables that exist when the blocks are written: the parts and the blocks, less than 1.6 times the texts' bytes; a table
    of each part's pairs would be as much again."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = sum(len((r["text"] or "").encode()) for r in docs.select("text").collect())
    folder = Path(common.shared_folder(spark).removeprefix("file://").removeprefix("file:"))
    files = lambda: {f: f.stat().st_size for f in folder.rglob("*.parquet")}
    real, before = op4_lm.bucketed, files()

    def until_blocks(df, name, *rest):
        real(df, name, *rest)
        raise Enough

    monkeypatch.setattr(op4_lm, "bucketed", until_blocks)
    with pytest.raises(Enough):
        op4_lm.model_scores(docs, blocks=4)
    assert sum(n for f, n in files().items() if f not in before) < 1.6 * text


@pytest.mark.parametrize("d", [0.3, 0.8, 0.93])
def test_shared_runs_are_each_sites_own(d):
    """Sites of one dish read one run: ratios from one count to the next are those of Stirling numbers worked out alone."""
    rng = np.random.default_rng(3)
    dish = rng.integers(0, 12, 200)
    t = rng.integers(1, 60, 12)[dish]
    c = (300 + 400 * rng.integers(0, 9, 12))[dish] - rng.integers(1, 48, 200)
    m = rng.choice([2, 3, 6, 12, 24, 48], 200)
    runs, first = P.shared_runs(d, dish, c, t, m)
    for i in range(200):
        alone = P.log_stirling(d, c[i] + np.arange(1, m[i] + 1), t[i])
        assert np.diff(runs[first[i] : first[i] + m[i]]) == pytest.approx(np.diff(alone), abs=1e-8)


def test_distinct_pairs_of_any_size():
    for big in (0, 1 << 40):
        c, t = np.array([5, 3, 5, 3, 9]) + big, np.array([2, 1, 2, 3, 1]) + big
        assert [x.tolist() for x in P.distinct(c, t)] == [[3 + big, 3 + big, 5 + big, 9 + big], [1 + big, 3 + big, 2 + big, 1 + big], [1, 1, 2, 1]]


def test_numbers_in_planes_come_back():
    for x in (np.zeros(0, np.int64), np.array([0]), np.array([7, 255]), np.array([0, 256, 65_535]), np.array([1, 1 << 23, 3]), np.array([1 << 31, 5])):
        assert op4_lm._unplaned(op4_lm._unzipped(op4_lm._zipped(op4_lm._planes(x)))).tolist() == x.tolist()
