"""Intermediate tables: where they lie, and that they go."""

import os

import pytest

from tickloom import constants, session


def test_tables_are_released(spark):
    frame = session.materialise(spark.range(10), "ten")
    path = session._WRITTEN[-1]
    assert frame.count() == 10 and os.path.isdir(path.removeprefix("file://"))
    session.release(spark)
    assert not os.path.exists(path.removeprefix("file://")) and not session._WRITTEN


def test_a_cluster_must_name_the_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://head:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_fixed_values():
    """What both sides of the comparison import is pinned by value here."""
    assert constants.LATENCY_BOUNDS == [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
    assert constants.WALK_FORWARD_GRID == [(1.0, 0.5), (0.8, 0.4), (0.6, 0.3)]
    assert constants.REGIME_FEATURES == ["rsi_dev", "macd_hist_norm", "ema_slope", "vol20", "ret10"]
    assert len(constants.FINANCE_LEXICON) == 39
