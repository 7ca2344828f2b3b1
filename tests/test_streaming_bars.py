"""Streaming bars take no watermark, which would drop late rows."""

import inspect

from tidemark.streaming import bars


def test_bars_cannot_drop_late_rows():
    assert list(inspect.signature(bars.bars).parameters) == ["events"]
    assert "withWatermark" not in inspect.getsource(bars)
