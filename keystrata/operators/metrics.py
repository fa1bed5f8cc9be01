"""Counts of durations in explicit buckets, and gauges, kept on the driver."""

from __future__ import annotations

import bisect
import resource
import time
from contextlib import contextmanager

from keystrata.operators import histogram


class Metrics:
    """Histograms are named (metric, table); a metric's suffix chooses its bounds."""

    def __init__(self):
        self.counts: dict[tuple[str, str], list[int]] = {}

    def record(self, metric: str, table: str, value: float) -> None:
        bounds = histogram.bounds_of(metric)
        held = self.counts.setdefault((metric, table), [0] * (len(bounds) + 1))
        held[bisect.bisect_left(bounds, value)] += 1

    @contextmanager
    def timed(self, metric: str, table: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.record(metric, table, (time.perf_counter() - began) * (1e6 if metric.endswith("_us") else 1e3))


def process_gauges() -> dict[str, int]:
    """Memory and CPU of the driver's Python process."""
    used = resource.getrusage(resource.RUSAGE_SELF)
    with open("/proc/self/statm") as file:
        pages = file.read().split()
    size = resource.getpagesize()
    return {"virtual_bytes": int(pages[0]) * size, "resident_bytes": int(pages[1]) * size, "cpu_ms": int(1000 * (used.ru_utime + used.ru_stime)), "read_blocks": used.ru_inblock, "written_blocks": used.ru_oublock}
