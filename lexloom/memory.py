"""Memory of the driver process: sampled, with its peak, and one warning above a limit."""

from __future__ import annotations

import logging
import threading

log = logging.getLogger(__name__)


def resident_bytes(pid: str = "self") -> int:
    try:
        with open(f"/proc/{pid}/status") as f:
            for line in f:
                if line.startswith("VmRSS:"):
                    return int(line.split()[1]) * 1024
    except OSError:
        pass
    return 0


class MemoryMonitor:
    """Samples in a thread until stopped; usable as a context."""

    def __init__(self, warn_at: int | None = None, interval: float = 5.0):
        self.warn_at, self.interval, self.peak, self.warned = warn_at, interval, 0, False
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def sample(self) -> int:
        now = resident_bytes()
        self.peak = max(self.peak, now)
        if self.warn_at is not None and now > self.warn_at and not self.warned:
            self.warned = True
            log.warning("memory %d bytes is above the limit of %d", now, self.warn_at)
        return now

    def _run(self) -> None:
        while not self._stop.wait(self.interval):
            self.sample()

    def start(self) -> MemoryMonitor:
        self.sample()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def stop(self) -> int:
        self._stop.set()
        if self._thread:
            self._thread.join()
            self._thread = None
        self.sample()
        return self.peak

    __enter__ = start

    def __exit__(self, *exc) -> None:
        self.stop()
