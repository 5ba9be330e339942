"""Retention: hides and deletes files whose rows were all received too long ago."""

from __future__ import annotations

import random
import threading
import time

from ..config import Config
from ..sources.store import Store


class Janitor:
    """Runs once before it is ready, then again and again at 75 to 100 % of the interval. After a failed pass it is not ready until one succeeds."""

    def __init__(self, config: Config, stores: dict[str, Store], clock=time.time_ns):
        self.config, self.stores, self.clock = config, stores, clock
        self.ready = False
        self.stopped = threading.Event()

    def sweep(self) -> dict[str, list[str]]:
        """The files deleted, by tenant."""
        gone = {}
        try:
            for tenant, store in self.stores.items():
                if (kept := self.config.kept(tenant)) is not None:
                    store.retire_before(max(0, self.clock() - kept))
                gone[tenant] = store.collect_retired()
        except Exception:
            self.ready = False
            raise
        self.ready = True
        return gone

    def run(self) -> None:
        while not self.stopped.is_set():
            try:
                self.sweep()
            except Exception:  # the next pass tries again; readiness tells
                pass
            self.stopped.wait(self.config.janitor_ms / 1000 * random.uniform(0.75, 1.0))

    def start(self) -> threading.Thread:
        thread = threading.Thread(target=self.run, daemon=True)
        thread.start()
        return thread

    def stop(self) -> None:
        self.stopped.set()
