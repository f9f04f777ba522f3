"""Cancellation and deadlines."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from dataclasses import dataclass, field

from .errors import Cancelled


class CancellationToken:
    def __init__(self) -> None:
        self._event = threading.Event()

    def cancel(self) -> None:
        self._event.set()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()


@dataclass
class Control:
    """A token and an absolute deadline (``time.monotonic`` seconds)."""

    token: CancellationToken = field(default_factory=CancellationToken)
    deadline: float | None = None

    def check(self, operation: str) -> None:
        if self.token.cancelled:
            raise Cancelled(f"{operation} was cancelled")
        if self.deadline is not None and time.monotonic() >= self.deadline:
            raise Cancelled(f"{operation} passed its deadline")

    @contextlib.contextmanager
    def watching(self, spark):
        """Interrupts the Spark jobs of the block when it is cancelled or late."""
        tag, done = f"recordloom-{uuid.uuid4().hex}", threading.Event()

        def watch() -> None:
            while not done.wait(0.05):
                if self.token.cancelled or (self.deadline is not None and time.monotonic() >= self.deadline):
                    spark.interruptTag(tag)
                    return

        spark.addTag(tag)
        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield
        except Exception as e:
            self.check("operation")
            raise e
        finally:
            done.set()
            spark.removeTag(tag)
