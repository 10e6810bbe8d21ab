"""Results of small reads, kept for a while under the generation they were read from."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable


class ResultCache:
    """At most ``most`` results for ``seconds`` each. A new generation is another key, so nothing stale is ever given."""

    def __init__(self, seconds: float = 60.0, most: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock, self.held = seconds, most, clock, OrderedDict()

    @staticmethod
    def key(tool: str, arguments: dict, graph: str, project: str, generation: str) -> str:
        text = json.dumps([tool, arguments, graph, project, generation], sort_keys=True, separators=(",", ":"), default=str)
        return hashlib.sha256(text.encode()).hexdigest()

    def get(self, key: str, make: Callable[[], object]) -> object:
        now, found = self.clock(), self.held.get(key)
        if found is not None and now - found[0] < self.seconds:
            self.held.move_to_end(key)
            return found[1]
        value = make()
        self.held[key] = now, value
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return value

    def clear(self) -> int:
        n = len(self.held)
        self.held.clear()
        return n
