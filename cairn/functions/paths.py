"""Names that follow from paths, outside Spark."""

from __future__ import annotations

import re

SUFFIX = re.compile(r"\.(py|pyi|ts|tsx|js|jsx|go|rs|java|ps1|psm1)$")


def module_name(path: str) -> str:
    """Dotted module of a path: without root, any ``src`` part and a known suffix."""
    return ".".join(p for p in SUFFIX.sub("", path).split("/") if p not in ("", ".", "src"))
