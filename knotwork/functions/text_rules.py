"""The rules of text.py that tasks need in plain Python."""

from __future__ import annotations

import re


def make_id_of(*parts: str | None) -> str:
    kept = [re.sub(r"^[_ .]+|[_ .]+$", "", p.strip()) for p in parts if p]
    return re.sub(r"^_+|_+$", "", re.sub(r"[^a-zA-Z0-9]+", "_", "_".join(p for p in kept if p))).lower()
