"""Tables that cut lineage; see :mod:`quillspark.storage`."""

from __future__ import annotations

from ..storage import dropped, merged, saved, shared_folder

__all__ = ["dropped", "merged", "saved", "shared_folder"]
