"""opslens: operational analytics reports as Spark DataFrame functions."""
from __future__ import annotations

from .params import ALL_PANELS, CustomPanel, Params
from .sources import Sources

__version__ = "0.1.0"
__all__ = ["ALL_PANELS", "CustomPanel", "Params", "Sources"]
