"""Registered queries: each module adds its family to the registry when imported."""
import importlib

from .registry import ORACLES, QUERIES

FAMILIES = ["features", "spatial", "tracks", "roads", "terrain", "feeds", "charts", "sources", "navigation", "guidance", "layers"]
for _m in FAMILIES:
    importlib.import_module(f"{__name__}.{_m}")

__all__ = ["ORACLES", "QUERIES"]
