"""Finds, explains, removes and re-checks sensitive identifiers in slide files and text tables, on Spark.

The names of the public interface are loaded when they are first asked for.
"""

from importlib import import_module

_PLACES = {
    "scan": "operators.scan",
    "anonymize": "operators.anonymize",
    "verified": "operators.anonymize",
    "recheck": "operators.recheck",
    "info": "operators.info",
    "preflight": "operators.report",
    "certificate": "operators.report",
    "RuleSet": "functions.rules",
    "register": "sources.datasource",
    "watch": "streaming.landing",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name in _PLACES:
        return getattr(import_module(f"{__name__}.{_PLACES[name]}"), name)
    raise AttributeError(name)
