"""Registered queries: the operators bound to the supplied tables, each with its SQL oracle."""

from importlib import import_module

MODULES = (
    "evaluation datasets sampling text history diffs provenance lifetimes statistics vectors "
    "modelling ingestion maintenance streams"
).split()


def load_all() -> None:
    import_module("faultline.plans.views")
    for name in MODULES:
        import_module(f"faultline.plans.{name}")
