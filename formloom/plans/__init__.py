"""Registered queries: one per operator, with the SQL of the same result."""

from importlib import import_module

MODULES = ("outline", "fourier", "sources", "tables", "joins", "morphospace", "cluster", "resampling", "pixels", "analysis")


def load():
    from .registry import QUERIES, SQL
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return QUERIES, SQL
