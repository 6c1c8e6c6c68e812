"""Training-data operators: queries() and oracle_sql() gather those of the modules."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("mixing", "suffix", "tokencount", "pst", "quality", "simhash", "chat", "licenses", "decontam", "warc", "packing", "repair", "variants")


def queries() -> dict:
    """opN_<name> of every module, by N."""
    found = {n: f for m in _MODULES for n, f in vars(import_module(f"{__name__}.{m}")).items() if n.startswith("op") and n[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {n: q for m in _MODULES for n, q in getattr(import_module(f"{__name__}.{m}"), "SQL", {}).items()}
