"""Queries by theme; each module holds QUERIES and ORACLE."""

from . import checks, effect, files, formats, further, genomics, references, sequence, text

MODULES = (text, sequence, genomics, effect, formats, checks, references, files, further)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
