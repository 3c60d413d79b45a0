"""Queries over the shared tables, each with its SQL twin where SQL can say it."""

from docprep.workloads import catalogue, content, files, feeds, layering, logs, packages, runs, structure

MODULES = (layering, catalogue, packages, structure, content, logs, runs, files, feeds)


def all_queries():
    out = {}
    for module in MODULES:
        out.update(module.QUERIES)
    return out


def all_sql():
    out = {}
    for module in MODULES:
        out.update(module.SQL)
    return out
