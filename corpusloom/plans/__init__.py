"""Queries over the driver's tables; ALL has every registered one, with its SQL."""

from . import disk, markup, queries, registry, reports, rules

MODULES = (queries, reports, rules, markup, disk)
ALL = registry
