"""All registered queries."""

from rolemill.plans.catalog import columns, files, labelling, statistics, streams, tables, trees  # noqa: F401
from rolemill.plans.catalog.base import ORACLES, QUERIES  # noqa: F401
