"""Queries over the test tables, each with its SQL twin where one exists."""

from . import base
from . import (  # noqa: F401  (registration)
    audio_checks,
    dataset_checks,
    detection_checks,
    evaluation_checks,
    file_checks,
    filter_checks,
    target_checks,
)

QUERIES = base.QUERIES
ORACLES = base.ORACLES
