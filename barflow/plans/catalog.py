"""All registered queries."""

from barflow.plans import bars, labels, models, research, stores, streams, text, trading  # noqa: F401
from barflow.plans.registry import ORACLES, QUERIES  # noqa: F401
