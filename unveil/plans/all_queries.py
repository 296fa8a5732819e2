"""Import every query module so each registers its queries."""

from unveil.plans import cleaner_queries  # noqa: F401
from unveil.plans import pipeline_queries  # noqa: F401
from unveil.plans import ledger_queries  # noqa: F401
from unveil.plans import evaluation_queries  # noqa: F401
from unveil.plans import receipt_queries  # noqa: F401
from unveil.plans import streaming_queries  # noqa: F401
