"""Classification of model failures and of the service's own errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def provider_error_code(status: Column) -> Column:
    """The job error code of an HTTP status that an embedding provider answered with; null (no answer) is a transport error."""
    return (
        F.when(status.isNull(), "transport").when(status == 408, "provider_timeout").when(status == 429, "provider_rate_limited")
        .when(status.between(500, 599), "provider_unavailable").when(status.between(400, 499), "provider_rejected").otherwise("invalid_response")
    )


#: Status that each kind of the service's errors is answered with; anything else is 500.
STATUS = {"invalid": 400, "not_found": 404, "conflict": 409, "unavailable": 503, "extraction_rejected": 502, "timeout": 504, "cancelled": 408}


def status_of(error: BaseException) -> int:
    from recallframe.service import Invalid, NotFound
    from recallframe.sources.ports import Unavailable
    from recallframe.sources.snapshots import Conflict

    kinds = ((Invalid, "invalid"), (NotFound, "not_found"), (Conflict, "conflict"), (Unavailable, "unavailable"), (TimeoutError, "timeout"))
    return next((STATUS[k] for t, k in kinds if isinstance(error, t)), 500)
