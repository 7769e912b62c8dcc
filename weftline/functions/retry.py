"""Retries: classes of errors, delays and attempt limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses and states of transient errors, and the longest wait a provider may ask for.
TRANSIENT_STATUS = (408, 425, 500, 502, 503, 504)
TRANSIENT_SQLSTATE = ("40001", "40P01", "55P03", "57014", "53300")
LONGEST_WAIT_MS = 604_800_000


def classify(status: Column, retry_after_ms: Column, kind: Column, sqlstate: Column, own_code: Column) -> Column:
    """struct(code, retryable).  ``kind`` is timeout, abort, transport or null; ``own_code`` that of a processing error."""

    def of(code, retryable: bool) -> Column:
        return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(retryable).alias("retryable"))

    return (
        F.when(own_code.isNotNull(), of(own_code, False))
        .when(retry_after_ms > LONGEST_WAIT_MS, of("retry_after_exceeds_limit", False))
        .when(status == 429, of("rate_limited", True))
        .when(status.isin(*TRANSIENT_STATUS), of("provider_transient", True))
        .when(status.isNotNull(), of("provider_terminal", False))
        .when(sqlstate.isin(*TRANSIENT_SQLSTATE), of("database_transient", True))
        .when(kind.isin("timeout", "abort"), of("provider_timeout", True))
        .when(kind == "transport", of("provider_transport", True))
        .otherwise(of("processing_terminal", False))
    )


def delay_ms(attempt: Column, retry_after_ms: Column, rnd: Column, base_ms: int = 1000, cap_ms: int = 60_000) -> Column:
    """Exponential, capped, with jitter from ``rnd`` in [0, 1); never less than the provider asked for."""
    step = F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(30)).cast("double"))
    own = F.ceil(F.least(F.lit(float(cap_ms)), F.lit(float(base_ms)) * step) * (F.lit(0.5) + F.lit(0.5) * rnd))
    return F.greatest(own, F.ceil(F.coalesce(retry_after_ms.cast("double"), F.lit(0.0)))).cast("long")


def attempt_limit(configured: int | None) -> int:
    return max(1, 5 if configured is None else configured)
