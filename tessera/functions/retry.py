"""Classification of errors and delays between attempts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, in the order they are tried, types and advice.
RATE_LIMIT = r"(?i)\b429\b|rate.?limit|too many requests"
AUTH = r"(?i)\b(401|403)\b|unauthorized|forbidden|invalid api key|permission denied|not set"
TRANSIENT = r"(?i)\b(408|500|502|503|504)\b|timeout|timed out|temporarily|unavailable|overloaded|connection (?:reset|refused|error)"
RETRY_AFTER = r"""(?i)retry[- ]?after["':\s]+(\d+(?:\.\d+)?)"""
TERMINAL_TYPES = ("ValueError", "TypeError", "KeyError", "FileNotFoundError", "LookupError", "NotImplementedError")


def error_class(message: Column, kind: Column) -> Column:
    """rate_limit, auth, transient, terminal or unknown."""
    return (
        F.when((kind == "RateLimited") | message.rlike(RATE_LIMIT), "rate_limit")
        .when(message.rlike(AUTH), "auth")
        .when(message.rlike(TRANSIENT), "transient")
        .when(kind.isin(*TERMINAL_TYPES), "terminal")
        .otherwise("unknown")
    )


def retryable(error: Column) -> Column:
    return error.isin("rate_limit", "transient", "unknown")


def retry_after(message: Column, error: Column) -> Column:
    found = F.regexp_extract(message, RETRY_AFTER, 1)
    return F.when(error.isin("rate_limit", "transient") & (found != ""), found.cast("double"))


def backoff_delay(attempt: Column, *, initial: float = 1.0, most: float = 60.0, fixed: bool = False, at_least: Column | None = None) -> Column:
    """Seconds before the given retry (from 1), without jitter; never under what the provider asked for."""
    base = F.lit(initial) if fixed else F.lit(initial) * F.pow(F.lit(2.0), attempt - 1)
    delay = F.when(attempt < 1, F.lit(0.0)).otherwise(F.least(base, F.lit(most)))
    return delay if at_least is None else F.greatest(delay, F.coalesce(at_least, F.lit(0.0)))
