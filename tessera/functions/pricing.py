"""Prices of model calls as column expressions. Rates are dollars per million tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (input, input beyond the long threshold, output, output beyond it).
MODEL_RATES = {
    "gemini-3.1-pro": (2.00, 4.00, 12.00, 18.00),
    "gemini-3-pro": (2.00, 4.00, 12.00, 18.00),
    "gemini-3-flash": (0.50, 0.50, 3.00, 3.00),
    "gemini-2.5-pro": (1.25, 2.50, 10.00, 15.00),
    "gemini-2.5-flash-lite": (0.10, 0.10, 0.40, 0.40),
    "gemini-2.5-flash": (0.30, 0.30, 2.50, 2.50),
    "gemini-2.0-flash": (0.10, 0.10, 0.40, 0.40),
    "claude-opus-4": (15.00, 15.00, 75.00, 75.00),
    "claude-sonnet-4": (3.00, 3.00, 15.00, 15.00),
    "claude-haiku-4": (1.00, 1.00, 5.00, 5.00),
    "claude-3-5-sonnet": (3.00, 3.00, 15.00, 15.00),
    "claude-3-5-haiku": (0.80, 0.80, 4.00, 4.00),
    "gpt-4o-mini": (0.15, 0.15, 0.60, 0.60),
    "gpt-4o": (2.50, 2.50, 10.00, 10.00),
    "gpt-4.1": (2.00, 2.00, 8.00, 8.00),
}
FALLBACK_RATES = (2.00, 4.00, 12.00, 18.00)
LONG_TOKENS = 200_000
VIDEO_TOKENS_A_SECOND = {"low": 102, "medium": 290, "high": 312}
SPEECH_DOLLARS_AN_HOUR = {"universal-3-5-pro": 0.21, "universal-2": 0.15}
SPEECH_DEFAULT, SPEECH_SPEAKERS = 0.21, 0.02


def rates(model: Column) -> Column:
    """Rates of the longest table key contained in the lower-cased name, else the fallback."""
    name = F.lower(model)
    pick = F.lit(None)
    for key in sorted(MODEL_RATES, key=len):
        pick = F.when(F.contains(name, F.lit(key)), F.array(*map(F.lit, MODEL_RATES[key]))).otherwise(pick)
    return F.coalesce(pick, F.array(*map(F.lit, FALLBACK_RATES)))


def estimate_cents(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    r = rates(model)
    far = tokens_in > LONG_TOKENS
    dollars = tokens_in / 1e6 * F.when(far, r[1]).otherwise(r[0]) + tokens_out / 1e6 * F.when(far, r[3]).otherwise(r[2])
    return dollars * 100


def video_tokens(duration: Column, resolution: Column) -> Column:
    rate = F.lit(VIDEO_TOKENS_A_SECOND["medium"])
    for name, value in VIDEO_TOKENS_A_SECOND.items():
        rate = F.when(F.lower(resolution) == name, value).otherwise(rate)
    return F.floor(F.greatest(F.coalesce(duration, F.lit(0.0)), F.lit(0.0)) * rate)


def speech_cents(duration: Column, model: Column, speakers: Column) -> Column:
    name = F.regexp_replace(model, "^assemblyai/", "")
    rate = F.lit(SPEECH_DEFAULT)
    for key, value in SPEECH_DOLLARS_AN_HOUR.items():
        rate = F.when(name == key, value).otherwise(rate)
    return F.coalesce(duration, F.lit(0.0)) / 3600 * (rate + F.when(speakers, SPEECH_SPEAKERS).otherwise(0.0)) * 100
