"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of all scripts in the basic plane that decompose to a letter and marks, by rule.
_MARKED = "".join(c for c in map(chr, range(0xC0, 0xD800)) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(map(unicodedata.combining, d[1:])))
_BASE = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)

SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z(])"
PARAGRAPH_BREAK = r"\n\s*\n+"


def strip_space(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def end_space(text: Column) -> Column:
    """Unicode white space off the end."""
    return F.regexp_replace(text, r"(?U)\s+$", "")


def is_blank(text: Column) -> Column:
    """Whether there is nothing but white space; null is blank."""
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def fold(text: Column) -> Column:
    """Lower case without diacritics, be they part of a letter or marks behind it."""
    low = F.lower(text)
    # The table is looked up for each character, so only where one can be in it.
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(low, _MARKED, _BASE), r"\p{M}+", "")).otherwise(low)


def tokenize(text: Column) -> Column:
    """Lower-case words of letters and digits, diacritics removed."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def split_units(text: Column, strategy: str = "sentence") -> Column:
    """Trimmed, non-empty sentences or paragraphs."""
    if strategy not in ("sentence", "paragraph"):
        raise ValueError(f"strategy: {strategy}")
    parts = F.split(text, "(?U)" + (SENTENCE_BREAK if strategy == "sentence" else PARAGRAPH_BREAK))
    return F.filter(F.transform(parts, strip_space), lambda x: x != "")


def raw_words(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def snippet(text: Column, words: Column, width: int = 160, lead: int = 40) -> Column:
    """A window that starts ``lead`` before the first query word found as it is written (but for case), in query order; else the head."""
    places = F.filter(F.transform(words, lambda w: F.instr(F.lower(text), F.lower(w))), lambda p: p > 0)
    start = F.greatest(F.coalesce(F.get(places, F.lit(0)), F.lit(1)) - lead, F.lit(1))
    return strip_space(F.substr(text, start, F.lit(width)))


def parse_reply(reply: Column) -> Column:
    """JSON text of the object in a model's reply, null if there is none: fences off, then first ``{`` to last ``}``."""
    bare = F.regexp_replace(strip_space(reply), r"(?m)^```(?:json)?\s*|\s*```$", "")
    found = F.regexp_extract(bare, r"\{[\s\S]*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def reply_error(reply: Column) -> Column:
    """Why a reply holds no object, or null."""
    bare = F.regexp_replace(strip_space(reply), r"(?m)^```(?:json)?\s*|\s*```$", "")
    found = F.regexp_extract(bare, r"\{[\s\S]*\}", 0)
    return F.when(F.coalesce(found, F.lit("")) == "", "model reply contained no JSON object").when(F.try_parse_json(found).isNull(), "model reply was not valid JSON")


def extract_prompt(prompt: Column, schema_json: Column, content: Column) -> Column:
    """The user message of a structured extraction."""
    # The wording of the message.
    ask = "\n\nReturn ONLY a JSON object that validates against this JSON schema. No prose, no markdown fences:\n"
    return F.concat(prompt, F.lit(ask), schema_json, F.lit("\n\nCONTENT:\n"), content)


def summary_prompt(focus: Column) -> Column:
    # The wording of the message.
    base = "Summarize the content below. Produce a concise prose `summary` and a `key_points` list of the most important takeaways."
    return F.when(F.coalesce(focus, F.lit("")) == "", F.lit(base)).otherwise(F.concat(F.lit(base + " Focus on: "), focus, F.lit(".")))


def classify_prompt(labels: Column, multi_label: Column) -> Column:
    # The wording of the message.
    head, pick_all, pick_one = "Classify the content below against this taxonomy: ", "Select every label that applies", "Select the single best label"
    tail = ". Put the chosen label(s) in `labels`, a per-label probability 0..1 map in `confidence`, and a one-sentence `rationale`."
    return F.concat(F.lit(head), F.array_join(labels, ", "), F.lit(".\n"), F.when(multi_label, pick_all).otherwise(pick_one), F.lit(tail))
