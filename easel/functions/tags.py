"""Comma-separated tags and captions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_tags(text: Column) -> Column:
    """Tags between commas, trimmed, empty ones dropped; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def join_tags(tags: Column) -> Column:
    return F.array_join(tags, ", ")


def _array(tags: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in tags]).cast("array<string>")


def insert_tags(text: Column, tags: Sequence[str], front: bool) -> Column:
    """Tags that the row lacks, put in front or behind; repeats within tags stay; the text is untouched if none lack."""
    have = split_tags(text)
    new = F.filter(_array(tags), lambda t: ~F.array_contains(have, t))
    return F.when(F.size(new) > 0, join_tags(F.concat(new, have) if front else F.concat(have, new))).otherwise(text)


def prepend_tags(text: Column, tags: Sequence[str]) -> Column:
    return insert_tags(text, tags, True)


def append_tags(text: Column, tags: Sequence[str]) -> Column:
    return insert_tags(text, tags, False)


def replace_tag(text: Column, old: str, new: str) -> Column:
    """Every such tag replaced, or dropped for an empty new one; the text is untouched without it."""
    have = split_tags(text)
    out = F.filter(F.transform(have, lambda t: F.when(t == old, F.lit(new)).otherwise(t)), lambda t: t != "")
    return F.when(F.array_contains(have, old), join_tags(out)).otherwise(text)


def remove_tag(text: Column, tag: str) -> Column:
    return replace_tag(text, tag, "")


def strip_think(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", ""), F.lit(" \t\r\n"))


def detect_provider(model: Column) -> Column:
    """By the model's name: gemini, claude, else openai."""
    m = F.lower(F.coalesce(model, F.lit("")))
    return F.when(m.contains("gemini"), "gemini").when(m.contains("claude"), "claude").otherwise("openai")


def build_prompts(system: Column, user: Column, image: Column | None = None, max_tokens: int = 0, temperature: float = 0.0) -> Column:
    """A request as JSON: messages with a system part if there is one, the image's place if given, and parameters
    above 0."""
    content = F.concat(user, F.coalesce(F.concat(F.lit(" <image:"), image, F.lit(">")), F.lit(""))) if image is not None else user
    role = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    messages = F.filter(F.array(F.when(F.coalesce(F.trim(system), F.lit("")) != "", role("system", system)), role("user", content)), lambda m: m.isNotNull())
    parts = [messages.alias("messages")]
    if max_tokens > 0:
        parts.append(F.lit(max_tokens).alias("max_tokens"))
    if temperature > 0:
        parts.append(F.lit(temperature).alias("temperature"))
    return F.to_json(F.struct(*parts))


def preview(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
