"""Chunks of Markdown under a token budget, as Column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions.columns import let

CHARS_PER_TOKEN, TOKENS = 4, 8000
_STATE = "struct<done:array<string>,held:string>"


def _packed(parts, chars, full):
    """Neighbouring parts joined by a blank line while they fit; ``full`` says when a buffer is closed."""
    def step(s, p):
        more = F.when(s["held"] == "", p).otherwise(F.concat(s["held"], F.lit("\n\n"), p))
        closed = full(s["held"], p, more)
        return F.struct(F.when(closed, F.concat(s["done"], F.array(s["held"]))).otherwise(s["done"]).alias("done"), F.when(closed, p).otherwise(more).alias("held"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    return F.aggregate(parts, start, step, lambda s: F.concat(s["done"], F.array(s["held"])))


def _fitted(text, chars):
    """A too long text by paragraphs, and what is still too long by length."""
    paragraphs = _packed(F.split(text, r"\n{2,}"), chars, lambda held, p, more: (F.length(held) + 2 + F.length(p) > chars) & (held != ""))
    trimmed = F.filter(F.transform(paragraphs, C.trimmed), lambda p: p != "")
    pieces = lambda p: F.regexp_extract_all(p, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))  # in one walk over the text
    return F.flatten(F.transform(trimmed, pieces))


def chunks(markdown, max_tokens: int = TOKENS):
    """A text's chunks: itself if it fits, else its sections (headings 1 to 3) packed in order."""
    chars = max_tokens * CHARS_PER_TOKEN

    def cut(text):
        sections = F.filter(F.transform(F.split(text, r"(?m)(?=^#{1,3}\s)"), C.trimmed), lambda s: s != "")
        packed = F.filter(_packed(sections, chars, lambda held, p, more: (F.ceil(F.length(more) / CHARS_PER_TOKEN) > max_tokens) & (held != "")), lambda s: s != "")
        small = lambda s: F.when(F.length(s) <= chars, F.array(s)).otherwise(_fitted(s, chars))
        return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= chars, F.array(text)).otherwise(F.flatten(F.transform(packed, small)))

    return let(C.trimmed(C.text(markdown)), cut)


def budget_chars(window, used):
    """Characters left of a model's context window; the default budget where none is known."""
    left = F.greatest(F.lit(256), window - F.coalesce(used, F.lit(0)) - 512) * CHARS_PER_TOKEN
    return F.when(window > 0, left).otherwise(TOKENS * CHARS_PER_TOKEN)


def prompt(task, url, lang, markdown, window, used):
    """A model's prompt for a page: the task, where the page is from, and as much of it as the budget allows."""
    return F.concat(task, F.lit("\n\nURL: "), C.text(url), F.lit("\nLanguage: "), C.text(lang), F.lit("\n\n"), F.left(C.text(markdown), budget_chars(window, used)))
