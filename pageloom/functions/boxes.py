"""Boxes, figures and spellings as Catalyst expressions. A box is a struct of l, t, r and b, y down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(left, top, right, bottom) -> Column:
    return F.struct(left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"))


def clipped(v: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, v))


def image_box(b: Column, width: Column, height: Column) -> Column:
    """A box with y up (its ``b`` below its ``t``) turned to y down and clipped to the page, left and top first."""
    left, top = clipped(b["l"], F.lit(0), width), clipped(height - b["t"], F.lit(0), height)
    return box(left, top, clipped(b["r"], left, width), clipped(height - b["b"], top, height))


def image_rect(b: Column, width: Column, height: Column) -> Column:
    """The same as left, top, width and height."""
    own = image_box(b, width, height)
    return F.struct(own["l"].alias("l"), own["t"].alias("t"), (own["r"] - own["l"]).alias("w"), (own["b"] - own["t"]).alias("h"))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["l"], b["l"]), F.least(a["t"], b["t"]), F.greatest(a["r"], b["r"]), F.greatest(a["b"], b["b"]))


def same_band(a: Column, b: Column) -> Column:
    """Whether two boxes share at least half the lower one's height."""
    least = F.least(a["b"] - a["t"], b["b"] - b["t"])
    return (least > 0) & ((F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])) * 2 >= least)


def json_box(b: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", b["l"], b["t"], b["r"], b["b"]), F.lit("]"))


def css_box(b: Column) -> Column:
    size = lambda low, high: F.greatest(F.lit(0), high - low)
    return F.format_string("left:%dpx;top:%dpx;width:%dpx;height:%dpx", b["l"], b["t"], size(b["l"], b["r"]), size(b["t"], b["b"]))


def percent_box(b: Column, width: Column, height: Column) -> Column:
    """The box in percent of the page; null if either is empty."""
    part = lambda v, of: v.cast("double") / of * 100.0
    text = F.format_string("left:%.3f%%;top:%.3f%%;width:%.3f%%;height:%.3f%%", part(b["l"], width), part(b["t"], height), part(b["r"] - b["l"], width), part(b["b"] - b["t"], height))
    return F.when((b["r"] > b["l"]) & (b["b"] > b["t"]) & (width > 0) & (height > 0), text)


def points(px: Column, dpi: Column) -> Column:
    return px.cast("double") * 72.0 / dpi


def text_metrics(xheight: Column, rise: Column, drop: Column, baseline: Column, glyph: Column) -> Column:
    """Font size and baseline in pixels; null without x-height or baseline."""
    size = F.coalesce(glyph * 4 / 3, xheight + F.coalesce(rise, F.lit(0.0)) - F.coalesce(drop, F.lit(0.0)))
    return F.when(xheight.isNotNull() & baseline.isNotNull(), F.struct(size.alias("font_px"), baseline.alias("baseline_px")))


def rotated(x: Column, y: Column, vx: Column, vy: Column) -> Column:
    """A point turned by a vector, to whole numbers."""
    return F.struct(F.floor(x * vx - y * vy + 0.5).alias("x"), F.floor(y * vx + x * vy + 0.5).alias("y"))


def within_margin(test: Column, number: Column, margin: float) -> Column:
    return (test >= number * (1 - margin)) & (test <= number * (1 + margin))


def certainty(p: Column, least: float = -20.0) -> Column:
    """Natural logarithm of a probability, ``least`` at the least."""
    return F.when(p > F.exp(F.lit(least)), F.ln(p)).otherwise(F.lit(least))


def confidence(certainties: Column) -> Column:
    """Confidence of a word by its letters' certainties, 0 to 100; 100 without any."""
    return F.when(F.size(certainties) > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 + 5 * F.array_min(certainties)))).otherwise(F.lit(100.0))


def confidence_text(mean: Column) -> Column:
    """The rounded mean, or a dash for the value -1 that stands for none."""
    return F.when(mean == -1, "—").otherwise(F.round(mean).cast("int").cast("string"))


def truth(mean_confidence: Column, coverage: Column, tokens: Column) -> Column:
    """Frequency and confidence of a sentence's statement."""
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return F.struct(((unit(mean_confidence / 100) + unit(coverage)) / 2).alias("frequency"), F.least(F.lit(0.99), tokens / (tokens + 1.0)).alias("confidence"))


def json_text(text: Column) -> Column:
    """Text with the escapes that JSON asks for; other signs stay as they are."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    named = {'"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    rest = {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in named}
    for sign, escaped in (named | rest).items():
        out = F.replace(out, F.lit(sign), F.lit(escaped))
    return out


def core(token: Column) -> Column:
    """What stands before the first letter, from the first letter to the last, and behind it."""
    before = F.regexp_extract(token, r"^(\P{L}*)", 1)
    inner = F.regexp_extract(token, r"(\p{L}(?:.*\p{L})?)", 1)
    behind = F.substring(token, F.length(before) + F.length(inner) + 1, F.length(token))
    return F.struct(before.alias("prefix"), inner.alias("core"), behind.alias("suffix"))


def cased_like(model: Column, word: Column) -> Column:
    """``word`` in capitals, or with a first capital, as ``model`` has it."""
    first = model.rlike(r"^\p{Lu}")
    rest = F.regexp_replace(F.substring(model, 2, 1 << 20), r"\P{L}", "")
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 20))
    return F.when(first & rest.rlike(r"^\p{Lu}+$"), F.upper(word)).when(first, capital).otherwise(word)


def edits_allowed(length: Column, short: int = 1, long: int = 1, least: int = 8) -> Column:
    """Edits that a correction of a word of this length may take."""
    return F.when(length >= least, long).otherwise(short)


def like_guid(token: Column) -> Column:
    return token.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")


def decoded_base64(text: Column) -> Column:
    """Bytes of either base-64 alphabet, padded or not."""
    own = F.rtrim(F.translate(text, "-_", "+/"), F.lit("="))
    return F.unbase64(F.rpad(own, (F.ceil(F.length(own) / 4) * 4).cast("int"), F.lit("=")))
