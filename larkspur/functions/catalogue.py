"""Model catalogues and term catalogues, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of names that mark what is no text model; ceilings of tiers, by price for a million tokens and by
# billions of parameters; ceilings of size buckets; parts of names that tell a role.
EXCLUDED = ("embed", "rerank", "guard", "safeguard", "whisper", "tts", "stt", "-vl", "-vision", "vlm", "ocr", "-base")
PRICE_TIERS, SIZE_TIERS, TOP_TIER = ((0.20, "$"), (0.60, "$$"), (1.50, "$$$")), ((8, "$"), (34, "$$"), (80, "$$$")), "$$$$"
SIZES, TOP_SIZE = ((8, "s"), (34, "m"), (80, "l")), "xl"
ROLES = (("coder", ("coder", "code")), ("reasoning", ("-r1", "reason", "thinking", "qwq")))
# How a name spells a size: experts times their size, a size with its active part, a size.
PRODUCT, ACTIVE, PLAIN = r"(\d+(?:\.\d+)?)\s*x\s*(\d+(?:\.\d+)?)\s*b", r"(\d+(?:\.\d+)?)\s*b[-_ ]a\d", r"(\d+(?:\.\d+)?)\s*b(?![a-z0-9])"


def excluded(name: Column) -> Column:
    return F.lower(name).rlike("|".join(map(re.escape, EXCLUDED)))


def billions(name: Column, known: Mapping[str, float] | None = None) -> Column:
    """Billions of parameters by a name: `known` first, then as the name spells it; null if it doesn't."""
    s = F.lower(name)
    number = lambda pattern, i=1: F.regexp_extract(s, pattern, i).cast("double")
    out = F.when(s.rlike(PRODUCT), number(PRODUCT) * number(PRODUCT, 2)).when(s.rlike(ACTIVE), number(ACTIVE)).when(s.rlike(PLAIN), number(PLAIN))
    if known:
        out = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, float(v))]), s), out)
    return out


def _under(x: Column, ceilings: Iterable[tuple[float, str]], top: str) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for ceiling, name in ceilings:
        out = out.when(x <= ceiling, name)
    return out.otherwise(top)


def cost_tier(price: Column, size: Column) -> Column:
    """By price where there is one, else by size."""
    return F.when(price.isNotNull(), _under(price, PRICE_TIERS, TOP_TIER)).otherwise(_under(size, SIZE_TIERS, TOP_TIER))


def size_bucket(size: Column) -> Column:
    return _under(size, SIZES, TOP_SIZE)


def role(name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, parts in ROLES:
        out = out.when(F.lower(name).rlike("|".join(map(re.escape, parts))), kind)
    return out.otherwise("general")


def term_pattern(terms: Iterable[str], overlay: Iterable[str] = ()) -> str:
    """A pattern of whole words or phrases regardless of case, the longest first; terms of an overlay are merged in.

    Terms are a list that a person keeps, so it is short.
    """
    every = sorted({t.lower() for t in (*terms, *overlay) if t}, key=lambda t: (-len(t), t))
    return rf"(?i)\b({'|'.join(re.sub(r'([^\w\s])', r'\\\1', t) for t in every)})\b" if every else r"(?!)"


def term_hits(text: Column, pattern: str) -> Column:
    """Sorted distinct terms in a text, in lower case."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.lower(x))))
