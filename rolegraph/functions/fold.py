"""Case- and accent-blind comparison form of strings.

Folding casefolds and decomposes a text (twice, as each can undo the other), drops combining marks
and writes some Latin letters that don't decompose with plain ones.  As a Spark expression that is
one `translate` and a few `replace` calls, and `lower` alone for plain ASCII, so it stays in generated
code; its table is computed here from the Unicode database.  Signs that fold to several others outside the Latin blocks stay as they
are in both forms, so a column and a literal always agree.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters that don't decompose, and what they are written with
_PLAIN = {"ı": "i", "ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ħ": "h", "ŋ": "n"}
#: Blocks whose signs may fold to several: Latin, Latin additional, ligatures.
_SEVERAL = ((0x80, 0x250), (0x1E00, 0x1F00), (0xFB00, 0xFB07))


def _one(sign: str) -> str:
    for _ in range(2):
        sign = unicodedata.normalize("NFKD", sign.casefold())
    return "".join(_PLAIN.get(c, c) for c in sign if not unicodedata.combining(c))


@functools.cache
def _tables() -> tuple[dict[str, str], dict[str, str]]:
    single, several = {}, {}
    for n in range(0x41, 0x10000):
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7A4:
            continue
        c = chr(n)
        f = _one(c)
        if f == c:
            continue
        if len(f) <= 1:
            single[c] = f
        elif any(a <= n < b for a, b in _SEVERAL):
            several[c] = f
    return single, several


def fold(text: str) -> str:
    single, several = _tables()
    return "".join(single.get(c, several.get(c, c)) for c in text)


def folded(col: Column) -> Column:
    single, several = _tables()
    kept = sorted(single, key=lambda c: (single[c] == "", c))
    out = F.translate(col, "".join(kept), "".join(single[c] for c in kept))
    wide = "[" + "".join(sorted(several)) + "]"
    many = out
    for c, f in several.items():
        many = F.replace(many, F.lit(c), F.lit(f))
    full = F.when(out.rlike(wide), many).otherwise(out)
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(full)  # plain ASCII needs no table


def name_key(text: str) -> str:
    """The folded text without signs that are no letters, digits or underscores."""
    return re.sub(r"\W", "", fold(text))


def name_keyed(col: Column) -> Column:
    return F.regexp_replace(folded(col), r"(?U)\W", "")
