"""Chunks of a text: by heading, then by paragraph up to a number of tokens; a paragraph with more signs than those is cut."""

from __future__ import annotations

import re

TOKENS, TOKEN = 600, 4


def tokens(text: str) -> int:
    return len(text) // TOKEN


def split(text: str, limit: int = TOKENS) -> list[tuple[str, int]]:
    """(chunk, offset in the text) in order; chunks are stripped, empty ones left out."""
    cuts = [m.start() for m in re.finditer(r"^#{1,6} ", text, re.M)]
    edges = sorted({0, *cuts, len(text)})
    out: list[tuple[str, int]] = []
    for a, b in zip(edges, edges[1:]):
        held, start = "", a
        for m in re.finditer(r"(?:(?!\n\s*\n).)+", text[a:b], re.S):
            part, at = m[0].strip(), a + m.start()
            if not part:
                continue
            if held and tokens(f"{held}\n\n{part}") > limit:
                out.append((held, start))
                held = ""
            if not held:
                start = at
                while len(part) > limit * TOKEN:
                    out.append((part[: limit * TOKEN], start))
                    start += limit * TOKEN
                    part = part[limit * TOKEN :]
            held = f"{held}\n\n{part}" if held else part
        if held.strip():
            out.append((held, start))
    return out
