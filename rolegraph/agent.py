"""Prompts for models that write programs, and the loop that repairs them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from rolegraph.lang.tree import ProgramError
from rolegraph.session import Session

GUIDE = """\
Write a program: one statement per line, each naming its result with `as`.
find <class> [where <cond>] as <name>            nodes of a class
follow <name> <edge> <role> [where <cond>] as <name>   arrive at the role; `via.<prop>` reads the edge
  ... upto N | any                               up to N steps, or all the way
  ... as <name> or none                          keep rows without a match
or                                               alone on a line: another branch, rows are unioned
group by <name>[.<prop>] as <g>                  then count|sum|avg|min|max [distinct] <g>.<name>[.<prop>] as <n>
keep <name> where <cond>                         filter rows or groups
compute <a> plus|minus|times|over|same <b> as <n>
return [distinct] <col>, ... [order by <col> [desc]] [limit N]
Conditions: = != > >= < <= contains, joined by and / or; `none` is absent; strings match without case or accents.
A name used twice means the same node. Answer with the program only."""
WRITES = """\
assert <class> {prop: value, ...} [source doc:...] as <name>
assert edge <edge>(<role>: <ref>, <role>: <ref>)
merge <ref>, <ref> | distinct <ref>, <ref> reason "..." | retire <ref> reason "..." | flag <ref> reason "..." """


def fingerprint() -> str:
    """Tells apart results that different guides have led to."""
    return hashlib.sha256((GUIDE + WRITES).encode()).hexdigest()[:12]


def strip_fences(text: str) -> str:
    m = re.search(r"```[a-z]*\n(.*?)```", text, re.S)
    return (m[1] if m else text).strip()


def agent_prompt(graph, question: str, writes: bool = False) -> str:
    return f"{GUIDE}\n{WRITES if writes else ''}\n{graph.catalog.listing(graph.populated() or None)}\n\n{question}"


def repair_prompt(graph, question: str, program: str, error: str, writes: bool = False) -> str:
    return f"{agent_prompt(graph, question, writes)}\n\nThis program was refused:\n{program}\n\n{error}\nWrite it again."


@dataclass
class Answer:
    rows: list[list] | None
    program: str
    turns: int
    error: str | None = None


def answer(session: Session, question: str, ask: Callable[[str], str], turns: int = 3) -> Answer:
    """Ask for a program and run it; its errors go back, for as many turns as given."""
    prompt, program, error = agent_prompt(session.graph, question), "", None
    for turn in range(1, turns + 1):
        program = strip_fences(ask(prompt))
        try:
            return Answer(session.rows(program), program, turn)
        except ProgramError as e:
            error = str(e)
            prompt = repair_prompt(session.graph, question, program, error)
    return Answer(None, program, turns, error)
