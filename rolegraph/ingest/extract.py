"""Facts out of staged chunks: a model writes a program for each, which is checked and run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from rolegraph.agent import agent_prompt, repair_prompt, strip_fences
from rolegraph.functions.chunk import tokens
from rolegraph.lang.tree import ProgramError
from rolegraph.session import Session


@dataclass
class Extraction:
    done: int = 0
    failed: list[str] = field(default_factory=list)
    spent: int = 0
    stopped: bool = False


def extract(session: Session, document: str, ask: Callable[[str], str], budget: int = 200_000) -> Extraction:
    """Ask for a program per chunk of a document; one repair each, then the document is flagged."""
    store = session.graph
    out = Extraction()
    doc = store.records().where((F.col("op") == "node") & (F.col("id") == document)).select("nid").first()
    if doc is None:
        raise ProgramError(f"there is no document {document}")
    members = store.edges("part_of").where(F.col("whole") == doc.nid).select(F.col("piece").alias("nid"))
    chunks = store.nodes("chunk").join(members, "nid").select("id", "text", "ord").orderBy(F.asc_nulls_last("ord"), "id")
    for c in chunks.toLocalIterator():
        prompt = agent_prompt(session.graph, f"Write assert statements for the facts in this text, chunk {c.id}:\n{c.text}", writes=True)
        for attempt in range(2):
            if out.spent + tokens(prompt) > budget:
                out.stopped = True
                return out
            program = strip_fences(ask(prompt))
            out.spent += tokens(prompt) + tokens(program)
            try:
                session.execute(program)
                out.done += 1
                break
            except ProgramError as e:
                prompt = repair_prompt(session.graph, c.text, program, str(e), writes=True)
        else:
            out.failed.append(c.id)
            session.execute(f'flag {document} reason "extraction failed at {c.id}"')
    return out
