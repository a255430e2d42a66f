"""Runners: what answers a prompt.  A spec names a kind and its argument, as in ``command:my-model --fast``.

A model behind a network is reached through a command of the user's own; nothing here opens a connection.
"""

from __future__ import annotations

import json
import shlex
import subprocess
from collections.abc import Callable
from typing import Protocol

from rolegraph.lang.tree import ProgramError


class Runner(Protocol):
    def __call__(self, prompt: str) -> str:
        """The answer to a prompt; raises ProgramError where there is none."""


_kinds: dict[str, Callable[[str], Runner]] = {}


def register(kind: str, make: Callable[[str], Runner]) -> None:
    """Offer runners of a kind; make gets what follows the colon."""
    _kinds[kind] = make


def kinds() -> list[str]:
    return sorted(_kinds)


def runner(spec: str) -> Runner:
    kind, _, argument = spec.partition(":")
    if kind not in _kinds:
        raise ProgramError(f"there is no runner {kind}; known: {', '.join(kinds())}")
    return _kinds[kind](argument)


def _command(line: str, seconds: float = 300.0) -> Runner:
    """A program that reads the prompt and prints the answer."""
    words = shlex.split(line)
    if not words:
        raise ProgramError("command: needs a program to run")

    def ask(prompt: str) -> str:
        try:
            done = subprocess.run(words, input=prompt, capture_output=True, text=True, timeout=seconds)
        except (OSError, subprocess.TimeoutExpired) as e:
            raise ProgramError(f"the runner {words[0]} gave no answer: {e}") from e
        if done.returncode:
            raise ProgramError(f"the runner {words[0]} ended with {done.returncode}: {done.stderr.strip()[-300:]}")
        return done.stdout

    return ask


def _recorded(path: str) -> Runner:
    """Answers from a file, one JSON string a line, in their order."""
    with open(path, encoding="utf-8") as f:
        answers = iter([json.loads(line) for line in f if line.strip()])

    def ask(prompt: str) -> str:
        try:
            return next(answers)
        except StopIteration:
            raise ProgramError(f"{path} holds no more answers") from None

    return ask


register("command", _command)
register("recorded", _recorded)
