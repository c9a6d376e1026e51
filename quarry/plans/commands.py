"""The command grammar of the manager."""

from __future__ import annotations

import shlex
from dataclasses import dataclass

#: Commands and their other names.
NAMES = {
    "help": ("/help", "h", "?", ""),
    "index": ("/index", "i"),
    "refresh": ("/refresh", "r"),
    "delete": ("/delete", "del", "d"),
    "confirm": ("/confirm", "yes"),
    "cancel": ("/cancel", "no"),
    "model": ("/model", "m"),
    "clear": ("/clear",),
    "quit": ("/quit", "exit", "q"),
}
_BY_NAME = {n: c for c, names in NAMES.items() for x in names for n in {x, x if x.startswith("/") or not x else "/" + x}}
MODELS = ("gemini", "ollama")


class CommandError(ValueError):
    """What can't be understood."""


@dataclass(frozen=True)
class Command:
    """arg: a path for index; a name, or None for the selected one, for delete; a model, or None for the other one, for model."""

    name: str
    arg: str | None = None


def parse_command(text: str) -> Command:
    """The command of a line; one that begins with no command's slash is a path to index."""
    text = text.strip()
    head, _, rest = text.partition(" ") if " " in text else (*text.split(None, 1), "", "")[:3] if "\t" in text else (text, "", "")
    rest = rest.strip()
    name = _BY_NAME.get(head.lower())
    if name is None:
        if head.startswith("/") and "/" not in head[1:] and head[1:].isalpha():
            raise CommandError(f"unknown command: {head}")
        return Command("index", _path(text))
    if name == "index":
        if not rest:
            raise CommandError("index needs a path")
        return Command(name, _path(rest))
    if name in ("delete", "model"):
        args = _split(rest)
        if len(args) > 1:
            raise CommandError(f"{name} takes one argument at most")
        arg = args[0] if args else None
        if name == "delete":
            return Command(name, None if arg is None or arg.lower() == "selected" else arg)
        if arg is not None and arg.lower() not in MODELS:
            raise CommandError(f"unknown model: {arg}")
        return Command(name, arg and arg.lower())
    if rest:
        raise CommandError(f"{name} takes no arguments")
    return Command(name)


def _path(text: str) -> str:
    """A path: as it stands without quotes; one quoted whole; with quotes inside an error."""
    if text[:1] in ("'", '"'):
        args = _split(text)
        if len(args) != 1 or not args[0]:
            raise CommandError("index takes one path")
        return args[0]
    if "'" in text or '"' in text:
        raise CommandError("a quote inside a path")
    return text


def _split(text: str) -> list[str]:
    try:
        return shlex.split(text)
    except ValueError as e:
        raise CommandError(str(e)) from e
