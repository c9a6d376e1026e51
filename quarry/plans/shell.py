"""Runs parsed commands on an engine and answers with text; also the command line."""

from __future__ import annotations

import argparse
from collections import deque
from datetime import UTC, datetime

from quarry.operators.search import SearchRequest
from quarry.plans.commands import NAMES, CommandError, parse_command
from quarry.plans.config import Config
from quarry.plans.engine import Engine, IndexError_

#: Lines of the log that are kept.
LOG_LINES = 200


class Shell:
    """Dispatches commands. selected: the collection that a command without a name means."""

    def __init__(self, engine: Engine):
        self.engine, self.done, self.selected = engine, False, None
        self.log: deque[str] = deque(maxlen=LOG_LINES)
        self.threads: list = []

    def run(self, text: str) -> str:
        """The answer to a line; what goes wrong is an answer too."""
        try:
            command = parse_command(text)
            answer = getattr(self, f"_{command.name}")(*([command.arg] if command.name in ("index", "refresh", "delete", "model") else []))
        except (CommandError, IndexError_, ValueError) as e:
            answer = f"error: {e}"
        self.log.append(f"{datetime.now(UTC).isoformat(timespec='seconds')} {answer}")
        return answer

    def tail(self, n: int) -> list[str]:
        return list(self.log)[-n:] if n > 0 else []

    def status(self) -> list[str]:
        """A line per job, the newest first."""
        return [j.line() for j in reversed(self.engine.registry.list())]

    def _help(self) -> str:
        return "\n".join(f"{name}: {', '.join(n or '(an empty line)' for n in others)}" for name, others in NAMES.items())

    def _index(self, path: str) -> str:
        job, thread = self.engine.start_index(path)
        self.threads.append(thread)
        return f"indexing {path} as {job.repo_name}, job {job.job_id}"

    def _refresh(self, _: str | None = None) -> str:
        return "collections: " + (", ".join(self.engine.store.list_collections()) or "none") + "".join(f"\n{line}" for line in self.status())

    def _delete(self, name: str | None) -> str:
        name = name or self.selected
        if name is None:
            return "error: no collection is selected"
        found = self.engine.request_delete(name)
        return f"error: no collection {name}" if found is None else f"delete {found}? confirm or cancel"

    def _confirm(self) -> str:
        if self.engine.pending_delete is None:
            return "error: nothing to confirm"
        name = self.engine.pending_delete
        return f"deleted {name}" if self.engine.confirm_delete() else f"error: {name} was gone"

    def _cancel(self) -> str:
        if self.engine.pending_delete is None:
            return "nothing to cancel"
        self.engine.cancel_delete()
        return "not deleted"

    def _model(self, name: str | None) -> str:
        busy = self.engine.registry.any_active()
        return f"model {self.engine.use_model(name)}" + (", once running jobs have ended with the one before" if busy else "")

    def _clear(self) -> str:
        self.log.clear()
        return ""

    def _quit(self) -> str:
        self.done = True
        return "bye"


def main(args: list[str] | None = None, engine: Engine | None = None) -> int:
    """index PATH | refresh PATH | search QUERY --repo R | shell."""
    parser = argparse.ArgumentParser(prog="quarry")
    parser.add_argument("--store")
    actions = parser.add_subparsers(dest="action", required=True)
    for name in ("index", "refresh"):
        one = actions.add_parser(name)
        one.add_argument("path")
        one.add_argument("--include", action="append")
        one.add_argument("--exclude", action="append")
    asked = actions.add_parser("search")
    asked.add_argument("query")
    for name in ("repo", "language", "path-prefix", "symbol-kind"):
        asked.add_argument(f"--{name}")
    asked.add_argument("--limit", type=int)
    actions.add_parser("shell")
    given = parser.parse_args(args)
    if engine is None:
        from pyspark.sql import SparkSession

        engine = Engine(SparkSession.builder.appName("quarry").getOrCreate(), Config.from_env(store_path=given.store))
    if given.action == "index":
        from quarry.plans.engine import IngestOptions

        print(engine.index(given.path, IngestOptions(given.include, given.exclude)).line())
    elif given.action == "refresh":
        print(engine.refresh(given.path, given.include, given.exclude))
    elif given.action == "search":
        print(engine.search_json(SearchRequest(given.query, given.language, given.path_prefix, given.symbol_kind, given.repo, given.limit)))
    else:
        shell = Shell(engine)
        while not shell.done:
            try:
                print(shell.run(input("> ")))
            except EOFError:
                break
    return 0
