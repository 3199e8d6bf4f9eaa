"""python -m kgspark COMMAND: a command line over a stored graph."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable

from kgspark.plans.pipeline import Config, Pipeline
from kgspark.session import local_session

COMMANDS = (
    ("setup", None, "make the store's folder and show the settings"),
    ("ingest", "folder", "read a folder's documents"),
    ("query", "question", "answer a question; without one, ask until a blank line"),
    ("chat", None, "a conversation; 'clear' forgets it, a blank line ends it"),
    ("cypher", "statement", "run a statement that reads"),
    ("stats", None, "nodes and edges"),
    ("serve", None, "answer HTTP"),
    ("update", "file", "read a changed document again"),
    ("delete-doc", "doc_id", "remove a document and what only it mentions"),
    ("finalize", None, "make duplicates one"),
    ("delete", None, "remove the graph"),
)


def environment(path: str = ".env") -> None:
    """KEY=VALUE lines of a file become environment variables that are not set yet."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                k, sep, v = line.strip().partition("=")
                if sep and not k.startswith("#"):
                    os.environ.setdefault(k.strip(), v.strip().strip("'\""))


def conversation(pipe: Pipeline, lines, say: Callable[[str], object] = print, remember: bool = True) -> None:
    history: list[tuple[str, str]] = []
    for line in lines:
        text = line.strip()
        if not text:
            break
        if text == "clear":
            history.clear()
            continue
        answer = (pipe.chat(history, text) if remember else pipe.query(text, human=True)).text
        say(answer)
        history += [("user", text), ("assistant", answer)]


def main(argv: list[str] | None = None, make: Callable[[str, Config], Pipeline] | None = None) -> int:
    environment()
    p = argparse.ArgumentParser(prog="kgspark")
    p.add_argument("--store", default=os.environ.get("KGSPARK_STORE", "kgspark-store"))
    p.add_argument("--strategy", default="recursive")
    p.add_argument("--extraction", default="single")
    s = p.add_subparsers(dest="command", required=True)
    for name, arg, text in COMMANDS:
        q = s.add_parser(name, help=text)
        if arg:
            q.add_argument(arg, nargs="?" if name == "query" else None)
        if name == "serve":
            q.add_argument("--port", type=int, default=8080)
    a = p.parse_args(argv)
    config = Config(strategy=a.strategy, extraction=a.extraction)
    pipe = make(a.store, config) if make else Pipeline(local_session(), a.store, config=config)
    if a.command == "setup":
        os.makedirs(a.store, exist_ok=True)
        print(json.dumps({"store": os.path.abspath(a.store), "version": pipe.store.current(), "strategy": a.strategy, "extraction": a.extraction}))
    elif a.command == "ingest":
        print(pipe.ingest_folder(a.folder))
    elif a.command == "query":
        print(pipe.query(a.question, human=True).text) if a.question else conversation(pipe, sys.stdin, remember=False)
    elif a.command == "chat":
        conversation(pipe, sys.stdin)
    elif a.command == "cypher":
        for line in pipe.cypher(a.statement).toJSON().toLocalIterator():
            print(line)
    elif a.command == "stats":
        print(json.dumps(pipe.stats()))
    elif a.command == "serve":
        from kgspark.server import serve

        serve(pipe, a.port).serve_forever()
    elif a.command == "update":
        with open(a.file, encoding="utf-8") as f:
            print(pipe.update_document(f.read(), a.file))
    elif a.command == "delete-doc":
        print(pipe.delete(a.doc_id))
    elif a.command == "finalize":
        print(pipe.finalize())
    else:
        pipe.store.delete()
    return 0


if __name__ == "__main__":
    sys.exit(main())
