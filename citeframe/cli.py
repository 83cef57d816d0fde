"""Command line of the engine: ``python -m citeframe.cli --home FOLDER COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import functions as F

from citeframe.engine import Engine
from citeframe.operators import history as H
from citeframe.operators import study as S
from citeframe.session import local_session
from citeframe.sources.lines import text_files


def _questions(e: Engine, texts: list[str]):
    return e.spark.createDataFrame(list(enumerate(texts, 1)), "query_id bigint, question string")


def _ingest(e: Engine, a: argparse.Namespace) -> None:
    report = e.ingest(text_files(e.spark, a.folder, a.glob)).orderBy("name").collect()
    e.refresh()
    for r in report:
        print(f"{r['name']}: {r.error or ('already there' if r.skipped else f'{r.n_lines} lines')}")


def _ask(e: Engine, a: argparse.Namespace) -> None:
    documents = [e.resolve(d) for d in a.doc] or None
    for r in e.ask(_questions(e, a.question), a.session, documents).orderBy("query_id").collect():
        place = f" ({r.doc_id} {r.locator})" if r.locator and not r.refused else ""
        print(f"{r.answer}{place}\n[{r.confidence}, groundedness {r.groundedness:.2f}]")


def _docs(e: Engine, a: argparse.Namespace) -> None:
    for r in e.documents().collect():
        print(r.doc_id, r["name"], f"{r.n_pages} pages, {r.n_lines} lines")


def _topics(e: Engine, a: argparse.Namespace) -> None:
    doc = e.resolve(a.document)
    for r in S.topics(e.table("chunks").where(F.col("doc_id") == doc)).orderBy("topic_no").collect():
        print(f"{r.topic_no}. {r['name']} ({r.label}, {r.word_count} words)")


def _quiz(e: Engine, a: argparse.Namespace) -> None:
    pack = e.study_pack([e.resolve(a.document)], a.count)
    for r in pack["mcqs"].collect():
        print(r.question, *(f"  {'*' if i == r.correct_index else ' '} {o}" for i, o in enumerate(r.options)), sep="\n")
    for r in pack["short_answers"].collect():
        print(f"{r.question}\n  {r.answer}")


def _explain(e: Engine, a: argparse.Namespace) -> None:
    documents = [e.resolve(d) for d in a.doc] or None
    for r in e.explain(e.spark.createDataFrame([(1, a.topic)], "query_id bigint, topic string"), a.level, None, documents).collect():
        print(r.answer)


def _reset(e: Engine, a: argparse.Namespace) -> None:
    e.reset()


def _sessions(e: Engine, a: argparse.Namespace) -> None:
    for r in e.sessions().collect():
        print(r.session_id, r.title, f"({r.n_messages} messages)")


def _history(e: Engine, a: argparse.Namespace) -> None:
    rows = e.table("messages").where(F.col("session_id") == a.session).select("session_id", "seq", "role", "content")
    for r in H.export_markdown(rows).collect():
        print(r.markdown)


def _search(e: Engine, a: argparse.Namespace) -> None:
    for r in e.search(a.text).join(e.table("messages"), "message_id").orderBy("rank").collect():
        print(f"{r.session_id} {r.role}: {r.content[:120]}")


def _stats(e: Engine, a: argparse.Namespace) -> None:
    for k, v in e.stats().items():
        print(k, v)


COMMANDS: dict[str, tuple[Callable[[Engine, argparse.Namespace], None], list[tuple[tuple[str, ...], dict]]]] = {
    "ingest": (_ingest, [(("folder",), {}), (("--glob",), {"default": "*.txt"})]),
    "ask": (_ask, [(("question",), {"nargs": "+"}), (("--session",), {}), (("--doc",), {"action": "append", "default": []})]),
    "docs": (_docs, []),
    "topics": (_topics, [(("document",), {})]),
    "quiz": (_quiz, [(("document",), {}), (("--count",), {"type": int, "default": 10})]),
    "explain": (_explain, [(("topic",), {}), (("--level",), {"default": "beginner"}), (("--doc",), {"action": "append", "default": []})]),
    "reset": (_reset, []),
    "sessions": (_sessions, []),
    "history": (_history, [(("session",), {})]),
    "search": (_search, [(("text",), {})]),
    "stats": (_stats, []),
}


def main(args: list[str], engine: Engine | None = None) -> None:
    parser = argparse.ArgumentParser(prog="citeframe")
    parser.add_argument("--home", default="citeframe-home")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        sub = commands.add_parser(name)
        for names, how in options:
            sub.add_argument(*names, **how)
    chosen = parser.parse_args(args)
    COMMANDS[chosen.command][0](engine or Engine(local_session(), chosen.home), chosen)


if __name__ == "__main__":
    main(sys.argv[1:])
