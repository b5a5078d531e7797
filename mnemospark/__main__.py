"""Command line: index, recall, note, stats and forget."""

from __future__ import annotations

import argparse
import sys

from . import __version__
from .engine import MemoryEngine
from .session import local_session
from .sources.git import repo_name
from .streaming.watch import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mnemospark", description="A document memory on Spark")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--home")
    s = p.add_subparsers(dest="command", required=True)
    i = s.add_parser("index")
    i.add_argument("--source", choices=("all", "agent", "code", "commits"), default="all")
    i.add_argument("--path", default=".")
    for agent in ("claude", "codex", "gemini"):
        i.add_argument(f"--{agent}-sessions")
    for flag in ("reindex", "no-embed", "no-prune", "no-redact", "watch"):
        i.add_argument(f"--{flag}", action="store_true")
    i.add_argument("--interval", type=int, default=15)
    r = s.add_parser("recall")
    r.add_argument("query")
    r.add_argument("-k", type=int, default=5)
    r.add_argument("--repo")
    r.add_argument("--type", default="")
    r.add_argument("--since", default="")
    r.add_argument("--no-embed", action="store_true")
    n = s.add_parser("note")
    n.add_argument("text", nargs="?")
    where = n.add_mutually_exclusive_group()
    where.add_argument("--repo")
    where.add_argument("--global", dest="everywhere", action="store_true")
    for flag in ("no-embed", "no-redact"):
        n.add_argument(f"--{flag}", action="store_true")
    s.add_parser("stats")
    f = s.add_parser("forget")
    what = f.add_mutually_exclusive_group(required=True)
    what.add_argument("--repo")
    what.add_argument("--all", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    e = MemoryEngine(local_session(), a.home, masked=not getattr(a, "no_redact", False), hashing=not getattr(a, "no_embed", False))
    if a.command == "index":
        roots = e.settings.sessions | {k: v for k in ("claude", "codex", "gemini") if (v := getattr(a, f"{k}_sessions"))}
        one = lambda again=False: e.index(a.source, a.path, roots, again, not a.no_prune)
        for source, counts in one(a.reindex).items():
            print(source, ", ".join(f"{k} {v}" for k, v in counts.items()))
        if a.watch:
            q = watch(e.spark, one, f"{e.store.home}/watch", a.interval)
            try:
                q.awaitTermination()
            except KeyboardInterrupt:
                q.stop()
    elif a.command == "recall":
        print(e.recall(a.query, a.k, a.repo, a.type, a.since, repo_name(inside_only=True)))
    elif a.command == "note":
        title = e.remember(a.text if a.text is not None else sys.stdin.read(), "" if a.everywhere else a.repo or repo_name(inside_only=True) or "")
        print(f"remembered: {title}" if title else "nothing to remember")
    elif a.command == "stats":
        for r in sorted(e.stats().collect(), key=lambda r: (r["dimension"], -r["n"])):
            print(r["dimension"], r["value"] or "(none)", r["n"])
        print("newest", e.last_time() or "(none)")
    elif a.command == "forget":
        print({"documents": e.reset()} if a.all else e.forget(a.repo))
    return 0


if __name__ == "__main__":
    sys.exit(main())
