"""Command line: ``python -m loomstack.cli COMMAND``.

Code: ``index --root DIR``, ``search --root DIR QUERY``, ``status --root DIR``, ``hook install|remove --root DIR``. Transcripts: ``sync``, ``reindex``, ``sessions``,
``show UID``, ``find QUERY``, ``episodes``, ``summary``, ``evidence UID --output FILE``, ``episode ID --output FILE``, all with ``--state DIR`` (the session
store) or ``--data DIR`` (a folder of tables). Registered queries: ``queries``, ``query NAME``. ``version`` tells what is installed.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys

from pyspark.sql import functions as F


def parse_time(value: str, end_of_day: bool = False) -> int:
    """Milliseconds of an RFC 3339 instant or a date; a date that ends a range means its last instant."""
    try:
        t = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        raise SystemExit(f"not a time: {value}") from None
    if len(value) == 10 and end_of_day:
        t = t + dt.timedelta(days=1) - dt.timedelta(milliseconds=1)
    t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
    return int(t.timestamp() * 1000)


def one_line(text: str, limit: int = 200) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= limit else flat[:limit] + "…"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomstack")
    p.add_argument("--data", default="/root/testdata/sf0.01", help="folder of the tables")
    p.add_argument("--state", help="folder of the session store, in place of tables")
    p.add_argument("--json", action="store_true", help="JSON instead of text")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="build or refresh the code index of a project")
    i.add_argument("--force", action="store_true", help="build all of it again")
    s = sub.add_parser("search", help="ranked code search")
    s.add_argument("query", nargs="+")
    s.add_argument("--top-k", type=int, default=0)
    s.add_argument("--no-symbols", action="store_true")
    h = sub.add_parser("hook", help="refresh the index after every commit")
    h.add_argument("action", choices=("install", "remove"))
    for q in (i, s, h, sub.add_parser("status", help="what is indexed, or the sizes of the tables")):
        q.add_argument("--root", help="project folder")
    y = sub.add_parser("sync", help="read new log lines into the session store")
    y.add_argument("--dry-run", action="store_true")
    for q in (y, sub.add_parser("reindex", help="read all logs again")):
        q.add_argument("--home", default=os.path.expanduser("~"))
        q.add_argument("--agent", action="append", help="only this agent")
    f = sub.add_parser("find", help="ranked search in sessions")
    f.add_argument("query", nargs="+")
    for name in ("kind", "file", "session"):
        f.add_argument(f"--{name}")
    for q in (f, sub.add_parser("sessions", help="list sessions"), sub.add_parser("episodes", help="list episodes"), sub.add_parser("summary", help="count episodes")):
        for name in ("agent", "repository", "project", "workspace", "lineage", "from", "to"):
            q.add_argument(f"--{name}")
        q.add_argument("--limit", type=int)
    sub.add_parser("show", help="all events of a session").add_argument("uid")
    v = sub.add_parser("evidence", help="write the evidence document of a session")
    v.add_argument("uid")
    e = sub.add_parser("episode", help="write the document of an episode")
    e.add_argument("id")
    for name in ("before", "after", "byte-budget", "token-budget"):
        e.add_argument(f"--{name}", type=int, default=0)
    for q in (v, e):
        q.add_argument("--output", required=True)
    sub.add_parser("query", help="run a registered query").add_argument("name")
    sub.add_parser("queries", help="names of the registered queries")
    sub.add_parser("version", help="versions")
    return p


class Tables:
    """Sessions, sources, events and contents: of a store, or of a folder of tables."""

    def __init__(self, spark, a):
        from loomstack.operators import documents as D
        from loomstack.operators import sessions as S
        from loomstack.operators.store import SessionStore
        from loomstack.runtime import table, written

        if a.state:
            store = SessionStore(spark, f"file://{os.path.abspath(a.state)}/store")
            src = store.sources()
            self.sessions, self.contents, self.files = store.sessions(), store.contents(), store.content_files()
            self.sources = src.select(F.col("source_id").alias("id"), "agent", "native_session_id", "path", "content_hash", "state")
            self.events = written(store.events(), "events")
        else:
            self.sessions, self.sources, self.contents = (table(spark, a.data, n) for n in ("sessions", "sources", "event_contents"))
            self.files = D.content_files(self.contents)
            self.events = S.materialized(table(spark, a.data, "session_events"))

    def session(self, uid: str) -> tuple[int, str]:
        """(id, uid) of one session by its uid, else by its native id; an error if there is none or several."""
        s = self.sessions.where((F.col("session_uid") == uid) | (F.col("native_id") == uid)).select("id", "session_uid").limit(3).collect()
        exact = [r for r in s if r["session_uid"] == uid] or s
        if len(exact) != 1:
            raise SystemExit("no such session" if not exact else "several sessions have this id")
        return exact[0]["id"], exact[0]["session_uid"]

    def full(self, session: int | None = None):
        from loomstack.operators import documents as D

        events = self.events if session is None else self.events.where(F.col("session_id") == session)
        return D.full_events(events, self.contents, self.sources, self.files)

    def anchored(self):
        from loomstack.operators import episodes as E
        from loomstack.runtime import written

        return written(E.anchors(self.events, self.contents), "anchors")


def _code(spark, a):
    """(index, facts of the project) of a project folder."""
    from loomstack import project
    from loomstack.operators.index import CodeIndex
    from loomstack.sources.files import TOOL_DIR

    root = project.repository_root(a.root) or os.path.abspath(a.root)
    return root, CodeIndex(spark, f"file://{root}/{TOOL_DIR}/index", 8), project.git_facts(root)


def run(argv: list[str] | None = None, spark=None) -> list[dict]:
    """Rows of the command, as dictionaries."""
    from loomstack import project
    from loomstack.operators import documents as D
    from loomstack.operators import episodes as E
    from loomstack.operators import sessions as S
    from loomstack.operators import store as ST
    from loomstack.plans import documents, ingest, retrieval, training, transcripts
    from loomstack.runtime import local_session
    from loomstack.sources import files as FS

    a = _parser().parse_args(argv)
    named = {k: v for m in (training, retrieval, transcripts, documents, ingest) for k, v in m.QUERIES.items()}
    if a.command == "queries":
        return [{"name": n} for n in sorted(named)]
    if a.command == "hook":
        root = project.repository_root(a.root or ".") or os.path.abspath(a.root or ".")
        return [{"hook": project.install_hook(root)}] if a.action == "install" else [{"hook": project.remove_hook(root) or "removed"}]
    spark = spark or local_session()
    if a.command == "version":
        from loomstack.operators import index, symbols

        return [{"schema": index.SCHEMA_VERSION, "tokenizer": index.TOKENIZER_VERSION, "symbols": symbols.fingerprint(frozenset(symbols.LANGUAGES))[:12], "spark": spark.version, "python": sys.version.split()[0]}]
    if getattr(a, "root", None):
        root, at, facts = _code(spark, a)
        if a.command == "index":
            with project.writer_lock(os.path.join(root, FS.TOOL_DIR)):
                stats = at.build(FS.read_tree(spark, root), project.load_config(root)["languages"], a.force, {"commit": facts["commit"], "root": root})
            ignore = os.path.join(root, ".gitignore")
            if os.path.isdir(os.path.join(root, ".git")) and not (os.path.isfile(ignore) and FS.TOOL_DIR in open(ignore, encoding="utf-8").read()):
                print(f"warning: {FS.TOOL_DIR}/ is not ignored by git", file=sys.stderr)
            return [stats]
        if a.command == "status":
            return [at.meta() | {"version": at.version(), "stale": bool(facts["commit"]) and facts["commit"] != at.meta().get("commit", facts["commit"])}]
        at.ensure_fresh(facts["commit"])
        return [r.asDict() for r in at.search(" ".join(a.query), a.top_k, not a.no_symbols).collect()]
    if a.command in ("sync", "reindex"):
        if not a.state:
            raise SystemExit("--state DIR names the store")
        folders = {k: v for k, v in ST.agent_folders(a.home, dict(os.environ)).items() if not a.agent or k in a.agent}
        store = ST.SessionStore(spark, f"file://{os.path.abspath(a.state)}/store")
        with project.writer_lock(a.state):
            return [store.reindex(folders) if a.command == "reindex" else store.sync(folders, a.dry_run)]
    window = {"from_ms": parse_time(a.__dict__["from"]) if a.__dict__.get("from") else None, "to_ms": parse_time(a.to, True) if a.__dict__.get("to") else None}
    if a.command in ("search", "index"):
        if a.command == "index":
            raise SystemExit("--root DIR names the project")
        df = retrieval.code_search(spark, a.data, " ".join(a.query), a.top_k)
    elif a.command == "status" and not a.state:
        df = ingest.table_counts(spark, a.data)
    elif a.command == "query":
        if a.name not in named:
            raise SystemExit(f"unknown query {a.name}")
        df = named[a.name](spark, a.data)
    else:
        t = Tables(spark, a)
        who = {n: getattr(a, n, None) for n in ("agent", "repository", "project", "workspace", "lineage")}
        if a.command == "status":
            df = t.sources.groupBy("agent", "state").count().orderBy("agent", "state")
        elif a.command == "sessions":
            df = S.list_sessions(t.sessions, t.sources, limit=a.limit, **who, **window)
        elif a.command == "show":
            df = t.full(t.session(a.uid)[0]).orderBy(*S.ORDER).drop("text_evidence", "command_evidence", "diff_evidence")
        elif a.command == "find":
            df = S.search_events(S.event_index(t.contents), t.events, t.sessions, " ".join(a.query), kind=a.kind, session=a.session, files=t.files, file=a.file, limit=a.limit, **who, **window)
        elif a.command == "evidence":
            doc = D.checked_size(D.session_evidence(t.full(t.session(a.uid)[0]), t.sessions)).first()
            project.write_document(doc.asDict(recursive=True), a.output)
            return [{"written": a.output}]
        elif a.command == "episode":
            uid, event, _ = D.split_episode_id(a.id)
            events = t.full(t.session(uid)[0]).where("duplicate_of is null").join(t.anchored().select("id", "anchor"), "id")
            doc = D.episode_by_id(events, t.sessions, a.id, before=a.before, after=a.after or None, byte_budget=a.byte_budget, token_budget=a.token_budget).first()
            project.write_document(doc.asDict(recursive=True), a.output)
            return [{"written": a.output}]
        else:
            e = E.episodes(t.anchored(), t.sessions, **window)
            df = E.summary(e) if a.command == "summary" else e.orderBy(F.desc("ts"), "episode_id").limit(a.limit or 100)
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    for row in run(argv):
        print(json.dumps(row, default=str, ensure_ascii=False) if "--json" in argv else "  ".join(f"{k}={one_line(str(v))}" for k, v in row.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
