"""Driver-side administration: project configuration, identities, the writer's lock, document export."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import tempfile
import tomllib
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame

from loomstack.operators.symbols import enabled

CONFIG_FILE = ".loomstack.toml"


def load_config(root: str) -> dict:
    """(languages, aliases) of a project; unknown keys and languages are errors, a missing file means all languages."""
    at = os.path.join(root, CONFIG_FILE)
    raw = tomllib.load(open(at, "rb")) if os.path.isfile(at) else {}
    unknown = set(raw) - {"symbols", "projects"} | set(raw.get("symbols", {})) - {"languages"}
    if unknown:
        raise ValueError(f"unknown configuration keys: {', '.join(sorted(unknown))}")
    return {"languages": enabled(raw.get("symbols", {}).get("languages")), "aliases": dict(raw.get("projects", {}))}


def normal_remote(url: str) -> str:
    """One form of a repository's address: scheme and host in lower case, no user, query or '.git'; '' if it is none."""
    url = url.strip()
    scp = re.fullmatch(r"(?:[^@/\s]+@)?([^:/\s]+):(?!/)(\S+)", url)
    if scp and "://" not in url:
        url = f"ssh://{scp.group(1)}/{scp.group(2)}"
    parts = urlsplit(url)
    if not parts.scheme or not parts.hostname:
        return ""
    port = f":{parts.port}" if parts.port else ""
    return f"{parts.scheme.lower()}://{parts.hostname.lower()}{port}{parts.path.rstrip('/').removesuffix('.git').rstrip('/')}"


def identity(kind: str, key: str) -> str:
    return f"{kind}:{hashlib.sha256(key.encode()).hexdigest()}"


def project_identity(root: str, aliases: dict[str, str], remote: str = "", common_dir: str = "") -> str:
    """A project is known by its alias, else its remote, else the folder its work trees share, else its path; '' for no path."""
    if not root:
        return ""
    alias = next((aliases[k] for k in sorted(aliases) if os.path.realpath(os.path.expanduser(k)) == os.path.realpath(root)), "")
    return identity("project", (f"alias:{alias}" if alias else "") or normal_remote(remote) or common_dir or os.path.realpath(root))


def repository_root(folder: str) -> str:
    """The nearest folder upwards that holds a repository; '' if there is none."""
    at = os.path.realpath(folder) if folder else ""
    while at and at != os.path.dirname(at):
        if os.path.exists(os.path.join(at, ".git")):
            return at
        at = os.path.dirname(at)
    return ""


def git_facts(root: str) -> dict:
    """(commit, remote, common_dir) of a repository, read from its files; '' for what is not known."""
    facts = {"commit": "", "remote": "", "common_dir": ""}
    git = os.path.join(root, ".git")
    with contextlib.suppress(OSError, UnicodeDecodeError):
        if os.path.isfile(git):  # a work tree that points to its repository
            git = os.path.join(root, open(git, encoding="utf-8").read().partition("gitdir:")[2].strip())
        common = os.path.join(git, open(os.path.join(git, "commondir"), encoding="utf-8").read().strip()) if os.path.isfile(os.path.join(git, "commondir")) else git
        facts["common_dir"] = os.path.realpath(common)
        head = open(os.path.join(git, "HEAD"), encoding="utf-8").read().strip()
        name = head.partition("ref: ")[2]
        if not name:
            facts["commit"] = head
        elif os.path.isfile(os.path.join(common, name)):
            facts["commit"] = open(os.path.join(common, name), encoding="utf-8").read().strip()
        elif os.path.isfile(os.path.join(common, "packed-refs")):
            refs = dict(reversed(line.split()[:2]) for line in open(os.path.join(common, "packed-refs"), encoding="utf-8") if len(line.split()) == 2 and line[0] not in "#^")
            facts["commit"] = refs.get(name, "")
        text = open(os.path.join(common, "config"), encoding="utf-8").read() if os.path.isfile(os.path.join(common, "config")) else ""
        m = re.search(r'\[remote "origin"\][^\[]*?^\s*url\s*=\s*(\S+)', text, re.M)
        facts["remote"] = m.group(1) if m else ""
    return facts


def resolve(cwd: str | None) -> tuple[str, str, str]:
    """(repository, project id, workspace id) of the folder that a session worked in; ids of '' for no folder."""
    if not cwd:
        return "", identity("project", "repo:"), identity("workspace", "")
    root = repository_root(cwd)
    facts = git_facts(root) if root else {"remote": "", "common_dir": ""}
    try:
        aliases = load_config(root or cwd)["aliases"]
    except (ValueError, OSError):
        aliases = {}
    return root, project_identity(root or cwd, aliases, facts["remote"], facts["common_dir"]), identity("workspace", os.path.realpath(cwd))


@contextlib.contextmanager
def writer_lock(state: str) -> Iterator[None]:
    """Only one writer of a state folder at a time; a second one fails at once."""
    import fcntl

    os.makedirs(state, mode=0o700, exist_ok=True)
    with open(os.path.join(state, "writer.lock"), "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            raise RuntimeError("another writer is at work") from None
        yield


def write_document(row: dict, path: str) -> None:
    """Pretty JSON, readable by its owner only, in place all at once."""
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".part-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(row, f, indent=2, ensure_ascii=False, default=str)
            f.write("\n")
        os.chmod(part, 0o600)
        os.replace(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(part)
        raise


def export_documents(df: DataFrame, folder: str, key: str) -> int:
    """One document per row, named by the hash of its key; rows come one at a time. Returns their number."""
    os.makedirs(folder, mode=0o700, exist_ok=True)
    n = 0
    for row in df.toLocalIterator():
        d = row.asDict(recursive=True)
        write_document(d, os.path.join(folder, hashlib.sha256(str(d[key]).encode()).hexdigest()[:24] + ".json"))
        n += 1
    return n


HOOK_MARK = "# loomstack: refresh the index"


def install_hook(root: str, command: str = "python -m loomstack.cli index --root . >/dev/null 2>&1 &") -> str:
    """Add our line to the post-commit hook, keeping what is there; installing twice changes nothing."""
    at = os.path.join(root, ".git", "hooks", "post-commit")
    text = open(at, encoding="utf-8").read() if os.path.isfile(at) else "#!/bin/sh\n"
    if HOOK_MARK not in text:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", encoding="utf-8") as f:
            f.write(f"{text.rstrip()}\n{HOOK_MARK}\n{command}\n")
        os.chmod(at, 0o755)
    return at


def remove_hook(root: str) -> None:
    at = os.path.join(root, ".git", "hooks", "post-commit")
    if os.path.isfile(at):
        lines = open(at, encoding="utf-8").read().split("\n")
        if HOOK_MARK in lines:
            k = lines.index(HOOK_MARK)
            del lines[k:k + 2]
            if "\n".join(lines).strip() == "#!/bin/sh":
                os.unlink(at)
            else:
                with open(at, "w", encoding="utf-8") as f:
                    f.write("\n".join(lines))
