import json
import os
import stat

import pytest

from loomstack import project as P


def test_config(tmp_path):
    assert "python" in P.load_config(str(tmp_path))["languages"]
    (tmp_path / P.CONFIG_FILE).write_text('[symbols]\nlanguages = ["go"]\n[projects]\n"/w" = "main"\n')
    c = P.load_config(str(tmp_path))
    assert c["languages"] == {"go"} and c["aliases"] == {"/w": "main"}
    (tmp_path / P.CONFIG_FILE).write_text("colour = 1\n")
    with pytest.raises(ValueError):
        P.load_config(str(tmp_path))


@pytest.mark.parametrize("url,want", [("git@Host.example:Team/x.git", "ssh://host.example/Team/x"), ("HTTPS://u:p@Host.example:8443/a/b.git/?q=1#f", "https://host.example:8443/a/b"), ("/local/path", ""), ("", "")])
def test_remote(url, want):
    assert P.normal_remote(url) == want


def test_identity_order(tmp_path):
    root = str(tmp_path)
    ids = [P.project_identity(root, {root: "a"}, "https://h.example/x"), P.project_identity(root, {}, "https://h.example/x.git"), P.project_identity(root, {}, "", "/c/.git"), P.project_identity(root, {})]
    assert len(set(ids)) == 4 and all(i.startswith("project:") for i in ids) and P.project_identity("", {}) == ""
    assert ids[1] == P.project_identity("/elsewhere", {}, "https://H.example/x")


def test_lock(tmp_path):
    with P.writer_lock(str(tmp_path / "s")):
        with pytest.raises(RuntimeError):
            with P.writer_lock(str(tmp_path / "s")):
                pass
    with P.writer_lock(str(tmp_path / "s")):
        pass


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("s:1", ["a"], None), ("s:2", [], 4)], "uid string, files array<string>, n int")
    assert P.export_documents(df, str(tmp_path / "out"), "uid") == 2
    made = sorted((tmp_path / "out").iterdir())
    assert {json.loads(p.read_text())["uid"] for p in made} == {"s:1", "s:2"} and stat.S_IMODE(os.stat(made[0]).st_mode) == 0o600


def test_hook(tmp_path):
    (tmp_path / ".git" / "hooks").mkdir(parents=True)
    at = P.install_hook(str(tmp_path))
    once = open(at).read()
    P.install_hook(str(tmp_path))
    assert open(at).read() == once and P.HOOK_MARK in once
    P.remove_hook(str(tmp_path))
    assert not os.path.exists(at)
