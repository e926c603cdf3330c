"""Facts of a repository on disk, tags, owners and plugin folders."""

import json

from plexmill.sources import repository as R


def test_facts_of_branches_and_detached_heads(spark, tmp_path):
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/work\n")
    (git / "packed-refs").write_text("# pack-refs\n" + "a" * 40 + " refs/heads/work\n" + "b" * 40 + " refs/heads/master\n^" + "c" * 40 + "\n")
    assert tuple(R.facts(spark, str(tmp_path)).first()) == (str(tmp_path), True, "work", "master", "a" * 40)
    (git / "refs/heads/work").write_text("d" * 40)
    (git / "refs/remotes/origin").mkdir(parents=True)
    (git / "refs/remotes/origin/HEAD").write_text("ref: refs/remotes/origin/trunk\n")
    assert tuple(R.facts(spark, str(tmp_path)).first())[2:] == ("work", "trunk", "d" * 40)
    (git / "HEAD").write_text("e" * 40)
    assert tuple(R.facts(spark, str(tmp_path)).first())[2:] == ("HEAD", "trunk", "e" * 40)
    assert tuple(R.facts(spark, str(tmp_path / "refs")).first())[1:] == (False, "", "", "")


def test_loose_tags(spark, tmp_path):
    folder = tmp_path / ".git/refs/tags/group"
    folder.mkdir(parents=True)
    (folder / "v1").write_text("1" * 40)
    (folder.parent / "v2").write_text("2" * 40 + "\n")
    assert sorted(map(tuple, R.tags(spark, str(tmp_path)).collect())) == [("group/v1", "1" * 40), ("v2", "2" * 40)]
    assert R.tags(spark, str(tmp_path / "no")).collect() == []


def test_owner_of_the_origin():
    form = '[core]\n\turl = x/y/z\n[remote "up"]\n\turl = https://h/other/r\n[remote "origin"]\n\turl = {}\n'
    assert R.owner_of_config(form.format("https://host.org/some/repo.git")) == "some"
    assert R.owner_of_config(form.format("git@host.org:group/sub/repo.git")) == "sub"
    assert R.owner_of_config(form.format("repo")) == "" and R.owner_of_config("") == ""


def test_manifests_in_folders(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for path, text in {
        a / "plugin.json": json.dumps({"id": "one", "version": "1.0.0"}), a / "x/manifest.json": json.dumps({"id": "two"}), a / "x/y/plugin.json": json.dumps({"id": "deep"}),
        b / "z/plugin.json": json.dumps({"id": "one", "version": "2.0.0"}), b / "bad/plugin.json": "{",
    }.items():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = R.manifests(R.read_manifests(spark, [str(a), "", str(tmp_path / "none"), str(b)], ["plugin.json", "manifest.json"])).collect()
    assert sorted((r.id or "", r.version or "", r.state) for r in got) == [("", "", "invalid"), ("one", "1.0.0", "found"), ("one", "2.0.0", "duplicate"), ("two", "", "found")]
