"""Settings, command line and deletion."""

import io
import json
import subprocess

import pytest
from helpers import png, pubspec

from gleaner import cli
from gleaner.config import AuditConfig, ConfigError, load_config


def test_defaults_and_file(tmp_path):
    c = load_config(str(tmp_path))
    assert (c.similarity_threshold, c.max_file_size_kb, c.max_hash_size, c.fail_on, c.treat_dynamic_as_used, c.treat_unresolvable_as_wildcard, c.dry_run) == (5, 500, 10 << 20, "error", True, False, True)
    f = tmp_path / "gleaner.yaml"
    f.write_text("ignore: ['a/**']\nsimilarity_threshold: 9\nmax_file_size_kb: '12'\nmax_hash_size_mb: 1\nfail_on: warn\ntreat_dynamic_as_used: false\n")
    c = load_config(str(tmp_path))
    assert (c.ignore, c.similarity_threshold, c.max_file_size_kb, c.max_hash_size, c.fail_on, c.treat_dynamic_as_used) == (("a/**",), 9, 12, 1 << 20, "warning", False)
    f.write_text("fail_on: none\n")
    assert load_config(str(tmp_path)).fail_on is None
    f.write_text("")
    assert load_config(str(tmp_path)) == AuditConfig(str(tmp_path))
    for bad in ("[1]", "fail_on: maybe", "ignore: x", "max_file_size_kb: many", "treat_dynamic_as_used: 3", "a: [", "similarity_threshold: true"):
        f.write_text(bad)
        with pytest.raises(ConfigError):
            load_config(str(tmp_path))


def call(spark, root, *args, answer=None):
    out, err = io.StringIO(), io.StringIO()
    code = cli.main(["--path", str(root), *args], spark, out, err, lambda: answer)
    return code, out.getvalue(), err.getvalue()


def test_usage_errors(spark, tmp_path):
    assert call(spark, tmp_path, "--nonsense")[0] == 2 and call(spark, tmp_path / "none")[0] == 2
    assert call(spark, tmp_path)[0] == 2  # no package
    assert call(spark, tmp_path, "--similarity-threshold", "65")[0] == 2 and call(spark, tmp_path, "--fail-on", "info")[0] == 2
    assert call(spark, tmp_path, "--delete-unused", "--check", "missing")[0] == 2
    assert call(spark, tmp_path, "--check", "unused,nothing")[0] == 2
    o = cli.settings(cli.parser().parse_args(["--path", str(tmp_path), "--check", "unused,missing", "--check", "similar", "--ignore", "a/**,b/*", "--fail-on", "none"]))
    assert o.checks == {"unused", "missing", "similar"} and o.ignore == ("a/**", "b/*") and o.fail_on is None
    assert call(spark, tmp_path, "--help")[0] == 0 and "0.1" in call(spark, tmp_path, "--version")[1]


@pytest.fixture
def project(tree):
    return tree.files({"pubspec.yaml": pubspec(assets=["assets/a/", "assets/old/"]), "lib/main.dart": "void main() { show('assets/a/used.png'); }", "assets/a/used.png": png(), "assets/a/2.0x/used.png": png(128, 128), "assets/old/orphan.png": png(tweak=3)})


def test_reports_and_gate(spark, project):
    code, out, _ = call(spark, project.root, "--format", "json", "--check", "unused", "--fail-on", "warning")
    data = json.loads(out)
    assert code == 1 and data["schemaVersion"] == 1 and data["packages"] == ["app"] and len(data["summary"]) == 12
    f = data["findings"][0]
    assert f["code"] == "UNUSED_ASSET" and f["path"] == "assets/old/orphan.png" and f["relatedPaths"] == [] and f["data"]["package"] == "app"
    code, out, err = call(spark, project.root, "--format", "markdown", "--check", "unused", "--output", "out/report.md")
    text = (project.root / "out/report.md").read_text()
    assert code == 0 and not out and "Report written" in err and "| warning | `assets/old/orphan.png` |" in text and "## Unused assets (1)" in text
    code, out, _ = call(spark, project.root, "--check", "duplicates")
    assert code == 0 and "No problems found." in out and "\x1b" not in out


def test_deletion_is_guarded(spark, project):
    root, orphan = project.root, project.root / "assets/old/orphan.png"
    args = ("--check", "unused", "--delete-unused")
    assert "Dry run" in call(spark, root, *args)[1] and orphan.exists()
    assert "not inside a git working tree" in call(spark, root, *args, "--no-dry-run", "--yes")[1] and orphan.exists()
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *a], cwd=root, check=True, capture_output=True)
    git("init")
    assert "uncommitted" in call(spark, root, *args, "--no-dry-run", "--yes")[1] and orphan.exists()
    git("add", "-A")
    git("commit", "-m", "all")
    assert "Cancelled" in call(spark, root, *args, "--no-dry-run", answer="n")[1] and orphan.exists()
    code, out, _ = call(spark, root, *args, "--no-dry-run", answer="yes")
    assert code == 0 and "Deleted 1 file(s)." in out and not orphan.exists() and not orphan.parent.exists()
    assert "assets/old/" not in (root / "pubspec.yaml").read_text() and "assets/a/" in (root / "pubspec.yaml").read_text()
    assert (root / "assets/a/2.0x/used.png").exists()
