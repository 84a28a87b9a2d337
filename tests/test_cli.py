import pytest

from notemill import cli


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "20230101120000.md").write_text("---\ntitle: Interface Design\nid: 20230101120000\ntags: [a, b]\n---\nText about [[20230101129999]].\n")
    (tmp_path / "20230101120001.md").write_text("---\ntitle: Notes\nid: 20230101120001\ntags: [a]\n---\nAn interface design matters.\n")
    return tmp_path


def test_commands(spark, folder, capsys):
    for command in ("analyze", "validate-frontmatter", "maintain", "summarize", "index", "tags"):
        assert cli.main([command, str(folder)]) == 0
    assert cli.main(["detect-dead-links", str(folder), "--format", "json"]) == 0
    assert "Did you mean '20230101120000'?" in capsys.readouterr().out
    assert cli.main(["organize", str(folder), "--detect-duplicates"]) == 0
    assert cli.main(["ask", str(folder), "interface design", "--threshold", "0.1"]) == 0
    assert "Interface Design" in capsys.readouterr().out
    assert cli.main(["tags", str(folder), "--search", "python"]) == 0
    with pytest.raises(ValueError):
        cli.main(["detect-dead-links", str(folder), "--link-type", "nonsense"])


def test_auto_link_writes_only_when_told(spark, folder):
    note = folder / "20230101120001.md"
    before = note.read_text()
    cli.main(["auto-link", str(folder)])
    assert note.read_text() == before
    cli.main(["auto-link", str(folder), "--execute", "--stamp", "20240101_000000"])
    assert note.read_text() == before.replace("interface design", "[[20230101120000|interface design]]")
    assert (folder / "20230101120001.backup_20240101_000000.bak").read_text() == before
