import json

from docveil import cli


def test_settings(tmp_path, monkeypatch):
    path = str(tmp_path / "c.json")
    monkeypatch.setenv("HERE", "/x")
    assert cli.settings(path) == {}
    assert cli.set_setting("filesdir", "$HERE/in", path) and cli.settings(path) == {"filesdir": "/x/in"}
    assert not cli.set_setting("other", "1", path) and json.load(open(path)) == {"filesdir": "/x/in"}


def test_config_command(tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "CONFIG", str(tmp_path / "c.json"))
    monkeypatch.setattr(cli.settings, "__defaults__", (str(tmp_path / "c.json"),))
    monkeypatch.setattr(cli.set_setting, "__defaults__", (str(tmp_path / "c.json"),))
    assert cli.main(["config", "set", "filesdir", "/in"]) == 0
    assert cli.main(["config", "get", "filesdir"]) == 0
    assert capsys.readouterr().out.strip() == "/in"
