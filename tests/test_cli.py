"""Commands."""

import json

import pytest

from tidemark import cli


def test_run(spark, tmp_path, capsys):
    html = "<ul><li class='c'><b class='n'>A</b><i data-p='1,200.5'>x</i></li><li class='c'><b class='n'>B</b></li></ul>"
    spark.createDataFrame([("https://h.example/", 200, html)], "url string, status int, html string").write.parquet(f"{tmp_path}/pages")
    job = {"target": "https://h.example/", "item": "li.c", "fields": {"n": {"selector": ".n"}, "p": {"selector": "i", "attr": "data-p", "type": "number"}}}
    (tmp_path / "job.yaml").write_text(json.dumps(job))
    cli.main(["run", f"{tmp_path}/job.yaml", "--pages", f"{tmp_path}/pages", "--out", f"{tmp_path}/o.json", "--merged"], spark)
    assert json.loads((tmp_path / "o.json").read_text()) == [{"n": "A", "p": 1200.5}, {"n": "B", "p": None}]
    assert "'visited': 1" in capsys.readouterr().out


def test_store_commands(spark, tmp_path, capsys):
    at = ["--store", f"{tmp_path}/store"]
    (tmp_path / "s.json").write_text('{"cookies": []}')
    for label in ("one", "two"):
        cli.main(["session", "add", "https://h.example/x", "--label", label, "--state", f"{tmp_path}/s.json", *at], spark)
    cli.main(["session", "remove", "h.example", "--label", "one", *at], spark)
    cli.main(["session", "list", *at], spark)
    out = capsys.readouterr().out
    assert "h.example\ttwo" in out and "one" not in out and "cookies" not in out
    spark.createDataFrame([(1, 1, "https://h.example/", "2026-01-01T00:00:00Z", 1, "[]", None, None, None)], cli.TABLES["runs"]).write.parquet(f"{tmp_path}/store/runs")
    cli.main(["domains", *at], spark)
    cli.main(["map", "https://h.example/", *at], spark)
    out = capsys.readouterr().out
    assert out.startswith("h.example\n") and "2026-01-01T00:00:00Z" in out
    with pytest.raises(SystemExit):
        cli.main(["session", "add", *at], spark)


def test_query_command(spark, tmp_path, capsys):
    cli.main(["query"], spark)
    assert "p4_found" in capsys.readouterr().out.splitlines()
    cli.main(["query", "runs_latest", "--tables", "/root/testdata/sf0.001", "--out", f"{tmp_path}/q"], spark)
    assert spark.read.parquet(f"{tmp_path}/q").count() > 0
    with pytest.raises(SystemExit):
        cli.main(["query", "nothing"], spark)
