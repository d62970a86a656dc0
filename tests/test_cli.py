"""The command line on literal texts."""

from __future__ import annotations

import pytest

from glyphmill import cli, discover


@pytest.mark.parametrize(
    ("argv", "want"),
    [
        (["unicode", "normalize", "--form", "NFKC", "-t", "ﬁ"], "fi"),
        (["idna", "enc", "-t", "münchen.de"], "xn--mnchen-3ya.de"),
        (["dur", "iso", "-t", "P2W"], "2 weeks"),
        (["regex", "replace", "--pattern", r"\d", "--with", "X", "-t", "a1"], "aX"),
        (["listfmt", "format", "-t", "a, b,,c"], "a, b, and c"),
        (["plural", "select", "--locale", "ru_RU", "-t", "3"], "few"),
        (["displayname", "region", "-t", "JP"], "Japan"),
        (["transliterate", "name", "--id", "Latin-Cyrillic", "-t", "hello"], "хелло"),
        (["collate", "compare", "--with", "b", "-t", "a", "-j"], '{"result":-1}'),
    ],
)
def test_text_commands(spark, capsys, argv, want):
    cli.main(argv)
    assert capsys.readouterr().out.strip() == want


def test_table_commands(spark, capsys):
    cli.main(["script", "list"])
    assert "Latn\tLatin" in capsys.readouterr().out
    cli.main(["region", "contains", "--code", "419"])
    assert "013" in capsys.readouterr().out


def test_every_command_can_be_planned(spark):
    lines = spark.createDataFrame([("1",)], "text string")
    for run, options in cli.TEXT.values():
        lines.select(run(lines["text"], dict(options)).alias("r")).schema  # noqa: B018
    for run, options in cli.LINES.values():
        run(lines, dict(options)).schema  # noqa: B018


def test_prefixes():
    assert cli.resolve("sc", ["script", "search"]) == "script" and cli.resolve("list", ["list", "listfmt"]) == "list"
    with pytest.raises(SystemExit):
        cli.resolve("s", ["script", "search"])


def test_discovery():
    assert any(f[1] == "remove_accents" for f in discover.search("ACCENT")) and len(discover.features()) > 100


def test_headers_columns_and_exit_codes(spark, capsys, tmp_path):
    cli.main(["script", "info", "--script", "latin", "-H", "-c", "code,name"])
    assert capsys.readouterr().out == "code\tname\nLatn\tLatin\n"
    cli.main(["regex", "search", "--pattern", "b+", "-t", "abc"])
    with pytest.raises(SystemExit) as e:
        cli.main(["regex", "search", "--pattern", "x", "-t", "abc"])
    assert e.value.code == 1
    with pytest.raises(SystemExit):
        cli.main(["script", "list", "-c", "nothing"])
    (tmp_path / "rules").write_text("a > b;", encoding="utf-8")
    (tmp_path / "text").write_text("a\na", encoding="utf-8")
    capsys.readouterr()
    cli.main(["transliterate", "rules", "-r", str(tmp_path / "rules"), "-w", str(tmp_path / "text")])
    assert capsys.readouterr().out == "b\nb\n"
    cli.main(["message", "format", "--pattern", "{who} has {n, plural, one {# item} other {# items}}", "--types", "who=text,n=number", "-t", "Ann\t2"])
    assert capsys.readouterr().out == "Ann has 2 items\n"


def test_discovery_of_commands():
    assert ("message", "format") in {c[:2] for c in discover.commands()} and discover.feature("normalize")[0] == "text" and discover.feature("nothing") is None
    assert "commands:" in discover.report()
