import pytest

from quarry.sources.files import find_files, read_vectors
from quarry.sources.markdown import front_matter, parse, sections, shortcodes


def test_front_matter():
    assert front_matter("none") == ({}, "none")
    assert front_matter("---\ntitle: A\n---\nbody") == ({"title": "A"}, "body")
    assert front_matter("---\r\ntitle: A\r\n---\r\nbody") == ({"title": "A"}, "body")
    bad = "---\na: [\n---\nbody"
    assert front_matter(bad) == ({}, bad)
    assert front_matter("---\ntitle: A\n---") == ({}, "---\ntitle: A\n---")


def test_sections():
    text = "pre\n\n# One\ntext\n### Deep\nmore\n```\n# code\n```\nTwo\n---\nunder\n> ## Quote\nq"
    assert sections(text) == [([], "pre"), (["One"], "text"), (["One", "Deep"], "more\n```\n# code\n```"), (["One", "Two"], "---\nunder"), (["One", "Quote"], "q")]


def test_shortcodes():
    rules = {"note": {"replacement": "Note:"}, "gone": {"skip": True}, "link": {}, "up": {"handler": lambda c, a: c.upper() + a}}
    assert shortcodes('{{% note %}}a{{% /note %}} {{< gone >}}b{{< /gone >}} {{% other %}}c{{% /other %}} {{< link "d" >}}{{< x >}} {{< up 1 >}}e{{< /up >}}', rules) == "Note: a  c d E1"
    assert shortcodes("a (c)", {}, {"(c)": "©"}) == "a ©"


def test_files_and_parse(spark, tmp_path):
    for name, text in {"a/x.md": "---\ntitle: T\ntags: [p, 1]\n---\n# H\nbody", ".git/y.md": "no", "b.assets/z.md": "no", "c.TXT": "plain", "d.png": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = find_files(spark, f"file://{tmp_path}")
    assert sorted(r.path for r in found.collect()) == ["a/x.md", "c.TXT"]
    rows = parse(found.selectExpr("path", "decode(content, 'UTF-8') AS text")).orderBy("path").collect()
    assert [(r.title, r.tags, r.heading_path, r.content) for r in rows] == [("T", ["p", "1"], ["H"], "body"), ("c", [], [], "plain")]


def test_vectors_in_lines(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"id":"a","values":[1,2]}\n\n{"id":"b","values":[0.5,1],"namespace":"n"}\n')
    assert sorted(tuple(r)[:2] for r in read_vectors(spark, str(tmp_path / "v.json")).collect()) == [("a", [1.0, 2.0]), ("b", [0.5, 1.0])]
    (tmp_path / "w.json").write_text('{"id":"a"\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        read_vectors(spark, str(tmp_path / "w.json")).collect()
    (tmp_path / "x.json").write_text('{"id":"a","values":[1]}\n{"id":"c","values":"none"}\n')
    with pytest.raises(Exception, match=r'x\.json: malformed line: \{"id":"c"'):
        read_vectors(spark, str(tmp_path / "x.json")).select("id").count()


def test_names_that_begin_with_an_underscore_are_files(spark, tmp_path):
    kept = ["a/_index.md", "a/b.md", "_sec/z.md", "x.TXT", "d.assets.md", ".hidden.md"]
    for name in [*kept, "node_modules/n.md", "dist/n.md", ".git/n.md", "a/pics.assets/n.md", "a/.x/n.md", "a/b.png", "plain", ".md"]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    got = {r.path: bytes(r.content).decode() for r in find_files(spark, str(tmp_path)).collect()}
    assert got == {n: n for n in kept}
    assert find_files(spark, f"file://{tmp_path}/a").count() == 2
    assert find_files(spark, f"{tmp_path}/missing").count() == 0
