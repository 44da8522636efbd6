import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.plans import config as C
from quarry.sources.docx import docx_markdown
from quarry.sources.jats import parse_jats
from quarry.sources.layout import Line, markdown
from quarry.sources.parsers import included, parse_files

JATS = """<?xml version="1.0"?><pmc><article xmlns:xlink="http://www.w3.org/1999/xlink"><front><journal-meta><journal-title-group><journal-title>J &nbsp;One</journal-title></journal-title-group></journal-meta>
<article-meta><article-id pub-id-type="pmid">7</article-id><title-group><article-title>On <italic>x</italic></article-title></title-group>
<contrib-group><contrib contrib-type="author"><name><surname>B</surname><given-names>A</given-names></name></contrib><contrib contrib-type="editor"><name><surname>No</surname></name></contrib><contrib><name><surname>C</surname></name></contrib></contrib-group>
<pub-date><month>1</month></pub-date><pub-date><year>2020</year><month>3</month></pub-date>
<permissions><license license-type="t" xlink:href="http://l"><p>free</p></license></permissions><abstract><p>Short.</p></abstract></article-meta></front>
<body><p>Loose.</p><sec><title>M</title><p>a</p><list><list-item><p>i</p></list-item><list-item><p>j</p></list-item></list><fig><caption><p>Cap</p></caption></fig><sec><title>N</title><p>b</p></sec></sec></body>
<back><ref-list><ref>r one</ref><ref/><ref>r two</ref></ref-list></back></article></pmc>"""


def test_jats():
    front, text = parse_jats(JATS)
    assert front == {"source": "jats", "title": "On x", "date": "2020-03", "journal": "J One", "pmid": "7", "authors": ["A B", "C"], "license": "http://l"}
    assert text == "# On x\n\n## Abstract\n\nShort.\n\nLoose.\n\n## M\n\na\n\n- i\n- j\n\nCap\n\n### N\n\nb\n\n## References\n\n1. r one\n2. r two"
    assert parse_jats("<a/>") == parse_jats("no xml <") == ({}, "")


def word(body: str) -> bytes:
    out = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H2"><w:name w:val="Heading 2"/></w:style></w:styles>')
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


BODY = '<w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>a</w:t></w:r><w:r><w:t> b_c</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>i</w:t></w:r></w:p><w:p/>'


def test_docx():
    assert docx_markdown(word(BODY)) == "## Top\n\n__a__ b\\_c\n\n- i"
    with pytest.raises(ValueError, match="Word"):
        docx_markdown(b"no")


def test_layout():
    lines = [Line("Big Title", 30, 700), Line("goes on", 30, 660), Line("one", 10, 640), Line("two • first", 10, 628), Line("and more", 10, 616), Line("•", 10, 604), Line("Second", 10, 592), Line("12", 10, 580), Line("far", 10, 500), Line("Sub", 16, 480), Line("larger text that is too long to be taken for a heading", 16, 460)]
    assert markdown(lines) == "# Big Title goes on\n\none two\n- first and more\n- Second\n\nfar\n## Sub\n\nlarger text that is too long to be taken for a heading"
    assert markdown([]) == ""


def test_files_of_every_kind(spark):
    files = [("a.md", b"---\ntitle: T\ndraft: true\nbrand: x\n---\n# H\ntext {{< toc >}}"), ("b.txt", b" plain "), ("c.xml", JATS.encode()), ("d.docx", word(BODY)), ("e.pdf", b"?"), ("f.docx", b"no"), ("g.md", b""), ("h.md", None)]
    df = spark.createDataFrame(files, "path string, content binary")
    rows = {(r.path, r.section_no): r for r in parse_files(df, C.rules(C.merge({}))).collect()}
    assert (rows["a.md", 0].title, rows["a.md", 0].draft, rows["a.md", 0].content) == ("T", True, "text") and rows["a.md", 0].front["brand"] == "x"
    assert rows["b.txt", 0].content == "plain" and rows["c.xml", 0].title == "On x" and rows["d.docx", 0].heading_path == ["Top"]
    assert rows["e.pdf", 0].error and rows["f.docx", 0].error and rows["g.md", 0].content is None and rows["h.md", 0].error is None
    lined = parse_files(df.filter("path = 'e.pdf'"), pdf_lines=lambda b: [("page", 10, 0)]).collect()
    assert [r.content for r in lined] == ["page"]


def test_included(spark):
    df = spark.createDataFrame([(1, {"brand": "x"}), (2, {"brand": "y"}), (3, {})], "id int, front map<string,string>")
    kept = lambda *a: [r.id for r in df.filter(included(F.col("front"), *a)).orderBy("id").collect()]
    rule = {"field": "brand", "include": ["x"], "default": "x"}
    assert kept([rule]) == kept([rule], {"brand": "all"}) == kept(None) == [1, 2, 3]
    assert kept([rule], {"brand": "x"}) == [1, 3] and kept([rule], {"brand": "y"}) == [2]
    assert kept([{"field": "brand", "exclude": ["x"]}]) == [2, 3]


def test_config(tmp_path):
    (tmp_path / "quarry.config.yaml").write_text("chunking: {overlap: 0}\nshortcodes: {x: {skip: true}}\n")
    (tmp_path / "a" / "b").mkdir(parents=True)
    config, path = C.project(str(tmp_path / "a" / "b"))
    assert path.parent == tmp_path.resolve() and config["chunking"] == {"maxTokens": 500, "overlap": 0} and "toc" in config["shortcodes"]
    assert C.parse_filter(["a=b=c", "=x", "y=", "z"]) == {"a": "b"}
    assert [C.provider(m) for m in ("mock", "ollama:x", "BGE-M3:latest", "text-x")] == ["mock", "ollama", "ollama", "openai"]
    assert C.model_folder("ollama:a/b:c") == "a-b-c"
