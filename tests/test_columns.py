"""Scalar columns on literals."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import markdown as M
from corpusloom.functions import paths as P
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V

C = F.lit


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("path,stem,ext,safe", [
    ("a/b c/my doc.PDF", "my doc", ".pdf", "my_doc"), (".hidden", ".hidden", "", ".hidden"),
    ("x/noext", "noext", "", "noext"), ("a.b/c.tar.gz", "c.tar", ".gz", "c.tar"),
])
def test_names(spark, path, stem, ext, safe):
    assert one(spark, P.stem(C(path))) == stem
    assert one(spark, P.suffix(C(path))) == ext
    assert one(spark, P.safe_name(C(path))) == safe


@pytest.mark.parametrize("rel,cat", [
    ("f.md", ""), ("a/f.md", "a"), ("a/b/f.md", "a/b"), ("../x/f.md", "外部文件"), ("a/../../x/f.md", "外部文件"),
    ("a\\b\\f.md", "a/b"),
])
def test_source_category(spark, rel, cat):
    assert one(spark, P.source_category(C(rel))) == cat


def test_portable_path(spark):
    f = lambda p: one(spark, P.portable_path(C(p), C("/v"), C("/s")))
    assert f("/v/source/a/x.pdf") == "source/a/x.pdf"
    assert f("/s/a/x.pdf") == "source/a/x.pdf"
    assert f("/other/x.pdf") == "x.pdf"


def test_link_target(spark):
    assert one(spark, P.link_target(C("/v/a/b/n.md"), C("/v"))) == "a/b/n"
    assert one(spark, P.link_target(C("/x/y/z/w/n.md"))) == "z/w/n"
    assert one(spark, P.link_target(C("/x/tech/w/n.md"), known_tops=["tech"])) == "tech/w/n"
    assert one(spark, P.link_target(C("n.md"))) == "n"


def test_page_key_keeps_date_by_default(spark):
    assert one(spark, P.page_key(C("a/2024-05-01-Elon.md"))) == "2024-05-01-elon"
    assert one(spark, P.page_key(C("a/2024-05-01-Elon.md"), True)) == "elon"


def test_excluded(spark):
    f = lambda p: one(spark, P.excluded(C(p), ["_failed"]))
    assert f("_failed/x.md") and f("a/.git/x.md") and not f("a/x.md") and not f("x.md")


FM = "---\nsource: a.pdf\nnote: k: v\ntags: [x, 'y z', \"w\"]\nempty: []\nsource: 'b.pdf'\n---\nbody: no\n"


def test_front_matter(spark):
    r = one(spark, M.parse_front_matter(C(FM)))
    assert r["fields"] == {"note": "k: v", "source": "b.pdf"}
    assert r["lists"] == {"tags": ["x", "y z", "w"], "empty": []}
    assert one(spark, M.front_field(C(FM), "note")) == "k: v"
    assert one(spark, M.front_field(C(FM), "body")) == ""
    assert one(spark, M.front_list(C(FM), "tags")) == ["x", "y z", "w"]
    r = one(spark, M.parse_front_matter(C("no front matter: x")))
    assert r["fields"] == {} and r["lists"] == {}


def test_title_falls_back_to_stem(spark):
    assert one(spark, M.page_title(C("---\ntitle: 'My T'\n---\n"), C("a/b.md"))) == "My T"
    assert one(spark, M.page_title(C("text"), C("a/b.md"))) == "b"
    assert one(spark, M.page_title(C(None).cast("string"), C("a/b.md"))) == ""


def test_line_values(spark):
    c = C("tags: [a, b]\nx\ntags: [c]\n")
    assert one(spark, M.line_list(c, "tags")) == ["a", "b"]
    assert one(spark, M.line_list(c, "tags", last=True)) == ["c"]
    assert one(spark, M.line_value(c, "none")) == ""


def test_fill_empty_tags_first_only(spark):
    t = F.array(*[C(f"t{i}") for i in range(25)])
    out = one(spark, M.fill_empty_tags(C("tags: []\ntags: []"), t))
    assert out == "tags: [" + ", ".join(f"t{i}" for i in range(20)) + "]\ntags: []"
    assert one(spark, M.fill_empty_tags(C("tags: []"), F.array().cast("array<string>"))) == "tags: []"


def test_rewrite_list_escapes(spark):
    out = one(spark, M.rewrite_list(C("sources: [a,\n b] x sources: []"), "sources", F.array(C(r"c:\$1")), "'"))
    assert out == r"sources: ['c:\$1'] x sources: ['c:\$1']"


def test_clean_markdown(spark):
    src = "# H\n**b** *i* `c` [t](u) ![a](b)\n> q\n- item\n```\ncode\n```\n"
    out = one(spark, M.clean_markdown(C(src)))
    for word in ("H", "b i c t", "q", "item"):
        assert word in out
    for mark in ("#", "*", "`", ">", "code", "]("):
        assert mark not in out


def test_split_sections(spark):
    f = lambda s, **k: [(r["level"], r["title"], r["text"]) for r in one(spark, M.split_sections(C(s), **k))]
    assert f("intro\n# A\ntext a\n### B  \n\ntext b") == [(0, "概述", "intro"), (1, "A", "text a"), (3, "B", "text b")]
    assert f("plain only") == [(0, "概述", "plain only")]
    assert f("# A\n\n# B\nx") == [(1, "B", "x")]
    assert f("") == []
    assert f("# only") == [(0, "概述", "only")]
    fenced = "a\n```\n# no\nc\n```\n# yes\nb"
    assert [t for _, t, _ in f(fenced)] == ["概述", "no", "yes"]
    assert [t for _, t, _ in f(fenced, ignore_fenced=True)] == ["概述", "yes"]


def test_image_refs_local_only(spark):
    assert one(spark, M.image_refs(C("![a](x.png) ![](http://h/y.png) ![](data:z)"))) == ["x.png"]


def test_wikilinks(spark):
    assert one(spark, M.wikilinks(C("[[a]] [[b c|d]] [[a]] [x] [[]]"))) == ["a", "b c", "a"]


def test_put_related(spark):
    t = F.array(C("x$1"), C("y"))
    block = "\n## 相关文档\n- [[x$1]]\n- [[y]]\n"
    f = lambda s: one(spark, M.put_related(C(s), t))
    assert f("a\n## 相关文档\n- [[old]]\n\n## z") == "a" + block + "\n## z"
    assert f("a\n> 自动生成于 t") == "a" + block + "\n> 自动生成于 t"
    assert f("a  \n") == "a" + block + "\n"
    twice = f(f("a\n## z\n"))
    assert twice.count("相关文档") == 1 and f(twice) == twice


def test_migrate_references(spark):
    f = lambda s: one(spark, M.migrate_references(C(s), C("v/page one.md")))
    assert f("a\n## 原文位置\n- 原文：`x.pdf`\n- 路径：`/p/x.pdf`\nz") == "a\n## 原始文件\n- 原文：[[page one]]\n\nz"
    assert f("a\n## 原始文件\n- 文件名：`x.y.pdf`\n- 源路径：`/p`\n\nz") == "a\n## 原始文件\n- 原文：[[x.y]]\n\nz"
    assert f("a\n## 原始文件\n- 文件名：`x.pdf`\n\nz") == "a\n## 原始文件\n- 原文：[[x]]\n\nz"
    assert f("nothing") == "nothing"


def test_keywords_and_jaccard(spark):
    assert one(spark, T.keywords(C("安全漏洞分析 白皮书"))) == ["安全漏洞", "分析", "白皮书"]
    assert one(spark, T.keywords(C(None).cast("string"))) == []
    a, b = F.array(C(1), C(2)), F.array(C(2), C(3))
    assert one(spark, T.jaccard(a, b)) == pytest.approx(1 / 3)
    assert one(spark, T.jaccard(a, F.array().cast("array<int>"))) == 0


def test_clean_tags(spark):
    t = F.array(*[C(x) for x in ["[ab]", " ab ", "x", "空响应", "y" * 21, "'cd'", "ef。", "ab"]])
    assert one(spark, T.clean_tags(t)) == ["ab", "cd", "ef"]
    assert one(spark, T.split_tags(C("a，b, c ,,d"))) == ["a", "b", "c", "d"]


def test_outline(spark):
    titles = F.array(C("abc"), C("long one"), C("long one"), C("other t"))
    assert one(spark, T.outline_lines(C("x\n- a\n- \n- b"), titles)) == ["- a", "- b"]
    assert one(spark, T.outline_lines(C("nothing"), titles)) == ["- long one", "- other t"]


@pytest.mark.parametrize("raw,out", [
    ("think<|end_of_thought|> yes ", "yes"), ("a</think>b", "b"), ("a</think>  ", "a</think>  "), ("plain", "plain"), ("", ""),
])
def test_after_reasoning(spark, raw, out):
    assert one(spark, T.after_reasoning(C(raw))) == out


def test_snap_label(spark):
    f = lambda a: one(spark, T.snap_label(C(a), ["net", "network", "db"], "other"))
    assert [f("network"), f("the network"), f("d"), f("zzz"), f("")] == ["network", "net", "db", "other", "other"]


def test_vectors(spark):
    v = lambda *x: F.array(*[C(float(i)) for i in x])
    assert one(spark, V.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.5 ** 0.5)
    assert one(spark, V.cosine(v(0, 0), v(1, 1))) == 0
    assert one(spark, V.cosine(F.array().cast("array<double>"), v(1))) == 0
    assert one(spark, V.unit(v(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.unit(v(0, 0))) == [0, 0]


def test_render_page(spark):
    out = one(spark, M.render_page(
        C("r x.pdf"), C("2024-05-01"), C("a/b"), F.array(C("t1"), C("t2")), C("source/a/b/r x.pdf"), C(""),
        F.array(C("- o")), C("now")))
    assert out.startswith("---\nsource: r x.pdf\ndate: 2024-05-01\ncategory: a/b\ntags: [t1, t2]\noriginal_path: source/a/b/r x.pdf\n---\n")
    assert "# r x\n" in out and "AI 摘要" not in out and "[[source/a/b/r x]]" in out and "`#t1`, `#t2`" in out
    assert out.endswith("> 自动生成于 now\n")
