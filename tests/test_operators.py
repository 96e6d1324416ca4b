"""Operators on small tables, against plain restatements of the rule."""

import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cascade, duplicates, enrich, incremental, links, moc, observe, related, repair
from corpusloom.operators import sections as X
from corpusloom.operators import topics, work_queue
from corpusloom.plans.components import components
from corpusloom.plans.ranking import global_rank, group_rank
from corpusloom.sources import tables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---- related documents --------------------------------------------------------------

def brute_related(docs, k, min_score):
    import re

    words = {n: set(re.findall("[a-z]{2,4}", s)) for n, _, _, s in docs}
    out = []
    for n, tags, cat, _ in docs:
        best = []
        for m, tags2, cat2, _ in docs:
            if m == n:
                continue
            a, b = words[n], words[m]
            sc = 3.0 * len(set(tags) & set(tags2)) + (1.0 if (cat or "其他") == (cat2 or "其他") else 0.0)
            sc += 0.5 * (len(a & b) / len(a | b)) if a and b else 0.0
            if sc >= min_score:
                best.append((-sc, m))
        for i, (s, m) in enumerate(sorted(best)[:k], 1):
            out.append((n, i, m, round(-s, 9)))
    return sorted(out)


def random_docs(seed, n, hot):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        tags = r.sample([f"t{j}" for j in range(12)], r.randint(0, 4)) + (["hot"] if r.random() < hot else [])
        text = " ".join(r.choice(["aa", "bbb", "cccc", "dd", "eee"]) for _ in range(r.randint(0, 5)))
        docs.append((f"n{i:03d}", tags, r.choice(["x", "y", None]), text))
    docs += [(f"z{i}", ["hot", "t1"], "x", "aa bbb") for i in range(15)]  # copies
    return docs


@pytest.mark.parametrize("seed,block,min_score", [(1, 512, 2.0), (2, 8, 2.0), (3, 16, 1.0), (4, 16, 0.4)])
def test_related_equals_brute_force(spark, seed, block, min_score):
    docs = random_docs(seed, 70, 0.5)
    df = spark.createDataFrame(docs, "note_name string, tags array<string>, category string, summary string")
    got = related.related_docs(df, 4, min_score, "[a-z]{2,4}", block_rows=block)
    assert [(a, b, c, round(d, 9)) for a, b, c, d in rows(got, "note_name", "rank", "other_name", "score")] == \
        brute_related(docs, 4, min_score)


def test_related_moves_words_once_to_their_cells(spark, monkeypatch):
    """The rows of the cells come from the table of profiles without another shuffle of the words."""
    plans, run_cells = [], related.blocks.run_cells

    def planned(rows, *args, **options):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return run_cells(rows, *args, **options)

    monkeypatch.setattr(related.blocks, "run_cells", planned)
    df = spark.createDataFrame(random_docs(5, 70, 0.5), "note_name string, tags array<string>, category string, summary string")
    assert related.related_docs(df, 4, 2.0, "[a-z]{2,4}", block_rows=8).count()
    assert len(plans) == 2 and not any("hashpartitioning" in p for p in plans)


# ---- duplicates ----------------------------------------------------------------------

def random_pages(seed, n):
    r = random.Random(seed)
    base = ["Annual Report", "annual reports 2024", "Kernel notes", "kernel note", "", "Safety plan A", "Safety plan B"]
    return [(f"p{i:03d}", r.choice(["k1", "k1", "k2"]), r.choice(base)) for i in range(n)]


def brute_pairs(pages, t):
    out = set()
    for (p, k, a), (q, k2, b) in itertools.combinations(sorted(pages), 2):
        if k == k2:
            s = 1.0 if not a or not b else SequenceMatcher(None, a.lower(), b.lower()).ratio()
            if s >= t:
                out.add((p, q))
    return out


@pytest.mark.parametrize("block", [512, 2])
def test_duplicate_titles_stand_for_all_page_pairs(spark, block):
    pages = random_pages(5, 40)
    df = spark.createDataFrame(pages, "page_path string, page_key string, title string")
    got = set()
    for d in duplicates.duplicate_titles(df, 0.7, block).collect():
        a = [p for p, k, t in pages if k == d["page_key"] and t == d["title_a"]]
        b = [p for p, k, t in pages if k == d["page_key"] and t == d["title_b"]]
        for p, q in itertools.product(a, b):
            if p < q and d["similarity"] >= 0.7:
                got.add((p, q))
            if q < p and d["reverse"] is not None and d["reverse"] >= 0.7:
                got.add((q, p))
    assert got == brute_pairs(pages, 0.7)


def test_common_lengths():
    r = random.Random(9)
    for _ in range(50):
        a = [r.randint(1, 4) for _ in range(r.choice([1, 5, 63, 64]))]
        b = [r.randint(1, 4) for _ in range(r.randint(1, 70))]
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        table = np.zeros((2, 80), dtype=np.int32)
        table[0, : len(b)] = b
        assert list(duplicates.common_lengths(np.array(a), table)) == [row[-1], 0]


def test_duplicate_map_joins_chains(spark):
    pages = random_pages(6, 30)
    df = spark.createDataFrame(pages, "page_path string, page_key string, title string")
    parent = {p: p for p, _, _ in pages}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, q in brute_pairs(pages, 0.7):
        a, b = sorted([find(p), find(q)])
        parent[b] = a
    groups = {}
    for p in parent:
        groups.setdefault(find(p), []).append(p)
    want = sorted((p, min(g)) for g in groups.values() if len(g) > 1 for p in g)
    assert rows(duplicates.duplicate_map(df), "page_path", "canonical") == want


def test_merge_duplicates(spark):
    pages = [("a/x.md", "---\nsources: [s1]\ntags: [t]\n---\nbody"), ("b/x.md", "---\nsources: [s2]\ntags: [u]\n---\nother"),
             ("c/y.md", "---\ntags: []\n---\nsee [[b/x|that]] and [[a/x]]")]
    df = spark.createDataFrame(pages, "page_path string, content string")
    dup = spark.createDataFrame([("a/x.md", "a/x.md"), ("b/x.md", "a/x.md")], "page_path string, canonical string")
    out, ren = duplicates.merge_duplicates(df, dup)
    got = {r["page_path"]: r["content"] for r in out.collect()}
    assert got == {
        "a/x.md": '---\nsources: ["s1", "s2"]\ntags: ["t", "u"]\n---\n\n> 合并自: x.md\nbody',
        "c/y.md": "---\ntags: []\n---\nsee [[a/x|that]] and [[a/x]]",
    }
    assert rows(ren, "old", "new") == [("b/x", "a/x")]


def test_components_of_a_chain(spark):
    n = 60
    ids = list(range(n))
    random.Random(0).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(100, 101)], "a int, b int")
    got = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100}


# ---- state -------------------------------------------------------------------------------

def test_changes(spark):
    inv = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("c", "3", 3), ("d", None, 4)], "path string, md5 string, size int")
    st = spark.createDataFrame([("a", "ok", "1", 1), ("b", "failed", "2", 9), ("d", "ok", None, 4)], "path string, status string, md5 string, size int")
    assert rows(incremental.detect_changes(inv, st).fillna("-"), "path", "prev_status", "change") == [
        ("a", "ok", "same"), ("b", "failed", "changed"), ("c", "-", "new"), ("d", "ok", "same")]


def test_skip_known_and_twins(spark):
    b = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "md5 string, ident int")
    i = spark.createDataFrame([("b",), ("b",)], "md5 string")
    assert rows(incremental.skip_known(b, i), "ident") == [(1,), (2,)]
    assert rows(incremental.skip_known(b, i, within_batch=True, order=[F.col("ident")]), "ident") == [(1,)]


def test_status_summary_zero_filled(spark):
    s = spark.createDataFrame([("success",), ("success",), ("odd",)], "status string")
    assert dict(rows(incremental.status_summary(s), "status", "n")) == {"success": 2, "odd": 1, "failed": 0, "updated": 0, "unchanged": 0}


def test_keyed_tables(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    delta = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert rows(incremental.replace_rows(base, delta, ["k"]), "k", "v") == [("a", 1), ("b", 2), ("c", 2)]
    assert rows(incremental.insert_missing(base, delta, ["k"], [F.col("v")]), "k", "v") == [("a", 1), ("b", 1), ("c", 2)]


def test_state_table_versions(spark, tmp_path):
    t = tables.StateTable(spark, str(tmp_path / "t"), "k string, v int")
    assert t.read().count() == 0
    t.write(spark.createDataFrame([("a", 1)], t.schema))
    t.write(t.read().unionByName(spark.createDataFrame([("b", 2)], t.schema)))
    assert rows(t.read(), "k", "v") == [("a", 1), ("b", 2)] and t.version() == 2


# ---- links ---------------------------------------------------------------------------------

PAGES = [("a", "v/a.md", "[[b]] [[b|x]] [[gone]] [[gone two]]"), ("b", "v/b.md", "[[a]] [[v/c]]"), ("c", "v/c.md", "none"),
         ("MOC_1", "MOC_1.md", "")]


def pages_df(spark):
    return spark.createDataFrame(PAGES, "note_name string, path string, content string")


def test_lint(spark):
    got = {(r["type"], r["note_name"], r["n"], tuple(r["related"])) for r in links.lint(pages_df(spark)).collect()}
    assert got == {
        ("orphan", "a", 1, ()), ("orphan", "c", 0, ()), ("broken-link", "a", 2, ("gone", "gone_two")),
        ("broken-link", "b", 1, ("v/c",)), ("no-outlinks", "c", 0, ())}


def test_lint_path_links(spark):
    got = {(r["type"], r["note_name"].rsplit("/", 1)[-1]) for r in links.lint(pages_df(spark), match_on="either").collect()}
    assert ("broken-link", "b") not in got and ("broken-link", "a") in got


def test_rewrite_keeps_alias_and_does_not_chain(spark):
    ren = spark.createDataFrame([("b", "a"), ("a", "z$1")], "old string, new string")
    got = {r["note_name"]: (r["content"], r["changed"]) for r in links.rewrite_links(pages_df(spark), ren).collect()}
    assert got["a"] == ("[[a]] [[a|x]] [[gone]] [[gone two]]", True)
    assert got["b"] == ("[[z$1]] [[v/c]]", True)
    assert got["c"] == ("none", False)


def test_remove_links_squeezes(spark):
    df = spark.createDataFrame([("p", "x\n\n[[b|q]]\n\ny"), ("q", "x\n\n\n\ny"), ("r", "[[bb]]")], "note_name string, content string")
    gone = spark.createDataFrame([("b",)], "note_name string")
    f = lambda sq: {r["note_name"]: (r["content"], r["changed"]) for r in links.remove_links(df, gone, sq).collect()}
    assert f(True) == {"p": ("x\n\ny", True), "q": ("x\n\ny", True), "r": ("[[bb]]", False)}
    assert f(False)["q"] == ("x\n\n\n\ny", False)


def test_cascade(spark):
    df = spark.createDataFrame([
        ("one", "one.md", "---\nsources: [s1]\n---\n"), ("two", "two.md", "---\nsources: ['s1', s2]\n---\n[[one]] x"),
        ("named", "n.md", "source_path: s1\ntext"), ("free", "f.md", "[[one|o]] [[two]]")], "note_name string, path string, content string")
    plan, after = cascade.cascade_delete(df, spark.createDataFrame([("s1",)], "source string"))
    assert rows(plan, "note_name", "action", "remaining") == [("named", "keep", []), ("one", "delete", []), ("two", "update", ["s2"])]
    assert rows(after, "note_name", "content") == [
        ("free", " [[two]]"), ("named", "source_path: s1\ntext"), ("two", "---\nsources: ['s2']\n---\n x")]


# ---- index pages ------------------------------------------------------------------------------

def entries_df(spark, items):
    return spark.createDataFrame(
        [(c, s, t, f"{c}/{s}.md".lstrip("/")) for c, s, t in items], "category string, stem string, tags array<string>, rel_path string")


def test_subtree_counts(spark):
    df = entries_df(spark, [("a/b/c", "1", []), ("a/b", "2", []), ("a", "3", []), ("", "4", []), ("z", "5", [])])
    assert rows(moc.subtree_counts(df), "prefix", "n") == [("a", 3), ("a/b", 2), ("a/b/c", 1), ("z", 1)]


def test_moc_lines(spark):
    df = entries_df(spark, [
        ("", "root", []), ("b", "n2", ["x", "y", "z", "w"]), ("a/deep", "n1", ["x"]), ("a", "n0", []),
        ("1/2/3/4/5/6", "low", [])])
    text = "".join(r["line"] for r in moc.moc_lines(df, "T").orderBy("part", "ord").collect())
    assert text == (
        "# 知识树\n> 自动更新于 T\n\n## 根目录 (1 篇)\n- [[root]]\n"
        "\n## 1 (1 篇)\n\n### 2 (1 篇)\n\n#### 3 (1 篇)\n\n##### 4 (1 篇)\n\n###### 5 (1 篇)\n- [[low]]\n"
        "\n## a (2 篇)\n- [[n0]]\n\n### deep (1 篇)\n- [[n1]] `#x`\n"
        "\n## b (1 篇)\n- [[n2]] `#x`, `#y`, `#z` 等4个\n\n---\n**总计：5 篇笔记**\n")


def test_moc_splits_and_cleans_up(spark):
    df = entries_df(spark, [("k", f"n{i:04d}", []) for i in range(1200)])
    parts = moc.part_files(df)
    assert rows(parts, "file", "n") == [("MOC_1.md", 500), ("MOC_2.md", 500), ("MOC_3.md", 200)]
    old = spark.createDataFrame([(f,) for f in ["MOC.md", "MOC_1.md", "MOC_9.md", "MOC_unsupported.md", "MOC_fail.md", "x.md"]], "file string")
    assert rows(moc.stale_files(old, parts), "file") == [("MOC.md",), ("MOC_9.md",)]
    lines = moc.moc_lines(df, "T").filter("ord = 3").collect()
    assert sorted(r["line"] for r in lines)[0] == "\n> 第 1/3 部分 | 总计 1200 篇笔记\n"


def test_moc_entries_filters(spark):
    df = spark.createDataFrame([
        ("a/1.md", "tags: [x]"), ("a/2.md", "parent: i\n"), ("a/3.md", "parent: i\ndoc_type: index"),
        ("_archive/4.md", ""), ("MOC_1.md", ""), ("5.md", "tags: [未识别格式]")], "rel_path string, content string")
    assert rows(moc.entries(df), "stem") == [("1",), ("3",)]


def test_ranks(spark):
    df = spark.createDataFrame([("k" if i % 3 else "j", i) for i in range(500)], "g string, v int").repartition(7)
    got = rows(global_rank(df, ["v"]), "rn", "v")
    assert got == [(i + 1, i) for i in range(500)]
    per = rows(group_rank(df, ["g"], ["v"]), "g", "rn", "v")
    for g in "jk":
        assert [(a, c) for b, a, c in per if b == g] == list(enumerate(sorted(r.v for r in df.filter(F.col("g") == g).collect()), 1))


def test_name_clashes(spark):
    df = spark.createDataFrame([("d", "n", 1), ("d", "n", 2), ("", "n", 3), ("d", "m", 4)], "dir string, base string, ident int")
    got = tables.number_clashes(df, "dir", "base", ["ident"])
    assert rows(got, "ident", "file") == [(1, "d/n.md"), (2, "d/n_1.md"), (3, "n.md"), (4, "d/m.md")]


def test_table_text(spark):
    df = spark.createDataFrame([("s", 1, "a", None), ("s", 2, None, None), ("s", 3, "", 5.0)], "sheet string, o int, x string, y double")
    lines = tables.row_text(df, ["x", "y"]).filter("line IS NOT NULL")
    assert rows(tables.sheet_text(lines, ["sheet"], "o"), "text") == [("## s\na | \n | 5.0",)]


# ---- sections and answers ------------------------------------------------------------------------

def test_page_runs(spark):
    pages = ["12\nIntro here\nx", "Intro here\ny", "3", "Other part"]
    df = spark.createDataFrame([(1, pages, [f"p{i}" for i in range(4)])], "doc int, pages array<string>, given array<string>")
    d = df.withColumn("titles", X.infer_titles("pages", "given", r"[A-Z][a-z ]{2,29}"))
    got = rows(X.merge_runs(d, "doc", "pages", "titles"), "run", "title", "text", "n_pages")
    assert got == [(0, "Intro here", "12\nIntro here\nx\n\nIntro here\ny", 2), (1, "p2", "3", 1), (2, "Other part", "Other part", 1)]


def test_batches_skip_blank(spark):
    df = spark.createDataFrame([(1, i, "" if i == 1 else f"s{i}") for i in range(6)] + [(2, 0, " ")], "doc int, pos int, text string")
    got = rows(X.batch_sections(df, "doc", "pos", "text", 3), "doc", "batch", "combined")
    assert got == [(1, 0, "s0\n\n---\n\ns2"), (1, 1, "s3\n\n---\n\ns4\n\n---\n\ns5")]


def test_images_limit(spark):
    img = spark.createDataFrame([(1, i, "t" if i % 2 else "") for i in range(15)], "doc int, pos int, ocr string")
    d = X.describe_images(img, F.concat(F.lit("r"), F.col("pos").cast("string")), 10)
    got = dict(rows(d, "pos", "description"))
    assert got[0] == "r0" and got[1] == "t" and got[12] == "" and got[13] == "t"
    ctx = X.image_context(d, "doc", limit=2).first()["context"]
    assert ctx == "[图片1] r0\n\n[图片2] t"


def test_requests_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(20001))
    df = spark.createDataFrame([(1, text), (2, " short ")], "doc int, text string")
    r = X.build_requests(df, "doc", "text", "summary").collect()
    assert "".join(x["body"] for x in sorted(r, key=lambda x: x["part"]) if x["doc"] == 1) == text
    assert [(x["body"], x["send"]) for x in r if x["doc"] == 2] == [("short", False)]
    cut = X.build_requests(df, "doc", "text", "summary", overflow="cut").filter("doc = 1").collect()
    assert [x["body"] for x in cut] == [text[:8000]]


def test_structure_answers(spark):
    long = "x" * 120
    data = [('```json\n{"doc_type": "report", "entities": ["a"]}\n```', long), ("not json", long), ('{"a": 1}', "tiny"), ('{"a": ', long)]
    df = spark.createDataFrame(data, "raw string, text string").select(X.parse_structure("raw", "text").alias("s"))
    got = [(r.s["doc_type"], r.s["entities"], r.s["summary_hint"]) for r in df.collect()]
    assert got == [("report", ["a"], ""), ("未知", [], long), ("短文本", [], "tiny"), ("未知", [], long)]


def test_enrich_isolates_errors(spark):
    def fn(s):
        if s.str.contains("bad").any():
            raise ValueError("no")
        return s.str.upper()

    df = spark.createDataFrame([(1, "a", True), (2, "bad", True), (3, "c", False)], "ident int, body string, send boolean").repartition(1)
    good, bad = enrich.split_errors(enrich.enrich(df, fn, ["ident"]))
    assert rows(good, "ident", "answer") == [(1, "A"), (3, "c")]
    assert rows(bad, "ident", "error") == [(2, "ValueError: no")]


# ---- topics --------------------------------------------------------------------------------------

def test_topic_paths_agree(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, "ab"[i % 2], rng.normal(size=6).tolist()) for i in range(120)] + [(999, "a", [1.0])],
                              "doc_id long, level1 string, embedding array<double>")
    t = spark.createDataFrame([(i, "ab"[i % 2], rng.normal(size=6).tolist()) for i in range(40)], "topic_id long, level1 string, centroid array<double>")
    a = topics.topic_candidates(v, t, 5)
    b = topics.topic_candidates(v, t, 5, max_shared=0, block_rows=7)
    f = lambda d: [(x, r, y, round(s, 9)) for x, r, y, s in rows(d, "doc_id", "rank", "topic_id", "score")]
    assert f(a) == f(b) and len(f(a)) == 600
    near = topics.merge_pairs(t, 0.3, block_rows=6)
    vec = {r["topic_id"]: np.array(r["centroid"]) for r in t.collect()}
    cos = lambda x, y: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    assert rows(near, "a_id", "b_id") == sorted((i, j) for i in vec for j in vec if i < j and cos(vec[i], vec[j]) >= 0.3)


def test_move_centroids(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 3)], "topic_id long, centroid array<double>, doc_count long")
    m = spark.createDataFrame([(1, [0.0, 1.0]), (1, [1.0, 2.0, 3.0])], "topic_id long, embedding array<double>")
    got = {r["topic_id"]: (r["centroid"], r["doc_count"]) for r in topics.move_centroids(t, m).collect()}
    assert got[1][0] == pytest.approx([0.5 ** 0.5] * 2) and got[1][1] == 2
    assert got[2] == ([0.0, 1.0], 3)


def test_merge_topics_keeps_best(spark):
    t = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 1)], "topic_id long, doc_count long")
    m = spark.createDataFrame([(1, 7, 0.1), (2, 7, 0.9), (3, 8, 0.5)], "topic_id long, doc_id long, score double")
    k = spark.createDataFrame([(1, "w", 1.0), (2, "w", 2.0)], "topic_id long, keyword string, weight double")
    p = spark.createDataFrame([(1, 2), (2, 3)], "a_id long, b_id long")
    out, mem, kw = topics.merge_topics(t, m, k, p)
    assert rows(out.fillna(-1), "topic_id", "status", "merged_into", "doc_count") == [
        (1, "active", -1, 9), (2, "merged", 1, 3), (3, "merged", 1, 4), (9, "active", -1, 1)]
    assert rows(mem, "topic_id", "doc_id", "score") == [(1, 7, 0.1), (1, 8, 0.5)]
    assert rows(kw, "topic_id", "keyword", "weight") == [(1, "w", 2.0)]


# ---- health and queue ---------------------------------------------------------------------------------

def test_streaks_equal_a_sequential_scan(spark):
    r = random.Random(3)
    calls = [(r.choice([1, 1, 1, 2]), 1_700_000_000 + r.randint(0, 50_000), i, r.choice(["ok", "rate_limit", "server_error", "other_error"]))
             for i in range(600)]
    want, state = [], {}
    for p, ts, seq, o in sorted(calls, key=lambda c: (c[1], c[2])):
        s = state.setdefault(p, {"rate_limit": 0, "server_error": 0})
        if o == "ok":
            s.update(rate_limit=0, server_error=0)
        elif o in s:
            s[o] += 1
        want.append((seq, s["rate_limit"], s["server_error"]))
    df = spark.createDataFrame(calls, "provider long, t long, seq long, outcome string").withColumn("ts", F.timestamp_seconds("t"))
    assert rows(observe.failure_streaks(df, 3600), "seq", "rate_limit", "server_error") == sorted(want)
    assert rows(observe.failure_streaks(df, 10), "seq", "rate_limit", "server_error") == sorted(want)


def test_health_edges(spark):
    df = spark.createDataFrame([("a", "fail", 1.0), ("a", "ok", 1.0), ("b", "fail", 1.0)], "run string, status string, elapsed double")
    assert rows(observe.run_health(df, ["run"]), "run", "healthy") == [("a", True), ("b", False)]
    assert observe.run_health(df.limit(0)).first()["healthy"] is True
    lines = spark.createDataFrame([("fine",)], "line string")
    assert rows(observe.log_triage(lines), "severity") == [("OK",)]
    lines = spark.createDataFrame([("[降级] x 429 状态码: 429",)] * 11, "line string")
    assert rows(observe.log_triage(lines), "kind", "severity", "n") == [("degradation", "HIGH", 11), ("rate_limit", "HIGH", 11)]


def test_queue_equals_a_sequential_fold(spark):
    r = random.Random(4)
    paths = [f"p{i}" for i in range(30)]
    out = [(r.choice(paths), i, r.choice(["done", "fail", "fail", "processing", "cancel"])) for i in range(120)]
    state = {p: ["pending", 0] for p in paths}
    for p, _, o in out:
        s = state[p]
        if o in ("done", "processing"):
            s[0] = o
        elif o == "fail":
            s[1] += 1
            s[0] = "pending" if s[1] < 3 else "failed"
        elif s[0] in ("pending", "processing"):
            s[0] = "cancelled"
    t = spark.createDataFrame([(p, p, "pending", 0, i) for i, p in enumerate(paths)], "task_id string, path string, status string, retry_count long, seq long")
    o = spark.createDataFrame(out, "path string, ord long, outcome string")
    want = sorted((p, s, n) for p, (s, n) in state.items())
    assert rows(work_queue.apply_outcomes(t, o), "path", "status", "retry_count") == want
    half = work_queue.apply_outcomes(t, o.filter("ord < 50"))  # in two steps
    assert rows(work_queue.apply_outcomes(half, o.filter("ord >= 50")), "path", "status", "retry_count") == want
    more = work_queue.enqueue(t, spark.createDataFrame([("p1", 1), ("new", 5), ("new", 3)], "path string, seq long"))
    assert more.count() == 31 and more.filter("path = 'new'").first()["seq"] == 3


# ---- repair ------------------------------------------------------------------------------------------------

def test_align_and_reconcile(spark):
    pages = spark.createDataFrame([("x/a.md", ""), ("b.md", ""), ("x/c.md", ""), ("MOC.md", "")], "rel_path string, content string")
    files = spark.createDataFrame([("x/a.pdf",), ("y/b.pdf",), ("z/b.doc",), ("c.pdf",)], "rel_path string")
    assert rows(repair.align_plan(pages, files), "rel_path", "target", "action") == [
        ("b.md", "z/b.md", "move"), ("x/a.md", "x/a.md", "skip"), ("x/c.md", "c.md", "move")]


def test_repair(spark):
    c = lambda cat, o: f"---\ncategory: {cat}\noriginal_path: {o}\n---\n"
    pages = spark.createDataFrame([
        ("old/a.md", c("old", "source/new/a.pdf")), ("new/b.md", c("bad", "source/new/b.pdf")), ("k/c.md", c("k", "src/k/c.pdf")),
        ("k/d.md", c("k", "src/k/gone.pdf")), ("e.md", "no path")], "rel_path string, content string")
    files = spark.createDataFrame([("new/a.pdf", "src/new/a.pdf"), ("new/b.pdf", "src/new/b.pdf"), ("k/c.pdf", "src/k/c.pdf")], "rel_path string, vault_path string")
    plan = repair.repair_plan(pages, files)
    assert rows(plan, "rel_path", "action") == [("e.md", "skip"), ("k/c.md", "skip"), ("k/d.md", "skip"), ("new/b.md", "rewrite"), ("old/a.md", "move")]
    fixed = dict(rows(repair.apply_repair(pages, plan), "rel_path", "content"))
    assert fixed["new/a.md"] == c("new", "source/new/a.pdf") and fixed["new/b.md"] == c("new", "source/new/b.pdf")
    assert rows(repair.reconcile(pages, files.unionByName(spark.createDataFrame([("src/k/c.pdf", "")], "rel_path string, vault_path string"))), "rel_path") == [("k/d.md",)]
