"""File sources, the vault jobs and streams over several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.plans.jobs import Vault, classify_dynamic, crosslink_pages, maintain_topics
from corpusloom.sources import files
from corpusloom.streaming import streams
from corpusloom.operators import observe, work_queue

BODY = "Spark engine writes whole shuffle partitions. " * 12
WORDS = r"\p{L}{2,4}"


@pytest.fixture
def source(tmp_path):
    s = tmp_path / "src"
    (s / "a" / "b c").mkdir(parents=True)
    (s / "a" / "b c" / "one.md").write_text(f"# T\n\n## Head one\n{BODY}\n## Head two\n{BODY}")
    (s / "a" / "two words+.md").write_text(BODY + "plus something else")
    (s / "data.csv").write_text("x,y\n1,2\n" * 50)
    (s / "a" / "d.svg").write_text("<svg><text>hello<tspan>in</tspan></text><g>out</g></svg>")
    (s / "a" / "bad.svg").write_text("<svg><text>")
    (s / "a" / "p.png").write_bytes(b"\x89PNG")
    (s / "u.xyz").write_text("?")
    (s / "r.docx").write_bytes(b"PK")
    return str(s)


def test_inventory(spark, source):
    inv = {r["rel_path"]: r for r in files.inventory(spark, source).collect()}
    assert {k: r["kind"] for k, r in inv.items()} == {
        "a/b c/one.md": "parseable", "a/two words+.md": "parseable", "data.csv": "parseable", "a/d.svg": "image",
        "a/bad.svg": "image", "a/p.png": "image", "u.xyz": "unsupported", "r.docx": "parseable"}
    assert inv["u.xyz"]["md5"] == "d1457b72c3fb323a2671125aef3eab5d" and inv["u.xyz"]["size"] == 1


def test_inventory_without_hashes_reads_no_content(spark, source):
    plan = files.inventory(spark, source, hashes=False)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_pages_and_text(spark, source):
    got = {r["rel_path"]: r["content"] for r in files.vault_pages(spark, source).collect()}
    assert set(got) == {"a/b c/one.md", "a/two words+.md"} and got["a/two words+.md"].startswith("Spark")
    assert files.text_files(spark, source).first()["text"].endswith("1,2")


def test_parse_hooks(spark, source):
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in files.parse_files(files.read_contents(spark, source)).collect()}
    assert got["d.svg"] == ("hello\nhello\nin\nin\nout", None) and got["bad.svg"] == ("", None)
    assert "u.xyz" not in got
    bad = files.parse_files(files.read_contents(spark, source), {".xyz": lambda b: 1 / 0}).first()
    assert bad["text"] is None and bad["error"].startswith("ZeroDivisionError")


def test_decode(spark):
    df = spark.createDataFrame([("u", bytearray("é x ", "utf-8")), ("g", bytearray("安全", "gbk")), ("n", bytearray(b"\xff\xff"))], "k string, content binary")
    assert {r["k"]: r["text"] for r in files.decode_files(df).collect()} == {"u": "é x", "g": "安全", "n": ""}


def test_ingest_twice_then_change(spark, source, tmp_path):
    v = Vault(spark, str(tmp_path / "vault"))
    r = v.ingest(source, "2024-05-01 10:00:00", pattern=WORDS)
    names = {p["rel_path"] for p in r["pages"].collect()}
    assert names == {"a/b c/2024-05-01-one.md", "a/2024-05-01-two_words+.md", "2024-05-01-data.md", "a/2024-05-01-d.md",
                     "a/2024-05-01-bad.md", "a/2024-05-01-p.md"}
    assert [f["path"].rsplit("/", 1)[1] for f in r["failed"].collect()] == ["r.docx"]
    assert {c["change"] for c in r["changes"].collect()} == {"new"}
    one = r["pages"].filter("note_name = '2024-05-01-one'").first()
    assert "- Head one\n- Head two" in one["content"] and "[[a/2024-05-01-two_words+]]" in one["content"]
    again = v.ingest(source, "2024-05-02 10:00:00", pattern=WORDS)
    assert again["new"].count() == 0 and {c["change"] for c in again["changes"].collect()} == {"same"}
    assert {p["content"] for p in again["pages"].collect()} == {p["content"] for p in r["pages"].collect()}
    with open(f"{source}/data.csv", "a") as f:
        f.write("3,4\n")
    third = v.ingest(source, "2024-05-03 10:00:00", pattern=WORDS)
    assert [p["rel_path"] for p in third["new"].collect()] == ["2024-05-03-data.md"]
    assert third["pages"].count() == 6
    text = "".join(x["line"] for x in v.moc("T").orderBy("part", "ord").collect())
    assert "**总计：6 篇笔记**" in text and "## 根目录 (1 篇)" in text
    assert "r.docx" in "".join(x["line"] for x in v.failed_moc("T").collect())
    assert "[[u.xyz]]" in "".join(x["line"] for x in v.unsupported_moc("T").collect())
    assert "**原因**: no parser" in v.failure_pages("2024-05-01", "x").first()["content"]
    img = v.refresh_images(source, "2024-05-04 10:00:00", pattern=WORDS)
    assert {p["rel_path"] for p in img["new"].collect()} == {"a/2024-05-04-d.md", "a/2024-05-04-bad.md", "a/2024-05-04-p.md"}
    rep = v.repair(source, "2024-05-04 10:00:00", WORDS)
    assert {p["action"] for p in rep["plan"].collect()} == {"skip"} and rep["gone"].count() == 0


def test_crosslink_leaves_child_pages(spark):
    df = spark.createDataFrame([
        ("a", "x/a.md", "---\nk: v\n---\nA", ["t", "u"], "x", ""), ("b", "x/b.md", "---\nparent: a\n---\nB", ["t", "u"], "x", ""),
        ("c", "c.md", "C", [], "y", "")], "note_name string, rel_path string, content string, tags array<string>, category string, summary string")
    got = {r["note_name"]: (r["content"], r["changed"]) for r in crosslink_pages(df).collect()}
    assert got["a"] == ("---\nk: v\n---\nA\n## 相关文档\n- [[x/b]]\n\n", True)
    assert not got["b"][1] and not got["c"][1]


def test_classify_dynamic(spark):
    docs = spark.createDataFrame([(1, "net", "a report", [1.0, 0.0], ["k"]), (2, "net", "", [0.5, -0.9], []), (3, "net", "", None, ["k", "z"]), (4, "?", "", None, ["k"])],
                                 "doc_id long, title string, text string, embedding array<double>, keywords array<string>")
    known = spark.createDataFrame([(7, "tech", "web", None, [1.0, 0.0])], "topic_id long, level1 string, level2 string, level3 string, centroid array<double>")
    words = spark.createDataFrame([(7, "tech", "k", 1.0)], "topic_id long, level1 string, keyword string, weight double")
    got = classify_dynamic(docs, {"tech": ["net"]}, known, words, ["report"])
    assert sorted((r["doc_id"], r["path"], r["decision"], r["type_tags"]) for r in got.collect()) == [
        (1, "tech/web", "match", ["report"]), (2, "tech/web", "validate", []), (3, "tech/web", "match", []), (4, "其他", "new", [])]


def test_maintain_topics(spark):
    t = spark.createDataFrame([(1, "x", [1.0, 0.0], 30), (2, "x", [0.99, 0.01], 40), (3, "y", [0.0, 1.0], 5)], "topic_id long, level1 string, centroid array<double>, doc_count long")
    m = spark.createDataFrame([(2, 5, 1.0)], "topic_id long, doc_id long, score double")
    k = spark.createDataFrame([(2, "w", 1.0)], "topic_id long, keyword string, weight double")
    out, mem, kw, big = maintain_topics(t, m, k)
    assert [r["topic_id"] for r in big.collect()] == [1] and mem.first()["topic_id"] == 1 and kw.first()["topic_id"] == 1


# ---- streams ------------------------------------------------------------------------------

def write_parts(df, path, order, n):
    """n Parquet files in event order, one micro-batch each."""
    from pyspark.sql import Window

    rows = df.withColumn("_n", F.ntile(n).over(Window.orderBy(order)))
    for i in range(1, n + 1):
        rows.filter(F.col("_n") == i).drop("_n").coalesce(1).write.mode("append").parquet(path)


def test_cooldown_stream_over_batches(spark, tmp_path):
    r = random.Random(1)
    data = [(r.choice([1, 1, 2]), 1_700_000_000 + i * 60, i, r.choice(["ok", "rate_limit", "rate_limit", "server_error"])) for i in range(300)]
    df = spark.createDataFrame(data, "provider long, t long, seq long, outcome string").select("provider", F.timestamp_seconds("t").alias("ts"), "seq", "outcome")
    path = str(tmp_path / "in")
    write_parts(df, path, "seq", 4)
    work = str(tmp_path / "work")
    q = streams.cooldown(streams.table_stream(spark, path, 1), work)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p.numInputRows]) == 4
    cols = ["seq", "outcome", "rate_limit", "server_error", "cooldown"]
    f = lambda d: sorted(tuple(x) for x in d.select(*cols).collect())
    assert f(streams.results(spark, work, streams.CALLS)) == f(observe.failure_streaks(df))


def brute_rests(calls, rules, limit, watermark):
    """Rests of one provider's (ts, outcome) in seconds, ended by the watermark at the latest."""
    out, run, rest = [], {k: 0 for k in rules}, None
    for ts, o in calls:
        if o == "ok" or o in rules:
            if rest and rest[1] <= ts:
                out.append((*rest, "timer"))
                rest = None
        if o == "ok":
            if rest:
                out.append((rest[0], ts, rest[2], "success"))
            run, rest = {k: 0 for k in rules}, None
        elif o in rules:
            run[o] += 1
            end = ts + rules[o][run[o] >= limit]
            rest = (rest[0] if rest else ts, end, rest[2] + 1 if rest else 1)
    if rest and rest[1] <= watermark:
        out.append((*rest, "timer"))
    return out


def test_rests_end_by_success_or_timer(spark, tmp_path):
    from corpusloom import constants as K

    r = random.Random(5)
    outcome = lambda: r.choice(["ok", "rate_limit", "rate_limit", "server_error", "other_error"])
    data = [(r.choice([1, 1, 2]), 1_700_000_000 + i * 25, i, outcome()) for i in range(300)]
    data += [(3, 1_700_000_100, 900, "rate_limit"), (4, 1_700_007_480, 901, "rate_limit")]  # one call each: timer, still open
    df = spark.createDataFrame(data, "provider long, t long, seq long, outcome string").select("provider", F.timestamp_seconds("t").alias("ts"), "seq", "outcome")
    path, work = str(tmp_path / "in"), str(tmp_path / "work")
    write_parts(df, path, "ts", 5)
    streams.rests(streams.table_stream(spark, path, 1), work, "1 minute").awaitTermination()
    got = streams.results(spark, work, streams.RESTS).select(
        "provider", F.unix_timestamp("start"), F.unix_timestamp("finish"), "failures", "ended_by").collect()
    mark = max(d[1] for d in data) - 60
    want = [(p, *x) for p in (1, 2, 3, 4) for x in brute_rests(sorted((t, o) for q, t, _, o in data if q == p), K.COOLDOWN, K.STREAK_LIMIT, mark)]
    assert sorted(tuple(x) for x in got) == sorted(want)
    assert any(x[0] == 3 for x in want) and not any(x[0] == 4 for x in want)
    assert {x[4] for x in want} == {"success", "timer"}


def test_queue_stream_over_batches(spark, tmp_path):
    r = random.Random(2)
    o = spark.createDataFrame([(f"p{r.randint(0, 9)}", i, r.choice(["done", "fail", "fail", "cancel", "processing"])) for i in range(90)]
                              + [("nobody", 91, "done"), (None, 92, "done"), ("p1", 93, None), ("p2", None, "fail")],
                              "path string, ord long, outcome string")
    t = spark.createDataFrame([(f"t{i}", f"p{i}", "pending", 0, i) for i in range(10)], streams.TASKS)
    f = lambda d: sorted(tuple(x) for x in d.select("task_id", "path", "status", "retry_count", "seq").collect())
    for name, order in (("forth", F.col("ord")), ("back", F.col("ord").desc())):  # any order of arrival
        path, work = str(tmp_path / name), str(tmp_path / f"{name}-work")
        write_parts(o, path, order, 4)
        run = lambda p=path, w=work: streams.queue(streams.table_stream(spark, p, 1), t, w).awaitTermination()
        run()
        got = streams.newest(spark, work, streams.CHANGES, ["path"], "version")
        assert f(got) == f(work_queue.apply_outcomes(t, o))
        run()  # nothing new
        assert f(streams.newest(spark, work, streams.CHANGES, ["path"], "version")) == f(got)


def test_queue_stream_merges_in_the_engine(spark, tmp_path):
    """No Python per task, and a restart goes on from the first tasks."""
    t = spark.createDataFrame([(f"t{i}", f"p{i}", "pending", 1, i) for i in range(3)], streams.TASKS)
    path, work = str(tmp_path / "in"), str(tmp_path / "work")
    start = lambda tasks: streams.queue(streams.table_stream(spark, path), tasks, work)
    spark.createDataFrame([("p1", 1, "fail"), ("p9", 2, "done")], "path string, ord long, outcome string").write.parquet(path)
    q = start(t)
    q.awaitTermination()
    assert {o["operatorName"] for o in q.lastProgress["stateOperators"]} == {"stateStoreSave"}
    spark.createDataFrame([("p1", 3, "fail"), ("p2", 4, "cancel")], "path string, ord long, outcome string").write.mode("append").parquet(path)
    start(t.withColumn("retry_count", F.lit(50).cast("bigint"))).awaitTermination()
    got = streams.newest(spark, work, streams.CHANGES, ["path"], "version").select("path", "status", "retry_count")
    assert sorted(map(tuple, got.collect())) == [("p1", "failed", 3), ("p2", "cancelled", 1)]


def test_streams_bring_their_own_state_store(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    path, work = str(tmp_path / "in"), str(tmp_path / "work")
    spark.createDataFrame([("a", "m"), ("b", "m"), ("c", None)], "path string, md5 string").write.parquet(path)
    try:
        spark.conf.set(key, other)
        streams.ingest(streams.table_stream(spark, path), work, within_batch=True).awaitTermination()
        assert spark.conf.get(key) == other
    finally:
        spark.conf.set(key, before)
    assert [tuple(r) for r in streams.results(spark, work, streams.INDEX).collect()] == [("m", "a", "success")]


def test_ingest_stream_is_incremental(spark, tmp_path):
    path, work = str(tmp_path / "in"), str(tmp_path / "work")
    df = spark.createDataFrame([(f"f{i}", f"m{i % 7}", i) for i in range(20)], "path string, md5 string, n long")
    write_parts(df, path, "n", 2)
    run = lambda: streams.ingest(streams.table_stream(spark, path, 1).select("path", "md5"), work, within_batch=True).awaitTermination()
    seen = lambda: streams.results(spark, work, streams.INDEX)
    assert seen().count() == 0
    run()
    assert sorted(r["path"] for r in seen().collect()) == [f"f{i}" for i in range(7)]
    run()  # nothing new
    spark.createDataFrame([("g", "m1", 1), ("h", "new", 2)], "path string, md5 string, n long").coalesce(1).write.mode("append").parquet(path)
    run()
    assert seen().count() == 8 and seen().filter("md5 = 'new'").count() == 1


# ---- what the jobs must not lose ----------------------------------------------------------

def test_names_with_underscore_or_dot_are_files(spark, tmp_path):
    root = tmp_path / "s r[c]"
    for name in ("_plan.md", "_drafts/x.md", "a/_b/_c/y.md", ".note.md", ".h/z.csv", "a/n.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}")
    got = {r["rel_path"]: r for r in files.inventory(spark, str(root)).collect()}
    assert set(got) == {"_plan.md", "_drafts/x.md", "a/_b/_c/y.md", ".note.md", ".h/z.csv", "a/n.md"}
    assert {r["kind"] for r in got.values()} == {"parseable"} and got["_plan.md"]["size"] == len("text of _plan.md")
    text = {r["rel_path"]: bytes(r["content"]).decode() for r in files.read_contents(spark, str(root)).collect()}
    assert text == {k: f"text of {k}" for k in got}
    assert {r["rel_path"] for r in files.vault_pages(spark, str(root)).collect()} == {"_drafts/x.md", "a/_b/_c/y.md", "a/n.md"}
    order = [r["rel_path"] for r in files.sorted_inventory(files.inventory(spark, str(root), hashes=False)).orderBy("rn").collect()]
    assert order == sorted(order, key=lambda p: p.replace("/", "\x01"))


def test_crosslink_tells_equal_stems_apart(spark):
    rows = [("a", "x/a.md", "A", ["t", "u"], "x", ""), ("a", "y/a.md", "B", ["v", "w"], "y", ""), ("c", "x/c.md", "C", ["t", "u"], "x", ""), ("d", "y/d.md", "D", ["v", "w"], "y", "")]
    df = spark.createDataFrame(rows, "note_name string, rel_path string, content string, tags array<string>, category string, summary string")
    got = {r["rel_path"]: r["content"] for r in crosslink_pages(df).collect()}
    assert "[[x/c]]" in got["x/a.md"] and "[[y/d]]" not in got["x/a.md"]
    assert "[[y/d]]" in got["y/a.md"] and "[[x/c]]" not in got["y/a.md"]
    assert "[[x/a]]" in got["x/c.md"] and "[[y/a]]" in got["y/d.md"]


def test_lint_of_cross_linked_vault_finds_nothing(spark, source, tmp_path):
    v = Vault(spark, str(tmp_path / "vault"))
    v.ingest(source, "2024-05-01 10:00:00", pattern=WORDS)
    linked = v.pages.read().filter("content LIKE '%## 相关文档%'")
    names = {r["rel_path"][:-3] for r in linked.collect()}
    found = v.lint(orphan_max=0, shown=None).collect()
    assert len(names) >= 2 and not names & {r["note_name"] for r in found if r["type"] == "orphan"}
    # only the links to the source files, which are no pages, stay open
    assert all(t.startswith("source/") for r in found if r["type"] == "broken-link" for t in r["related"])


def test_ingest_resumes_after_a_crash_between_the_writes(spark, source, tmp_path, monkeypatch):
    v = Vault(spark, str(tmp_path / "vault"))

    def crash(*a):
        raise OSError("lost")

    monkeypatch.setattr(v, "_record", crash)
    with pytest.raises(OSError):
        v.ingest(source, "2024-05-01 10:00:00", pattern=WORDS)
    monkeypatch.undo()
    second = v.ingest(source, "2024-05-01 11:00:00", pattern=WORDS)
    assert second["new"].count() == 6 and second["pages"].count() == 6
    assert v.status.read().filter("status = 'success'").count() == 6


def test_deleted_sources_go_with_their_links(spark, source, tmp_path):
    v = Vault(spark, str(tmp_path / "vault"))
    pages = v.ingest(source, "2024-05-01 10:00:00", pattern=WORDS)["pages"]
    one = pages.filter("note_name = '2024-05-01-one'").first()
    assert pages.filter(F.contains("content", F.lit(f"[[{one['rel_path'][:-3]}]]"))).count() > 0
    left = v.drop_sources(spark.createDataFrame([(one["source_path"],)], "path string"))
    assert left.count() == 5 and left.filter(F.contains("content", F.lit(f"[[{one['rel_path'][:-3]}]]"))).count() == 0
    assert v.status.read().filter(F.col("path") == one["source_path"]).count() == 0
    assert v.ingest(source, "2024-05-02 10:00:00", pattern=WORDS)["new"].count() == 1


def test_tags_of_the_last_part_count(spark):
    from corpusloom.plans.jobs import ranked_tags

    rows = [("p", 0, ",".join(f"tag{i}" for i in range(8)), None), ("p", 1, "late, tag0", None), ("p", 2, "late", None), ("q", 0, None, "boom")]
    got = {r["path"]: r for r in ranked_tags(spark.createDataFrame(rows, "path string, part int, answer string, error string")).collect()}
    assert got["p"]["_t"][:2] == ["tag0", "late"] and len(got["p"]["_t"]) == 8 and got["q"]["_e2"] == "boom"


def test_merge_note_lists_all_pages(spark):
    from corpusloom.operators import duplicates

    pages = spark.range(701).select(F.format_string("p%04d.md", "id").alias("page_path"), F.lit("---\nsources: [s]\n---\nx").alias("content"))
    where = pages.select("page_path", F.lit("p0000.md").alias("canonical"))
    merged, renames = duplicates.merge_duplicates(pages, where)
    text = merged.first()["content"]
    assert merged.count() == 1 and all(f"p{i:04d}.md" in text for i in range(1, 701)) and renames.count() == 700


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from corpusloom import session

    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))
