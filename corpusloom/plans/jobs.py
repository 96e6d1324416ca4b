"""User-level jobs composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import markdown as M
from ..functions import paths as P
from ..functions import text as T
from ..operators import classify, enrich, incremental, links, moc, related, repair, sections, topics
from ..session import settle, settle_table
from ..sources import files as files_source
from ..sources.tables import StateTable, number_clashes
from .joins import attach

C = F.lit

PAGES = "rel_path string, note_name string, source_path string, category string, tags array<string>, summary string, content string"
STATUS = "path string, status string, md_path string, category string, error string, size bigint, modified timestamp, md5 string, processed_at string"
CACHE = "path string, sha256 string, processed_at string, md_path string, category string, tags array<string>"
INDEX = "md5 string, filename string, category string, note_path string"


def crosslink_pages(pages: DataFrame, k: int = K.MAX_LINKS, min_score: float = K.MIN_LINK_SCORE,
                    pattern: str = K.CJK_KEYWORD) -> DataFrame:
    """Pages with their related-pages section written, and ``changed``.

    pages: note_name, rel_path, content, tags, category, summary. Pages are
    told apart by rel_path, since folders may share a stem. Child pages
    (``parent:``) are left as they are.
    """
    best = related.related_docs(pages.withColumn("note_name", F.col("rel_path")), k, min_score, pattern)
    # at most k links per page
    per = best.groupBy(F.col("note_name").alias("rel_path")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "other_name"))),
                    lambda s: P.without_suffix(s["other_name"])).alias("_targets"))
    j = attach(pages, per, "rel_path")
    child = F.contains(M.front_block("content"), C("parent:"))
    text = F.when(F.col("_targets").isNull() | child, F.col("content")).otherwise(M.put_related("content", "_targets", keep_footer=True))
    return j.withColumn("_new", text).withColumn("changed", F.col("_new") != F.col("content")).withColumn(
        "content", F.col("_new")).select(*pages.columns, "changed")


def ranked_tags(answers: DataFrame, limit: int = 8) -> DataFrame:
    """path, _t, _e2: the tags of all parts of a text, those that most parts
    name first, then by part and place; the error of any part.

    answers: path, part, answer (comma-separated), error.
    """
    each = answers.select("path", "part", F.posexplode(F.split("answer", ",")).alias("at", "tag"))
    each = each.select("path", "part", "at", T.strip("tag").alias("tag"))
    told = each.groupBy("path", "tag").agg(F.count_distinct("part").alias("n"), F.min(F.struct("part", "at")).alias("first"))
    row = F.struct((-F.col("n")).alias("n"), "first", "tag")
    listed = told.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["tag"]).alias("all"))
    failed = answers.groupBy("path").agg(F.max("error").alias("_e2"))
    return failed.join(listed, "path", "left").select("path", T.clean_tags("all", limit).alias("_t"), "_e2")


def classify_dynamic(docs: DataFrame, rules: dict, known: DataFrame, words: DataFrame, type_words: list[str],
                     match: float = K.TOPIC_MATCH, validate: float = K.TOPIC_VALIDATE) -> DataFrame:
    """doc_id, path, decision, type_tags: rules pick the first level, then the
    nearest topic by vector, or by keywords where a document has no vector.

    docs: doc_id, title, text, embedding (may be NULL), keywords; known:
    topic_id, level1, level2, level3, centroid; words: topic keywords. A
    ``validate`` decision is left to whoever confirms it.
    """
    # texts are read once; what follows needs the rules' results only
    d = settle_table(docs.select(
        "doc_id", classify.rule_domain("title", "text", rules).alias("level1"),
        classify.doc_type_tags("title", "text", type_words).alias("type_tags"), "embedding", "keywords"))
    vec = d.filter("embedding IS NOT NULL")
    by_vec = topics.assign_topics(vec, known, match, validate).select("doc_id", "topic_id", "decision")
    by_word = topics.keyword_topics(d.filter("embedding IS NULL"), words).select(
        "doc_id", "topic_id", C("match").alias("decision"))
    got = by_vec.unionByName(by_word)
    name = known.select("topic_id", "level2", "level3")
    out = d.select("doc_id", "level1", "type_tags").join(got, "doc_id", "left").join(name, "topic_id", "left")
    taken = F.col("decision").isin("match", "validate")
    path = F.concat_ws("/", "level1", F.when(taken, F.col("level2")), F.when(taken, F.col("level3")))
    return out.select("doc_id", path.alias("path"), F.coalesce("decision", C("new")).alias("decision"), "type_tags")


def maintain_topics(known: DataFrame, members: DataFrame, words: DataFrame, threshold: float = K.TOPIC_MERGE,
                    size: int = K.TOPIC_SPLIT_SIZE):
    """(topics, members, keywords, topics due for a split) after merging."""
    t, m, w = topics.merge_topics(known, members, words, topics.merge_pairs(known, threshold))
    return t, m, w, topics.oversized(t, size)


class Vault:
    """A vault kept as versioned tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.pages = StateTable(spark, f"{root}/pages", PAGES)
        self.status = StateTable(spark, f"{root}/status", STATUS)
        self.cache = StateTable(spark, f"{root}/cache", CACHE)
        self.index = StateTable(spark, f"{root}/index", INDEX)

    def ingest(self, source: str, made_at: str, summarise=enrich.longest_sentences, tag=enrich.longest_words,
               pattern: str = K.CJK_KEYWORD, parsers=files_source.PARSERS, only: str | None = None) -> dict[str, DataFrame]:
        """Import new and changed files below ``source``.

        ``only='image'`` redoes images whatever the cache says. Returns the
        tables of this run: new pages, failures, index page lines, changes.
        Running it again without changes imports nothing.
        """
        date = made_at[:10]
        inv = settle(files_source.inventory(self.spark, source))
        changes = settle(incremental.detect_changes(inv, self.status.read()))
        kinds = ["image"] if only == "image" else ["parseable", "image"]
        todo = inv.filter(F.col("kind").isin(kinds)).withColumn("category", P.source_category("rel_path"))
        if only != "image":
            todo = incremental.skip_known(todo, self.index.read())
            hit = incremental.cache_lookup(todo, self.cache.read()).filter("hit").select("path")
            todo = todo.join(hit, "path", "left_anti")
        raw = files_source.read_contents(self.spark, source).select("path", "ext", "content")
        known = F.col("ext").isin(list(parsers))
        wanted = attach(raw, todo.select("path"), "path", "left_semi")
        parsed = settle_table(
            files_source.parse_files(wanted.filter(known), parsers)
            .unionByName(wanted.filter(~known & F.col("ext").isin(K.IMAGE_EXTS)).select(
                "path", "ext", C("").alias("text"), C(None).cast("string").alias("error")))
            .unionByName(wanted.filter(~known & ~F.col("ext").isin(K.IMAGE_EXTS)).select(
                "path", "ext", C(None).cast("string").alias("text"), C("no parser for this type").alias("error"))))
        good, bad = enrich.split_errors(parsed)
        md = good.withColumn("secs", F.when(F.col("text") != "", M.split_sections("text")))
        md = md.withColumn("plain", F.when(F.col("ext").isin(".md", ".markdown"), M.clean_markdown("text")).otherwise(F.col("text")))

        def ask(kind, fn):
            # a long text is answered in parts, which are joined in order
            r = sections.build_requests(md.select("path", "plain"), "path", "plain", kind)
            return settle(enrich.enrich(r, fn, ["path", "part"]))

        sums, tags = ask("summary", summarise), ask("tags", tag)
        summary = sums.groupBy("path").agg(sections.ordered_text("part", F.col("answer"), "\n").alias("summary"),
                                           F.max("error").alias("_e1"))
        notes = md.join(summary, "path").join(ranked_tags(tags), "path").join(todo.select("path", "rel_path", "category", "name"), "path")
        failed = settle(bad.select("path", "error").unionByName(
            notes.filter("_e1 IS NOT NULL OR _e2 IS NOT NULL").select("path", F.coalesce("_e1", "_e2").alias("error"))))
        notes = notes.filter("_e1 IS NULL AND _e2 IS NULL")
        short = F.length("plain") < K.REQUEST_LIMITS["tags"][0]
        notes = notes.withColumn("tags", F.when(short, F.array().cast("array<string>")).otherwise(F.col("_t")))
        titles = F.transform(F.coalesce("secs", F.array()), lambda s: s["title"])
        outline = T.outline_lines(C(""), titles)
        page = M.render_page("name", C(date), "category", "tags", F.concat(C("source/"), "rel_path"), "summary", outline, C(made_at))
        named = number_clashes(
            notes.select(
                F.col("category").alias("dir"), F.concat(C(date + "-"), P.safe_name("rel_path")).alias("base"),
                F.col("path").alias("source_path"), "category", "tags", "summary", page.alias("content")),
            "dir", "base", ["source_path"])
        new = settle_table(named.select(
            F.col("file").alias("rel_path"), P.stem("file").alias("note_name"), "source_path", "category", "tags", "summary", "content"))

        # pages go first: if the run ends before the state is written, the next one does these files again
        pages = self.pages.read()
        if not new.isEmpty():  # nothing new leaves the stored pages as they are
            pages = incremental.replace_rows(pages, new, ["source_path"])
            pages = self.pages.write(crosslink_pages(pages, pattern=pattern).drop("changed"))
        self._record(inv, todo, new, failed, date, made_at)
        return {"new": new, "failed": failed, "changes": changes, "moc": self.moc(made_at), "pages": pages}

    def _record(self, inv, todo, new, failed, date, made_at) -> None:
        facts = inv.select("path", "size", "modified", "md5", "sha256")
        ok = new.select(F.col("source_path").alias("path"), C("success").alias("status"), F.col("rel_path").alias("md_path"),
                        "category", C(None).cast("string").alias("error"))
        no = failed.join(todo.select("path", "category"), "path").select(
            "path", C("failed").alias("status"), C(None).cast("string").alias("md_path"), "category", "error")
        odd = incremental.register_unsupported(inv.filter("kind = 'unsupported'").withColumn(
            "category", P.source_category("rel_path"))).select(
            "path", "status", C(None).cast("string").alias("md_path"), "category", C(None).cast("string").alias("error"))
        rows = ok.unionByName(no).unionByName(odd).join(facts, "path").withColumn("processed_at", C(made_at))
        self.status.write(incremental.replace_rows(self.status.read(), rows.drop("sha256"), ["path"]))
        done = new.join(facts, F.col("source_path") == F.col("path"))
        cache = done.select("path", "sha256", C(made_at).alias("processed_at"), F.col("rel_path").alias("md_path"), "category", "tags")
        self.cache.write(incremental.replace_rows(self.cache.read(), cache, ["path"]))
        index = incremental.latest(done.select(
            "md5", P.basename("path").alias("filename"), "category", F.col("rel_path").alias("note_path")),
            ["md5"], [F.col("note_path").desc()])
        self.index.write(incremental.replace_rows(self.index.read(), index, ["md5"]))

    def moc(self, made_at: str) -> DataFrame:
        """Lines of the knowledge tree over all pages."""
        return moc.moc_lines(moc.entries(self.pages.read(), front_only=True), made_at)

    def failed_moc(self, made_at: str) -> DataFrame:
        rows = self.status.read().filter("status = 'failed'").select(
            P.stem(M.failure_name("path", C(made_at))).alias("stem"), "path", P.basename("path").alias("source"),
            F.coalesce("error", C("")).alias("reason"))
        return moc.failed_lines(rows, made_at)

    def unsupported_moc(self, made_at: str) -> DataFrame:
        return moc.unsupported_lines(moc.unsupported_evidence(None, self.status.read(), None), made_at)

    def failure_pages(self, date: str, stamp: str) -> DataFrame:
        """rel_path, content of a page per failed file."""
        bad = self.status.read().filter("status = 'failed'")
        return bad.select(M.failure_name("path", C(stamp)).alias("rel_path"),
                          M.render_failure("path", F.coalesce("error", C("")), C(date)).alias("content"))

    def refresh_images(self, source: str, made_at: str, **kw) -> dict[str, DataFrame]:
        """Forget the cache, redo the images, refresh the index pages."""
        self.cache.write(self.cache.read().limit(0))
        return self.ingest(source, made_at, only="image", **kw)

    def lint(self, **kw) -> DataFrame:
        """Findings; links name pages by path or stem."""
        return links.lint(self.pages.read().withColumnRenamed("rel_path", "path"), **{"match_on": "either", **kw})

    def drop_sources(self, deleted: DataFrame) -> DataFrame:
        """The cascade on the stored pages: those made from deleted files go,
        links to them go, and status, cache and index forget the files.

        deleted: path. Returns the pages that are left.
        """
        gone = deleted.select(F.col("path").alias("source_path")).distinct()
        pages = self.pages.read()
        lost = settle(pages.join(gone, "source_path", "left_semi").select("rel_path", "note_name"))
        left = attach(pages, lost.select("rel_path"), "rel_path", "left_anti")
        # links are paths without extension, or stems that no page left has
        stems = lost.select("note_name").join(left.select("note_name"), "note_name", "left_anti")
        dead = lost.select(P.without_suffix("rel_path").alias("note_name")).unionByName(stems)
        named = left.withColumn("_stem", F.col("note_name")).withColumn("note_name", F.col("rel_path"))
        cut = links.remove_links(named, dead, squeeze_all=False)
        out = self.pages.write(cut.withColumn("note_name", F.col("_stem")).select(*pages.columns))
        files = gone.withColumnRenamed("source_path", "path")
        self.status.write(self.status.read().join(files, "path", "left_anti"))
        self.cache.write(self.cache.read().join(files, "path", "left_anti"))
        notes = lost.select(F.col("rel_path").alias("note_path"))
        self.index.write(self.index.read().join(notes, "note_path", "left_anti").select("md5", "filename", "category", "note_path"))
        return out

    def repair(self, source: str, made_at: str, pattern: str = K.CJK_KEYWORD) -> dict[str, DataFrame]:
        """Bring categories and folders in line with the sources, rewrite old
        reference blocks, then redo links and index pages."""
        inv = settle(files_source.inventory(self.spark, source, hashes=False))
        where = inv.select("rel_path", F.concat(C(source.rstrip("/") + "/"), "rel_path").alias("vault_path"))
        pages = self.pages.read()
        plan = settle(repair.repair_plan(pages, where))
        fixed = repair.migrate(repair.apply_repair(pages, plan)).drop("changed")
        fixed = fixed.withColumn("category", P.dirname("rel_path"))
        pages = self.pages.write(crosslink_pages(fixed, pattern=pattern).drop("changed"))
        return {"plan": plan, "moc": self.moc(made_at), "gone": repair.reconcile(pages, where), "pages": pages}
