"""Index pages: category tree counts and paged line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import markdown as M
from ..functions import paths as P
from ..functions import text as T
from ..plans.ranking import global_rank

C = F.lit


def entries(pages: DataFrame, max_chars: int | None = None, skip_tag: str = K.UNSUPPORTED_TAG,
            front_only: bool = False) -> DataFrame:
    """Pages that belong in the index: category, stem, tags, rel_path.

    Child pages (``parent:`` without ``doc_type: index``), excluded folders,
    index pages and pages with the unsupported tag are left out. The marks are
    looked for in the whole page, its first ``max_chars`` characters, or its
    front matter only.
    """
    head = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    head = M.front_block("content") if front_only else head
    tags = M.line_list(head, "tags")
    return pages.filter(
        ~P.excluded("rel_path", K.MOC_EXCLUDE_DIRS)
        & ~F.startswith(P.basename("rel_path"), C("MOC"))
        & ~F.startswith(P.basename("rel_path"), C("."))
        & (~F.contains(head, C("parent:")) | F.contains(head, C("doc_type: index")))
        & ~F.array_contains(tags, skip_tag)
    ).select(P.dirname("rel_path").alias("category"), P.stem("rel_path").alias("stem"), tags.alias("tags"), "rel_path")


def prefixes(category, depth: int | None = None) -> Column:
    """["a", "a/b", "a/b/c"] of "a/b/c"; [] for the root."""
    parts = F.split(F.col(category), "/")
    n = F.size(parts) if depth is None else F.least(F.size(parts), C(depth))
    return F.when(F.col(category) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(C(1), n), lambda i: F.array_join(F.slice(parts, C(1), i), "/"))
    )


def category_counts(rows: DataFrame, root: str = K.ROOT_COUNT_LABEL) -> DataFrame:
    return rows.groupBy(F.coalesce(T.nonblank("category"), C(root)).alias("category")).agg(F.count("*").alias("n"))


def subtree_counts(rows: DataFrame) -> DataFrame:
    """prefix, depth, n: rows below each node of the tree, itself included.

    Rows are counted per category first; only the counts are multiplied out.
    """
    per = rows.groupBy("category").agg(F.count("*").alias("n"))
    return (
        per.select(F.explode(prefixes("category")).alias("prefix"), "n")
        .groupBy("prefix").agg(F.sum("n").alias("n"))
        .select("prefix", F.size(F.split("prefix", "/")).alias("depth"), "n")
    )


def paged(rows: DataFrame, max_entries: int = K.MOC_MAX_ENTRIES) -> DataFrame:
    """Adds rn, part, parts and total in walk order of rel_path."""
    # a path may be listed more than once
    ties = [c for c in ("stem", "category", "ext") if c in rows.columns]
    ranked = global_rank(rows.withColumn("_walk", P.walk_order("rel_path")), ["_walk", *ties]).drop("_walk")
    total = ranked.agg(F.count("*")).scalar()
    return ranked.withColumn("total", total).select(
        "*",
        F.ceil(F.col("rn") / max_entries).cast("int").alias("part"),
        F.ceil(F.col("total") / max_entries).cast("int").alias("parts"),
    )


def part_files(rows: DataFrame, max_entries: int = K.MOC_MAX_ENTRIES, base: str = "MOC") -> DataFrame:
    """file, part, n of each index page."""
    name = F.when(F.col("parts") == 1, f"{base}.md").otherwise(
        F.concat(C(base + "_"), F.col("part").cast("string"), C(".md")))
    return paged(rows.select("rel_path"), max_entries).groupBy(name.alias("file"), "part").agg(F.count("*").alias("n"))


def stale_files(existing: DataFrame, current: DataFrame, base: str = "MOC") -> DataFrame:
    """Index pages of this family that are no longer needed.

    Families are told apart by name: plain ones never take the
    ``_unsupported`` and ``_fail`` pages.
    """
    other = F.col("file").rlike(r"^MOC_(unsupported|fail)(_.*)?\.md$")
    mine = existing.filter(F.col("file").rlike(rf"^{base}(_.*)?\.md$"))
    if base == "MOC":
        mine = existing.filter(F.col("file").rlike(r"^MOC.*\.md$") & ~other)
    return mine.select("file").join(current.select("file").distinct(), "file", "left_anti").distinct()


def _lines(rows: DataFrame, link: Column, head: list[tuple[str, Column, Column | None]], foot: Column,
           max_entries: int, depth: int | None) -> DataFrame:
    """part, ord, line. Parts hold at most max_entries notes, so the windows
    and groups per part are bounded. Notes in folders below ``depth`` stand
    under their deepest heading."""
    r = paged(rows, max_entries).withColumn("_link", link)
    folders = F.split("category", "/")
    path = F.concat(C("2"), F.array_join(folders if depth is None else F.slice(folders, 1, depth), "\x01"))
    notes = r.select(
        "part", "rn",
        F.when(F.col("category") == "", C("1\x01")).otherwise(F.concat(path, C("\x01"))).alias("k"),
        F.concat(C("- [["), "_link", C("\n")).alias("line"),
    )
    zero = C(0).cast("bigint").alias("rn")
    per = r.groupBy("part", "category").agg(F.count("*").alias("n"))
    root = per.filter("category = ''").select(
        "part", zero, C("1").alias("k"),
        F.concat(C(f"\n## {K.ROOT_LABEL} ("), F.col("n").cast("string"), C(" 篇)\n")).alias("line"))
    heads = (
        per.select("part", "n", F.explode(prefixes("category", depth)).alias("p"))
        .groupBy("part", "p").agg(F.sum("n").alias("n"))
        .select(
            "part", zero, F.concat(C("2"), F.replace(F.col("p"), C("/"), C("\x01"))).alias("k"),
            F.concat(
                C("\n"), F.repeat(C("#"), F.size(F.split("p", "/")) + 1), C(" "), M.leaf("p"),
                C(" ("), F.col("n").cast("string"), C(" 篇)\n"),
            ).alias("line"),
        )
    )
    one = r.groupBy("part").agg(F.max("parts").alias("parts"), F.max("total").alias("total"))
    fixed = F.array(*[
        F.struct(C(k).alias("k"), (F.when(cond, line) if cond is not None else line).alias("line"))
        for k, line, cond in [*head, ("3", foot, None)]
    ])
    ends = one.select("part", F.explode(fixed).alias("x")).select("part", zero, "x.k", "x.line").filter("line IS NOT NULL")
    every = notes.unionByName(root).unionByName(heads).unionByName(ends)
    w = Window.partitionBy("part").orderBy("k", "rn")
    return every.select("part", F.row_number().over(w).alias("ord"), "line")


def _num(c: str) -> Column:
    return F.col(c).cast("string")


def moc_lines(rows: DataFrame, made_at: str, max_entries: int = K.MOC_MAX_ENTRIES,
              max_tags: int = K.MOC_MAX_TAGS, max_depth: int | None = K.MOC_MAX_DEPTH) -> DataFrame:
    """Lines of the knowledge-tree pages from index entries.

    Headings count whole subtrees of their part; notes in folders below
    ``max_depth`` are listed under their deepest heading (None: no limit).
    """
    shown = T.tag_display("tags", max_tags)
    link = F.concat(F.col("stem"), C("]]"), F.when(F.size("tags") > 0, F.concat(C(" "), shown)).otherwise(""))
    part_line = F.concat(C("\n> 第 "), _num("part"), C("/"), _num("parts"), C(" 部分 | 总计 "), _num("total"), C(" 篇笔记\n"))
    head = [
        ("00", C(K.MOC_TITLE + "\n"), None),
        ("01", C(f"{K.UPDATED_PREFIX}{made_at}\n"), None),
        ("02", part_line, F.col("parts") > 1),
    ]
    foot = F.concat(C("\n---\n**总计："), _num("total"), C(" 篇笔记**\n"))
    return _lines(rows, link, head, foot, max_entries, max_depth)


def unsupported_lines(rows: DataFrame, made_at: str, max_entries: int = K.MOC_MAX_ENTRIES,
                      max_depth: int | None = K.MOC_MAX_DEPTH, footer: str = K.FOOTER_PREFIX) -> DataFrame:
    """Lines of the unsupported-file pages; rows: category, stem, ext, rel_path."""
    link = F.concat("stem", F.coalesce("ext", C("")), C("]]"))
    part_line = F.concat(C("\n> 第 "), _num("part"), C("/"), _num("parts"), C(" 部分 | 总计 "), _num("total"), C(" 个文件\n"))
    head = [
        ("00", C(K.UNSUPPORTED_MOC_TITLE + "\n"), None),
        ("01", C(f"{K.UPDATED_PREFIX}{made_at}\n"), None),
        ("02", part_line, F.col("parts") > 1),
        ("03", F.concat(C("\n共 "), _num("total"), C(" 个文件格式不支持。\n")), None),
    ]
    return _lines(rows, link, head, C(f"\n{footer}{made_at}\n"), max_entries, max_depth)


def unsupported_evidence(memory: DataFrame | None, status: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """Union of what is known of unsupported files: this run's list
    (path, category), the status table (path, category, status) and older
    pages that carry the tag (content, rel_path). No de-duplication."""
    parts = []
    from_path = lambda df: df.select(
        "category", P.safe_name("path").alias("stem"), P.suffix("path").alias("ext"), F.col("path").alias("rel_path"))
    if memory is not None:
        parts.append(from_path(memory))
    if status is not None:
        parts.append(from_path(status.filter("status = 'unsupported'")))
    if pages is not None:
        tagged = pages.filter(F.array_contains(M.line_list("content", "tags"), K.UNSUPPORTED_TAG))
        parts.append(tagged.select(
            P.dirname("rel_path").alias("category"), P.stem("rel_path").alias("stem"),
            P.suffix(M.line_value("content", "original_path")).alias("ext"), "rel_path"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failed_entries(pages: DataFrame) -> DataFrame:
    """stem, source, reason of pages in the failed folder."""
    reason = F.filter(F.split("content", "\n"), lambda s: F.startswith(s, C("- **原因**:")))
    why = T.strip(F.substr(F.try_element_at(reason, C(-1)), C(len("- **原因**:") + 1)))
    return pages.select(
        P.stem("rel_path").alias("stem"), M.line_value("content", "source", last=True).alias("source"),
        F.coalesce(why, C("")).alias("reason"),
    )


def failed_lines(rows: DataFrame, made_at: str, shown: int | None = None, footer: str = K.FOOTER_PREFIX) -> DataFrame:
    """ord, line of the failed-file page; rows: stem, source, reason, and path
    if stems repeat. ``shown``: characters of a reason (None: all)."""
    r = global_rank(rows, [c for c in ("stem", "path", "source", "reason") if c in rows.columns])
    total = r.agg(F.count("*").alias("n")).filter("n > 0")
    short = F.col("reason") if shown is None else F.when(F.length("reason") > shown, F.concat(F.substring("reason", 1, shown), C("..."))).otherwise(F.col("reason"))
    body = r.select(
        F.col("rn").alias("ord"),
        F.concat(
            C("- [["), "stem", C("]] "), "source", C("\n"),
            F.when(F.col("reason") != "", F.concat(C("  - 原因: "), short, C("\n"))).otherwise(""),
        ).alias("line"),
    )
    head = F.concat(
        C(f"{K.FAILED_MOC_TITLE}\n{K.UPDATED_PREFIX}{made_at}\n\n共 "), F.col("n").cast("string"), C(" 个文件处理失败。\n\n"))
    return (
        body.unionByName(total.select(C(0).cast("bigint").alias("ord"), head.alias("line")))
        .unionByName(total.select((F.col("n") + 1).alias("ord"), C(f"\n{footer}{made_at}\n").alias("line")))
    )
