"""Queries on duplicates, topics and rules."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import classify, duplicates, incremental, topics
from ..plans.ranking import global_rank
from ..session import settle
from ..sources import corpus as S
from .registry import NOTES, TITLE_PAIRS, WEB, query

C = F.lit

# ---- duplicate pages -----------------------------------------------------------------


@query("dup_title_groups", f"""WITH {WEB} SELECT page_key, title, count(*) AS n, min(page_path) AS first, max(page_path) AS last FROM web GROUP BY 1, 2""")
def dup_title_groups(spark, sf):
    return duplicates.title_groups(S.web_pages(spark, sf))


SHOWN = "page_key, title_a, title_b, first_a, first_b, n_a, n_b, round(similarity, 6) AS similarity, round(reverse, 6) AS reverse"


def rounded(d):
    return d.withColumn("similarity", F.round("similarity", 6)).withColumn("reverse", F.round("reverse", 6))


@query("dup_page_pairs", f"WITH RECURSIVE {WEB}, keyed AS (SELECT page_path, page_key, title FROM web), {TITLE_PAIRS} SELECT {SHOWN} FROM dup")
def dup_page_pairs(spark, sf):
    return rounded(duplicates.duplicate_titles(S.web_pages(spark, sf)))


def words_as_titles(spark, sf):
    """Pages whose titles are two words of a page's title, keyed by the first
    letter: many titles under a key, many of them alike."""
    p = S.web_pages(spark, sf)
    words = F.split("title", " ")
    title = F.array_join(F.slice(words, 2, 2), " ")
    return p.select("page_path", F.lower(F.substring(title, 1, 2)).alias("page_key"), title.alias("title"))


WORD_TITLES = f"""{WEB}, keyed AS (
  SELECT page_path, lower(left(title, 2)) AS page_key, title FROM (
    SELECT page_path, array_to_string(string_split(title, ' ')[2:3], ' ') AS title FROM web))"""


@query("dup_title_near", f"WITH RECURSIVE {WORD_TITLES}, {TITLE_PAIRS} SELECT {SHOWN} FROM dup")
def dup_title_near(spark, sf):
    return rounded(duplicates.duplicate_titles(words_as_titles(spark, sf)))


@query("dup_title_near_map", f"WITH RECURSIVE {WORD_TITLES}, {TITLE_PAIRS} SELECT page_path, canonical FROM dup_map")
def dup_title_near_map(spark, sf):
    """Chains of similar titles end at one page."""
    return duplicates.duplicate_map(words_as_titles(spark, sf))


@query("dup_page_map", f"WITH RECURSIVE {WEB}, keyed AS (SELECT page_path, page_key, title FROM web), {TITLE_PAIRS} SELECT page_path, canonical FROM dup_map")
def dup_page_map(spark, sf):
    return duplicates.duplicate_map(S.web_pages(spark, sf))


@query("dup_page_merge", f"""WITH RECURSIVE {WEB}, keyed AS (SELECT page_path, page_key, title FROM web), {TITLE_PAIRS},
u AS (SELECT canonical, list_sort(list_distinct(list(w.path))) AS sources FROM dup_map d JOIN web w USING (page_path) GROUP BY 1),
nm AS (SELECT canonical, string_agg(regexp_extract(page_path, '[^/]*$'), ', ' ORDER BY page_path) AS names FROM dup_map WHERE page_path <> canonical GROUP BY 1)
SELECT page_path, false AS changed, md5(CASE WHEN names IS NULL THEN '---' || chr(10) || 'sources: [' || w.path || ']' || chr(10) || 'tags: [web]' || chr(10) || '---' || chr(10) || title
  ELSE '---' || chr(10) || 'sources: [' || array_to_string(list_transform(sources, lambda s: '"' || s || '"'), ', ') || ']' || chr(10) || 'tags: ["web"]' || chr(10) || '---' || chr(10)
    || chr(10) || '> 合并自: ' || names || chr(10) || title END) AS content_md5
FROM web w LEFT JOIN u ON u.canonical = w.page_path LEFT JOIN nm ON nm.canonical = w.page_path
WHERE page_path NOT IN (SELECT page_path FROM dup_map WHERE page_path <> canonical)""")
def dup_page_merge(spark, sf):
    w = S.web_pages(spark, sf)
    pages = w.select("page_path", F.concat(C("---\nsources: ["), "path", C("]\ntags: [web]\n---\n"), "title").alias("content"))
    merged, _ = duplicates.merge_duplicates(pages, duplicates.duplicate_map(w))
    return merged.select("page_path", F.md5(F.col("content").cast("binary")).alias("content_md5"), "changed")


# ---- vectors -----------------------------------------------------------------------------

NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
EMB = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e),
s AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM d GROUP BY ALL),
c AS (SELECT label AS topic_id, list(m / l ORDER BY i) AS cen, max(n) AS doc_count
      FROM s JOIN (SELECT label, sqrt(sum(m * m)) AS l FROM s GROUP BY label) USING (label) GROUP BY label)"""


def vecs(spark, sf):
    return S.table(spark, sf, "embeddings")


def centroids(spark, sf):
    c = topics.build_centroids(vecs(spark, sf), ["label"])
    level = F.when(F.size("centroid") > 0, "all")
    return c.select(F.col("label").cast("bigint").alias("topic_id"), level.alias("level1"), "centroid", "doc_count")


def leveled(spark, sf):
    level = F.when(F.size("embedding") > 0, "all")
    return vecs(spark, sf).select(F.col("vec_id").alias("doc_id"), level.alias("level1"), "embedding")


@query("topic_centroids", f"WITH {EMB} SELECT CAST(topic_id AS BIGINT) AS topic_id, CAST(i - 1 AS INTEGER) AS pos, round(cen[i], 6) AS x, doc_count FROM (SELECT *, unnest(range(1, len(cen) + 1)) AS i FROM c)")
def topic_centroids(spark, sf):
    c = centroids(spark, sf)
    return c.select("topic_id", F.posexplode("centroid").alias("pos", "x"), "doc_count").withColumn("x", F.round("x", 6))


@query("vector_norms", f"WITH {EMB} SELECT vec_id, round(list_dot_product(v, cen) / {NORM.format('v')} / {NORM.format('cen')}, 6) AS own_cosine FROM e JOIN c ON label = topic_id")
def vector_norms(spark, sf):
    """Cosine of each vector with its own label's centroid, in SQL functions."""
    c = centroids(spark, sf).select(F.col("topic_id").alias("label"), "centroid")
    return vecs(spark, sf).join(c, "label").select("vec_id", F.round(V.cosine("embedding", "centroid"), 6).alias("own_cosine"))


SCORES = f"""{EMB}, sc AS (SELECT vec_id AS doc_id, topic_id, list_dot_product(v, cen) / {NORM.format('v')} / {NORM.format('cen')} AS score FROM e, c),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic_id) AS rank FROM sc)"""


@query("topic_candidates", f"WITH {SCORES} SELECT doc_id, CAST(topic_id AS BIGINT) AS topic_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10")
def topic_candidates(spark, sf):
    t = topics.topic_candidates(leveled(spark, sf), centroids(spark, sf))
    return t.withColumn("score", F.round("score", 6))


@query("topic_candidates_mixed", f"""WITH {EMB}, bo AS (SELECT vec_id AS doc_id, v, len(v) AS d FROM e
  UNION ALL SELECT vec_id + 1000000, list_slice(v, 1, 8), 8 FROM e WHERE vec_id % 3 = 0),
tops AS (SELECT CAST(topic_id AS BIGINT) AS topic_id, cen FROM c UNION ALL SELECT CAST(topic_id AS BIGINT) + 100, list_slice(cen, 1, 8) FROM c),
sc AS (SELECT doc_id, topic_id, list_dot_product(v, cen) / {NORM.format('v')} / {NORM.format('cen')} AS score FROM bo JOIN tops ON len(cen) = d)
SELECT doc_id, topic_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic_id) AS INTEGER) AS rank
FROM sc QUALIFY rank <= 3""")
def topic_candidates_mixed(spark, sf):
    """Vectors and topics of two dimensions: each meets its own."""
    v, t = leveled(spark, sf), centroids(spark, sf)
    short = v.filter("doc_id % 3 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), "level1", F.slice("embedding", 1, 8).alias("embedding"))
    few = t.select((F.col("topic_id") + 100).alias("topic_id"), "level1", F.slice("centroid", 1, 8).alias("centroid"))
    out = topics.topic_candidates(v.unionByName(short), t.select("topic_id", "level1", "centroid").unionByName(few), 3)
    return out.withColumn("score", F.round("score", 6))


@query("topic_assign", f"""WITH {SCORES} SELECT doc_id, CASE WHEN score >= 0.2 THEN CAST(topic_id AS BIGINT) END AS topic_id, round(score, 6) AS score,
  CASE WHEN score >= 0.3 THEN 'match' WHEN score >= 0.2 THEN 'validate' ELSE 'new' END AS decision FROM rk WHERE rank = 1""")
def topic_assign(spark, sf):
    t = topics.assign_topics(leveled(spark, sf), centroids(spark, sf), 0.30, 0.20)
    return t.withColumn("score", F.round("score", 6))


@query("topic_assign_blocks", f"""WITH {SCORES} SELECT doc_id, CAST(topic_id AS BIGINT) AS topic_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 3""")
def topic_assign_blocks(spark, sf):
    """The way for many topics: blocks of vectors meet blocks of topics."""
    t = topics.topic_candidates(leveled(spark, sf), centroids(spark, sf), 3, max_shared=0)
    return t.withColumn("score", F.round("score", 6))


PAIRS = f"""{EMB}, mp AS (SELECT CAST(a.topic_id AS BIGINT) AS a_id, CAST(b.topic_id AS BIGINT) AS b_id, list_dot_product(a.cen, b.cen) AS s
  FROM c a JOIN c b ON a.topic_id < b.topic_id)"""


@query("topic_merge_pairs", f"WITH {PAIRS} SELECT a_id, b_id, round(s, 6) AS similarity FROM mp WHERE s >= 0.05")
def topic_merge_pairs(spark, sf):
    """Centroids of the test vectors are far apart, hence the low threshold."""
    return topics.merge_pairs(centroids(spark, sf), 0.05).withColumn("similarity", F.round("similarity", 6))


@query("topic_centroid_move", f"""WITH {EMB}, a AS (SELECT label AS topic_id, i, sum(x) AS sx, count(*) AS k FROM d JOIN e USING (vec_id, label) GROUP BY ALL),
u AS (SELECT topic_id, i, (cen[i] * doc_count + sx) / (doc_count + k) AS m, doc_count + k AS n FROM a JOIN c USING (topic_id))
SELECT CAST(topic_id AS BIGINT) AS topic_id, CAST(i - 1 AS INTEGER) AS pos, round(m / l, 6) AS x, n AS doc_count
FROM u JOIN (SELECT topic_id, sqrt(sum(m * m)) AS l FROM u GROUP BY 1) USING (topic_id)""")
def topic_centroid_move(spark, sf):
    """Every vector is added once more to its label's topic."""
    members = vecs(spark, sf).select(F.col("label").cast("bigint").alias("topic_id"), "embedding")
    t = topics.move_centroids(centroids(spark, sf), members)
    return t.select("topic_id", F.posexplode("centroid").alias("pos", "x"), "doc_count").withColumn("x", F.round("x", 6))


@query("vector_upsert", """SELECT vec_id, count(*) OVER () AS total, CASE WHEN vec_id % 2 = 0 THEN len(embedding) ELSE 8 END AS dims FROM embeddings""")
def vector_upsert(spark, sf):
    """Odd vectors and every fourth one are stored with 8 dimensions, then all
    even ones are set in full: some are replaced, some stay, some are new."""
    v = vecs(spark, sf).select("vec_id", "embedding")
    old = v.filter("vec_id % 2 <> 0 OR vec_id % 4 = 0").withColumn("embedding", F.slice("embedding", 1, 8))
    out = incremental.replace_rows(old, v.filter("vec_id % 2 = 0"), ["vec_id"])
    n = out.agg(F.count("*")).scalar()
    return out.select("vec_id", n.alias("total"), F.size("embedding").cast("bigint").alias("dims"))


# ---- topics by keywords -----------------------------------------------------------------------

TOPIC_WORDS = f"""{NOTES}, w AS (SELECT doc_id, category, unnest(tags) AS keyword FROM notes),
tid AS (SELECT category, CAST(row_number() OVER (ORDER BY category) AS BIGINT) AS topic_id FROM (SELECT DISTINCT category FROM notes)),
tk AS (SELECT topic_id, keyword, count(*) AS weight FROM w JOIN tid USING (category) GROUP BY ALL),
tot AS (SELECT topic_id, sum(weight) AS total FROM tk GROUP BY 1),
got AS (SELECT doc_id, topic_id, sum(weight) AS got FROM w JOIN tk USING (keyword) GROUP BY ALL),
rk AS (SELECT doc_id, topic_id, got / total AS score, row_number() OVER (PARTITION BY doc_id ORDER BY got / total DESC, topic_id) AS rank
  FROM got JOIN tot USING (topic_id))"""


def topic_words(spark, sf):
    """(docs, topic_keywords): a topic per category, its words weighted by how
    many of its documents carry them."""
    n = settle(S.notes(spark, sf).select("doc_id", "category", C("all").alias("level1"), F.col("tags").alias("keywords")))
    tid = global_rank(n.select("category").distinct(), ["category"], "topic_id")
    words = n.select("category", F.explode("keywords").alias("keyword")).join(tid, "category")
    tk = words.groupBy("topic_id", "keyword").agg(F.count("*").alias("weight")).withColumn("level1", C("all"))
    return n, tk


@query("topic_keyword_candidates", f"WITH {TOPIC_WORDS} SELECT doc_id, topic_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10")
def topic_keyword_candidates(spark, sf):
    d, tk = topic_words(spark, sf)
    return topics.keyword_candidates(d, tk).withColumn("score", F.round("score", 6))


@query("topic_keyword_assign", f"WITH {TOPIC_WORDS} SELECT doc_id, topic_id, round(score, 6) AS score FROM rk WHERE rank = 1 AND score >= 0.2")
def topic_keyword_assign(spark, sf):
    d, tk = topic_words(spark, sf)
    return topics.keyword_topics(d, tk).withColumn("score", F.round("score", 6))


@query("keyword_upsert", f"""WITH {TOPIC_WORDS}, n AS (SELECT topic_id, keyword, max(doc_id) AS weight FROM w JOIN tid USING (category) GROUP BY ALL)
SELECT topic_id, keyword, weight FROM n""")
def keyword_upsert(spark, sf):
    """Words of labelled documents are stored, the others are set; for a
    (topic, keyword) the last document's weight holds."""
    n = settle(S.notes(spark, sf).select("doc_id", "category", "tags"))
    tid = global_rank(n.select("category").distinct(), ["category"], "topic_id")
    sets = n.join(tid, "category").select("doc_id", "topic_id", F.explode("tags").alias("keyword"), F.col("doc_id").alias("weight"))
    lab = S.table(spark, sf, "labels").select("doc_id")
    have, add = sets.join(lab, "doc_id", "left_semi").drop("doc_id"), sets.join(lab, "doc_id", "left_anti").drop("doc_id")
    return incremental.upsert_latest(have, add, ["topic_id", "keyword"], [F.col("weight").desc()])


@query("topic_insert", """WITH known AS (SELECT DISTINCT source AS name, lang AS level1 FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT source AS name, lang AS level1, min(doc_id) AS doc_id, CAST(1 AS BIGINT) AS doc_count, 1.0::DOUBLE AS score
FROM documents WHERE (source, lang) NOT IN (SELECT (name, level1) FROM known) GROUP BY 1, 2""")
def topic_insert(spark, sf):
    """Topics proposed by all documents; those with a toxic document exist."""
    d = S.table(spark, sf, "documents").select(F.col("source").alias("name"), F.col("lang").alias("level1"), "doc_id",
                                               F.array(F.col("n_chars").cast("double")).alias("embedding"))
    lab = S.table(spark, sf, "labels").filter("toxic = 1")
    have = d.join(lab, "doc_id", "left_semi").select("name", "level1").distinct()
    return topics.add_topics(have, d).select("name", "level1", "doc_id", "doc_count", "score")


MEMBERS = """t AS (SELECT DISTINCT lang AS name FROM documents), ids AS (SELECT name, CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS topic_id FROM t),
a AS (SELECT topic_id, doc_id, n_chars AS score FROM documents JOIN ids ON name = lang),
m AS (SELECT a.topic_id, a.doc_id, 1.0::DOUBLE AS score FROM a JOIN labels USING (doc_id))"""


def membership(spark, sf):
    d = S.table(spark, sf, "documents")
    tid = global_rank(d.select("lang").distinct(), ["lang"], "topic_id")
    a = d.join(tid, "lang").select("topic_id", "doc_id", F.col("n_chars").cast("double").alias("score"))
    have = a.join(S.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("topic_id", "doc_id", C(1.0).alias("score"))
    base = tid.select("topic_id", F.col("lang").alias("name"), C(0).cast("bigint").alias("doc_count"), C("active").alias("status"))
    return base, have, a


@query("topic_members_add", f"""WITH {MEMBERS}
SELECT topic_id, doc_id, coalesce(m.score, a.score) AS score FROM a LEFT JOIN m USING (topic_id, doc_id)""")
def topic_members_add(spark, sf):
    return topics.add_members(*membership(spark, sf))[1]


@query("topic_oversized", f"WITH {MEMBERS} SELECT topic_id, count(*) AS doc_count FROM a GROUP BY 1 HAVING count(*) >= 50")
def topic_oversized(spark, sf):
    return topics.oversized(topics.add_members(*membership(spark, sf))[0]).select("topic_id", "doc_count")




@query("topic_merge", f"""WITH RECURSIVE {PAIRS}, ed AS (SELECT a_id AS a, b_id AS b FROM mp WHERE s >= 0.05 UNION SELECT b_id, a_id FROM mp WHERE s >= 0.05),
reach AS (SELECT CAST(topic_id AS BIGINT) AS a, CAST(topic_id AS BIGINT) AS b FROM c UNION SELECT reach.a, ed.b FROM reach JOIN ed ON reach.b = ed.a),
root AS (SELECT a AS topic_id, min(b) AS to_id FROM reach GROUP BY 1),
n AS (SELECT to_id, sum(doc_count) AS n FROM root JOIN c USING (topic_id) GROUP BY 1)
SELECT r.topic_id, CASE WHEN r.to_id = r.topic_id THEN 'active' ELSE 'merged' END AS status,
  CASE WHEN r.to_id <> r.topic_id THEN r.to_id END AS merged_into,
  CAST(CASE WHEN r.to_id = r.topic_id THEN n.n ELSE c.doc_count END AS BIGINT) AS doc_count
FROM root r JOIN c USING (topic_id) JOIN n ON n.to_id = r.to_id""")
def topic_merge(spark, sf):
    t = centroids(spark, sf)
    m = vecs(spark, sf).select(F.col("label").cast("bigint").alias("topic_id"), F.col("vec_id").alias("doc_id"), C(1.0).alias("score"))
    k = m.select("topic_id", C("w").alias("keyword"), C(1.0).alias("weight"))
    return topics.merge_topics(t, m, k, topics.merge_pairs(t, 0.05))[0].select("topic_id", "status", "merged_into", "doc_count")


@query("topic_merge_members", f"""WITH RECURSIVE {PAIRS}, ed AS (SELECT a_id AS a, b_id AS b FROM mp WHERE s >= 0.05 UNION SELECT b_id, a_id FROM mp WHERE s >= 0.05),
reach AS (SELECT CAST(topic_id AS BIGINT) AS a, CAST(topic_id AS BIGINT) AS b FROM c UNION SELECT reach.a, ed.b FROM reach JOIN ed ON reach.b = ed.a),
root AS (SELECT a AS topic_id, min(b) AS to_id FROM reach GROUP BY 1)
SELECT DISTINCT to_id AS topic_id, vec_id AS doc_id FROM e JOIN root ON topic_id = label""")
def topic_merge_members(spark, sf):
    t = centroids(spark, sf)
    m = vecs(spark, sf).select(F.col("label").cast("bigint").alias("topic_id"), F.col("vec_id").alias("doc_id"), C(1.0).alias("score"))
    k = m.select("topic_id", C("w").alias("keyword"), C(1.0).alias("weight"))
    return topics.merge_topics(t, m, k, topics.merge_pairs(t, 0.05))[1].select("topic_id", "doc_id")


# ---- rules ---------------------------------------------------------------------------------

RULES = {"english": ["the", "and", "that", "the"], "french": ["que", "les", "dans"], "german": ["und", "der", "sch"]}
TYPES = ["tion", "ment", "heit", "keit", "ando", "ering", "a"]


def score_sql(words):
    return " + ".join(f"CAST(contains(h, '{w}') AS INTEGER)" for w in words)


RULE_SQL = "r AS (SELECT doc_id, " + ", ".join(f"{score_sql(w)} AS {d}" for d, w in RULES.items()) + \
    " FROM (SELECT doc_id, lower(source || ' ' || text) AS h FROM documents))"


@query("rule_domain", f"""WITH {RULE_SQL} SELECT doc_id, CASE WHEN greatest(english, french, german) = 0 THEN '其他'
  WHEN english >= greatest(french, german) THEN 'english' WHEN french >= german THEN 'french' ELSE 'german' END AS domain,
  CAST(english AS INTEGER) AS english FROM r""")
def rule_domain(spark, sf):
    d = S.spread(S.table(spark, sf, "documents"))
    return d.select("doc_id", classify.rule_domain("source", "text", RULES).alias("domain"),
                    classify.rule_scores("source", "text", RULES)[0]["score"].alias("english"))


@query("doc_type_tags", "SELECT doc_id, concat_ws('|', " + ", ".join(
    f"CASE WHEN contains(lower(source || ' ' || text), '{w}') THEN '{w}' END" for w in TYPES if len(w) >= 2)
    + ") AS full_tags, array_to_string(list_slice(string_split(full_tags, '|'), 1, 5), '|') AS tags FROM documents")
def doc_type_tags(spark, sf):
    d = S.spread(S.table(spark, sf, "documents"))
    return d.select(
        "doc_id", F.array_join(classify.doc_type_tags("source", "text", TYPES), "|").alias("tags"),
        F.array_join(classify.doc_type_tags("source", "text", TYPES, limit=9), "|").alias("full_tags"))


TREE = {"english/a/x": ["ing"], "english/b": [], "french/c/y": [], "french/c/z": ["eau"], "german": []}


@query("tree_classify", f"""WITH {RULE_SQL}, l AS (SELECT doc_id, source, CASE WHEN greatest(english, french, german) = 0 THEN ''
  WHEN english >= greatest(french, german) THEN 'english' WHEN french >= german THEN 'french' ELSE 'german' END AS l1 FROM r JOIN documents USING (doc_id)),
m AS (SELECT doc_id, l1, CASE l1 WHEN 'english' THEN CASE WHEN source = 'src1' THEN 'b' ELSE 'a' END WHEN 'french' THEN 'c' ELSE '' END AS l2,
  source FROM l)
SELECT doc_id, CASE WHEN l1 = '' THEN '其他' WHEN l2 = '' THEN l1 WHEN l1 = 'english' AND l2 = 'a' THEN 'english/a/x'
  WHEN l1 = 'english' THEN 'english/b' WHEN source = 'src2' THEN 'french/c/z' ELSE 'french/c' END AS path FROM m""")
def tree_classify(spark, sf):
    """Answers for the second and third level come from the source name."""
    src = F.col("source")
    d = S.spread(S.table(spark, sf, "documents")).select(
        "doc_id", src.alias("title"), "text", F.when(src == "src1", "b").otherwise("a").alias("answer2"),
        F.when(src == "src2", "z").otherwise("?").alias("answer3"))
    return classify.classify_by_tree(d, TREE, RULES, TYPES).select("doc_id", "path")


@query("classify_dynamic", f"""WITH {RULE_SQL}, {EMB}, l AS (SELECT doc_id, CASE WHEN greatest(english, french, german) = 0 THEN '其他'
  WHEN english >= greatest(french, german) THEN 'english' WHEN french >= german THEN 'french' ELSE 'german' END AS l1 FROM r),
sc AS (SELECT l.doc_id, topic_id, list_dot_product(v, cen) / {NORM.format('v')} / {NORM.format('cen')} AS score
  FROM l JOIN e ON vec_id = doc_id, c WHERE l1 = 'english'),
b AS (SELECT doc_id, topic_id, score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic_id) = 1)
SELECT l.doc_id, CASE WHEN score >= 0.2 THEN 'english/t' || topic_id WHEN l1 = 'french' AND e.vec_id IS NULL AND contains(lower(text), 'eau') THEN 'french/eau' ELSE l1 END AS path,
  CASE WHEN score >= 0.3 THEN 'match' WHEN score >= 0.2 THEN 'validate'
       WHEN l1 = 'french' AND e.vec_id IS NULL AND contains(lower(text), 'eau') THEN 'match' ELSE 'new' END AS decision
FROM l JOIN documents USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN e ON e.vec_id = l.doc_id""")
def classify_dynamic(spark, sf):
    """Documents with a vector go to the label topics of the first domain,
    French ones without a vector to a keyword topic."""
    from ..plans import jobs

    v = vecs(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")
    d = S.spread(S.table(spark, sf, "documents")).join(v, "doc_id", "left").select(
        "doc_id", F.col("source").alias("title"), "text", "embedding",
        F.when(F.contains(F.lower("text"), C("eau")), F.array(C("eau"))).otherwise(F.array().cast("array<string>")).alias("keywords"))
    none = C(None).cast("string")
    known = centroids(spark, sf).select(
        "topic_id", C("english").alias("level1"), F.concat(C("t"), F.col("topic_id").cast("string")).alias("level2"), none.alias("level3"), "centroid")
    words = d.select(F.explode("keywords").alias("keyword")).distinct().select(
        (F.length("keyword") + 1000).cast("bigint").alias("topic_id"), C("french").alias("level1"), "keyword", C(1.0).alias("weight"))
    eau = words.select("topic_id", "level1", F.col("keyword").alias("level2"), none.alias("level3"),
                       F.array().cast("array<double>").alias("centroid"))
    out = jobs.classify_dynamic(d, RULES, known.unionByName(eau), words, TYPES, 0.30, 0.20)
    return out.select("doc_id", "path", "decision")


@query("topic_listing", f"""WITH {TOPIC_WORDS}
SELECT topic_id, keyword, weight, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, keyword) AS INTEGER) AS rank FROM tk""")
def topic_listing(spark, sf):
    """Keywords of each topic by falling weight."""
    _, tk = topic_words(spark, sf)
    return topics.keyword_listing(tk)
