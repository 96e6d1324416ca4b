"""Rule-based classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.paths import _col

Rules = dict[str, list[str]]


def _head(title, text, max_chars: int | None) -> Column:
    body = _col(text) if max_chars is None else F.substring(_col(text), 1, max_chars)
    return F.lower(F.concat_ws(" ", F.coalesce(_col(title), F.lit("")), body))


def rule_scores(title, text, rules: Rules, max_chars: int | None = None) -> Column:
    """array<struct<score, ord, domain>>; a repeated keyword counts twice."""
    h = _head(title, text, max_chars)
    return F.array(*[
        F.struct(T.contains_any_score(h, words).alias("score"), F.lit(-i).alias("ord"), F.lit(d).alias("domain"))
        for i, (d, words) in enumerate(rules.items())
    ])


def rule_domain(title, text, rules: Rules, default: str = K.DEFAULT_CATEGORY, max_chars: int | None = None) -> Column:
    """Domain with the most keywords in the title and text; ties go to the one
    declared first, no hit to the default. One projection, no shuffle."""
    best = F.array_max(rule_scores(title, text, rules, max_chars))
    return F.when(best["score"] > 0, best["domain"]).otherwise(default)


def doc_type_tags(title, text, words: list[str], limit: int = 5, max_chars: int | None = None) -> Column:
    """Listed words found in the title and text, in list order, 2-20 long."""
    h = _head(title, text, max_chars)
    keep = [w for w in dict.fromkeys(words) if 2 <= len(w) <= 20]
    hits = F.array(*[F.when(F.contains(h, F.lit(w.lower())), F.lit(w)) for w in keep])
    found = F.slice(F.array_compact(hits), 1, limit)
    return F.when(T.strip(text) != "", found).otherwise(F.array().cast("array<string>"))


def classify_by_tree(
    docs: DataFrame, tree: Rules, rules: Rules, type_words: list[str], default: str = K.DEFAULT_CATEGORY
) -> DataFrame:
    """doc_id, path, type_tags by a category tree of at most three levels.

    docs: doc_id, title, text, answer2, answer3 - the answers of whoever picks
    the second and third level where rules cannot; they are snapped to the
    tree's names. ``tree`` maps "a/b/c" to extra type words.
    """
    tops = list(dict.fromkeys(k.split("/")[0] for k in tree))
    used = {d: w for d, w in rules.items() if d in tops}
    l1 = rule_domain("title", "text", used, "") if used else F.lit("")
    out = docs.withColumn("_l1", l1)
    seconds: dict[str, list[str]] = {}
    thirds: dict[str, list[str]] = {}
    for k in tree:
        p = k.split("/")
        if len(p) > 1 and p[1] not in seconds.setdefault(p[0], []):
            seconds[p[0]].append(p[1])
        if len(p) > 2 and p[2] not in thirds.setdefault("/".join(p[:2]), []):
            thirds["/".join(p[:2])].append(p[2])

    def pick(key: Column, options: dict[str, list[str]], answer: str) -> Column:
        c = F.lit("")
        for k, names in options.items():
            one = F.lit(names[0]) if len(names) == 1 else T.snap_label(answer, names, "")
            c = F.when(key == k, one).otherwise(c)
        return c

    out = out.withColumn("_l2", pick(F.col("_l1"), seconds, "answer2"))
    out = out.withColumn("_p2", F.concat_ws("/", "_l1", "_l2"))
    out = out.withColumn("_l3", F.when(F.col("_l2") != "", pick(F.col("_p2"), thirds, "answer3")).otherwise(""))
    path = F.concat_ws("/", T.nonblank("_l1"), T.nonblank("_l2"), T.nonblank("_l3"))
    extra = F.lit(None).cast("array<string>")
    for k, words in tree.items():
        extra = F.when(F.col("_path") == k, doc_type_tags("title", "text", [*words, *type_words])).otherwise(extra)
    out = out.withColumn("_path", path)
    tags = F.when(F.col("_l2") != "", F.coalesce(extra, doc_type_tags("title", "text", type_words)))
    return out.select(
        "doc_id", F.when(F.col("_l1") == "", default).otherwise(F.col("_path")).alias("path"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("type_tags"))
