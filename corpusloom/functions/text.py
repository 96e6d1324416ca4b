"""Keyword, tag and text columns (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .paths import _col, strip

C = F.lit


def keywords(text, pattern: str = K.CJK_KEYWORD) -> Column:
    """Distinct greedy non-overlapping matches of ``pattern``; [] for NULL."""
    return F.coalesce(
        F.array_distinct(F.regexp_extract_all(_col(text), C(pattern), C(0))),
        F.array().cast("array<string>"),
    )


def tiled_keywords(text, title, char_class: str = "[一-鿿]") -> Column:
    """Runs of exactly 2, 3 and 4 characters of the text, 2-6 of the title."""
    out = keywords(title, char_class + "{2,6}")
    for n in (2, 3, 4):
        out = F.array_union(out, keywords(text, char_class + "{%d}" % n))
    return out


def jaccard(a, b) -> Column:
    """Set overlap of two arrays without repeats; 0 when either is empty."""
    a, b = _col(a), _col(b)
    inter = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), C(0.0)).otherwise(
        inter / (F.size(a) + F.size(b) - inter)
    )


def longest_tokens(text, n: int = 5, pattern: str = r"\p{L}{4,20}") -> Column:
    """The n longest distinct tokens of the lower-cased text, ties by name."""
    toks = F.array_distinct(F.regexp_extract_all(F.lower(_col(text)), C(pattern), C(0)))
    ranked = F.sort_array(F.transform(toks, lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: s["t"])


def clean_tags(
    tags, limit: int = 8, min_len: int = 2, max_len: int = 20,
    placeholders: list[str] = K.PLACEHOLDER_TAGS, strip_chars: str = K.TAG_STRIP_CHARS,
) -> Column:
    """Strip quotes and brackets, drop short/long/placeholder tags, keep the
    first of each, at most ``limit``."""
    bare = F.transform(_col(tags), lambda t: strip(strip(t), strip_chars))
    skip = F.array(*[C(p) for p in placeholders])
    keep = F.filter(
        bare,
        lambda t: F.length(t).between(min_len, max_len)
        & ~F.array_contains(skip, t)
        & ~(F.startswith(t, C("[")) & F.endswith(t, C("]"))),
    )
    return F.slice(F.array_distinct(keep), 1, limit)


def split_tags(raw, limit: int = 8) -> Column:
    """Tags of a comma-separated answer (ASCII or full-width commas)."""
    parts = F.split(F.replace(_col(raw), C("，"), C(",")), ",")
    return F.slice(F.filter(F.transform(parts, lambda s: strip(s)), lambda t: t != ""), 1, limit)


def tag_display(tags, shown: int = K.MOC_MAX_TAGS) -> Column:
    """First tags as `` `#t` ``, and the total when there are more."""
    t = _col(tags)
    head = F.array_join(F.transform(F.slice(t, 1, shown), lambda x: F.concat(C("`#"), x, C("`"))), ", ")
    more = F.concat(head, C(" 等"), F.size(t).cast("string"), C("个"))
    return F.when(F.size(t) > shown, more).otherwise(head)


def outline_lines(answer, titles=None, limit: int = 30, fallback: int = 20) -> Column:
    """Lines starting with ``- `` of an answer; else distinct long titles."""
    lines = F.filter(
        F.split(strip(answer), "\n"),
        lambda s: F.startswith(s, C("- ")) & (F.length(strip(s)) > 2),
    )
    out = F.slice(lines, 1, limit)
    if titles is None:
        return out
    long_titles = F.array_distinct(F.filter(_col(titles), lambda t: F.length(t) > 3))
    alt = F.transform(F.slice(long_titles, 1, fallback), lambda t: F.concat(C("- "), t))
    return F.when(F.size(out) > 0, out).otherwise(alt)


def after_reasoning(raw, marks: list[str] = K.REASONING_MARKS) -> Column:
    """Text after the first end-of-reasoning mark that has text behind it."""
    r = _col(raw)
    rest = []
    for m in marks:
        at = F.instr(r, C(m)) if isinstance(m, str) else F.instr(r, m)
        tail = strip(F.substr(r, at + len(m)))
        rest.append(F.when((at > 0) & (tail != ""), tail))
    return F.coalesce(*rest, r)


def contains_any_score(haystack, words: list[str]) -> Column:
    """Number of list entries contained in the text (repeats count again)."""
    h = F.lower(_col(haystack))
    out = C(0)
    for w in words:
        out = out + F.contains(h, C(w.lower())).cast("int")
    return out


def snap_label(answer, candidates: list[str], default: str | None = "") -> Column:
    """Exact candidate, else the first one inside the answer or around it."""
    a = _col(answer)
    arr = F.array(*[C(c) for c in candidates])
    near = F.filter(arr, lambda c: F.contains(a, c) | F.contains(c, a))
    return F.when(F.array_contains(arr, a), a).otherwise(
        F.coalesce(F.when(a != "", F.try_element_at(near, C(1))), C(default))
    )


def joined(*parts: Column, sep: str = "\n") -> Column:
    """Join the parts that are not NULL."""
    return F.concat_ws(sep, *parts)


def nonblank(c) -> Column:
    """The value, or NULL when it is empty."""
    c = _col(c)
    return F.when(c != "", c)
