"""Path, stem and link-name columns (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

C = F.lit


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c, chars: str = K.WHITESPACE) -> Column:
    """Trim any of ``chars`` on both sides (all white space by default)."""
    return F.btrim(_col(c), C(chars))


def basename(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def dirname(path) -> Column:
    return F.regexp_replace(_col(path), r"/?[^/]*$", "")


def suffix(path) -> Column:
    """Lower-case extension with its dot, '' without one or for dot-files."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def stem(path) -> Column:
    """File name without its last extension; a dot-file is its own stem."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]+$", "")


def safe_name(path) -> Column:
    return F.replace(stem(path), C(" "), C("_"))


def dated_name(path, date: str | Column) -> Column:
    d = C(date) if isinstance(date, str) else date
    return F.concat(d, C("-"), safe_name(path), C(".md"))


def without_ext(path) -> Column:
    """Text before the last dot, wherever that dot is."""
    p = _col(path)
    return F.when(F.contains(p, C(".")), F.regexp_replace(p, r"\.[^.]*$", "")).otherwise(p)


def relative_to(path, root) -> Column:
    """Path below ``root``, NULL when it lies elsewhere."""
    p, r = _col(path), F.concat(F.rtrim(_col(root), C("/")), C("/"))
    return F.when(F.startswith(p, r), F.substr(p, F.length(r) + 1))


def _escapes(rel: Column) -> Column:
    """True when `..` steps leave the folder the path starts in."""
    steps = F.filter(F.split(rel, "/"), lambda s: (s != "") & (s != "."))
    lowest = F.aggregate(
        steps,
        F.struct(C(0).alias("d"), C(0).alias("low")),
        lambda acc, s: F.struct(
            (acc["d"] + F.when(s == "..", -1).otherwise(1)).alias("d"),
            F.least(acc["low"], acc["d"] + F.when(s == "..", -1).otherwise(1)).alias("low"),
        ),
        lambda acc: acc["low"],
    )
    return lowest < 0


def source_category(rel_path, external: str = K.EXTERNAL_BUCKET) -> Column:
    """Category of a file = folder of its source-relative path; '' at the root.

    Paths that leave the vault go to one fixed bucket.
    """
    d = dirname(F.replace(_col(rel_path), C("\\"), C("/")))
    return F.when(d == "", "").when(_escapes(d), external).otherwise(d)


def portable_path(path, vault, source) -> Column:
    """Vault-relative path, else ``source/`` + source-relative, else the name."""
    return F.coalesce(
        relative_to(path, vault),
        F.concat(C("source/"), relative_to(path, source)),
        basename(path),
    )


def link_target(path, vault=None, known_tops: list[str] | None = None) -> Column:
    """Link name of a page: vault-relative without extension, else from the
    first known top folder, else the last three path parts."""
    p = without_suffix(path)
    parts = F.filter(F.split(p, "/"), lambda s: s != "")
    tail = F.when(
        F.size(parts) >= 3, F.array_join(F.slice(parts, -3, 3), "/")
    ).otherwise(basename(p))
    out = tail
    if known_tops:
        tops = F.array(*[C(t) for t in known_tops])
        hits = F.filter(parts, lambda s: F.array_contains(tops, s))
        first = F.try_element_at(hits, C(1))
        at = F.array_position(parts, first).cast("int")
        out = F.when(
            F.size(hits) > 0, F.array_join(F.slice(parts, at, F.size(parts)), "/")
        ).otherwise(tail)
    if vault is None:
        return out
    return F.coalesce(relative_to(p, vault), out)


def without_suffix(path) -> Column:
    """Path with the extension of its last part removed."""
    return F.regexp_replace(_col(path), r"(?<=[^./])\.[^./]+$", "")


def normalize_link(target) -> Column:
    return F.replace(strip(target), C(" "), C("_"))


def page_key(path, strip_date: bool = False) -> Column:
    """Grouping key of a page: its lower-case stem.

    ``strip_date=True`` also drops a leading ``YYYY-MM-DD-``; off by default
    because existing vaults were grouped without it.
    """
    s = stem(path)
    if strip_date:
        s = F.regexp_replace(s, r"^\d{4}-\d{2}-\d{2}-", "")
    return F.lower(s)


def walk_order(rel_path) -> Column:
    """Sort key that equals a sorted depth-first walk of the folders."""
    return F.replace(_col(rel_path), C("/"), C("\x01"))


def excluded(rel_path, dirs: list[str], hidden: bool = True) -> Column:
    """True when a folder of the path is excluded (or hidden)."""
    folders = F.filter(F.split(dirname(rel_path), "/"), lambda s: s != "")
    names = F.array(*[C(d) for d in dirs])
    bad = lambda s: F.array_contains(names, s) | (C(hidden) & F.startswith(s, C(".")))
    return F.exists(folders, bad)
