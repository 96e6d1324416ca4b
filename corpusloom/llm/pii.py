"""Surrogate generation: private entities get keyed stand-ins of the same kind.

Entities are found in whole texts, reduced to a key that is the same for all
ways to write one (digits of a number, lower case of an address or name), and
every distinct key gets one surrogate: keyed by HMAC, of the same type, length,
script, gender and check digit. Two keys never share a surrogate and no
surrogate is itself an entity of the corpus: rounds of checks give later keys
another try. A key reads the same in all documents (coreference), written the
way each occurrence is written.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.joins import attach
from ..session import settle
from . import words as W

# Forms of address and common first names, by gender.
TITLES = {
    "m": "Mr Herr Monsieur Señor Signor Господин".split(),
    "f": "Mrs Ms Miss Frau Madame Mademoiselle Señora Señorita Signora Госпожа".split(),
}
FIRST_NAMES = {
    "m": """James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Steven Andrew
        Kenneth George Edward Brian Ronald Kevin Jürgen Klaus Wolfgang Stefan Andreas Jean Pierre Jacques François
        Laurent Nicolas Carlos Miguel Javier Alejandro Fernando Sergio Иван Сергей Алексей Дмитрий Владимир""".split(),
    "f": """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley
        Emily Michelle Amanda Melissa Deborah Stephanie Sabine Petra Monika Claudia Katrin Isabelle Nathalie Sylvie
        Céline Élodie Carmen Isabel Lucía Cristina Beatriz Мария Елена Ольга Наталья Татьяна""".split(),
}
# Syllables of made-up names, by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве во".split(),
}
ENDINGS = {
    ("latin", "m"): "n r s l d k".split(), ("latin", "f"): "a na la ra ia".split(), ("latin", ""): "n r s ld nd rt ck".split(),
    ("cyrillic", "m"): "н р с л д к".split(), ("cyrillic", "f"): "а на ла ра ия".split(), ("cyrillic", ""): "н р с лд нд рт".split(),
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_UPPER = r"[A-ZÀ-ÖØ-ÞА-ЯЁ]"
_NAME = _UPPER + r"[a-zß-öø-ÿа-яёA-ZÀ-ÖØ-ÞА-ЯЁ]+"
_FIRST = "|".join(sorted({n for names in FIRST_NAMES.values() for n in names}, key=len, reverse=True))
_TITLE = "|".join(sorted({n for names in TITLES.values() for n in names}, key=len, reverse=True))
PATTERNS = re.compile("|".join([
    r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)",
    r"(?P<secret>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bsk-[A-Za-z0-9_-]{20,}\b|\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}"
    r"|(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])"
    r"|(?<=password=)[^\s\"']{4,}|(?<=passwd=)[^\s\"']{4,}|(?<=secret=)[^\s\"']{4,}|(?<=api_key=)[^\s\"']{4,}|(?<=token=)[^\s\"']{8,})",
    r"(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
    rf"(?P<ip>(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9]))",
    r"(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))",
    r"(?P<phone>(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]))",
    r"(?P<number>(?<![0-9A-Za-z.,])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z.,])[0-9]{9,19}(?![0-9A-Za-z]))",
    rf"(?P<name>\b(?:(?:{_TITLE})\.? (?:(?:{_FIRST}) )?{_NAME}|(?:{_FIRST}) {_NAME}))",
]))
#: A line without these, in a text without the marks and names below, holds no entity.
_DIGIT = re.compile("[0-9@]").search
_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "eyJ", "password=", "passwd=", "secret=", "api_key=", "token=")
_NAMED = frozenset(n for table in (TITLES, FIRST_NAMES) for names in table.values() for n in names)
_HEX = re.compile("[a-f]{32}").search


class _Blanks(dict):
    """For str.translate: letters and digits of any script stay, all else is a blank.

    A name in PATTERNS has a word border on both sides, so it is a token of the blanked text.
    """

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = c if c.isalnum() else " "
        return self[code]


_SPACES = _Blanks()
_GENDER = {n: g for table in (TITLES, FIRST_NAMES) for g, names in table.items() for n in names}
SPAN = "array<struct<start:int,stop:int,kind:string,entity:string>>"


#: Made-up marks for an entity without letters and digits; all may stand in a local part.
MARKS = "._%+-"


@cache
def _alike(c: str) -> str:
    """Other letters or digits of the same category among the 128 code points around a non-ASCII one."""
    start, category = ord(c) & ~127, unicodedata.category(c)
    near = "".join(chr(i) for i in range(start, start + 128) if i > 127 and chr(i) != c and unicodedata.category(chr(i)) == category)
    return near or ("0123456789" if category[0] == "N" else "abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def script(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, entity) of each entity, from left to right."""
    whole = any(m in text for m in _MARKS) or _HEX(text) is not None
    if not whole and not _NAMED.isdisjoint(text.translate(_SPACES).split()):
        whole = True
    out, at = [], 0
    for line in text.split("\n"):  # no entity goes over a line end
        if whole or _DIGIT(line):
            out += [(a + at, b + at, kind, entity) for a, b, kind, entity in _find_line(line)]
        at += len(line) + 1
    return _named_again(text, out)


def _find_line(text: str) -> list[tuple[int, int, str, str]]:
    out = []
    for m in PATTERNS.finditer(text):
        kind, value, at = m.lastgroup, m[0], m.start()
        if kind == "email":
            local, _, domain = value.rpartition("@")
            out.append((at, at + len(local), "local", value.lower()))
            out.append((at + len(local) + 1, m.end(), "domain", domain.lower()))
        elif kind == "name":
            words = [(x.start() + at, x[0]) for x in re.finditer(r"[^\s.]+", value)]
            gender = next((_GENDER[w] for _, w in words if w in _GENDER), "")
            for i, (start, w) in enumerate(words):
                if w in FIRST_NAMES["m"] or w in FIRST_NAMES["f"]:
                    out.append((start, start + len(w), "first:" + _GENDER.get(w, gender), w.casefold()))
                elif i == len(words) - 1:
                    out.append((start, start + len(w), "last", w.casefold()))
        elif kind in ("phone", "ssn", "number"):
            digits = re.sub(r"\D", "", value)
            if kind == "number":
                kind = "card" if 13 <= len(digits) <= 19 and luhn(digits) else "number"
            if kind == "phone" and value[0] == "+":
                kind = f"phone+{len(re.match(r'[+]([0-9]+)', value)[1]) if not value[1:].isdigit() else 1}"
            out.append((at, m.end(), kind, digits))
        elif kind == "iban":
            out.append((at, m.end(), kind, value.replace(" ", "")))
        else:
            out.append((at, m.end(), kind, value))
    return out


def _named_again(text: str, spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Adds the places where a person found above is named by one name alone."""
    names = {entity: kind for _, _, kind, entity in spans if (kind == "last" or kind.startswith("first:")) and len(entity) > 2}
    if not names:
        return spans
    taken = {i for a, b, _, _ in spans for i in range(a, b)}
    for m in re.finditer(rf"\b{_NAME}\b", text):
        if m[0].casefold() in names and m.start() not in taken:
            spans.append((m.start(), m.end(), names[m[0].casefold()], m[0].casefold()))
    return sorted(spans)


class Stream:
    """Keyed numbers for one entity and try."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.seed, self.n, self.pool = [key, f"{kind}\0{entity}\0{attempt}".encode()], 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.seed[0], self.seed[1] + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def like(self, text: str) -> str:
        """Every letter and digit by one of its kind; the rest stays."""
        out = []
        for c in text:
            if "0" <= c <= "9":
                out.append(str(self.below(10)))
            elif "a" <= c <= "z":
                out.append(chr(97 + self.below(26)))
            elif "A" <= c <= "Z":
                out.append(chr(65 + self.below(26)))
            elif c.isalnum():
                out.append(_alike(c)[self.below(len(_alike(c)))])
            else:
                out.append(c)
        return "".join(out)

    def some(self, alphabet: str, n: int) -> str:
        return "".join(alphabet[self.below(len(alphabet))] for _ in range(n))

    def free(self, text: str) -> str:
        """like(); marks alone are replaced by marks."""
        return self.like(text) if any(map(str.isalnum, text)) else self.some(MARKS, len(text))


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """A stand-in of the entity's type and form. After 8 tries it grows, so that
    there is always a free one (an ip has any four octets then: 2^32)."""
    s = Stream(key, kind, entity, attempt)
    longer = max(0, attempt - 7)
    if kind == "local":
        return s.free(entity.rpartition("@")[0]) + "".join(chr(97 + s.below(26)) for _ in range(longer))
    if kind == "domain":
        # names under the reserved example domains stay there
        kept = re.search(r"\.example\.[a-z]+$|\.[^.]+$", entity)[0]
        return s.like(entity[:-len(kept)]) + "".join(chr(97 + s.below(26)) for _ in range(longer)) + kept
    if kind == "ip":
        small = {1: (0, 10), 2: (10, 100), 3: (100, 256)}
        octets = []
        for part in entity.split("."):
            lo, hi = small[len(part)] if not longer else (0, 256)
            octets.append(str(lo + s.below(hi - lo)))
        return ".".join(octets)
    if kind == "card":
        body = entity[0] + s.some("0123456789", len(entity) - 2 + longer)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind.startswith("phone+"):
        code = int(kind[6:])
        return entity[:code] + s.like(entity[code:]) + "".join(str(s.below(10)) for _ in range(longer))
    if kind == "number" and entity[0] != "0":
        return str(1 + s.below(9)) + s.like(entity[1:]) + "".join(str(s.below(10)) for _ in range(longer))
    if kind in ("phone", "ssn", "number"):
        return s.like(entity) + "".join(str(s.below(10)) for _ in range(longer))
    if kind == "iban":
        body = s.like(entity[4:]) + s.some("0123456789", longer)
        value = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return f"{entity[:2]}{98 - value % 97:02d}{body}"
    if kind.startswith("first:") or kind == "last":
        alphabet, gender = script(entity), kind[6:]
        parts = SYLLABLES[alphabet]
        size = 2 + len(entity) // 6 + longer
        return "".join(parts[s.below(len(parts))] for _ in range(size)) + (
            lambda e: e[s.below(len(e))])(ENDINGS[alphabet, gender if kind != "last" else ""])
    if re.fullmatch(r"[0-9a-f]+", entity):
        return s.some("0123456789abcdef", len(entity) + longer)
    for mark in ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "eyJ"):
        if entity.startswith(mark) and any(map(str.isalnum, entity[len(mark):])):
            return mark + s.like(entity[len(mark):]) + s.some("abcdefghijklmnopqrstuvwxyz", longer)
    return s.free(entity) + s.some("abcdefghijklmnopqrstuvwxyz", longer)


def written(occurrence: str, stand_in: str, kind: str) -> str:
    """The surrogate in the way the occurrence is written."""
    if kind.startswith("phone") or kind in ("ssn", "card", "number", "iban"):
        marks = iter(stand_in)
        out = [next(marks, "") if c.isalnum() else c for c in occurrence]
        return "".join(out) + "".join(marks)
    if kind in ("local", "domain"):
        if len(occurrence) == len(stand_in):
            return "".join(b.upper() if a.isupper() else b for a, b in zip(occurrence, stand_in, strict=True))
        return stand_in.upper() if occurrence.isupper() else stand_in
    if kind.startswith("first:") or kind == "last":
        if occurrence.isupper():
            return stand_in.upper()
        return stand_in.capitalize() if occurrence[:1].isupper() else stand_in
    return stand_in


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("entity", pa.string())]))
    for part in W.blocks(batches, "text", 1 << 20):
        found, rows = [], []
        for i, text in enumerate(part.column("text").to_pylist()):
            spans = find(text)
            if spans:
                rows.append(i)
                found.append([dict(zip(("start", "stop", "kind", "entity"), s, strict=True)) for s in spans])
        if rows:
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([part.column("h").take(at), part.column("size").take(at), pa.array(found, kinds)],
                                             names=["h", "size", "spans"])


def _tries(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "attempt")), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("entity"), batch.column("attempt"), pa.array([surrogate(key, *r) for r in rows], pa.string())],
                names=["kind", "entity", "attempt", "stand_in"])

    return run


def assign(entities: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """(kind, entity, stand_in): a distinct surrogate for every distinct entity.

    In each round the keys without one try the next; a try counts if no entity
    and no earlier surrogate of the kind reads so, and among equal tries the
    smallest entity has it.
    """
    real = settle(entities.select("kind", "entity").distinct())
    taken = real.select("kind", F.col("entity").alias("stand_in"))
    done: DataFrame | None = None
    left = real
    for attempt in range(rounds):
        tried = left.withColumn("attempt", F.lit(attempt)).mapInArrow(
            _tries(key.encode()), "kind string, entity string, attempt int, stand_in string")
        first = Window.partitionBy("kind", "stand_in").orderBy("entity")
        # the local part of an address is compared as such; its entity is the whole address
        free = tried.join(taken, ["kind", "stand_in"], "left_anti")
        won = free.withColumn("n", F.row_number().over(first)).filter("n = 1").select("kind", "entity", "stand_in")
        won = settle(won)
        done = won if done is None else done.unionByName(won)
        left = settle(left.join(won, ["kind", "entity"], "left_anti"))
        if left.isEmpty():
            return done
        taken = taken.unionByName(won.select("kind", "stand_in"))
    raise RuntimeError("too many entities of one form for distinct surrogates")


@F.pandas_udf(StringType())
def _rewrite(text: pd.Series, edits: pd.Series) -> pd.Series:
    def one(t, spans):
        if t is None or spans is None or not len(spans):
            return t
        out, at = [], 0
        for e in sorted(spans, key=lambda e: e["start"]):
            out += [t[at:e["start"]], written(t[e["start"]:e["stop"]], e["stand_in"], e["kind"])]
            at = e["stop"]
        return "".join([*out, t[at:]])

    out = pd.Series([one(t, s) for t, s in zip(text, edits, strict=True)], dtype=object)
    W.release()
    return out


def surrogates(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every private entity of ``text_col`` replaced.

    Same columns and rows; ``count_col`` adds the number of entities replaced.
    Null and empty texts stay; repeated rows get the same text; other columns
    are untouched, whatever their names. The result depends on ``key`` and on
    the set of entities only.
    """
    h, size = F.xxhash64(F.col(text_col), F.lit("pii")), F.octet_length(F.col(text_col))
    texts = docs.filter(F.col(text_col).isNotNull()).select(h.alias("h"), size.alias("size"), F.col(text_col).alias("text"))
    spans = settle(texts.mapInArrow(_detect, f"h long, size int, spans {SPAN}").groupBy("h", "size").agg(F.any_value("spans").alias("spans")))
    each = spans.select("h", "size", F.explode("spans").alias("s")).select("h", "size", "s.*")
    chosen = assign(each, key)
    edits = settle(
        each.join(chosen, ["kind", "entity"]).groupBy("h", "size")
        .agg(F.collect_list(F.struct("start", "stop", "kind", "stand_in")).alias("edits"))
    )
    # only texts with edits go to Python, and none is shuffled while the edits are few
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text_col).alias("own"), h.alias("h"), size.alias("size"))
    found = attach(keyed, edits, ["h", "size"], "inner").select(
        "row", _rewrite("own", "edits").alias("text"), F.size("edits").cast("bigint").alias("n"))
    plain = keyed.withColumn("size", F.coalesce("size", F.lit(-1)))
    rest = attach(plain, edits.select("h", "size"), ["h", "size"], "left_anti").select(
        "row", F.lit(None).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n"))
    both = found.unionByName(rest)
    out = [F.coalesce("text", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return both.select(*out, *([F.col("n").alias(count_col)] if count_col else []))
