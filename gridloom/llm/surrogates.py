"""PII: keyed, type-consistent surrogates for detected entities.

The same entity gets the same surrogate in every document (coreference), different
entities get different ones (distinctness), and a surrogate keeps its entity's
type, format, script and gender.  Formatted values run through a keyed
permutation of all values of their format; names are drawn by a keyed hash.  All are
checked for collisions over the whole corpus: surrogates that collide, or that are
someone's real value, are drawn again under another key, and in a wider format if
theirs has no room.  A name is introduced by a title; from there on, every mention of
its parts in that document is the same entity, titled or not.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import accumulate
from operator import mul

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import textops as tx
from .common import BROADCAST_ROWS, stored

#: Attempts in an entity's own format; each later one makes it longer by a character,
#: where a format can be small (addresses, names).
SAME_FORMAT = 8
#: Attempts after which a corpus counts as impossible: its values fill a whole format.
MOST_ATTEMPTS = 60

# What the detectors look for.
_TITLES = {
    "m": "Mr Mister Herr Herrn Monsieur Señor Sr Don Hr г-н".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Fr г-жа".split(),
    "n": "Dr Prof Professor".split(),
}
_NAME = r"[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*"
_PATTERNS = {
    "email": r"[^\W_][\w.+%-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W_](?:[\w-]*[^\W_])?",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z_-]{16,}|xox[abpr]-[0-9A-Za-z-]{10,}|eyJ[\w-]+\.[\w-]+\.[\w-]+)(?![0-9A-Za-z])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ipv6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,5}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{5,8}|0\d(?:[ .-]?\d{2}){4}|[67]\d{2} \d{3} \d{3}(?! ?\d))(?!\w)",
}
_EMAIL = re.compile(_PATTERNS["email"])
_NUMBERED = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _PATTERNS.items() if k != "email"))
#: From a digit to the end of its word and of the words behind it that have digits too, or
#: are a few capitals, as in a grouped number.
_REST = re.compile(r"\S*(?:\s(?:\S*\d\S*|[A-Z]{1,4}(?!\w)))*")
_DIGIT = re.compile(r"\d")
#: Values that only the words before them give away.
_ANNOUNCED = re.compile(
    r"(?i:\b(?:pass(?:word|wort|wd|code)|pwd|contraseña|mot de passe|пароль)\b)[\"']?\s*[:=]\s*[\"']?(?P<secret>[^\s\"'<>]{4,}[^\s\"'<>.,;:)!?])"
    r"|(?i:\b(?:api[_ -]?key|secret|token)\b)[\"']?\s*[:=]\s*[\"']?(?P<key>(?=[^\s\"'<>]*\d)[\w+/=-]{8,})"
    r"|(?i:\b(?:passport|reisepass|passeport|pasaporte)\b)(?i:[ -]?(?:no|nr|number|nummer|n°|número)\b)?[.:#]* ?(?P<id>(?=[A-Z]*\d)[A-Z0-9]{6,9})\b"
    r"|(?i:\b(?:born(?: on)?|date of birth|dob|geboren am|née? le|nacid[oa] el)\b)[: ]+(?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\w)"
)
_ANNOUNCES = ("passw", "passc", "passp", "reisepass", "pasaporte", "pwd", "contrase", "mot de passe", "пароль", "api", "secret", "token", "born", "birth", "dob", "né le", "née le", "nacid", "geboren")
_CALLED = re.compile(r"(?<!\w)(?P<title>" + "|".join(t for ts in _TITLES.values() for t in ts) + rf")\.?[ ](?P<name>(?=[^\W\d_])(?-i:{_NAME})(?:[ ]{_NAME}){{0,2}})")
#: What entities without a digit begin with or contain.
_UNNUMBERED = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyJ", "::")
_WORD = re.compile(_NAME)
_PIECE = re.compile(r"[^\W\d_]+")
_GENDER = {t: g for g, ts in _TITLES.items() for t in ts}

#: Consonants and vowels that names are made of, and how they end by gender (f, m).
_SCRIPTS = {
    "LATIN": ("bcdfghklmnprstvw", "aeiou", "an"),
    "CYRILLIC": ("бвгдзклмнпрстфх", "аеиоу", "ан"),
    "GREEK": ("βγδζκλμνπρστφχ", "αεηιουω", "ας"),
}


@lru_cache(10_000)
def _alphabet(c: str) -> str:
    """The letters or digits of the same kind in the same 128 code points, so of the same script."""
    page, kind = ord(c) & ~127, unicodedata.category(c)
    return "".join(x for x in map(chr, range(page, page + 128)) if x.isalnum() and unicodedata.category(x) == kind)


def _lowered(text: str) -> str:
    """Lower case, character by character, so that the length stays."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _draw(key: bytes, *parts: object) -> int:
    text = "\x1f".join(map(str, parts)).encode()
    return int.from_bytes(hashlib.blake2b(text, key=key, digest_size=32).digest(), "big")


def _permute(key: bytes, kind: str, digits: list[int], radix: list[int], attempt: int) -> list[int]:
    """A keyed permutation of all digit strings of these radices; each attempt has its own.

    Both halves of the string are numbers; each round adds a keyed hash of one to
    the other, modulo its range, which can be undone, so no two strings meet.
    """
    cut = len(digits) // 2
    sizes = [*accumulate(radix[:cut], mul, initial=1)][-1], [*accumulate(radix[cut:], mul, initial=1)][-1]
    halves = [0, 0]
    for i, (d, r) in enumerate(zip(digits, radix, strict=True)):
        halves[i >= cut] = halves[i >= cut] * r + d
    shape = ",".join(map(str, radix))
    for turn in range(8):
        side = turn % 2
        halves[side] = (halves[side] + _draw(key, kind, shape, attempt, turn, halves[1 - side])) % sizes[side]
    out = []
    for side, part in ((1, radix[cut:]), (0, radix[:cut])):
        for r in reversed(part):
            halves[side], d = divmod(halves[side], r)
            out.append(d)
    return out[::-1]


def _reformat(key: bytes, kind: str, text: str, attempt: int, fixed: range | tuple = ()) -> str:
    """``text`` with letters and digits replaced inside their alphabets; the rest stays."""
    at = [i for i, c in enumerate(text) if c.isalnum() and i not in fixed]
    alphabets = ["0123456789abcdef" if kind in ("hex", "ipv6") else _alphabet(text[i]) for i in at]
    taken = set(at)
    mask = "".join("\0" if i in taken else c for i, c in enumerate(text))
    new = _permute(key, f"{kind}\x1f{mask}\x1f{''.join(a[0] for a in alphabets)}", [a.index(text[i]) for i, a in zip(at, alphabets, strict=True)], [len(a) for a in alphabets], attempt)
    out = list(text)
    for i, a, d in zip(at, alphabets, new, strict=True):
        out[i] = a[d]
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def canonical(kind: str, text: str) -> str:
    """What makes two mentions the same entity: case and separators don't count."""
    if kind in ("card", "phone", "ssn"):
        return ("+" if text.startswith("+") else "") + re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    return _lowered(text) if kind in ("email", "ipv6", "name") else text


#: Dates of 150 years are numbers of two digits of this radix.
_DATE_RADIX, _FIRST_DATE = 234, datetime.date(1900, 1, 1)


def _date(key: bytes, value: str, attempt: int) -> str:
    """Another date in the same notation; what is no date of those years changes its digits."""
    numbers = [int(x) for x in re.findall(r"\d+", value)]
    iso = value[4:5] == "-"
    first_is_day = iso or numbers[1] <= 12
    y, m, d = numbers if iso else (numbers[2], *(numbers[1::-1] if first_is_day else numbers[:2]))
    try:
        number = (datetime.date(y, m, d) - _FIRST_DATE).days
    except ValueError:
        number = -1
    if not 0 <= number < _DATE_RADIX**2:
        return _reformat(key, "date", value, attempt)
    a, b = _permute(key, "date", [*divmod(number, _DATE_RADIX)], [_DATE_RADIX] * 2, attempt)
    new = _FIRST_DATE + datetime.timedelta(days=a * _DATE_RADIX + b)
    if iso:
        return new.isoformat()
    dot = re.search(r"\D", value)[0]
    day, month = (f"{new.day:02d}", f"{new.month:02d}")
    return dot.join([*((day, month) if first_is_day else (month, day)), f"{new.year}"])


def _name(key: bytes, value: str, attempt: int, gender: str) -> str:
    """A name of the same script, parts and gender."""
    script = next((s for s in _SCRIPTS if unicodedata.name(value[0], "").startswith(s)), None)
    if script is None:  # letters of the script itself
        more = max(0, attempt - SAME_FORMAT)
        return _reformat(key, "name", value, attempt) + "".join(_alphabet(value[-1])[_draw(key, "more", value, attempt, i) % len(_alphabet(value[-1]))] for i in range(more))
    consonants, vowels, ends = _SCRIPTS[script]
    n, pieces = _draw(key, "name", value, attempt), []
    for _ in _PIECE.findall(value):
        piece = ""
        for _ in range(3 + max(0, attempt - SAME_FORMAT)):
            n, c = divmod(n, len(consonants))
            n, v = divmod(n, len(vowels))
            piece += consonants[c] + vowels[v]
        pieces.append(piece[:-1] + ends[0] if gender == "f" else piece + ends[1] if gender == "m" else piece)
    parts = iter(pieces)
    return _PIECE.sub(lambda _: next(parts), value)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0, gender: str = "n") -> str:
    """The surrogate of a canonical value; a higher attempt gives another one."""
    if kind == "ipv4":
        octets = [int(x) for x in value.split(".")]
        return ".".join(map(str, _permute(key, kind, octets, [256] * 4, attempt)))
    if kind == "card":
        body = _reformat(key, kind, value[:-1], attempt)
        return body + str((_luhn(body) + int(value[-1]) - _luhn(value[:-1])) % 10)
    if kind == "phone" and value.startswith("+"):
        return _reformat(key, kind, value, attempt, range(2 if value[1] in "17" else 3))
    if kind == "iban":
        body = _reformat(key, kind, value[4:], attempt)
        number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+", value):
            return _reformat(key, "hex", value, attempt)
        if re.fullmatch("[0-9A-F]+", value):
            return _reformat(key, "hex", value.lower(), attempt).upper()
        fixed = re.match(r"AKIA|gh._|sk-|xox.-|eyJ", value)
        return _reformat(key, kind, value, attempt, range(fixed.end() if fixed else 0))
    if kind == "email":
        more = "".join(_alphabet("a")[_draw(key, "more", value, attempt, i) % 26] for i in range(max(0, attempt - SAME_FORMAT)))
        return more + _reformat(key, kind, value, attempt, range(value.rindex("."), len(value)))
    if kind == "date":
        return _date(key, value, attempt)
    if kind == "name":
        return _name(key, value, attempt, gender)
    return _reformat(key, kind, value, attempt)


def _cased(new: str, old: str) -> str:
    """``new`` in the case of a name's mention."""
    upper = lambda c: x if len(x := c.upper()) == 1 else c
    if old.isupper() and len(old) > 1:
        return "".join(map(upper, new))
    return upper(new[0]) + new[1:] if old[0].isupper() else new


def _poured(kind: str, new: str, old: str) -> str:
    """A canonical surrogate in the format of the mention it replaces."""
    if kind in ("card", "phone", "ssn", "iban"):
        parts = iter(new.replace("+", ""))
        return "".join(next(parts) if c.isalnum() else c for c in old)
    if kind == "email":
        more = len(new) - len(old)
        return new[:more] + "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for n, o in zip(new[more:], old, strict=True))
    if kind == "ipv6":
        return new.upper() if any(c.isupper() for c in old) else new
    if kind == "name":
        pieces = _PIECE.findall(old)
        which = iter(range(len(pieces)))
        return _PIECE.sub(lambda m: _cased(m[0], pieces[min(next(which), len(pieces) - 1)]), new)
    return new


def _called(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, gender, part) of the names that follow titles."""
    for m in _CALLED.finditer(text):
        parts = []
        for p in re.finditer(r"[^ ]+", m["name"]):
            if p[0][0].islower():
                break
            mine = re.sub(r"['’]s$", "", p[0])
            parts.append((m.start("name") + p.start(), mine))
            if mine != p[0]:
                break
        for i, (at, part) in enumerate(parts):
            yield at, at + len(part), _GENDER[m["title"]] if i < len(parts) - 1 or not i else "", part


def _mentions(text: str, introduced: set[str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, part) of every mention of introduced names, by whole words; in scripts
    without capitals, and so perhaps without spaces, anywhere in the text."""
    for m in _WORD.finditer(text):
        if canonical("name", m[0]) in introduced and not m[0][0].islower():
            yield m.start(), m.end(), m[0]
            continue
        for p in _PIECE.finditer(m[0]):
            if canonical("name", p[0]) in introduced and not p[0][0].islower():
                yield m.start() + p.start(), m.start() + p.end(), p[0]
    for value in introduced:
        if len(value) > 1 and value[0].upper() == value[0]:
            for m in re.finditer(re.escape(value), text):
                yield m.start(), m.end(), value


def _emails(text: str) -> Iterator[re.Match]:
    """Addresses, looked for around each @."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isalnum() or text[start - 1] in "._+%-"):
            start -= 1
        while start < at and not text[start].isalnum():
            start += 1
        if m := _EMAIL.match(text, start):
            yield m
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _numbered_parts(text: str) -> Iterator[tuple[int, int]]:
    """The parts of a text, from space to space, in which a number can stand; the whole
    text if it may hold a key without digits."""
    if any(x in text for x in _UNNUMBERED):
        yield 0, len(text)
        return
    m = _DIGIT.search(text)
    while m:
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        end = _REST.match(text, m.start()).end()
        yield start, end
        m = _DIGIT.search(text, end)


def detect(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, mention, gender) of the entities of a text, in order, without
    overlaps.  The gender is m, f or n (neutral) where a title tells it, else empty."""
    found = [(m.start(), m.end(), "email", m[0], "") for m in _emails(text)]
    for start, end in _numbered_parts(text):
        found += [(m.start(), m.end(), m.lastgroup, m[0], "") for m in _NUMBERED.finditer(text, start, end)]
    lowered = text.lower()
    if any(x in lowered for x in _ANNOUNCES):
        for m in _ANNOUNCED.finditer(text):
            kind = m.lastgroup
            found.append((m.start(kind), m.end(kind), "secret" if kind == "key" else kind, m[kind], ""))
    if any(t in text for t in _GENDER):
        called = list(_called(text))
        found += [(start, end, "name", part, gender) for start, end, gender, part in called]
        if called:
            found += [(start, end, "name", part, "") for start, end, part in _mentions(text, {canonical("name", p) for *_, p in called})]
    at = 0
    for start, end, kind, mention, gender in sorted(found, key=lambda x: (x[0], -x[1], x[2], not x[4])):
        if start >= at:
            at = end
            yield start, end, kind, mention, gender


@lru_cache(100_000)
def _cached(key: bytes, kind: str, value: str, attempt: int, gender: str) -> str:
    return surrogate(key, kind, value, attempt, gender)


def replaced(key: bytes, text: str, known: Mapping[tuple[str, str], tuple[int, str]]) -> tuple[str, int]:
    """``text`` with surrogates, and how many mentions were replaced.  ``known`` has the
    attempt and gender of the entities for which they are not 0 and neutral."""
    out, at, n = [], 0, 0
    for start, end, kind, mention, _ in detect(text):
        value = canonical(kind, mention)
        new = _cached(key, kind, value, *known.get((kind, value), (0, "n")))
        out += [text[at:start], _poured(kind, new, mention)]
        at, n = end, n + 1
    return "".join([*out, text[at:]]) if n else text, n


def entities(docs: DataFrame) -> DataFrame:
    """(kind, value, gender) of every entity mentioned in ``docs`` (text, and any keys)."""
    keys = [f for f in docs.schema if f.name != "text"]

    def run(batches):
        for part in tx.slices(batches):
            rows, found = [], []
            for row, text in enumerate(part.column("text").to_pylist()):
                mine = dict.fromkeys((k, canonical(k, m), g) for _, _, k, m, g in detect(text or ""))
                rows += [row] * len(mine)
                found += mine
            take = pa.array(rows, pa.int64())
            columns = [pa.array([x[i] for x in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*[part.column(f.name).take(take) for f in keys], *columns], names=[*[f.name for f in keys], "kind", "value", "gender"])

    return docs.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keys], "kind string, value string, gender string"]))


def _drawn(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, gender, attempt, surrogate) of all entities: surrogates are distinct
    and none is an entity's real value."""

    @F.pandas_udf(StringType())
    def new(kinds: pd.Series, values: pd.Series, attempts: pd.Series, genders: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, *x) for x in zip(kinds, values, attempts, genders, strict=True)], dtype=object)

    draw = new("kind", "value", "attempt", "gender")
    says = lambda g: F.max(F.col("gender") == g)
    gender = F.when(says("m") & ~says("f"), F.lit("m")).when(says("f") & ~says("m"), F.lit("f")).otherwise(F.lit("n"))
    known = stored(found.groupBy("kind", "value").agg(gender.alias("gender")), "entities")
    real = known.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
    drawn = stored(known.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw), "surrogates")
    for _ in range(MOST_ATTEMPTS):
        shared = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"), F.count(F.lit(1)).alias("n"))
        bad = shared.join(real, ["kind", "surrogate"], "left").where("n > 1 OR real")
        clash = drawn.join(bad, ["kind", "surrogate"]).where("real OR value <> owner").select("kind", "value", F.lit(True).alias("again"))
        if not clash.limit(1).count():
            return drawn
        after = drawn.join(clash, ["kind", "value"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
        after = after.withColumn("attempt", F.col("attempt") + F.col("again").cast("int"))
        drawn = stored(after.withColumn("surrogate", F.when(F.col("again"), draw).otherwise(F.col("surrogate"))).drop("again"), "surrogates")
    raise RuntimeError(f"no distinct surrogates after {MOST_ATTEMPTS} attempts: the corpus has nearly all values of some format")


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, gender) of the entities that need to be known: their first
    surrogate won't do, as it is another entity's too or some entity's real value, or
    titles tell their gender."""
    return _drawn(found, key).where("attempt > 0 OR gender <> 'n'").select("kind", "value", "attempt", "gender")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in text, and n_entities (mentions replaced).

    The map from entities to surrogates depends on ``key`` and on the set of all
    entities of ``docs``.  Detected are e-mail, IPv4 and IPv6 addresses, IBANs, card,
    phone and social security numbers, keys, announced passwords, passport numbers and
    dates of birth, and names that a title introduces; other names and street
    addresses are not.  A null text stays null and has no entities; a text without
    entities stays as it is, an empty or very long one too.  Repeated rows get equal
    texts; an empty table stays empty; a column named n_entities is replaced, all
    others pass through.
    """
    docs = docs.drop("n_entities")
    secret = hashlib.sha256(key.encode()).digest()
    version = F.xxhash64("text")
    mentions = stored(entities(docs.select("text", version.alias("version"))), "mentions")
    special = stored(assign(mentions, secret), "exceptions")
    few = special.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    fixed = {(r.kind, r.value): (r.attempt, r.gender) for r in special.collect()} if few else {}
    kind = "array<struct<kind:string,value:string,attempt:int,gender:string>>"
    own_name, at = "__special", "__version"
    if few:
        joined = docs.withColumn(own_name, F.lit(None).cast(kind))
    else:
        own = mentions.select(F.col("version").alias(at), "kind", "value").join(special, ["kind", "value"]).groupBy(at).agg(F.collect_set(F.struct("kind", "value", "attempt", "gender")).alias(own_name))
        joined = docs.withColumn(at, version).join(own, at, "left").select(*docs.columns, own_name)
    shared = docs.sparkSession.sparkContext.broadcast(fixed)
    schema = docs.withColumn("n_entities", F.lit(0).cast("long")).schema

    def run(batches):
        for part in tx.slices(batches):
            texts, counts = [], []
            for text, own in zip(part.column("text").to_pylist(), part.column(own_name).to_pylist(), strict=True):
                known = {(x["kind"], x["value"]): (x["attempt"], x["gender"]) for x in own} if own else shared.value
                new, n = (None, 0) if text is None else replaced(secret, text, known)
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in schema.names[:-1]], pa.array(counts, pa.int64())], names=schema.names
            )

    return joined.mapInArrow(run, schema)
