"""Personal data replaced by keyed surrogates of the same kind, format, script and gender.

E-mail addresses, phone numbers, IPv4 addresses, card numbers, secrets behind a name such as `token =`
and long hexadecimal strings are permuted within their format: a string's characters are digits of a
mixed-radix number, each of its own alphabet (digits, lower or upper case of a script), and a keyed
permutation of these numbers without fixed points gives the surrogate. So different entities of one format
can't collide, and equal ones, also in other case or punctuation, stay equal. Card numbers keep their
first digit and stay valid or invalid by check digit; phone numbers keep their country code.

Names behind a form of address are replaced word by word by invented ones of the same script and
gender. These are drawn by a keyed hash, so two names may draw the same one: all distinct entities of the
corpus are checked, and all but one of those that collide draw again until none do.

Rules: a null text stays null and has no entities, an empty one stays empty; every row is treated by
itself, repeated rows alike; further columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pin, small, written
from .words import slices

KEY = b"rotate-per-corpus"


def _span(first: str, last: str, without: str = "") -> str:
    return "".join(chr(c) for c in range(ord(first), ord(last) + 1) if chr(c) not in without)


# One alphabet per case and script; a character keeps its alphabet.
ALPHABETS = [
    "0123456789", _span("a", "z"), _span("A", "Z"), _span("ß", "ÿ", "÷"), _span("À", "Þ", "×"), _span("α", "ω", "ς"),
    _span("Α", "Ω", "΢"), _span("а", "я"), _span("А", "Я"), _span("א", "ת"), _span("ぁ", "ん"), _span("ァ", "ン"), _span("一", "鿿"),
    _span("가", "힣"),
]
_ALPHABET_OF = {c: a for a in ALPHABETS for c in a}
HEX, HEX_UPPER, HIGH, LOW = "0123456789abcdef", "0123456789ABCDEF", "23456789", "01"

# Forms of address by gender; what follows them is a name.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "г-н", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
_TITLE = "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True))

# Syllables and endings of invented names, by script.
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve".split(),
              {"m": ["n", "r", "s", "k"], "f": ["a", "ia", "elle", "ine"], "n": ["", "m", "l", "th"]}),
    "cyrillic": ("ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се та те ва ве".split(),
                 {"m": ["в", "н", "р", "к"], "f": ["а", "ия", "ина", "ева"], "n": ["", "м", "л", "ш"]}),
    "greek": ("βα βε δα δε κα κε λα λε μα με να νε πα πε ρα ρε σα σε τα τε".split(),
              {"m": ["ς", "ος", "ης", "ας"], "f": ["α", "η", "ια", "ω"], "n": ["", "ν", "ρ", "ι"]}),
}

_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.\w{2,}")
_SECRET = re.compile(r"(?<![^\W_])(?:token|api[_-]?key|secret|password|passwd|TOKEN|API[_-]?KEY|SECRET|PASSWORD)\W{1,4}([A-Za-z0-9_/+-]{8,})")
_HEX = re.compile(r"(?<!\w)(?:[0-9a-f]{24,}|[0-9A-F]{24,})(?!\w)")
_PHONE = re.compile(r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?!\w)|(?<![\w.])\+[0-9][0-9 .-]{6,14}[0-9](?!\w)")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])")
_CARD = re.compile(r"(?<![\w.])[0-9](?:[ -]?[0-9]){12,18}(?!\w)")
_NAME = re.compile(rf"(?<!\w)({_TITLE})\.? ((?:[^\W\d_a-zа-яα-ω][^\W\d_]+)(?: [^\W\d_a-zа-яα-ω][^\W\d_]+){{0,2}})")


def find(text: str) -> list[tuple[int, int, str]]:
    """Entities as (start, end, kind); of those that overlap, the first found in this order."""
    found = []
    if "@" in text:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    found += [(*m.span(1), "secret") for m in _SECRET.finditer(text)]
    found += [(*m.span(), "secret") for m in _HEX.finditer(text) if any(c.isdigit() for c in m[0])]
    found += [(*m.span(), "phone") for m in _PHONE.finditer(text)]
    found += [(*m.span(), "ip") for m in _IP.finditer(text)]
    found += [(*m.span(), "card") for m in _CARD.finditer(text)]
    for m in _NAME.finditer(text):
        kind = f"name-{_GENDER[m[1]]}"
        at = m.start(2)
        for word in m[2].split(" "):
            found.append((at, at + len(word), kind))
            at += len(word) + 1
    kept, taken = [], []
    for start, end, kind in found:
        if all(end <= a or start >= b for a, b in taken):
            taken.append((start, end))
            kept.append((start, end, kind))
    return sorted(kept)


def canonical(kind: str, text: str) -> str:
    """What is equal for all forms of an entity."""
    if kind in ("phone", "card"):
        return ("+" if text.startswith("+") else "") + "".join(c for c in text if c.isdigit())
    low = text.lower()
    return text if kind == "secret" or len(low) != len(text) else low


def _round(key: bytes, i: int, x: int, size: int) -> int:
    raw = hashlib.blake2b(b"%d,%d" % (i, x), key=key, digest_size=16 + size.bit_length() // 8).digest()
    return int.from_bytes(raw, "big") % size


def _permute(x: int, n: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..n-1: a Feistel network on two digits, walked until it is inside."""
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for i in reversed(range(8)) if back else range(8):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * _round(key, i, left, b)) % b
            else:
                left = (left + sign * _round(key, i, right, a)) % a
        x = left * b + right
        if x < n:
            return x


def _moved(x: int, n: int, key: bytes) -> int:
    """A keyed permutation without fixed points."""
    if n < 2:
        return x
    return _permute((_permute(x, n, key) + 1 + _round(key, 99, 0, n - 1)) % n, n, key, back=True)


def _shaped(text: str, alphabets: list[str | None], key: bytes) -> str:
    """Characters with an alphabet permuted together, others as they are."""
    places = [(i, a) for i, a in enumerate(alphabets) if a]
    x = n = 0
    n = 1
    for i, a in places:
        x, n = x * len(a) + a.index(text[i]), n * len(a)
    template = "".join("." if not a else a[0] for a in alphabets)
    fixed = "".join(c for c, a in zip(text, alphabets, strict=True) if not a)
    x = _moved(x, n, hashlib.blake2b(f"{template}|{fixed}".encode(), key=key).digest())
    out = list(text)
    for i, a in reversed(places):
        x, at = divmod(x, len(a))
        out[i] = a[at]
    return "".join(out)


def _by_class(text: str) -> list[str | None]:
    return [_ALPHABET_OF.get(c) for c in text]


def _check_digit(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _card(digits: str, key: bytes) -> str:
    """First digit kept; valid stays valid, and otherwise the check digit's error is permuted too."""
    off = (int(digits[-1]) - _check_digit(digits[:-1])) % 10
    n = 10 ** (len(digits) - 2)
    x = int(digits[1:-1])
    key = hashlib.blake2b(f"{digits[0]}{len(digits)}{off > 0}".encode(), key=key).digest()
    if off:
        x, off = divmod(_moved(x * 9 + off - 1, n * 9, key), 9)
        off += 1
    else:
        x = _moved(x, n, key)
    body = digits[0] + str(x).zfill(len(digits) - 2)
    return body + str((_check_digit(body) + off) % 10)


def _phone(digits: str, key: bytes) -> str:
    """Country code kept; first digits of area and exchange stay such as may begin them."""
    plus = digits.startswith("+")
    own = min(10, len(digits) - 2 * plus)
    national = digits[-own:]
    shape: list[str | None] = [ALPHABETS[0]] * own
    if own == 10:
        for i in (0, 3):
            shape[i] = HIGH if national[i] in HIGH else LOW
    return digits[:-own] + _shaped(national, shape, key)


def _ip(text: str, key: bytes) -> str:
    octets = [int(o) for o in text.split(".")]
    usual = 1 <= octets[0] <= 223
    firsts = list(range(1, 224)) if usual else [0, *range(224, 256)]
    x = ((firsts.index(octets[0]) * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
    x = _moved(x, len(firsts) << 24, hashlib.blake2b(b"ip%d" % usual, key=key).digest())
    return ".".join(map(str, (firsts[x >> 24], x >> 16 & 255, x >> 8 & 255, x & 255)))


def _script(word: str) -> str:
    return "cyrillic" if any("а" <= c <= "я" or c == "ё" for c in word) else "greek" if any("ά" <= c <= "ώ" for c in word) else "latin"


def _name(word: str, gender: str, attempt: int, key: bytes) -> str:
    syllables, endings = SYLLABLES[_script(word)]
    x = int.from_bytes(hashlib.blake2b(f"{gender}|{word}|{attempt}".encode(), key=key, digest_size=16).digest(), "big")
    parts = []
    for _ in range(4):
        x, at = divmod(x, len(syllables))
        parts.append(syllables[at])
    return "".join(parts) + endings[gender][x % 4]


@lru_cache(maxsize=50_000)
def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """Surrogate of a canonical entity."""
    if kind == "card":
        return _card(entity, key)
    if kind == "phone":
        return _phone(entity, key)
    if kind == "ip":
        return _ip(entity, key)
    if kind == "secret":
        hexes = next((h for h in (HEX, HEX_UPPER) if all(c in h for c in entity)), None)
        return _shaped(entity, [hexes] * len(entity) if hexes else _by_class(entity), key)
    if kind == "email":
        local, domain = entity.split("@")
        dot = domain.rindex(".")
        new = _shaped(local, _by_class(local), key + b"l"), _shaped(domain[:dot], _by_class(domain[:dot]), key + b"d")
        return f"{new[0]}@{new[1]}{domain[dot:]}"
    return _name(entity, kind[-1], attempt, key)


def written_like(kind: str, shown: str, new: str) -> str:
    """The surrogate in the form in which the entity stood: its punctuation, or its case."""
    if kind in ("phone", "card"):
        digits = iter(new.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in shown)
    if kind == "secret" or kind == "ip":
        return new
    if shown.isupper() and len(shown) > 1:
        return new.upper()
    if kind.startswith("name"):
        return new[:1].upper() + new[1:]
    return "".join(n.upper() if s.isupper() else n for s, n in zip(shown, new, strict=True))


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str, int]:
    """The text with surrogates, and the number of entities."""
    parts, before = [], 0
    found = find(text)
    for start, end, kind in found:
        shown = text[start:end]
        entity = canonical(kind, shown)
        new = surrogate(kind, entity, key, (attempts or {}).get((kind, entity), 0))
        parts += [text[before:start], written_like(kind, shown, new)]
        before = end
    return "".join([*parts, text[before:]]), len(found)


def mentions(docs: DataFrame) -> DataFrame:
    """Distinct entities of each text: text_hash, kind, entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in slices(whole)):
            rows = []
            for text, own in zip(batch["text"].to_pylist(), batch["text_hash"].to_pylist(), strict=True):
                rows += [(own, *e) for e in {(k, canonical(k, text[a:b])) for a, b, k in find(text)}] if text else []
            if rows:
                h, k, e = zip(*rows, strict=True)
                yield pa.record_batch({"text_hash": pa.array(h, pa.int64()), "kind": pa.array(k), "entity": pa.array(e)})

    given = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    return given.mapInArrow(run, "text_hash long, kind string, entity string")


def redraws(entities: DataFrame, key: bytes) -> DataFrame | None:
    """(kind, entity, attempt) for entities whose surrogate is another's; None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("kind", "entity", "attempt")), strict=True)
            new = [surrogate(k, e, key, a) for k, e, a in rows]
            yield pa.record_batch([*batch.columns, pa.array(new, pa.string())], [*batch.schema.names, "surrogate"])

    named = entities.withColumn("attempt", F.lit(0))
    schema = "kind string, entity string, attempt int, surrogate string"
    collided = False
    while True:
        drawn = written(named.mapInArrow(run, schema), "drawn")
        family = F.substring("kind", 1, 4)
        owner = drawn.groupBy(family.alias("family"), "surrogate").agg(
            F.min(F.struct("kind", "entity")).alias("owner"), F.max(F.struct("kind", "entity")).alias("last")
        ).filter("owner <> last")
        owner = written(owner, "collisions")
        if owner.isEmpty():
            return drawn.filter("attempt > 0").select("kind", "entity", "attempt") if collided else None
        collided = True
        clash = drawn.join(owner, (family == owner["family"]) & (drawn["surrogate"] == owner["surrogate"]), "left")
        again = F.col("owner").isNotNull() & (F.struct("kind", "entity") != F.col("owner"))
        named = clash.select("kind", "entity", F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Per document: doc_id, text with surrogates, n_entities."""
    pin(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    seen = written(mentions(docs), "mentions")
    again = redraws(seen.select("kind", "entity").distinct(), key)
    schema = "doc_id long, text string, n_entities long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in slices(whole)):
            redrawn = batch["redrawn"].to_pylist() if "redrawn" in batch.schema.names else [None] * batch.num_rows
            texts, counts = [], []
            for text, own in zip(batch["text"].to_pylist(), redrawn, strict=True):
                attempts = {(r["kind"], r["entity"]): r["attempt"] for r in own or []}
                new, n = replace(text, key, attempts) if text else (text, 0)
                texts.append(new)
                counts.append(n)
            yield pa.record_batch({"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string()), "n_entities": pa.array(counts, pa.int64())})

    if again is None:
        return docs.mapInArrow(run, schema)
    own = written(
        seen.join(again, ["kind", "entity"]).groupBy("text_hash").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("redrawn")),
        "redrawn",
    )
    own = small(own, 8 * own.count())
    return docs.withColumn("text_hash", F.xxhash64("text")).join(own, "text_hash", "left").select("doc_id", "text", "redrawn").mapInArrow(run, schema)
