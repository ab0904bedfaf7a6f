"""Personal data replaced by keyed surrogates.

1. Entities are detected: e-mail addresses, phone, card and social security numbers, IP addresses,
   IBANs, secrets (long hexadecimal strings, values assigned to key, token, secret, password), and
   names after a title in five languages, of any number of words and with particles between them, with
   later mentions of the same words in that document.
2. Every distinct entity (type and canonical value, so "(1) 2" and "1-2" are one) draws a surrogate
   from an HMAC of a secret key, its type, its value and an attempt number.
3. Collisions are checked over the whole table: of entities that drew the same surrogate one keeps
   it, and none may draw a value that occurs as an original; all kinds of names count as one type
   here, and a word that is a name of several kinds is one entity. The others draw again, until none is
   left. So distinct entities stay distinct, and mentions of one entity get one surrogate in all
   documents.
4. Surrogates are written into the mentions in their format: separators, case, country codes,
   validity of card and IBAN check digits, script and, for given names, gender (from the title).

Texts that can hold no entity (see `worth`) are passed by without any shuffle. Defined results: null
texts stay null, empty ones empty. Repeated rows get equal results. Rows with a null doc_id are
treated like others. Extra columns pass through; one that has the name of a result is replaced.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from collections.abc import Iterator
from ipaddress import IPv6Address
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.shared import aside, stored

#: From this attempt on surrogates get longer, so that a full format cannot hold up the draw.
WIDEN = 6

TITLES = {
    "f": "Mrs Ms Miss Frau Mme Madame Mlle Señora Sra Sig.ra Signora",
    "m": "Mr Herr Monsieur Señor Sr Sig Signor",
    "n": "Dr Prof Doctor Professor",
}
GENDER = {t: g for g, names in TITLES.items() for t in names.split()}
_TITLE = "|".join(sorted(map(re.escape, GENDER), key=len, reverse=True))
#: Small words inside names, which stay as they are.
PARTICLES = frozenset(
    "af al av bin da dal de del della den der des di do dos du e el i ibn la las le los op ten ter "
    "'t thoe und v van vom von y zu zum zur".split()
)
_GAP = r"[\s\x1c-\x1f\x{85}\p{Z}]"
#: Patterns in Java's spelling for what a text must hold to be looked at: a digit or an @, a title before
#: another word, a word for a secret and what assigns it, or two hexadecimal groups. Whatever
#: `detect` finds holds one of them. Literals that are quick to look for come before the patterns.
_DIGIT = r"[\p{N}@]"
_BEFORE = rf"(?:{_TITLE.replace(chr(92) + '.', '[.]')})\.?{_GAP}+['\p{{L}}]"
_ASSIGNED = (
    rf"(?iu:key|token|secret|password|passwd){_GAP}*[=:]"
    r"|[0-9a-fA-F]:{1,2}[0-9a-fA-F]{1,4}:|[0-9a-fA-F]{4}::|::[0-9a-fA-F]{3}"
)
#: Each title holds one of them.
_STARTS = [t for t in GENDER if not any(o != t and o in t for o in GENDER)]


def worth(text: Column) -> Column:
    """Whether a text may hold an entity."""

    def holds(words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(text, F.lit(w))
        return found

    titled = holds(_STARTS) & text.rlike(_BEFORE)
    assigned = holds([":", "="]) & text.rlike(_ASSIGNED)
    return F.coalesce(text.rlike(_DIGIT) | titled | assigned, F.lit(False))


#: A word behind a title or another word of a name, on the same line.
_TITLED = re.compile(rf"\b({_TITLE})\.?(?=\s)")
_NEXT = re.compile(r"[^\S\r\n]+('?[^\W\d_][\w'’-]*)")
_DOMAIN = re.compile(r"@[\w-]+(?:\.[\w-]+)+")
_LOCAL = re.compile(r"[\w.%+-]")
_SECRET = re.compile(
    r"(?i)\b(?:api[_-]?key|access[_-]?key|key|token|secret|password|passwd)\s*[=:]\s*[\"']?([^\s\"']{8,})"
)
_NUMBERS = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w.]*\d)"
    r"|(?P<ip6>(?<!:)(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}"
    r"|(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?))(?![\w:])"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])"
    r"|(?P<hex>(?=[0-9a-fA-F]*\d)(?=\d*[a-fA-F])[0-9a-fA-F]{32,})(?!\w)"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4})(?![\w-])"
    r"|(?P<phone2>\+\d{8,14})(?!\w)"
    r")"
)


def _canonical(kind: str, raw: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in raw if c.isdigit() or c == "+")
    if kind == "iban":
        return raw.replace(" ", "")
    if kind == "ip6":
        return str(IPv6Address(raw))
    if kind == "secret":
        return raw
    return raw.casefold()


def _is_address(raw: str) -> bool:
    """Whether it is an IPv6 address; a compressed one only if no slice or scope looks like it."""
    if "::" in raw and not any(
        len(g) == 4 or len(g) == 3 and any(c.isdigit() for c in raw) for g in raw.split(":")
    ):
        return False
    try:
        return bool(IPv6Address(raw))
    except ValueError:
        return False


def _words_of_name(text: str, at: int, gender: str) -> list[tuple[int, int, str]]:
    """Begin, end and kind of the capitalised words of the name that starts at a place.

    A name runs over capitalised words, of any number, and particles between or before them. The last
    word and all behind a particle are surnames, the others given names.
    """
    words, particle, pending = [], False, False
    while m := _NEXT.match(text, at):
        word, at = m[1], m.end()
        if word[0].isupper():
            particle, pending = particle or pending, False
            words.append((*m.span(1), particle))
        elif word in PARTICLES:
            pending = True
        else:
            break
    return [
        (a, b, "surname" if behind or i == len(words) - 1 else f"given-{gender}")
        for i, (a, b, behind) in enumerate(words)
    ]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Begin, end, type and canonical value of each entity, in order, none overlapping."""
    found = []
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start and _LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            found.append((start, m.end(), "email"))
    found += [(*m.span(1), "secret") for m in _SECRET.finditer(text)]
    for m in _NUMBERS.finditer(text):
        kind = m.lastgroup.rstrip("2")
        if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
            continue
        if kind == "ip6" and not _is_address(m[0]):
            continue
        found.append((*m.span(), {"hex": "secret", "ip6": "ip6"}.get(kind, kind)))
    names: dict[str, str] = {}
    for m in _TITLED.finditer(text):
        for a, b, kind in _words_of_name(text, m.end(), GENDER[m[1]]):
            found.append((a, b, kind))
            names.setdefault(text[a:b], kind)
    for m in re.finditer(r"\w[\w'’-]*", text) if names else ():
        if m[0] in names:
            found.append((*m.span(), names[m[0]]))
    out, end = [], -1
    for a, b, kind in sorted(set(found), key=lambda x: (x[0], -x[1], x[2])):
        if a >= end:
            out.append((a, b, kind, _canonical(kind, text[a:b])))
            end = b
    return out


class _Draw:
    """A stream of numbers that a key, an entity and an attempt determine."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key = key
        self.seed = f"{kind}\0{value}\0{attempt}".encode("utf-8", "surrogatepass")
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.digest(self.key, self.block.to_bytes(4, "big") + self.seed, "sha256")
            self.block += 1
        number, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return number % n


#: Syllables by script; a name is built from those of its own.
SYLLABLES = {
    "LATIN": "ba be bi bo da de di do fa fe ga ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "CYRILLIC": "ба бе бо ва ве ви да де ди до за ка ки ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си та те ти то".split(),
    "GREEK": "βα βε γα δα δε δη κα κε κο λα λε λη λο μα με μη να νε νη νο πα πε πο ρα ρε ρη ρο σα σε τα τε τη το".split(),
}
ENDINGS = {
    "LATIN": {"f": ["na", "la", "ra"], "m": ["n", "r", "s"], "n": ["nen", "ris", "len"]},
    "CYRILLIC": {"f": ["на", "ла"], "m": ["н", "р"], "n": ["ко", "но"]},
    "GREEK": {"f": ["να", "λη"], "m": ["νος", "ρης"], "n": ["νου", "λου"]},
}


def _like(c: str, draw: _Draw) -> str:
    """A character of the same class, case and script."""
    if c.isdigit():
        return str(draw.below(10))
    if not c.isalpha():
        return c
    script = unicodedata.name(c, "LATIN").split()[0]
    first = {"CYRILLIC": ("а", 32), "GREEK": ("α", 17)}.get(script, ("a", 26))
    low = chr(ord(first[0]) + draw.below(first[1]))
    return low.upper() if c.isupper() else low


def _luhn(digits: str) -> int:
    """The check digit that completes digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """A canonical value of the same type for a canonical value."""
    draw = _Draw(key, kind, value, attempt)
    more = max(0, attempt - WIDEN)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host = domain.split(".")[0]
        # A reserved domain, so that no surrogate is anybody's address.
        return "".join(_like(c, draw) for c in local + "x" * more) + "@" + "".join(
            _like(c, draw) for c in host
        ) + ".example"
    if kind == "ip":
        private = value.startswith(("10.", "192.168.", "127."))
        parts = value.split(".")
        kept = 2 if value.startswith("192.168.") else int(private)
        return ".".join(p if i < kept else str(1 + draw.below(254)) for i, p in enumerate(parts))
    if kind == "ip6":
        shape = value if not more else "0000:" * 7 + "0000"
        new = "".join("0123456789abcdef"[draw.below(16)] if c != ":" else c for c in shape)
        return str(IPv6Address(new))
    if kind == "iban":
        rest = "".join(_like(c, draw) for c in value[4:] + "0" * more)
        number = "".join(str(int(c, 36)) for c in rest + value[:2] + "00")
        return f"{value[:2]}{98 - int(number) % 97:02d}{rest}"
    if kind in ("phone", "card", "ssn"):
        # A number of one digit more only if the format is full.
        body = value + "0" * more
        kept = (2 if body.startswith("+") else 0) if kind == "phone" else 0
        new = body[:kept] + "".join(
            str(1 + draw.below(9)) if i == 0 else str(draw.below(10)) for i in range(len(body) - kept)
        )
        if kind == "card" and _luhn(value[:-1]) == int(value[-1]):
            new = new[:-1] + str(_luhn(new[:-1]))
        return new
    if kind == "secret":
        if re.fullmatch(r"[0-9a-fA-F]+", value):
            hexes = "".join("0123456789abcdef"[draw.below(16)] for _ in value + "0" * more)
            return hexes.upper() if value.isupper() else hexes
        return "".join(_like(c, draw) for c in value + "x" * more)
    script = unicodedata.name(value[0], "LATIN").split()[0]
    script = script if script in SYLLABLES else "LATIN"
    many = max(1, min(4, len(value) // 2 - 1)) + more
    sounds = [SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(many)]
    ends = ENDINGS[script][kind[-1] if kind.startswith("given") else "n"]
    return "".join(sounds) + ends[draw.below(len(ends))]


def written(kind: str, raw: str, new: str) -> str:
    """The surrogate in the format of a mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        left, out = iter(new), []
        for c in raw:
            out.append(next(left, "") if c.isalnum() or c == "+" else c)
        return "".join(chain(out, left))
    if kind == "ip6" and "::" not in raw:
        groups = IPv6Address(new).exploded.split(":")
        new = ":".join(groups if len(raw) == 39 else (f"{int(g, 16):x}" for g in groups))
    if kind in ("email", "ip6", "given-f", "given-m", "given-n", "surname"):
        shape = raw.split("@")[0]  # a domain has no case of its own
        if shape.isupper() and len(shape) > 1:
            return new.upper()
        if kind.startswith(("given", "surname")):
            return new[:1].upper() + new[1:]
    return new


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and entity; p_spans has the mentions' begins and ends in turn."""
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            b = whole.slice(at, 64)
            rows = []
            for doc, h, t in zip(b[0].to_pylist(), b[1].to_pylist(), b[2].to_pylist(), strict=True):
                spans: dict[tuple, list] = {}
                for begin, end, *entity in detect(t):
                    spans.setdefault(tuple(entity), []).extend((begin, end))
                rows += [(doc, h, *entity, spans[entity]) for entity in sorted(spans)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(_KEYS)],
                names=["p_doc", "p_h", "p_kind", "p_value", "p_spans"],
            )


_KEYS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
_FOUND = "p_doc long, p_h long, p_kind string, p_value string, p_spans array<int>"
_ENTITY = "p_kind string, p_value string, p_attempt int, p_new string"


def _drawer(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            new = [surrogate(key, k, v, a) for k, v, a in rows]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(new, pa.string())],
                names=["p_kind", "p_value", "p_attempt", "p_new"],
            )

    return run


def _class() -> Column:
    """The kind, or name for all kinds of names: values of a class are kept apart."""
    kind = F.col("p_kind")
    return F.when(kind.rlike("^(given-|surname)"), "name").otherwise(kind).alias("p_class")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """p_kind, p_value and p_new: a surrogate of its own for each distinct entity.

    All kinds of names are one class: a word that is a name of several kinds is one entity, drawn
    as the first of them, and no two words of the class get the same surrogate.
    """
    draw = _drawer(key)
    given = entities.select("p_kind", "p_value").distinct()
    entities = given.groupBy(_class(), "p_value").agg(F.min("p_kind").alias("p_kind"))
    originals = entities.select(_class(), F.col("p_value").alias("p_new"))
    first = entities.select("p_kind", "p_value", F.lit(0).alias("p_attempt"))
    drawn = stored(first.mapInArrow(draw, _ENTITY), "surrogates")
    while True:
        # The one with the smallest digest keeps a surrogate; an original keeps nobody's.
        rank = F.xxhash64(_class(), "p_value")
        taken = drawn.groupBy(_class(), "p_new").agg(
            F.min(rank).alias("p_rank"), F.count("*").alias("p_n")
        )
        shared = taken.where("p_n > 1").select("p_class", "p_new", "p_rank")
        barred = (
            taken.join(originals, ["p_class", "p_new"], "left_semi")
            .select("p_class", "p_new", F.lit(None).cast("long").alias("p_rank"))
        )
        clash = stored(
            barred.union(shared.join(barred, ["p_class", "p_new"], "left_anti")), "clashes"
        )
        if clash.isEmpty():
            known = drawn.select(_class(), "p_value", "p_new")
            return given.withColumn("p_class", _class()).join(known, ["p_class", "p_value"]).drop("p_class")
        lost = F.col("p_clash").isNotNull() & ~rank.eqNullSafe(F.col("p_rank"))
        marked = drawn.withColumn("p_class", _class()).join(
            clash.withColumn("p_clash", F.lit(True)), ["p_class", "p_new"], "left"
        )
        again = marked.where(lost).select(
            "p_kind", "p_value", (F.col("p_attempt") + 1).cast("int").alias("p_attempt")
        )
        fine = marked.where(~lost).select("p_kind", "p_value", "p_attempt", "p_new")
        drawn = stored(fine.union(again.mapInArrow(draw, _ENTITY)), "surrogates")


def _replacer(names: list[str], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                b = whole.slice(start, 64)
                texts, numbers, kinds = [], [], []
                for t, found in zip(b[at].to_pylist(), b[b.num_columns - 1].to_pylist(), strict=True):
                    mentions = sorted(
                        (a, z, x["p_kind"], x["p_new"])
                        for x in found or ()
                        for a, z in zip(x["p_spans"][::2], x["p_spans"][1::2], strict=True)
                    )
                    parts, end, seen = [], 0, []
                    for a, z, kind, new in mentions:
                        parts += [t[end:a], written(kind, t[a:z], new)]
                        seen.append(kind)
                        end = z
                    texts.append(None if t is None else "".join([*parts, t[end:]]))
                    numbers.append(len(seen))
                    kinds.append(sorted(set(seen)))
                columns = [pa.array(texts, pa.string()) if i == at else b[i] for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(numbers, pa.int64()), pa.array(kinds, pa.list_(pa.string()))],
                    names=[*names, "p_entities", "p_kinds"],
                )

    return run


def replace(
    df: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """df with its text rewritten, and p_entities, the number of mentions, and p_kinds."""
    names = df.columns
    df, (text, doc_id) = aside(df, text, doc_id)
    t = F.col(f"`{text}`")
    some = worth(t)
    keyed = df.where(some).withColumns(
        {"p_doc": F.col(f"`{doc_id}`").cast("long"), "p_h": F.xxhash64(t)}
    )
    # A text is read for entities once; where they stand travels with them.
    found = keyed.select("p_doc", "p_h", t).mapInArrow(_detected, _FOUND)
    found = stored(found.distinct(), "entities")
    entities = stored(found.select("p_kind", "p_value").distinct(), "distinct-entities")
    known = assign(entities, key)
    own = (
        found.join(known, ["p_kind", "p_value"])
        .groupBy("p_doc", "p_h")
        .agg(F.collect_list(F.struct("p_kind", "p_new", "p_spans")).alias("p_found"))
        .withColumnsRenamed({"p_doc": "p_doc2", "p_h": "p_h2"})
    )
    with_found = keyed.join(
        own, F.col("p_doc").eqNullSafe(F.col("p_doc2")) & (F.col("p_h") == F.col("p_h2")), "left"
    ).select(*(f"`{c}`" for c in df.columns), "p_found")
    kept = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    done = with_found.mapInArrow(
        _replacer(df.columns, df.columns.index(text)),
        f"{kept}, p_entities long, p_kinds array<string>",
    )
    rest = df.where(~some).withColumns(
        {"p_entities": F.lit(0).cast("long"), "p_kinds": F.array().cast("array<string>")}
    )
    made = ["p_entities", "p_kinds"]
    old = [(n, c) for n, c in zip(df.columns, names, strict=True) if c not in made]
    return done.union(rest).select(*(F.col(n).alias(c) for n, c in old), *made)
