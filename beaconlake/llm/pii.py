"""Surrogates for personal data: keyed, consistent in type, distinct, and the same everywhere.

Detected entities are reduced to a canonical value per type. The distinct values of the whole
corpus get candidates from a keyed hash: letters for letters of the same script and case, digits for
digits, names for names of the same gender and script, valid octets and check digits where the
original has them. A candidate that is itself a value of the corpus, or that several values
share, is drawn anew for all but one of them, until every value has a surrogate of its own. Each
occurrence then gets the surrogate in its own spelling.
"""

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconlake.llm.common import UID, batch_slices
from beaconlake.session import materialise

ENTITIES = "__entities"
#: Bytes of text that become Python strings at once.
AT_ONCE = 1 << 21
#: Draws after which a candidate may be longer than the original, and after which the search fails.
LONGER_AFTER, ATTEMPTS = 8, 200

#: A host name that is nobody's and stays.
RESERVED = "example"

TITLES = {
    "m": "Mr|Herr|Herrn|Monsieur|Señor|Mister",
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita",
    "u": "Dr|Prof",
}
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
HEX = "[0-9a-fA-F]{1,4}"
#: Types in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[\w.+%-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63})+",
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}(?![0-9A-Za-z])",
    "ipv6": rf"(?<![\w:.])(?=[0-9a-fA-F:]*\d|(?:[0-9a-fA-F]*:){{3}})(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}(?::{HEX}){{0,6}})?::(?:(?:{HEX}:){{0,5}}(?:{OCTET}\.){{3}}{OCTET}|{HEX}(?::{HEX}){{0,6}})?)(?![\w:]|\.\d)",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?![\d]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "national": r"(?<![\w.,:/+-])(?:\(0\d{1,4}\) ?\d{2,4}(?:[ -]?\d{2,4}){1,3}|0\d{2,4}(?: ?[/-] ?| )\d{3,4}(?:[ -]?\d{2,4}){1,3}|0\d(?:[ .-]\d\d){4}|0\d{9,10})(?!\w|[.,/:-]\d)",
    "assigned": r"(?i:token|secret|password|passwd|api[_-]?key)[\"']?\s*[=:]\s*[\"']?(?P<assigned_value>[\w/+-]{8,})",
}
FINDER = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
ALL_TITLES = "|".join(TITLES.values())
TITLED = re.compile(
    "|".join(rf"(?P<{gender}>(?<!\w)(?:{titles})\.? )(?:(?:{ALL_TITLES})\.? )*" for gender, titles in TITLES.items())
)
#: A word of a name; an initial stays, as does a genitive ending.
NAME_WORD = re.compile(rf"(?P<initial>[^\W\d_]\. ?(?=[^\W\d_]{{2}}))|(?P<word>{WORD})")
GENITIVE = ("'s", "’s")
PARTICLES = set("van von vom zu zur de der den del della di da das do dos du la le el al bin ibn ter ten y".split())
NO_NAMES = set(ALL_TITLES.split("|"))
HEXADECIMAL = re.compile("[0-9a-fA-F]{32,}")
MAYBE = re.compile(r"[0-9@=:]")

GIVEN = {
    "m": "Adam Bruno Carl Daniel Erik Felix Georg Hugo Ivan Jonas Karl Lukas Martin Nils Oscar Paul".split(),
    "f": "Anna Berta Clara Dora Emma Frida Greta Helena Ida Julia Karla Laura Maria Nora Olga Paula".split(),
    "u": "Alex Billie Charlie Dominique Eden Frankie Jamie Kim Lou Marion Noel Robin Sam Toni Ulli Yael".split(),
}
SYLLABLES = {
    "LATIN": "ba be bo da de do fa fe ga go ka ke la le lo ma me mo na ne no ra re ro sa se ta te to va ve za".split(),
    "CYRILLIC": "ба бе бо да де до га го ка ке ла ле ло ма ме мо на не но ра ре ро са се та те то ва ве за".split(),
    "GREEK": "βα βε βο δα δε δο γα γο κα κε λα λε λο μα με μο να νε νο ρα ρε ρο σα σε τα τε το ζα ζε".split(),
}
ENDINGS = {
    "LATIN": {"m": "no", "f": "na", "u": "ni"}, "CYRILLIC": {"m": "н", "f": "на", "u": "ни"},
    "GREEK": {"m": "νος", "f": "να", "u": "νι"},
}
ALPHABETS = {
    "LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω",
}


def script_of(letter: str) -> str:
    name = unicodedata.name(letter, "LATIN").split(" ")[0]
    return name if name in ALPHABETS else "LATIN"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def canonical(kind: str, value: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).exploded
    return unicodedata.normalize("NFC", value).lower() if kind != "assigned" else value


def name_at(text: str, at: int) -> list[tuple[int, int]]:
    """Where the words of the name are that begins at a place; they begin with capitals."""
    spans = []
    while m := NAME_WORD.match(text, at):
        at = m.end()
        if m["initial"]:
            if not m["initial"][0].isupper():
                break
            continue
        word = m["word"]
        owned = word.endswith(GENITIVE) and len(word) > 2
        if word[0].isupper() and word not in NO_NAMES:
            spans.append((m.start(), at - 2 if owned else at))
        elif word not in PARTICLES:
            break
        if owned or text[at : at + 1] != " ":
            break
        at += 1
    return spans


def names_of(text: str) -> list[tuple[str, int, int, str]]:
    """Names after titles, and every other place of a text where a word of such a name stands.

    Elsewhere a word has the type of its first titled mention, so its surrogate is the same.
    """
    found, kind_of, spellings = [], {}, set()
    for m in TITLED.finditer(text):
        spans = name_at(text, m.end())
        for i, (at, end) in enumerate(spans):
            kind = "family" if i == len(spans) - 1 else f"given_{m.lastgroup}"
            value = canonical(kind, text[at:end])
            found.append((kind, at, end, value))
            kind_of.setdefault(value, kind)
            spellings |= {unicodedata.normalize(form, text[at:end]) for form in ("NFC", "NFD")} | {text[at:end]}
    if found:
        longest_first = sorted(spellings, key=lambda w: (-len(w), w))
        again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, longest_first))})(?!\w)", re.IGNORECASE)
        for m in again.finditer(text):
            value = canonical("family", m[0])
            if m[0][0].isupper() and value in kind_of:
                found.append((kind_of[value], m.start(), m.end(), value))
    return found


def entities_of(text: str) -> list[tuple[str, int, int, str]]:
    """``type, start, end, canonical value`` of the entities of a text, in order, apart."""
    found = []
    if MAYBE.search(text):
        for m in FINDER.finditer(text):
            kind = {"assigned_value": "assigned", "national": "phone"}.get(m.lastgroup, m.lastgroup)
            at, end = m.span("assigned_value" if kind == "assigned" else m.lastgroup)
            if kind == "assigned" and HEXADECIMAL.fullmatch(text, at, end):
                kind = "secret"
            try:
                found.append((kind, at, end, canonical(kind, text[at:end])))
            except ipaddress.AddressValueError:  # more groups than an address has
                continue
    found += names_of(text)
    found.sort(key=lambda e: (e[1], -e[2]))
    apart, free = [], 0
    for entity in found:
        if entity[1] >= free:
            apart.append(entity)
            free = entity[2]
    return apart


class Draw:
    """Numbers from a keyed hash of a value and the number of the draw."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{attempt}\0{value}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        self.pool, self.round = b"", 0

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.seed + self.round.to_bytes(4, "big")).digest()
            self.round += 1
        number, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return number % n

    def like(self, value: str, hexadecimal: bool = False) -> str:
        """Digits for digits, letters of the same script and case for letters; the rest as it is."""
        out = []
        for c in value:
            if c.isdecimal():
                out.append(str(self.below(10)))
            elif c.isalpha():
                letters = "abcdef" if hexadecimal else ALPHABETS[script_of(c)]
                letter = letters[self.below(len(letters))]
                out.append(letter.upper() if c.isupper() else letter)
            else:
                out.append(c)
        return "".join(out)


def candidate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The surrogate of a canonical value at the given draw, in canonical form."""
    draw = Draw(key, kind, value, attempt)
    extra = max(0, attempt - LONGER_AFTER)
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ipv6":
        return ":".join(f"{draw.below(1 << 16):04x}" for _ in range(8))
    if kind == "secret":
        return draw.like(value, hexadecimal=True) + "".join(draw.like("0") for _ in range(extra))
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        hosts = [
            label if label == RESERVED else Draw(key, "domain", label, attempt).like(label) for label in labels[:-1]
        ]
        return f"{draw.like(local)}{draw.like('a' * extra)}@{'.'.join([*hosts, labels[-1]])}"
    if kind in ("phone", "ssn", "iban"):
        keep = 1 if kind == "phone" else 2 if kind == "iban" else 0
        return value[:keep] + draw.like(value[keep:])
    if kind == "card":
        body = draw.like(value[:-1])
        checks = [d for d in "0123456789" if luhn(body + d)]
        return body + (checks[0] if luhn(value) else draw.like("0"))
    if kind.startswith("given_") or kind == "family":
        return name_like(draw, kind, value, attempt)
    return draw.like(value) + draw.like("a" * extra)


def name_like(draw: Draw, kind: str, value: str, attempt: int) -> str:
    """A name of the same gender and script; from the list at first, composed when that is taken."""
    gender, script = kind.removeprefix("given_"), script_of(value[0])
    if kind != "family" and script == "LATIN" and attempt < 2:
        return GIVEN[gender][draw.below(len(GIVEN[gender]))].lower()
    syllables = SYLLABLES[script]
    parts = [syllables[draw.below(len(syllables))] for _ in range(2 + attempt // LONGER_AFTER)]
    return "".join(parts) + ("" if kind == "family" else ENDINGS[script][gender])


def spelled(kind: str, surrogate: str, occurrence: str) -> str:
    """The surrogate in the spelling of an occurrence: its separators and its case."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(surrogate)
        return "".join(next(rest, "") if c.isalnum() else c for c in occurrence) + "".join(rest)
    letters = [c for c in occurrence if c.isalpha()]
    if letters and all(c.isupper() for c in letters) and len(letters) > 1:
        return surrogate.upper() if kind != "assigned" else surrogate
    if kind.startswith("given_") or kind == "family":
        return surrogate[:1].upper() + surrogate[1:] if occurrence[:1].isupper() else surrogate
    if kind == "email":
        return "".join(
            s.upper() if i < len(occurrence) and occurrence[i].isupper() else s for i, s in enumerate(surrogate)
        )
    return surrogate


ENTITY = "type string, start int, end int, value string"


def _detect(with_entities: bool):
    """Keep the rows of a batch that have entities, with a column of them, or those that have none."""
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, "text", AT_ONCE):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = [entities_of(t) if t else [] for t in texts]
            if with_entities:
                rows = [[dict(zip(("type", "start", "end", "value"), e, strict=True)) for e in f] or None for f in found]
                batch = batch.append_column(ENTITIES, pa.array(rows, type=kind))
            yield batch.filter(pa.array([bool(f) == with_entities for f in found]))

    return run


def _candidates(key: bytes):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = zip(frame["type"], frame["value"], frame["attempt"], strict=True)
            yield frame.assign(surrogate=[candidate(key, *row) for row in rows])

    return run


def surrogates(values: DataFrame, key: bytes) -> DataFrame:
    """``type, value, surrogate`` for distinct ``type, value``: one to one within a type.

    No surrogate is a value of the table. Of the values that draw the same one the smallest keeps
    it; the others draw again.
    """
    pending, taken = values.withColumn("attempt", F.lit(0)), None
    real = values.withColumnRenamed("value", "surrogate")
    for _ in range(ATTEMPTS):
        drawn = materialise(
            pending.mapInPandas(_candidates(key), "type string, value string, attempt int, surrogate string"),
            "surrogate-draws",
        )
        free = drawn.join(real, ["type", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        won = free.groupBy("type", "surrogate").agg(F.min("value").alias("value")).select("type", "value", "surrogate")
        won = materialise(won, "surrogate-won")
        taken = won if taken is None else taken.unionByName(won)
        lost = drawn.join(won, ["type", "value"], "left_anti")
        pending = lost.select("type", "value", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return taken
    raise ValueError(f"no distinct surrogates within {ATTEMPTS} draws")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batch_slices(batches, "text", AT_ONCE):
        place = batch.schema.get_field_index("text")
        texts = []
        for text, spans in zip(batch.column(place).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
            parts, at = [], 0
            for span in sorted(spans, key=lambda s: s["start"]):
                parts += [text[at : span["start"]], spelled(span["type"], span["surrogate"], text[span["start"] : span["end"]])]
                at = span["end"]
            texts.append("".join([*parts, text[at:]]))
        kept = [n for n in batch.schema.names if n != "__spans"]
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in kept]
        yield pa.RecordBatch.from_arrays(columns, names=kept)


def pseudonymise(documents: DataFrame, key: bytes) -> DataFrame:
    """``documents`` with surrogates in ``text``, and ``pii_types``: the entities' types in order.

    Equal values have one surrogate in all documents, different ones different surrogates, and no
    surrogate is a value that occurs. Rows without entities are as before, missing and empty texts
    among them, with an empty list. Repeated rows are replaced alike. Other columns are kept as they
    are; an empty table gives no rows.
    """
    columns = documents.columns
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in documents.schema])
    numbered = documents.withColumn(UID, F.monotonically_increasing_id())
    found_schema = T.StructType([*numbered.schema, T.StructField(ENTITIES, T.ArrayType(T.StructType.fromDDL(ENTITY)))])
    found = materialise(numbered.mapInArrow(_detect(True), found_schema), "pii-found")
    occurring = found.select(UID, F.inline(ENTITIES))
    distinct = materialise(occurring.select("type", "value").distinct(), "pii-values")
    spans = (
        occurring.join(surrogates(distinct, key), ["type", "value"])
        .groupBy(UID)
        .agg(F.collect_list(F.struct("start", "end", "type", "surrogate")).alias("__spans"))
    )
    types = F.transform(ENTITIES, lambda e: e["type"]).alias("pii_types")
    changed = found.join(spans, UID).select(*columns, types, "__spans")
    rewritten_schema = T.StructType([*schema, T.StructField("pii_types", T.ArrayType(T.StringType()))])
    rewritten = changed.mapInArrow(_rewrite, rewritten_schema)
    untouched = documents.mapInArrow(_detect(False), schema)
    return untouched.withColumn("pii_types", F.array().cast("array<string>")).unionByName(rewritten)
