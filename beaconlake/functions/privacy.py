"""Scrubbing expressions: literal names, home paths and hardware addresses in text."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Addresses that identify nobody.
SAFE_MACS = ["ff:ff:ff:ff:ff:ff", "00:00:00:00:00:00", "aa:bb:cc:dd:ee:ff"]

# Six pairs of hexadecimal digits joined by : or -, between word boundaries.
# The boundaries are spelled out so that letters outside ASCII count as word characters.
WORD = r"[\p{L}\p{N}_]"
# The look-ahead fails fast on ordinary text.
MAC_PATTERN = rf"(?=[0-9A-Fa-f]{{2}}[:-])(?<!{WORD})(?:[0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}}(?!{WORD})"
HOME_PATTERN = "(?U)/home/[^/\\s\"']+/"
HOME_REPLACEMENT = "/home/user/"
# Entries of a mapping up to which each is a call of its own.
NESTED_ENTRIES = 32
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def normalise_mac(mac: Column) -> Column:
    return F.replace(F.lower(F.regexp_replace(mac, EDGE_SPACE, "")), F.lit("-"), F.lit(":"))


def pseudonym(mac: Column) -> Column:
    """Deterministic locally administered address; safe addresses keep themselves."""
    return _pseudonym_of(normalise_mac(mac))


def _pseudonym_of(plain: Column) -> Column:
    octets = F.regexp_replace(F.substring(F.sha2(plain, 256), 1, 10), "(..)", ":$1")
    return F.when(plain.isin(SAFE_MACS), plain).otherwise(F.concat(F.lit("02"), octets))


def replace_literals(text: Column, mapping: dict[str, str]) -> Column:
    """Replace each key by its value, longest key first; a later key sees what earlier ones have made.

    Few entries become nested calls. Of many, a text has but a few, so each text's own pieces are looked up
    among the keys instead of trying every key on it.
    """
    ordered = sorted(mapping.items(), key=lambda pair: len(pair[0]), reverse=True)
    if len(ordered) > NESTED_ENTRIES:
        return _replace_many(ordered)(text)
    for old, new in ordered:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def replace_in_order(text: str, ordered: list[tuple[str, str]], places: dict[int, dict[str, int]]) -> str:
    """The text after all entries in turn; those that do not occur when their turn comes are passed over.

    ``places`` has the number of each key in ``ordered``, by length of the key, longest first.
    """
    for length, keys in places.items():
        at = -1
        while True:
            pieces = {text[i : i + length] for i in range(len(text) - length + 1)}
            later = [keys[p] for p in pieces if p in keys and keys[p] > at]
            if not later:
                break
            at = min(later)
            text = text.replace(*ordered[at])
    return text


def _replace_many(ordered: list[tuple[str, str]]):
    places: dict[int, dict[str, int]] = {}
    for number, (old, _) in enumerate(ordered):
        places.setdefault(len(old), {})[old] = number

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: replace_in_order(t, ordered, places), na_action="ignore")

    return replaced


def replace_home_paths(text: Column) -> Column:
    return F.regexp_replace(text, HOME_PATTERN, HOME_REPLACEMENT)


def macs_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MAC_PATTERN), F.lit(0))


def replace_macs(text: Column) -> Column:
    """Every address in the text becomes its pseudonym; safe ones stay as written."""

    def changed(found: Column) -> Column:
        plain = F.replace(F.lower(found), F.lit("-"), F.lit(":"))
        return F.when(plain.isin(SAFE_MACS), found).otherwise(_pseudonym_of(plain))

    between = F.split(text, MAC_PATTERN, -1)
    closed = F.concat(F.transform(macs_in(text), changed), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, closed, lambda a, b: F.concat(a, b)), "")


def scrub_names(text: Column, ssid_map: dict[str, str], path_map: dict[str, str]) -> Column:
    """Network names, then mapped paths, then home paths. Addresses come after these."""
    text = replace_literals(replace_literals(text, ssid_map), path_map)
    return replace_home_paths(text)
