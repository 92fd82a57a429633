"""Consonant signatures: each distinct token of a batch of lines is shortened once, then put back where it stood.

Tokens are told apart by kind (code, hexadecimal number, number with a unit, domain term, key=value pair, plain word), and
all tokens of a kind are shortened together. The values of pairs are texts of their own, and are shortened the same way,
a level deeper. What shows of a value is at most as long as its cut, and each level spends a character of it on its
"=", so levels end where nothing more would show: the result is that of any depth.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foldlog.functions.text import TOKEN

# Patterns and vocabularies that results depend on.
CODE = r"(?i)\b([PCBU][0-9A-F]{4}|SPN\s*\d+|FMI\s*\d+|DTC[:= -]?[A-Z0-9-]+)\b"
HEX = r"^0x[0-9A-Fa-f]+$"
NUMBER = r"^[-+]?\d+(?:[.,]\d+)?(?:%|[A-Za-z]{1,5})?$"
VOWELS = "[AEIOUÄÖÜaeiouäöü]"
MARKS = ".,;|()[]{}"
DOMAIN_TERMS = {
    "temperature": "TMP", "temp": "TMP", "pressure": "PRS", "voltage": "VLT", "current": "CUR", "misfire": "MSFR", "combustion": "CMB", "irregularity": "IRG", "cylinder": "CYL",
    "engine": "ENG", "emission": "EMS", "emissions": "EMS", "aftertreatment": "AFT", "sensor": "SNSR", "plausibility": "PLSB", "latency": "LAT", "timeout": "TMOT", "torque": "TRQ",
    "brake": "BRK", "fault": "FLT", "diagnostic": "DGN", "diagnostics": "DGN", "xentry": "XTRY", "guided-test": "GDT", "guided": "GDD", "keepalive": "KALV",
}
STOP_WORDS = ["a", "an", "and", "by", "detected", "for", "from", "in", "of", "on", "says", "test", "the", "to", "with"]
CONTEXT_KEYS = ["ecu", "module", "source"]
ENUM_KEYS = ["axle", "cylinder", "cyl", "fmi"]
#: Parts of a signature, characters of a part, for families and for plain texts.
FAMILY_PARTS, PARTS, FAMILY_CUT, CUT = 12, 16, 8, 10
#: Characters that show of a pair's key and of a value below it; of a value that names an item; of a field's value.
KEY_CUT, VALUE_CUT, FIELD_CUT = 6, 6, 8
EMPTY = "EMPTY"


def bare(words: pd.Series) -> pd.Series:
    return words.str.replace(VOWELS, "", regex=True).str.upper()


def is_measure(words: pd.Series) -> pd.Series:
    return words.str.fullmatch(NUMBER) | words.str.fullmatch(HEX)


def measures(words: pd.Series, exact: bool) -> pd.Series:
    """Numbers in upper case, or as the slot of their unit."""
    if exact:
        return words.str.upper()
    unit = words.str.extract("([A-Za-z]+|%)$")[0].str.upper().fillna("N")
    return ("#" + unit).mask(words.str.fullmatch(HEX), "0x#")


def pairs(words: pd.Series, exact: bool, family: bool, room: int) -> pd.Series:
    split = words.str.extract("^([^=:]*)[=:](.*)$", flags=re.S)
    key, value = split[0], split[1]
    name = key.str.lower()
    shown = bare(value).str[:FIELD_CUT]
    number = is_measure(value)
    shown = shown.mask(number, measures(value.where(number, "0"), exact))
    if family:
        deeper = ~number & ~name.isin(ENUM_KEYS) & ~name.isin(CONTEXT_KEYS)
        if deeper.any():
            shown[deeper] = signatures(value[deeper], False, True, min(VALUE_CUT, room - 1)).str[:VALUE_CUT]
    whole = bare(key).str[:KEY_CUT] + "=" + shown
    return whole.mask(name.isin(CONTEXT_KEYS), "") if family else whole


def plain(words: pd.Series, family: bool) -> pd.Series:
    once = bare(words).str.replace(r"([^0-9])\1+", r"\1", regex=True)
    return once.str.replace("[^A-Z0-9_.:/+-]", "", regex=True).str[: FAMILY_CUT if family else CUT]


def shortened(words: pd.Series, exact: bool, family: bool, room: int) -> pd.Series:
    """The part that each token leaves, "" for none; room: how many characters can show."""
    out = pd.Series("", index=words.index, dtype=object)
    low = words.str.lower().str.strip(MARKS)
    term = low.map(DOMAIN_TERMS)
    left = (low != "") & ~(low.isin(STOP_WORDS) & family)
    kinds = [
        (words.str.fullmatch(CODE), lambda x: x.str.upper().str.replace(" ", "")),
        (words.str.fullmatch(HEX), lambda x: x.str.upper() if not family else pd.Series("0x#", index=x.index)),
        (words.str.fullmatch(NUMBER), lambda x: measures(x, exact)),
        (term.notna(), lambda x: term[x.index]),
        (words.str.contains("[=:]"), lambda x: pairs(x, exact, family, room)),
        (pd.Series(True, index=words.index), lambda x: plain(x, family)),
    ]
    for kind, made in kinds:
        these = left & kind.astype(bool)
        if these.any():
            out[these] = made(words[these])
        left &= ~these
    return out


def signatures(texts: pd.Series, exact: bool = True, family: bool = False, room: int = 1 << 30) -> pd.Series:
    """The signature of each text: what its tokens leave, joined by dots; EMPTY where nothing is left."""
    if room <= 0 or not len(texts):
        return pd.Series("", index=texts.index, dtype=object)
    found = [re.findall(TOKEN, t or "") for t in texts]
    numbers, names = pd.factorize(np.array(list(chain.from_iterable(found)), dtype=object))
    parts = shortened(pd.Series(names, dtype=object), exact, family, room).to_numpy() if len(names) else np.array([], dtype=object)
    placed, at, out, most = parts[numbers].tolist() if len(names) else [], 0, [], FAMILY_PARTS if family else PARTS
    for tokens in found:
        kept = [p for p in placed[at : at + len(tokens)] if p]
        at += len(tokens)
        out.append(".".join(kept[:most]) or EMPTY)
    return pd.Series(out, index=texts.index, dtype=object)


def field_values(keys: pd.Series, values: pd.Series) -> pd.Series:
    """What shows of fields' values: items by their own text, numbers by their unit, other values by their signature."""
    item, number = keys.isin(ENUM_KEYS), is_measure(values)
    out = pd.Series("", index=keys.index, dtype=object)
    out[item] = signatures(values[item], True, True).str[:FIELD_CUT]
    out[~item & number] = measures(values[~item & number], False)
    rest = ~item & ~number
    out[rest] = signatures(values[rest], False, True).str[:FIELD_CUT]
    return out


def signature(text: Column, exact: bool = True, family: bool = False) -> Column:
    """The signature of a text column; null counts as empty. exact: numbers stay; family: for the keys of families."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield signatures(texts.fillna(""), exact, family)

    return of(text)


def event_signatures(text: Column, keys: Column, values: Column, before: Column) -> Column:
    """STRUCT<signature, fields, fingerprint> of events.

    text: the line without its prefixes. keys, values: its fields that count, in order. before: what stands before the signature
    in the material of the fingerprint, the first five bytes of its BLAKE2s in upper-case hexadecimal digits.
    """

    @F.pandas_udf("signature string, fields string, fingerprint string")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, names, said, material in batches:
            whole = signatures(texts, False, True)
            flat_names, flat_values = (pd.Series(list(chain.from_iterable(x)), dtype=object) for x in (names, said))
            # equal pairs of a batch are shortened once
            numbers, pair = pd.factorize(pd.MultiIndex.from_arrays([flat_names, flat_values])) if len(flat_names) else (np.array([], int), [])
            one = pd.DataFrame(list(pair), columns=["k", "v"], dtype=object)
            shown = (signatures(one["k"], True, True).str[:KEY_CUT] + "=" + field_values(one["k"], one["v"])).to_numpy()[numbers].tolist() if len(one) else []
            fields, at = [], 0
            for x in names:
                fields.append(",".join(shown[at : at + len(x)]))
                at += len(x)
            prints = [hashlib.blake2s(f"{m}|{s}".encode(), digest_size=5).hexdigest().upper() for m, s in zip(material, whole)]
            yield pd.DataFrame({"signature": whole.to_numpy(), "fields": fields, "fingerprint": prints})

    return of(text, keys, values, before)
