"""Signatures, family keys and fingerprints against a plain reading, token by token and without a bound on depth."""

import hashlib
import random
import re
import sys

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldlog.operators import parse as P
from foldlog.operators import signatures as S

sys.setrecursionlimit(20_000)


def number(v, exact):
    return v.upper() if exact else "0x#" if re.fullmatch(S.HEX, v) else "#" + (re.search("([A-Za-z]*|%)$", v)[0].upper() or "N")


def plain_part(t, exact, family):
    low, short = t.lower().strip(S.MARKS), lambda x: re.sub(S.VOWELS, "", x).upper()
    if not low or family and low in S.STOP_WORDS:
        return ""
    if re.fullmatch(S.CODE, t):
        return t.upper()
    if re.fullmatch(S.HEX, t):
        return "0x#" if family else t.upper()
    if re.fullmatch(S.NUMBER, t):
        return number(t, exact)
    if low in S.DOMAIN_TERMS:
        return S.DOMAIN_TERMS[low]
    if (m := re.search("[=:]", t)) is not None:
        k, v = t[: m.start()], t[m.end() :]
        if family and k.lower() in S.CONTEXT_KEYS:
            return ""
        measured = re.fullmatch(S.NUMBER, v) or re.fullmatch(S.HEX, v)
        return short(k)[:6] + "=" + (number(v, exact) if measured else plain(v, False, True)[:6] if family and k.lower() not in S.ENUM_KEYS else short(v)[:8])
    return re.sub("[^A-Z0-9_.:/+-]", "", re.sub(r"([^0-9])\1+", r"\1", short(t)))[: 8 if family else 10]


def plain(text, exact=True, family=False):
    parts = [p for p in (plain_part(t, exact, family) for t in re.findall(S.TOKEN, text)) if p]
    return ".".join(parts[: 12 if family else 16]) or "EMPTY"


PIECES = st.sampled_from(["a", "e", "=", ":", "ecu", "cyl", "Balloon", "the", "temp", "97C", "2.4bar", "0xFf", "P0301", "SPN12", "DTC:", "-", ".", "/", " ", "  ", "+5%", "guided-test", "Ä", "x", "misfire", "_", "12", ",", "("])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=1, max_size=20), st.booleans(), st.booleans())
def test_signatures_are_the_plain_reading(texts, exact, family):
    assert S.signatures(pd.Series(texts, dtype=object), exact, family).tolist() == [plain(t, exact, family) for t in texts]


@pytest.mark.parametrize("link", ["a=", "=", "e:", "ab=", "abc=ee:", "o=u=i="])
def test_pairs_in_pairs_to_any_depth(link):
    texts = [link * n + end for n in (1, 2, 5, 6, 7, 8, 9, 40, 800) for end in ("temp", "97C", "ecu=1", "", "zz")]
    assert S.signatures(pd.Series(texts, dtype=object), False, True).tolist() == [plain(t, False, True) for t in texts]
    assert len(S.signatures(pd.Series(["a=" * 200_000]), False, True)[0]) == 7


def plain_event(raw):
    """(signature, family, fingerprint) of a line, from what parse_lines() tests say of its other parts."""
    severity = re.search(P.SEVERITY, raw)
    severity = P.SEVERITY_ALIASES[severity[1].upper()] if severity else "INFO"
    named, known = re.search(P.MODULE_FIELD, raw), re.search(P.MODULE, raw)
    ecu = named[1].upper()[:12] if named else known[1].upper() if known else "GEN"
    codes = list(dict.fromkeys(c.upper().replace(" ", "") for c in re.findall(S.CODE, raw)))
    fields = {k.lower(): v for k, v in re.findall(P.FIELD, raw)}
    text = re.sub(P.SEVERITY, "", re.sub(P.TIMESTAMP, "", raw))
    text = re.sub(r"(?i)\b(?:ECU|module|source)\s*(?:=|:)\s*[A-Za-z0-9_-]+", "", text).strip(" -|[]")
    sig, shown = plain(text, False, True), []
    for k in [k for k in sorted(fields) if k not in S.CONTEXT_KEYS][:5]:
        v = fields[k]
        measured = re.fullmatch(S.NUMBER, v) or re.fullmatch(S.HEX, v)
        shown.append(plain(k, True, True)[:6] + "=" + (plain(v, True, True)[:8] if k in S.ENUM_KEYS else number(v, False) if measured else plain(v, False, True)[:8]))
    family = f"{ecu}:{severity}:{codes[0] if codes else 'NO_CODE'}:{sig[:32]}:{','.join(shown) if fields else '-'}"
    return sig, family, hashlib.blake2s("|".join((severity, ecu, ",".join(codes), sig)).encode(), digest_size=5).hexdigest().upper()


def test_lines_are_the_plain_reading(spark):
    rng = random.Random(3)
    words = ["engine", "misfire", "temp=97C", "temp=103C", "cyl=2", "cylinder=one", "axle:=x", "DTC:P0301", "SPN 1234", "FMI 5", "ECU=mcm", "source: a-very-long-module-name", "k=(v=1;2)", "path=/a/b.c:80", "ERROR", "warn", "2024-01-02T03:04:05Z", "P0301", "p0301", "0x1F", "note:ok", "a=b=c=d", "Temperature", "|", "[x]", "é=ü", "rate=5%", "zeta=1", "beta=2", "gamma=three", "delta=4", "eps=5V"]
    raws = [" ".join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(300)] + ["x" * 50_000, "k=" * 4000 + "v", "=", "ecu=1"]
    rows = [("a", i, r) for i, r in enumerate(raws)] + [("a", -1, None), ("a", -2, "  ")]
    got = {r.raw: (r.signature, r.family, r.fingerprint) for r in P.parse_lines(spark.createDataFrame(rows, "log_id string, line_no int, raw string")).collect()}
    assert got == {r: plain_event(r) for r in raws}


def test_drifting_measures_are_one_family(spark):
    lines = ["ECU=MCM P0301 engine misfire cylinder=1 temperature=97C pressure=2.4bar voltage=23.9V", "ECU=MCM P0301 engine misfire cylinder=1 temperature=103C pressure=2.9bar voltage=24.4V"]
    got = P.parse_lines(spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)], "log_id string, line_no int, raw string")).collect()
    assert len({(r.signature, r.family, r.fingerprint) for r in got}) == 1
    assert "#C" in got[0].signature and "#BAR" in got[0].signature and "97C" not in got[0].family
