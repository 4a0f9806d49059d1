"""Secret scanning: Aho-Corasick keywords, anchored expressions at the hits, embedded checksums.

One automaton over the whole text finds keyword hits; an expression runs only where a hit begins
(hexadecimal runs, which have no keyword, are anchored at a stride that no long run can avoid).
Kinds with an embedded checksum are reported only if it holds.

Kinds, as listed: assign, access, hex (the base), then github and npm (six base-62 digits that
hold the CRC-32 of the thirty before them), jwt (a JSON header in base 64) and pem (private keys).

Defined results: a null text is empty and has no spans; offsets count code points; repeated rows
give repeated results; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import json
import re
import zlib

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = 3

# Keywords and expressions.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ASSIGN_WORDS) + ")" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
GITHUB = re.compile("(?<![A-Za-z0-9_-])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile("(?<![A-Za-z0-9_-])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,20}PRIVATE KEY-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24


def base62_crc(body: str) -> str:
    """CRC-32 of body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _checksum(m: re.Match) -> bool:
    body = m.group()[4:]
    return base62_crc(body[:30]) == body[30:]


def _header(m: re.Match) -> bool:
    head = m.group().split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError, RecursionError):
        return False


#: By kind: the anchored expression and what a match must pass.
RULES = {
    "assign": (ASSIGN, lambda m: len(m.group(2)) >= ASSIGN_LEAST),
    "access": (ACCESS, lambda m: len(m.group()) >= ACCESS_LEAST),
    "github": (GITHUB, _checksum),
    "npm": (NPM, _checksum),
    "jwt": (JWT, _header),
    "pem": (PEM, lambda m: True),
}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        for spelt in itertools.product(*({c, c.upper()} for c in word)):
            a.add_word("".join(spelt), (len(word), "assign"))
    for word, kind in (("AKIA", "access"), ("npm_", "npm"), ("eyJ", "jwt"), ("-----BEGIN ", "pem"), *((f"gh{c}_", "github") for c in "pousr")):
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


AUTOMATON = _automaton()
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def _hex_anchors(text: str) -> list[int]:
    """Places, in order, that hold a hexadecimal digit; every run of HEX_LEAST has one of them."""
    step = HEX_LEAST // 3
    codes = np.frombuffer(text.encode("ascii") if text.isascii() else text.encode("utf-32-le", "surrogatepass"), np.uint8 if text.isascii() else "<u4")
    at = codes[::step]
    held = _IS_HEX[np.minimum(at, 255)]
    # A run of 3 steps covers two neighbouring anchors at least, and so the places between them.
    both = np.flatnonzero(held[:-1] & held[1:])
    middle = codes[both * step + step // 2]
    return (both[_IS_HEX[np.minimum(middle, 255)]] * step).tolist()


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), ordered by start and then by kind."""
    found: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (length, kind) in sorted((last - x[0] + 1, x) for last, x in AUTOMATON.iter(text)):
        if last < done[kind]:
            continue
        expression, passes = RULES[kind]
        if m := expression.match(text, last):
            done[kind] = m.end()
            if passes(m):
                found.append((m.start(), m.end(), kind))
    for at in _hex_anchors(text):
        if at < done["hex"]:
            continue
        start = at
        while start > done["hex"] and text[start - 1] in "0123456789abcdef":
            start -= 1
        end = HEX.match(text, start).end()
        done["hex"] = end
        if end - start >= HEX_LEAST:
            found.append((start, end, "hex"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each maximal covered stretch replaced by [secret]."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def findings(text: Column) -> Column:
    """Column (n_assign, n_access, n_hex long, base_sha256, spans string) of a text column."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = scan(text or "")
            base = [s for s in spans if KINDS.index(s[2]) < BASE]
            rows.append((*(sum(s[2] == k for s in base) for k in KINDS[:BASE]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found(text.cast("string"))


def redaction(text: Column) -> Column:
    """The text without its secrets; null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, scan(t)) for t in texts], dtype=object)

    return clean(text.cast("string"))
