"""Personal data and secrets by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, colons, address schemes, cues of identifiers and
secrets, and beginnings of well-known keys. From each
anchor a deterministic local parser expands left and right to the boundaries of one kind and validates what it has.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from kinespark.llm.common import keyed_text, small_batches, spread

#: Kinds in the order of the digests; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "ssn", "account", "secret", "ipv6")
BASE = KINDS[:4]

# Schemes, and cues before which an identifier may stand, in lower case.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account", "passport": "account"}
SECRET_CUES = ("token", "secret", "password", "passwd", "passphrase", "pwd", "api_key", "api-key", "apikey", "api key", "access_key", "access-key", "access key", "auth_key", "private_key", "private-key", "client_secret", "bearer", "authorization", "credential")
KEY_STARTS = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "rk_live_", "AKIA", "ASIA", "AIza", "xoxb-", "xoxp-", "xoxa-", "hf_", "npm_", "pypi-", "eyJ")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+")
_LINK = re.compile(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+")
_AFTER_CUE = re.compile(r"[\x20\t]*(?:no|nr|number|num)?[.:#=\x20\t-]{0,4}", re.ASCII | re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"[A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,17}(?![A-Za-z0-9])")
#: Between a cue and its secret: the rest of a name, a sign, quotes; or just blanks, as behind "Bearer".
_ASSIGNED = re.compile(r"[A-Za-z0-9_-]{0,24}[\"'`]?[\x20\t]*(?:=>|:=|==|[:=]|\bis\b)[\x20\t]*(?:[Bb]earer[\x20\t]+)?[\"'`]?|[\x20\t]+")
_SECRET = re.compile(r"[A-Za-z0-9_./+=~-]+")
_CHOSEN = re.compile(r"[^\s\"'`,;<>]+")
_HEX_GROUPS = frozenset("0123456789abcdefABCDEF:")
_DIGITS = "0123456789"


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for mark in "@+":
        a.add_word(mark, (mark, 1))
    for d in _DIGITS:
        a.add_word(d, ("0", 1))
    for scheme in SCHEMES:
        for form in (scheme, scheme.upper(), scheme.capitalize()):
            a.add_word(form, (":", len(form)))
    for cue, kind in CUES.items():
        for form in (cue, cue.upper(), cue.capitalize(), cue.title()):
            a.add_word(form, (kind, len(form)))
    a.add_word(":", ("6", 1))
    for cue in SECRET_CUES:
        for form in (cue, cue.upper(), cue.capitalize(), cue.title()):
            a.add_word(form, ("secret" if cue[:4] != "pass" and cue != "pwd" else "chosen", len(form)))
    for start in KEY_STARTS:
        a.add_word(start, ("key", len(start)))
    a.make_automaton()
    return a


_FINDER = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _secret_end(text: str, begin: int, least: int) -> int:
    """End of a secret that begins there, or begin: letters and digits mixed, or hexadecimal, of so many at least."""
    value = _SECRET.match(text, begin)
    end = begin + len(value[0].rstrip("./=-")) if value else begin
    own = text[begin:end]
    return end if end - begin >= least and any(c in _DIGITS for c in own) and any(map(str.isalpha, own)) else begin


def _ipv6_span(text: str, at: int) -> tuple[int, int] | None:
    start = end = at
    while start and text[start - 1] in _HEX_GROUPS and at - start < 40:
        start -= 1
    while end < len(text) and text[end] in _HEX_GROUPS and end - at < 40:
        end += 1
    if text[end - 1] == ":" and text[end - 2 : end] != "::":
        end -= 1
    own = text[start:end]
    if (start and (text[start - 1].isalnum() or text[start - 1] in "_.")) or (end < len(text) and (text[end].isalnum() or text[end] == "_")) or own.count(":") < 2 or sum(map(bool, own.split(":"))) < 3:
        return None
    try:
        ipaddress.IPv6Address(own)
    except ValueError:
        return None
    return start, end


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, by start, in code points, the end exclusive. Spans of one kind do not overlap."""
    text = text or ""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(("@", "+", "ip", "card", ":", "iban", "ssn", "account", "secret", "6"), 0)
    for last, (mark, size) in _FINDER.iter(text):
        at = last - size + 1
        if mark == "0":
            if at >= done["ip"]:  # a chain of numbers with dots; each four numbers of it are one address
                chain = _DOTTED.match(text, at)
                done["ip"] = chain.end()
                parts = chain[0].split(".")
                start = at
                for k in range(0, len(parts) - 3, 4):
                    end = start + sum(map(len, parts[k : k + 4])) + 3
                    if all(map(_small, parts[k : k + 4])):
                        out["ip"].append((start, end))
                    start = end + 1
            if at >= done["card"]:
                group = _GROUPED.match(text, at)
                if group:
                    done["card"] = group.end()
                    digits = group[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(group.span())
        elif mark == "@":
            start, least = at, done["@"]
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                domain = _LABELS.match(text, at + 1)
                if domain:
                    out["email"].append((start, domain.end()))
                    done["@"] = domain.end()
        elif mark == "+":
            if at >= done["+"]:
                run = _DIALLED.match(text, at)
                if run:
                    number = run[0].rstrip(" ().-")
                    if len(number) >= 4:
                        done["+"] = at + len(number)
                        if 9 <= sum(map(number.count, _DIGITS)) <= 15:
                            out["phone"].append((at, at + len(number)))
        elif mark == ":":
            if at >= done[":"]:
                link = _LINK.match(text, at + size)
                if link:
                    end = at + size + len(link[0].rstrip(".,;:!?)'"))
                    if end > at + size:
                        out["url"].append((at, end))
                        done[":"] = end
        elif mark == "6":
            if at >= done["6"]:
                found = _ipv6_span(text, at)
                if found:
                    out["ipv6"].append(found)
                    done["6"] = found[1]
        elif mark == "key":
            if at >= done["secret"] and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
                end = _secret_end(text, at, 20)
                if end > at:
                    out["secret"].append((at, end))
                    done["secret"] = end
        elif mark in ("secret", "chosen"):
            gap = _ASSIGNED.match(text, last + 1)
            begin = gap.end() if gap else last + 1
            if gap and begin >= done["secret"]:
                end = _secret_end(text, begin, 16)
                if end == begin and mark == "chosen" and not gap[0].isspace():  # a person chose it: any form
                    value = _CHOSEN.match(text, begin)
                    end = value.end() if value and value.end() - begin >= 6 and any(not c.isalpha() for c in value[0]) else begin
                if end > begin:
                    out["secret"].append((begin, end))
                    done["secret"] = end
        else:
            if (at and text[at - 1].isalnum()) or last + 1 < len(text) and text[last + 1].isalpha():
                continue
            begin = _AFTER_CUE.match(text, last + 1).end()
            found = (_IBAN if mark == "iban" else _SSN if mark == "ssn" else _ACCOUNT).match(text, begin)
            if found is None or begin < done[mark]:
                continue
            if mark == "iban" and not _iban_ok(found[0]) or mark == "ssn" and (found[1] in ("000", "666") or found[1][0] == "9" or found[2] == "00" or found[3] == "0000"):
                continue
            out[mark].append(found.span())
            done[mark] = found.end()
    return out


def written(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each stretch of overlapping spans replaced by the name of the first span's kind."""
    every = sorted((a, -b, KINDS.index(k), k) for k in KINDS for a, b in found[k])
    out, at, end = [], 0, -1
    for a, b, _, kind in every:
        b = -b
        if a >= end:
            out += [text[at:a] if at <= a else "", f"[{kind.upper()}]"]
            end = b
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def find_personal_data(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Counts, digest and spans of personal data, a row for each row of documents, and the redacted text if asked for.

    Null texts count as empty and stay null when redacted; texts without personal data have zeros and empty strings; equal
    texts and repeated rows get equal results; texts of any length are read whole; other columns are not read. Base kinds
    are counted and digested apart from those that the method adds.
    """
    small_batches(documents.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string" + ", redacted string" * with_text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [spans(t) for t in texts]
            columns = [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS]
            columns.append(pa.array([hashlib.sha256(written(f, BASE).encode()).hexdigest() for f in found], pa.string()))
            columns.append(pa.array([written(f, KINDS) for f in found], pa.string()))
            if with_text:
                columns.append(pa.array([t if t is None else redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", *counts, "base_sha256", "spans", *["redacted"] * with_text])

    return keyed_text(documents, id_col, text_col).mapInArrow(work, schema)


def redact_column(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of documents, the text column redacted; null and empty texts stay as they are."""
    small_batches(documents.sparkSession)
    at = documents.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = pa.array([t if t is None else redact(t, spans(t)) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names)

    return spread(documents).mapInArrow(work, documents.schema)
