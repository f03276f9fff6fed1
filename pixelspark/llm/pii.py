"""PII by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, schemes, identifier cues, plus signs before a digit and digits. From
each anchor a small deterministic parser expands to the left and right and validates: emails, IPv4 addresses, card and
phone numbers (the base kinds), URLs, keys after cues (password, token, access keys) and IBAN-like accounts.

The base kinds equal the leftmost non-overlapping matches, per kind, of
    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)            parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                             16 to 19 digits that pass Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                       8 to 15 digits
where a match that fails its check is dropped and not retried. Spans are half-open, in code points.

Defined results: a null text is the empty text, without spans; repeated rows get equal results; an empty table gives no
rows. Work is linear in the text, whatever its length. Only key and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices

# The character classes and cues of the patterns above.
DIGITS = frozenset("0123456789")
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = WORD | frozenset("._%+-")
DOMAIN = WORD | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URL_END = frozenset(" \t\r\n\v\f\"'<>`")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")
KEY_PREFIXES = ("AKIA", "ASIA")
ACCOUNT_CUES = ("IBAN", "iban")
KINDS = ("email", "ip", "card", "phone", "url", "secret", "access_key", "account")
BASE_KINDS = KINDS[:4]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (v * 2 if v < 5 else v * 2 - 9)
    return total % 10 == 0


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The email around the at-sign, not reaching before floor."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    n, end, labels = len(text), at + 1, 0
    while True:
        stop = end
        while stop < n and text[stop] in DOMAIN:
            stop += 1
        if stop == end:
            end -= 1  # the dot before it is not part of the match
            break
        labels, end = labels + 1, stop
        if end < n and text[end] == ".":
            end += 1
        else:
            break
    return (start, end) if labels >= 2 else None


def ip_at(text: str, start: int) -> tuple[int, bool]:
    """(end of the match or of the digits that cannot start one, whether it is an address)."""
    n, end, parts = len(text), start, []
    while len(parts) < 4:
        stop = end
        while stop < n and text[stop] in DIGITS:
            stop += 1
        if stop == end:
            return -1, False
        parts.append(text[end:stop])
        end = stop
        if len(parts) < 4:
            if end >= n or text[end] != ".":
                return -1, False
            end += 1
    return end, all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)


def card_at(text: str, start: int) -> tuple[int, bool]:
    n, end, digits = len(text), start + 1, [text[start]]
    while end < n:
        if text[end] in DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return end, 16 <= len(digits) <= 19 and luhn("".join(digits))


def phone_at(text: str, start: int) -> tuple[int, bool]:
    """From a plus sign: (end or -1, whether the digits are 8 to 15)."""
    n, end = len(text), start + 2
    if end > n or text[start + 1] not in DIGITS:
        return -1, False
    last = -1
    while end < n and text[end] in PHONE:
        if text[end] in DIGITS:
            last = end
        end += 1
    if last < start + 3:
        return -1, False
    return last + 1, 8 <= sum(c in DIGITS for c in text[start : last + 1]) <= 15


def url_at(text: str, start: int) -> int:
    n, end = len(text), start
    while end < n and text[end] not in URL_END:
        end += 1
    while end > start and text[end - 1] in ".,;:!?)]}":
        end -= 1
    return end


def run_at(text: str, start: int, allowed: frozenset, most: int | None = None) -> int:
    n, end = len(text) if most is None else min(len(text), start + most), start
    while end < n and text[end] in allowed:
        end += 1
    return end


def secret_at(text: str, after: int) -> tuple[int, int] | None:
    """The value after a cue, an equals sign or colon, optional blanks and quotes: 8 letters, digits or more."""
    at = run_at(text, after, frozenset(" "))
    if at >= len(text) or text[at] not in "=:":
        return None
    at = run_at(text, at + 1, frozenset(" \"'"))
    end = run_at(text, at, WORD | frozenset("_-+/."))
    while end > at and text[end - 1] == ".":
        end -= 1
    return (at, end) if end - at >= 8 else None


def iban_at(text: str, after: int) -> tuple[int, int] | None:
    """Two letters, two digits and 11 to 30 letters or digits in groups, whose ISO 7064 remainder is 1."""
    at = run_at(text, after, frozenset(" :#"))
    end, kept = at, []
    while end < len(text) and len(kept) < 34 and (text[end] in WORD or text[end] == " " and end + 1 < len(text) and text[end + 1] in WORD):
        if text[end] != " ":
            kept.append(text[end].upper())
        end += 1
        if len(kept) >= 15:
            s = "".join(kept)
            if s[:2].isalpha() and s[2:4].isdigit() and (end >= len(text) or text[end] not in WORD) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
                return at, end
    return None


def build_automaton():
    import ahocorasick

    cues = {"@": "email", "+": "plus"} | dict.fromkeys(DIGITS, "digit") | dict.fromkeys(SCHEMES, "url") | dict.fromkeys(SECRET_CUES, "secret") | dict.fromkeys(KEY_PREFIXES, "access_key") | dict.fromkeys(ACCOUNT_CUES, "account")
    automaton = ahocorasick.Automaton()
    for cue, kind in cues.items():
        automaton.add_word(cue, (kind, len(cue)))
    automaton.make_automaton()
    return automaton


def find_spans(text: str, automaton) -> list[tuple[int, int, int]]:
    """(index in KINDS, start, end), sorted."""
    found: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)  # where the next match of a kind may start
    digits_end = 0  # an ip cannot start inside digits it already failed on with more parts to the left
    for last, (kind, size) in automaton.iter(text):
        start = last - size + 1
        if kind == "digit":
            if start >= done[2]:
                end, good = card_at(text, start)
                done[2] = end
                if good:
                    found.append((2, start, end))
            if start >= done[1] and start >= digits_end:
                end, good = ip_at(text, start)
                if end < 0:
                    digits_end = run_at(text, start, DIGITS)  # every later start in these digits fails likewise
                else:
                    done[1] = end
                    if good:
                        found.append((1, start, end))
        elif kind == "email":
            if span := email_at(text, start, done[0]):
                done[0] = span[1]
                found.append((0, *span))
        elif kind == "plus":
            if start >= done[3] and start + 1 < len(text) and text[start + 1] in DIGITS:
                end, good = phone_at(text, start)
                if end >= 0:
                    done[3] = end
                    if good:
                        found.append((3, start, end))
        elif kind == "url":
            if start >= done[4]:
                end = url_at(text, start)
                if end > last + 1:
                    done[4] = end
                    found.append((4, start, end))
        elif kind == "secret":
            if (span := secret_at(text, last + 1)) and span[0] >= done[5]:
                done[5] = span[1]
                found.append((5, *span))
        elif kind == "access_key":
            end = run_at(text, start, WORD, 21)  # one more than a key has: cues in a long word cost no walk to its end
            if end - start == 20 and start >= done[6] and (start == 0 or text[start - 1] not in WORD):
                done[6] = end
                found.append((6, start, end))
        elif (span := iban_at(text, last + 1)) and span[0] >= done[7]:
            done[7] = span[1]
            found.append((7, *span))
    return sorted(found)


_automaton = None


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    global _automaton
    _automaton = _automaton or build_automaton()
    for batch, raw, at in slices(batches, "text"):
        data = raw.tobytes()
        counts: list[list[int]] = [[] for _ in KINDS]
        base, spans, found_all = [], [], []
        for i in range(len(at) - 1):
            found = find_spans(data[at[i] : at[i + 1]].decode("utf-8", "replace"), _automaton)
            named = [f"{KINDS[k]}:{a}:{b}" for k, a, b in found]
            n_base = sum(k < 4 for k, _, _ in found)
            for k in range(len(KINDS)):
                counts[k].append(sum(x[0] == k for x in found))
            base.append(hashlib.sha256(",".join(named[:n_base]).encode()).hexdigest())
            spans.append(",".join(named))
            found_all.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(found_all, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
            names=["key", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "found"],
        )


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_<kind> of the base kinds, base_sha256, spans, n_<kind> of the others, found array of (kind, start, end)) of every whole text."""
    schema = f"key {docs.schema[key].dataType.simpleString()}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_finder, schema).select("key", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", *[f"n_{k}" for k in KINDS[4:]], "found").withColumnRenamed("key", key)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """Each span as <KIND>; of overlapping spans the one that starts first, then the longer, gives the name, and the rest of the later one goes with it."""
    out, at = [], 0
    for k, start, end in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[k].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redactor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    global _automaton
    _automaton = _automaton or build_automaton()
    for batch, raw, at in slices(batches, "text"):
        data = raw.tobytes()
        texts = []
        for i in range(len(at) - 1):
            text = data[at[i] : at[i + 1]].decode("utf-8", "replace")
            found = find_spans(text, _automaton)
            texts.append(redact(text, found) if found else text)
        new = pa.array([t if ok else None for t, ok in zip(texts, batch.column("text").is_valid().to_pylist())], pa.string())
        yield pa.RecordBatch.from_arrays([new if n == "text" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every found span of the text replaced by its kind; all columns and rows stay, a null text stays null."""
    names = ["text" if c == text else f"c{i}" for i, c in enumerate(docs.columns)]  # clashing column names are safe
    renamed = docs.toDF(*names)
    return renamed.mapInArrow(_redactor, renamed.schema).toDF(*docs.columns)
