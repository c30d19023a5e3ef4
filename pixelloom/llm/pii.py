"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, schemes and identifier cues. Each anchor goes to a
parser of its kind, which reads outwards from it, code point by code point, until the rule of its kind ends, and
validates what it has read. The parsers never go back over what their kind has taken, so a text is read once for a kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, pick, small_batches

#: Kinds in their order; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account")

# Schemes and cues, in any case.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "iban", "passport", "ssn", "customer id", "user id", "member id")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = re.compile(r"[A-Za-z0-9-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
CARD_RUN = re.compile(r"[0-9](?:[ -]?[0-9])*")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
PHONE_RUN = re.compile(r"[ ().0-9-]*")
HOST = re.compile(r"(?:[A-Za-z0-9._~%!$&'()*+,;=:-]*@)?(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+(?::[0-9]{1,5})?")
PATH = re.compile(r"[/?#][A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*")
JOIN = re.compile(r"(?:[ ]?(?:number|no\.?|num|#|id))?[ ]?[:=#]?[ ]?\"?", re.IGNORECASE)
#: Letters and digits of an identifier at most, and a group of it: one more is read, so that a longer group shows.
LONGEST = 34
GROUP = re.compile(rf"[A-Za-z0-9]{{1,{LONGEST + 1}}}")


@lru_cache(1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def small(digits: str) -> bool:
    """At most 255; any number of leading zeros."""
    rest = digits.lstrip("0")
    return len(rest) <= 3 and int(rest or 0) <= 255


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data in a text, by start, then in the order of KINDS; null: none.

    Places are code points, ends exclusive. Base kinds are the leftmost non-overlapping matches of their rules; a match
    that fails its check is dropped, and what it covers isn't tried again. Spans of several kinds may overlap.
    """
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    n, email_to, dotted_to, card_to, phone_to, url_to, account_to = len(text), 0, 0, 0, 0, 0, 0
    lower = text.lower() if text.isascii() else as_bytes(text).lower().decode("utf-8", "surrogatepass")  # A-Z only: places stay
    for last, (kind, length) in automaton().iter(lower):
        at = last - length + 1
        if kind == "digit":
            # Both rules start at the leftmost digit of a run and read on as far as they can.
            if at >= card_to:
                card_to = CARD_RUN.match(text, at).end()
                digits = text[at:card_to].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, card_to, "card"))
            if at >= dotted_to:
                chain = DOTTED.match(text, at)
                dotted_to = chain.end()
                if chain[0].count(".") >= 3:
                    groups = [(m.start(), m.end()) for m in DIGITS.finditer(text, at, dotted_to)]
                    for k in range(0, len(groups) - 3, 4):  # four groups make a match; the next one starts after it
                        four = groups[k : k + 4]
                        if all(small(text[a:b]) for a, b in four):
                            out.append((four[0][0], four[3][1], "ip"))
        elif kind == "at":
            start = at
            while start > email_to and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_to = m.end()
                out.append((start, email_to, "email"))
        elif kind == "plus":
            if at >= phone_to and at + 1 < n and text[at + 1] in "0123456789":
                end = PHONE_RUN.match(text, at + 2).end()
                while end > at + 3 and text[end - 1] not in "0123456789":
                    end -= 1
                if end > at + 3:
                    phone_to = end
                    if 9 <= sum(c in "0123456789" for c in text[at:end]) <= 15:
                        out.append((at, end, "phone"))
        elif kind == "scheme":
            if at >= url_to and (at == 0 or not text[at - 1].isalnum()) and (m := HOST.match(text, last + 1)):
                url_to = m.end()
                if p := PATH.match(text, url_to):
                    url_to = max(url_to, url_to + len(p[0].rstrip(".,;:!?'()")))
                out.append((at, url_to, "url"))
        elif at >= account_to and (at == 0 or not text[at - 1].isalnum()) and (span := account(text, last + 1)):
            account_to = span[1]
            out.append((*span, "account"))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[2]]))


def account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier right after a cue: from 6 to 34 letters and digits with four digits at least, or an IBAN."""
    at_first = start = JOIN.match(text, at).end()
    # Groups, parted by one space or hyphen, belong to it as long as they have a digit: words that follow don't. The
    # reading ends at the first that doesn't, or beyond LONGEST, so a cue costs the same whatever follows.
    end, size, digits = start, 0, 0
    while start > at and (m := GROUP.match(text, start)):
        has = sum(c in "0123456789" for c in m[0])
        size += len(m[0])
        if not has or size > LONGEST:
            size -= len(m[0])
            break
        end, digits = m.end(), digits + has
        start = end + 1 if text[end : end + 1] in (" ", "-") else len(text)
    return (at_first, end) if size >= 6 and digits >= 4 else None


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redacted(text: str | None) -> str | None:
    """The text with <KIND> for each span; of spans that overlap, one mark named after the first."""
    found = spans(text)
    if not found:
        return text
    out, to, kind, at = [], 0, None, 0
    for a, b, k in found:
        if kind is not None and a < to:
            to = max(to, b)
            continue
        if kind is not None:
            out.append(f"<{kind.upper()}>")
            at = to
        out.append(text[at:a])
        to, kind = b, k
    return "".join([*out, f"<{kind.upper()}>", text[to:]])


_FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each kind, base_sha256 and spans of every row.

    Null and empty texts have no spans: counts of 0 and the hash of the empty text. Repeated rows come out as often.
    A null doc_id stays null. An empty table gives no rows. Other columns of docs don't matter.
    """
    small_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = set(KINDS[:4])
        for batch in batches:
            out: list[list] = [[] for _ in _FOUND]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = spans(text)
                kinds = [k for _, _, k in found]
                row = [doc_id, *[kinds.count(k) for k in KINDS], hashlib.sha256(joined([s for s in found if s[2] in base]).encode()).hexdigest(), joined(found)]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _FOUND.types, strict=True)], schema=_FOUND)

    return pick(docs, "doc_id", "text").mapInArrow(find, "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The columns of documents with marks for personal data; n_chars follows the new text. A null text stays null."""
    small_batches(docs.sparkSession)
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: batch.column(c).to_pylist() for c in kinds.names}
            new = [redacted(t) for t in own["text"]]
            own["n_chars"] = [k if t is None or t == o else len(t) for k, t, o in zip(own["n_chars"], new, own["text"], strict=True)]
            own["text"] = new
            yield pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) for f in kinds], schema=kinds)

    return pick(docs, *kinds.names).mapInArrow(mark, "doc_id bigint, text string, lang string, source string, n_chars bigint")
