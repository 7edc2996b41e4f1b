"""Personal data by anchor expansion: one Aho-Corasick pass over a text finds anchors, local parsers do the rest.

Anchors are at-signs, plus signs, digits, schemes and identifier cues. At each anchor a parser for that kind expands
to the left and right, decides the boundaries and validates. Parsers run in time linear in what they read, and what
a parser has consumed it never reads again, so a text of any length costs one pass.

Base kinds, leftmost and non-overlapping within a kind; a match that fails its check is dropped and not retried:

=======  ==========================================================  ==================================
email    ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
ip       ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``                 every part at most 255
card     ``[0-9]([\\x20-]?[0-9])+``                                  14 to 19 digits, Luhn
phone    ``\\+[0-9][\\x20().0-9-]+[0-9]``                            10 to 15 digits
=======  ==========================================================  ==================================

Further kinds: ``url`` (an address with a scheme and user information before the host), ``iban`` (check digits
right), ``account`` (a cue such as "account no" and the identifier after it, or a cloud access key).

Null and empty texts have no spans. Places are code points, ends exclusive. Rows and other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account")
RANK = {kind: i for i, kind in enumerate(KINDS)}
SPANS_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
CONTACT_SCHEMES = ("://",)
KEY_CUE = "AKIA"


class Finder:
    """Anchors and parsers; one per task."""

    def __init__(self) -> None:
        self.anchors = ahocorasick.Automaton()
        for digit in "0123456789":
            self.anchors.add_word(digit, ("digit", 1))
        for cue in CONTACT_SCHEMES:
            self.anchors.add_word(cue, ("scheme", len(cue)))
        for cue in ACCOUNT_CUES:
            for form in (cue, cue.capitalize(), cue.upper()):
                self.anchors.add_word(form, ("cue", len(cue)))
        for form in ("IBAN", "Iban", "iban"):
            self.anchors.add_word(form, ("iban", 4))
        self.anchors.add_word("@", ("at", 1))
        self.anchors.add_word("+", ("plus", 1))
        self.anchors.add_word(KEY_CUE, ("key", len(KEY_CUE)))
        self.anchors.make_automaton()
        # Possessive: a parser never goes back into what it has read.
        self.domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
        self.run = re.compile(r"[0-9]++").match
        self.quad = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)").match
        self.digits = re.compile(r"[0-9](?:[ -]?[0-9])*+").match
        self.dial = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
        self.authority = re.compile(r"[^\s/?#@]++@[^\s/?#@]++[^\s\"'<>]*+").match
        self.after_iban = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])").match
        self.after_cue = re.compile(r"(?:[ ](?:no|nr|number|id)\b\.?)?[ :#]{1,3}([A-Z]{0,3}[0-9][0-9A-Z-]{4,33})(?![A-Za-z0-9])").match
        self.key = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])").match

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then kind as listed."""
        if not text:
            return []
        out = []
        email_from = quad_from = digits_from = dial_from = url_from = account_from = 0
        for end, (what, size) in self.anchors.iter(text):
            at = end - size + 1
            if what == "digit":
                if at >= digits_from:
                    digits_from = self.digits(text, at).end()
                    if digits_from - at >= 14 and card(text[at:digits_from]):
                        out.append((at, digits_from, "card"))
                if at >= quad_from:
                    if found := self.quad(text, at):
                        quad_from = found.end()
                        if all(at_most_255(part) for part in found.groups()):
                            out.append((at, quad_from, "ip"))
                    else:
                        quad_from = self.run(text, at).end()
            elif what == "at":
                start = at
                while start > email_from and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (found := self.domain(text, at + 1)):
                    email_from = found.end()
                    out.append((start, email_from, "email"))
            elif what == "plus":
                if at >= dial_from and (found := self.dial(text, at)):
                    dial_from = found.end()
                    if 10 <= sum(c in "0123456789" for c in found[0]) <= 15:
                        out.append((at, dial_from, "phone"))
            elif what == "scheme":
                start = at
                while start > url_from and text[start - 1] in SCHEME:
                    start -= 1
                if start < at and (found := self.authority(text, end + 1)):
                    url_from = found.end()
                    out.append((start, url_from, "url"))
            elif what == "iban":
                if (found := self.after_iban(text, end + 1)) and iban(found[1]):
                    out.append((found.start(1), found.end(1), "iban"))
            elif what == "cue":
                if (found := self.after_cue(text, end + 1)) and found.start(1) >= account_from:
                    account_from = found.end(1)
                    out.append((found.start(1), account_from, "account"))
            elif found := self.key(text, end + 1):
                out.append((at, found.end(), "account"))
        out.sort(key=lambda span: (span[0], RANK[span[2]]))
        return out


def at_most_255(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def card(text: str) -> bool:
    """14 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = [ord(c) - 48 for c in text if c not in " -"]
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return 14 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def iban(text: str) -> bool:
    """The remainder by 97 of the rearranged number is one."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by the kind that starts it."""
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


@F.arrow_udf(SPANS_TYPE)
def personal_spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Column function: the spans of a text, by start and kind; an empty array where there are none."""
    finder = Finder()
    for texts in batches:
        yield pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in finder.spans(x.as_py())] for x in texts], ARROW_SPANS)


@F.arrow_udf(T.StringType())
def without_personal_data(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Column function: the text with its spans masked; null stays null."""
    finder = Finder()
    for texts in batches:
        yield pa.array([x and masked(x, finder.spans(x)) for x in (y.as_py() for y in texts)], pa.string())


def find(df: DataFrame, text_col: str = "text", out: str = "personal_spans") -> DataFrame:
    """``df`` with ``out``: array of (kind, start, end)."""
    return df.withColumn(out, personal_spans(F.col(text_col)))


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the personal data of its text masked."""
    return df.withColumn(text_col, without_personal_data(F.col(text_col)))


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of ``kinds``, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
