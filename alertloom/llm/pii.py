"""Personal data: fixed patterns, and a linear-chain random field that adds what they miss.

The field is trained on a small labelled table below and on pattern spans of about
``SAMPLE_ROWS`` documents chosen by hashed id and text, at most ``spans.SAMPLE_PIECES`` sequences of them; it is decoded by Viterbi in numpy batches.

Defined results: a null text is empty and has no spans; repeated rows are searched each by itself; an
empty table gives an empty result (the field then knows the labelled table only). Texts of any length are
searched whole.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm import spans
from alertloom.llm.crf import Field

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 2000
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# A small labelled table; kinds as above.
LABELLED = (
    "please write to [[email|anna.berg@post.example.org]] before noon",
    "mail [[email|j_doe99@corp-mail.example]] or call [[phone|+44 20 7946 0958]] today",
    "contact: [[email|info@example.net]], phone [[phone|+49 (30) 901820]].",
    "her number is [[phone|555-867-5309]] at home",
    "call me at [[phone|(212) 555-0147]] after five",
    "tel [[phone|030 1234567]] or fax",
    "the host [[ip|10.0.12.7]] did not answer [[ip|192.168.1.44]]",
    "login from [[ip|203.0.113.9]] port 22 failed",
    "charged card [[card|4111 1111 1111 1111]] on Monday",
    "card number [[card|5500-0000-0000-0004]] expires 12/27",
    "paid with [[card|4012888888881881]] yesterday",
    "in 2019 the 3 teams met 45 times in room 12",
    "version 1.2.3 was followed by 1.2.4 on 2021-05-03",
    "chapter 4 section 2.10 page 133",
    "order 123456 of 7 items costs 19.99 each",
    "total = 14 + 28 and ratio 3:1 at 10:45",
    "see figure 3 (page 17) and table 2",
    "price +5 percent in 2020 and -3 in 2021",
    "the meeting @ noon with 4 guests",
    "a population of 1 204 000 in 1998",
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[spans.Span]:
    """Leftmost matches: every sign @ with the run before it and the domain behind it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        hit = _DOMAIN.match(text, at) if start < at else None
        if hit:
            out.append(("email", start, hit.end()))
            done = hit.end()
        at = text.find("@", max(done, at + 1))
    return out


def rules(text: str) -> list[spans.Span]:
    """Spans of the fixed patterns; matches that fail their check are dropped."""
    out = emails(text)
    for hit in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
               for p in hit.group().split(".")):
            out.append(("ip", *hit.span()))
    for hit in _CARD.finditer(text):
        digits = hit.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *hit.span()))
    if "+" in text:
        for hit in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in hit.group()) <= 15:
                out.append(("phone", *hit.span()))
    return out


def field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rows: int = SAMPLE_ROWS) -> Field:
    return spans.trained(docs, id_col, text_col, Field(KINDS, "@+"), LABELLED, rules, rows)


def find(docs: DataFrame, model: Field, text: Column | None = None) -> Column:
    """Struct of n_email, n_ip, n_card, n_phone, base_sha256, spans, starts and ends."""
    return spans.finder(docs, model, rules, KINDS, F.col("text") if text is None else text)
