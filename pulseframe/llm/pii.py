"""Personal data by anchor expansion.

Method. One Aho-Corasick automaton over each text finds the anchors: at-signs, URL
schemes, plus signs, digits and identifier cues, these in any case. Each anchor is handed to a small
deterministic parser, which expands to the left or right as far as the kind's
characters go and validates what it got (dotted domain, octets, Luhn, digit counts,
IBAN check digits). A parser reports how far it has read, so the same characters
are not parsed twice for one kind and every text is read in linear time.

Base kinds, with the results of a leftmost, non-overlapping search for

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([\\x20-]?[0-9])+, 13 to 19 digits that pass Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits

where a match that fails its condition is dropped without another try. Added kinds:
``url`` (scheme://host with a userinfo part, or a query parameter that names a
person's data), ``account`` (an IBAN with valid check digits wherever it stands, or the
identifier of ACCOUNT_DIGITS digits after a cue such as "account number:") and
``secret`` (after a cue such as "token" and a colon or equals sign, SECRET characters or
more with letters and digits among them). An identifier reaches as far as its characters go.

Semantics. A null text is empty and has no spans; positions are code points, ends
exclusive; each row is searched by itself, without a shuffle. An empty table gives
an empty result.
"""

from __future__ import annotations


import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, pieces, table, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")

DIGITS = frozenset("0123456789")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
WORD = UPPER | DIGITS | frozenset("abcdefghijklmnopqrstuvwxyz")
LOCAL = WORD | frozenset("._%+-")
LABEL = WORD | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
KEY = WORD | frozenset("_-./+=~")
URL_END = frozenset(" \t\n\r\x0b\x0c<>\"'`{}|\\^")
SCHEMES = ("http://", "https://", "ftp://", "ftps://")
CUES = ("account number", "account no", "account id", "acct", "kontonummer", "numéro de compte", "número de cuenta", "customer id", "passport no", "passport number", "ssn", "social security")
SECRETS = ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "access key", "access_key", "private key", "private_key")
PERSONAL = ("email=", "user=", "username=", "phone=", "name=", "account=", "ssn=")
#: How many digits an identifier after a cue must have, and the least characters of a secret.
ACCOUNT_DIGITS = (6, 30)
SECRET = 16
IBAN_LENGTHS = (15, 34)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def iban(body: str) -> bool:
    """Whether letters and digits without spaces are an IBAN with valid check digits."""
    return int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def iban_at(text: str, digit: int) -> tuple[int, int] | None:
    """An IBAN whose first check digit is at ``digit``: groups may be set apart by single spaces; the longest valid one."""
    begin, n = digit - 2, len(text)
    if begin < 0 or text[begin] not in UPPER or text[begin + 1] not in UPPER or (begin and text[begin - 1] in WORD) or digit + 1 >= n or text[digit + 1] not in DIGITS:
        return None
    body, at, ends = [], begin, []
    while at < n and len(body) <= IBAN_LENGTHS[1]:
        if text[at] in UPPER or text[at] in DIGITS:
            body.append(text[at])
            at += 1
            if at == n or text[at] not in WORD:
                ends.append((len(body), at))
        elif text[at] == " " and at + 1 < n and (text[at + 1] in UPPER or text[at + 1] in DIGITS):
            at += 1
        else:
            break
    for size, end in reversed(ends):
        if IBAN_LENGTHS[0] <= size <= IBAN_LENGTHS[1] and iban("".join(body[:size])):
            return begin, end
    return None


def automaton() -> ahocorasick.Automaton:
    """Anchors, in lower case, and the parser that each goes to."""
    found = ahocorasick.Automaton()
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for words, what in ((SCHEMES, "scheme"), (CUES, "cue"), (SECRETS, "secret")):
        for word in words:
            found.add_word(word, (what, len(word)))
    found.make_automaton()
    return found


_LOWER = {code: code + 32 for code in range(65, 91)}


def lowered(text: str) -> str:
    """The text in lower case, every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def run_of(text: str, at: int, chars: frozenset) -> int:
    """End of the stretch of such characters that begins at ``at``."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    begin = at
    while begin > floor and text[begin - 1] in LOCAL:
        begin -= 1
    if begin == at:
        return None
    end = run_of(text, at + 1, LABEL)
    dots = 0
    if end > at + 1:
        while end < len(text) and text[end] == "." and (more := run_of(text, end + 1, LABEL)) > end + 1:
            end, dots = more, dots + 1
    return (begin, end) if dots else None


def numbers(text: str, at: int, out: dict) -> int:
    """IP addresses and cards from the digit at ``at``, which no digit precedes; where to go on.

    Both kinds live on chains of digit runs: single dots join an address's, single
    spaces or hyphens a card's.
    """
    end = run_of(text, at, DIGITS)
    n = len(text)
    if at >= out["ip_from"]:
        runs, stop = [(at, end)], end
        while len(runs) < 4 and stop + 1 < n and text[stop] == "." and text[stop + 1] in DIGITS:
            runs.append((stop + 1, run_of(text, stop + 1, DIGITS)))
            stop = runs[-1][1]
        if len(runs) == 4:
            out["ip_from"] = stop
            if all(len(part := text[a:b].lstrip("0")) <= 3 and int(part or 0) <= 255 for a, b in runs):
                out["ip"].append((at, stop))
    if at >= out["card_from"]:
        stop, digits = end, end - at
        while stop + 1 < n and text[stop] in " -" and text[stop + 1] in DIGITS:
            more = run_of(text, stop + 1, DIGITS)
            digits += more - stop - 1
            stop = more
        out["card_from"] = stop
        if 13 <= digits <= 19 and luhn(text[at:stop].replace(" ", "").replace("-", "")):
            out["card"].append((at, stop))
    return end


def phone(text: str, at: int) -> tuple[int, int] | None:
    """The span that the phone expression matches at a plus sign."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run_of(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end > at + 3 and text[end - 1] in DIGITS else None


def url(text: str, begin: int, host: int) -> tuple[int, int] | None:
    end = host
    while end < len(text) and text[end] not in URL_END:
        end += 1
    while end > host and text[end - 1] in ".,;:!?)":
        end -= 1
    body = text[host:end]
    authority = body.split("/", 1)[0].split("?", 1)[0]
    query = body.partition("?")[2].lower()
    return (begin, end) if "@" in authority.strip("@") or any(p in query for p in PERSONAL) else None


_IDENTIFIER = regex.compile(r"(?:\s?(?:no\.?|number|nr\.?))?\s?[:#=]?\s?([A-Za-z]{0,4}[0-9](?:[ -]?[0-9A-Z])*+)")


def account(text: str, after: int) -> tuple[tuple[int, int] | None, int]:
    """The identifier that follows a cue, if it has enough digits, and how far was read."""
    found = _IDENTIFIER.match(text, after)
    if not found:
        return None, after
    begin, end = found.span(1)
    digits = sum(c in DIGITS for c in text[begin:end])
    return ((begin, end) if ACCOUNT_DIGITS[0] <= digits <= ACCOUNT_DIGITS[1] else None), end


_ASSIGNED = regex.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?")


def secret(text: str, after: int) -> tuple[tuple[int, int] | None, int]:
    """The key that a cue names after a colon or equals sign, and how far was read."""
    found = _ASSIGNED.match(text, after)
    if not found:
        return None, after
    begin = found.end()
    end = run_of(text, begin, KEY)
    body = text[begin:end]
    mixed = any(c in DIGITS for c in body) and any(c in WORD and c not in DIGITS for c in body)
    return ((begin, end) if end - begin >= SECRET and mixed else None), end


class Finder:
    def __init__(self):
        self.anchors = automaton()

    def spans(self, text: str) -> dict[str, list[tuple[int, int]]]:
        out: dict = {kind: [] for kind in KINDS} | {"ip_from": 0, "card_from": 0}
        emails = phones = urls = accounts = secrets = digits = 0
        for last, (what, length) in self.anchors.iter(lowered(text)):
            if what == "digit":
                if last >= digits:
                    digits = numbers(text, last, out)
                    if last >= accounts and (found := iban_at(text, last)):
                        out["account"].append(found)
                        accounts = found[1]
            elif what == "at":
                if (found := email(text, last, emails)) is not None:
                    out["email"].append(found)
                    emails = found[1]
            elif what == "plus":
                if last >= phones and (found := phone(text, last)):
                    phones = found[1]
                    if 9 <= sum(c in DIGITS for c in text[found[0] : found[1]]) <= 15:
                        out["phone"].append(found)
            elif what == "scheme":
                if last >= urls and (found := url(text, last + 1 - length, last + 1)):
                    out["url"].append(found)
                    urls = found[1]
            elif what == "cue":
                if last >= accounts:
                    found, accounts = account(text, last + 1)
                    if found:
                        out["account"].append(found)
            elif last >= secrets:
                found, secrets = secret(text, last + 1)
                if found:
                    out["secret"].append(found)
        return {kind: out[kind] for kind in KINDS}


def written(spans: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in sorted(spans[kind]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def annotate(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the spans of personal data, and that column's name."""
    name = free_name(docs.columns, "pii")

    def run(batches):
        find = Finder().spans
        for batch in pieces(batches, text):
            rows = [[{"kind": k, "start": a, "end": b} for k, own in find(t).items() for a, b in sorted(own)] for t in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, ARROW_SPANS)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, SPANS)])), name


def op9_pii(spark, sf_dir):
    from pyspark.sql import functions as F

    found, pii = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter(pii, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    line = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    base = F.filter(pii, lambda s: s.kind.isin(*BASE))
    return found.select(
        "doc_id",
        *(of(kind) for kind in BASE),
        F.size(pii).cast("long").alias("n_found"),
        F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(pii, line), ",").alias("spans"),
    )
