"""Secret scans with structural confirmation.

Three patterns find credential assignments, access ids and long hex runs. Beyond them, runs that
look like base64 or hex are decoded and reported only if their bytes have the structure of a
secret: a private key in DER whose nested lengths add up, an OpenSSH private key, an armoured key
block around either, or a signed token whose header and claims are JSON. Keys may be wrapped over
lines, with real line breaks or written as in a JSON string or a source literal.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_rows, query, ship, table

#: Kinds in the order that ties at one start take: three by pattern, four by structure.
KINDS = ("assign", "access", "hex", "armour", "der", "ssh", "jwt")

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
# A run is taken whole from its start, so asking for its least length at once finds the same runs.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
ANY_HEX = re.compile(r"[0-9a-fA-F]{32,}")
TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")
TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]++")
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
HEADER = re.compile(r"^[A-Za-z0-9-]+:.*$", re.M)
#: Line breaks as escapes of a string, perhaps escaped themselves; ASCII characters by number; joined literals.
ESCAPED_BREAK = re.compile(r"(?<!\\)\\++[nr]")
ESCAPED_CHAR = re.compile(r"(?<!\\)\\++u00([2-7][0-9a-fA-F])")
JOINT = re.compile(r"""["']\s*+[+,.]?\s*+["']""")
QUOTING = re.compile(r"""["'\\]""")
#: Lines of base64 and what may stand between them: escapes, or a line break with quotes, joining signs and indentation.
#: Nothing here gives characters back, and runs are entered at their first character only, so time is linear.
BETWEEN = r"""(?:(?:\\++[nr])*+(?:["'][\x20\t]*+[+,.]?)?[\x20\t]*+\\?\r?\n[\x20\t]*+(?:[+,.][\x20\t]*+)?(?:(?<![A-Za-z0-9/_-])["'])?|(?:\\++[nr])++)"""
WRAPPED = re.compile(
    rf"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\[A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{{32,}}+(?:{BETWEEN}[A-Za-z0-9+/_-]++={{0,2}}+)++"
)
LINE = re.compile(rf"{BETWEEN}|[A-Za-z0-9+/_-]++={{0,2}}+")
SSH_MAGIC = b"openssh-key-v1\0"

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
MAX_DEPTH = 16


def der_items(raw: bytes, start: int, end: int, depth: int = 0):
    """[(tag, start, end, children)] of a span, or None if any length does not add up."""
    items = []
    while start < end:
        if end - start < 2 or depth > MAX_DEPTH:
            return None
        tag, size, at = raw[start], raw[start + 1], start + 2
        if tag & 0x1F == 0x1F or size == 0x80:
            return None
        if size > 0x80:
            wide = size & 0x7F
            if wide > 4 or at + wide > end or raw[at] == 0:
                return None
            size, at = int.from_bytes(raw[at : at + wide], "big"), at + wide
            if size < 0x80:
                return None
        if at + size > end:
            return None
        children = der_items(raw, at, at + size, depth + 1) if tag & 0x20 else []
        if children is None:
            return None
        items.append((tag, at, at + size, children))
        start = at + size
    return items


def is_der_key(raw: bytes) -> bool:
    """A whole private key: RSA or DSA integers, an EC key, or a wrapped or encrypted one."""
    if len(raw) < 32 or raw[0] != SEQUENCE:
        return False
    top = der_items(raw, 0, len(raw))
    if not top or len(top) != 1:
        return False
    items = top[0][3]
    tags = [t for t, *_ in items]
    if len(tags) >= 6 and set(tags[:6]) == {INTEGER}:
        return items[0][2] - items[0][1] == 1
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:
        return [t for t, *_ in items[1][3]][:1] == [OID]
    if tags[:2] == [INTEGER, OCTETS]:
        return raw[items[0][1] : items[0][2]] == b"\x01"
    if tags == [SEQUENCE, OCTETS]:
        return [t for t, *_ in items[0][3]][:1] == [OID]
    return False


def is_ssh_key(raw: bytes) -> bool:
    if not raw.startswith(SSH_MAGIC):
        return False
    at, count = len(SSH_MAGIC), None
    fields = 0
    while at < len(raw):
        if at + 4 > len(raw):
            return False
        size = int.from_bytes(raw[at : at + 4], "big")
        at += 4
        if fields == 3 and count is None:
            count = size
            if not 1 <= count <= 64:
                return False
            continue
        if at + size > len(raw):
            return False
        at, fields = at + size, fields + 1
        if count is not None and fields == 4 + count:
            return at == len(raw)
    return False


def from_base64(text: str) -> bytes:
    body = text.rstrip("=").translate({45: 43, 95: 47})
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_signed_token(text: str) -> bool:
    head, claims, signature = text.split(".")
    try:
        head, claims = (json.loads(from_base64(x)) for x in (head, claims))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(claims, dict) or not isinstance(head.get("alg"), str):
        return False
    return head["alg"].lower() == "none" or len(from_base64(signature)) >= 16


def key_kind(raw: bytes) -> str | None:
    return "der" if is_der_key(raw) else "ssh" if is_ssh_key(raw) else None


def armour_body(text: str) -> str:
    """The base64 of an armour's body, also where it is written as a string or as joined literals."""
    text = ESCAPED_CHAR.sub(lambda m: chr(int(m[1], 16)), text)
    text = QUOTING.sub("", JOINT.sub("", ESCAPED_BREAK.sub("\n", text)))
    return "".join(HEADER.sub("", text).split())


def base64_chars(size: int) -> int:
    """Characters of that many bytes, without padding."""
    return -(-size * 4 // 3)


def der_size(head: bytes) -> int | None:
    """The bytes that the DER sequence takes that begins like this, if a key's first item follows."""
    if len(head) < 7 or head[0] != SEQUENCE:
        return None
    wide = head[1] & 0x7F if head[1] > 0x80 else 0
    if wide > 4 or head[2 + wide] not in (INTEGER, SEQUENCE):
        return None
    return 2 + wide + (int.from_bytes(head[2 : 2 + wide], "big") if wide else head[1])


def ssh_size(peek) -> int | None:
    """The bytes that an OpenSSH key takes, from its length fields alone; ``peek(at)`` gives four bytes."""
    at, fields, count = len(SSH_MAGIC), 0, None
    while count is None or fields < 4 + count:
        raw = peek(at)
        if len(raw) < 4:
            return None
        size, at = int.from_bytes(raw[:4], "big"), at + 4
        if fields == 3 and count is None:
            if not 1 <= size <= 64:
                return None
            count = size
        else:
            at, fields = at + size, fields + 1
    return at


def wrapped_spans(text: str) -> list[tuple[int, str, int]]:
    """Keys over several lines of one width, the last one as long or shorter.

    A key's own length fields say how many characters it takes; lines are joined only where that fits.
    """
    found = []
    for m in WRAPPED.finditer(text):
        lines = [x for x in LINE.finditer(text, m.start(), m.end()) if x[0][0].isalnum() or x[0][0] in "+/_-"]
        sizes = [len(x[0]) for x in lines]
        # The last line of the stretch of one width that begins at each line, and a shorter one after it.
        ends = [0] * len(lines)
        for i in range(len(lines) - 1, -1, -1):
            more = i + 1 < len(lines) and sizes[i + 1] <= sizes[i]
            ends[i] = i if not more else ends[i + 1] if sizes[i + 1] == sizes[i] else i + 1
        after = -1
        for i, first in enumerate(lines):
            width, line = sizes[i], first[0]
            if i <= after or width < 32 or not line.startswith(("M", "b3BlbnNzaC1rZXktdjE")):
                continue
            last = ends[i]
            if line[0] == "M":
                size = der_size(from_base64(line[:12]))
                if size is not None:
                    last = max(i, min(last, i + -(-base64_chars(size) // width) - 1))
            else:

                def peek(at, i=i, width=width):
                    low, chars = at // 3 * 4, []
                    for place in range(low, low + 8):
                        if (row := i + place // width) <= ends[i] and place % width < sizes[row]:
                            chars.append(lines[row][0][place % width])
                    return from_base64("".join(chars))[at % 3 :]

                size = ssh_size(peek)
            if size is None:
                continue
            for end in (last, last - 1):
                chars = (end - i) * width + len(lines[end][0].rstrip("="))
                if end > i and chars == base64_chars(size):
                    if kind := key_kind(from_base64("".join(x[0] for x in lines[i : end + 1]))):
                        found.append((first.start(), kind, lines[end].end()))
                        after = end
                        break
    return found


def armour_spans(text: str) -> list[tuple[int, str, int]]:
    """Armoured keys; an armour ends before the next one begins."""
    found, begins = [], list(BEGIN.finditer(text))
    for m, following in zip(begins, [*(x.start() for x in begins[1:]), len(text)], strict=False):
        close = f"-----END {m[1]}-----"
        end = text.find(close, m.end(), following)
        if end > 0 and key_kind(from_base64(armour_body(text[m.end() : end]))):
            found.append((m.start(), "armour", end + len(close)))
    return found


def token_spans(text: str) -> list[tuple[int, str, int]]:
    """Signed tokens; where a run's first start is none, its other starts are none either."""
    found, at = [], text.find("eyJ")
    while at >= 0:
        m = TOKEN.match(text, at)
        if m and is_signed_token(m[0]):
            found.append((at, "jwt", m.end()))
        at = text.find("eyJ", (m or TOKEN_RUN.match(text, at)).end())
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    found = armour_spans(text)
    for m in CANDIDATE.finditer(text):
        if kind := key_kind(from_base64(m[0])):
            found.append((m.start(), kind, m.end()))
    found += wrapped_spans(text)
    for m in ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(m[0]))):
            found.append((m.start(), kind, m.end()))
    found += token_spans(text)
    return sorted(set(found))


def in_order(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found): arrays of (kind, start, end) by start, in code points, end exclusive.

    ``base`` has the spans by pattern, ``found`` those and the confirmed ones. Every row of
    ``docs`` gets a row, repeated ones too; a null text counts as empty and has no spans; an empty
    table gives an empty result.
    """

    def run(batches):
        for b in batches:
            out = {"doc_id": b["doc_id"], "base": [], "found": []}
            for text in b["text"]:
                base = base_spans(text or "")
                both = base + confirmed_spans(text or "")
                for name, spans in (("base", base), ("found", both)):
                    out[name].append([{"kind": k, "start": s, "end": e} for s, k, e in in_order(spans)])
            yield out

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), f"doc_id bigint, base {span}, found {span}", run)


def listed(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op2_secret_scan")
def op2(spark, sf):
    found = find_secrets(table(spark, sf, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"),
    )


ship(__name__)
