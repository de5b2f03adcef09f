"""Secret scans that confirm what they report by its structure.

Three plain patterns (assignments, access keys, hex runs) are reported as they match. Beyond these, base64 and hex
candidates are reported only once they decode into something that parses as a secret: a DER key whose nested lengths
fill it exactly, an OpenSSH private key with its length-prefixed fields, or a signed token whose header is JSON that
names an algorithm. A base64 key may start anywhere in a run, in either alphabet, and go on over line breaks, real or
escaped, and the quotes around them. A hex key may start anywhere in a run too, and its bytes may be parted by colons,
commas, blanks, line breaks and prefixes. In both, the key's own lengths tell where it ends.
"""

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.llm.common import ship

#: The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Candidates for confirmation: armoured blocks, three dotted base64url parts, long base64 and hex runs.
MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,40})-----")
ARMOURED = re.compile(r"""[A-Za-z0-9+/=\s:,\\"'-]*""")
URL_RUN = re.compile(r"[A-Za-z0-9_-]+")
#: How a DER sequence or an OpenSSH key starts in base64, whatever comes before it.
KEY_START = re.compile(r"M[A-P](?=[A-Za-z0-9+/_-]{14})|b3BlbnNzaC1rZXktdjEA")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
#: A line break between two parts of a key, real or escaped, with what source code has around it. Nothing is tried twice.
BREAK = re.compile(r"""[\x20\t"'\\+]*+(?:(?<=\\)[rn]|[\r\n])(?:(?<=\\)[rnt]|(?<=["'\s])\+(?=\s)|[\s"'\\])*+""")
ESCAPES = re.compile(r"\\+[rnt]|\r\n?")
GLUE = re.compile(r"""["']\s*\+\s*["']|["'\\]""")
MIN_KEY = 40
#: No key format has more than ten values in its outer sequence, so that longer sequences are no keys.
MOST_FIELDS = 16
#: What may part the bytes of a hex dump, how a DER sequence or an OpenSSH key starts in one, and the least bytes of a key.
PARTS = r"""(?:0x|(?<=\\)[rntx]|[\s:,;"'\\+-])*+"""
HEX_RUN, HEX_GAP = re.compile(r"[0-9A-Fa-f]+"), re.compile(PARTS)
HEX_START = re.compile(f"30{PARTS}(?:8[1-4]|[2-7][0-9A-Fa-f])|6[Ff]{PARTS}70{PARTS}65{PARTS}6[Ee]{PARTS}73{PARTS}73{PARTS}68")
MIN_HEX_KEY = 24

#: All kinds, in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem_key", "signed_token", "der_key", "ssh_key")
BASE_KINDS = KINDS[:3]
SPANS = "array<struct<kind:string,start:int,end:int>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
OPENSSH = b"openssh-key-v1\x00"


def base64_bytes(text: str, url: bool = False) -> bytes | None:
    body = "".join(text.split()).rstrip("=")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes, at: int, end: int, most: int | None = MOST_FIELDS) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[at:end] exactly, or None; also None where they are more than most."""
    found = []
    while at < end:
        if at + 2 > end or len(found) == most:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        found.append((tag, at, at + size))
        at += size
    return found


def other_primes(data: bytes, at: int, end: int) -> bool:
    """The last field of an RSA key with more than two primes: sequences of three integers, however many."""
    primes = der_fields(data, at, end, most=None)
    return bool(primes) and all(tag == 0x30 and [t for t, _, _ in der_fields(data, *span) or []] == [0x02] * 3 for tag, *span in primes)


def is_der_key(data: bytes, at: int = 0, end: int | None = None, seen: dict | None = None) -> bool:
    """PKCS#1, SEC1, PKCS#8 or an encrypted PKCS#8 private key: one sequence that fills data[at:end], with the right fields.

    seen keeps what was found for lists of further primes of the same data, so that none is read twice.
    """
    outer = der_fields(data, at, len(data) if end is None else end)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_fields(data, *outer[0][1:])
    if not inner:
        return False
    tags = [t for t, _, _ in inner]
    if tags[:1] == [0x02]:
        small = inner[0][2] - inner[0][1] == 1
        if small and len(tags) >= 6 and set(tags) == {0x02}:
            return True  # version and the integers of an RSA or DSA key
        if small and tags == [0x02] * 9 + [0x30]:
            span, seen = inner[9][1:], {} if seen is None else seen
            if span not in seen:
                seen[span] = other_primes(data, *span)
            return seen[span]
        if small and tags[1:2] == [0x04]:
            return inner[1][2] - inner[1][1] >= 16  # an elliptic curve's scalar
        if small and tags[1:3] == [0x30, 0x04]:
            algorithm = der_fields(data, *inner[1][1:])
            return bool(algorithm) and algorithm[0][0] == 0x06
        return False
    if tags == [0x30, 0x04]:
        algorithm = der_fields(data, *inner[0][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06 and inner[1][2] - inner[1][1] >= 16
    return False


def ssh_size(data: bytes, at: int = 0) -> int:
    """Bytes of the OpenSSH private key that starts there, or 0: magic, three length-prefixed strings, a key count and as many more strings."""
    if not data.startswith(OPENSSH, at):
        return 0
    start, at, left, keys = at, at + len(OPENSSH), 3, None
    while left:
        if at + 4 > len(data):
            return 0
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return 0
        left -= 1
        if left == 0 and keys is None:
            keys = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else 0
            if not 1 <= keys <= 16:
                return 0
            at, left = at + 4, keys + 1
    return at - start


def is_signed_token(text: str) -> bool:
    try:
        head = json.loads(base64_bytes(text.partition(".")[0], url=True) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "ssh_key" if ssh_size(data) else "der_key" if is_der_key(data) else None


def armoured_bytes(body: str) -> bytes | None:
    """What an armoured block holds, its line breaks, quotes and headers dropped."""
    lines = GLUE.sub("", ESCAPES.sub("\n", body)).split("\n")
    headers = max((i + 1 for i, x in enumerate(lines) if ":" in x), default=0)
    return base64_bytes("".join(lines[headers:]))


def key_in(data: bytes, at: int, seen: dict) -> tuple[str, int] | None:
    """Kind and number of bytes of the key that starts at data[at]; its own lengths tell where it ends."""
    if size := ssh_size(data, at):
        return "ssh_key", size
    if len(data) < at + 12 or data[at] != 0x30:
        return None
    wide = data[at + 1] & 0x7F if data[at + 1] & 0x80 else 0
    if wide > 4 or data[at + 1] == 0x80 or data[at + 2 + wide] not in (0x02, 0x30):
        return None
    size = 2 + wide + (int.from_bytes(data[at + 2 : at + 2 + wide], "big") if wide else data[at + 1])
    return ("der_key", size) if at + size <= len(data) and is_der_key(data, at, at + size, seen) else None


class Region:
    """Base64 characters from a place on, over line breaks, as one string that is decoded once for each alignment."""

    run, gap, chars, octets, least = RUN, BREAK, 4, 3, MIN_KEY

    def __init__(self, text: str, at: int):
        parts, self.text = [], text
        self.starts: list[int] = []
        self.before: list[int] = []
        n = 0
        while run := self.run.match(text, at):
            self.starts.append(at)
            self.before.append(n)
            parts.append(run[0])
            n, at = n + len(run[0]), run.end()
            if gap := self.gap.match(text, at):
                at = gap.end()
        self.body = "".join(parts)
        self.end = self.starts[-1] + len(parts[-1])
        self.decoded: dict[int, tuple[bytes, dict]] = {}

    def decode(self, turn: int) -> bytes:
        body = self.body.replace("-", "+").replace("_", "/")
        whole = (len(body) - turn) // 4 * 4
        tail = body[turn + whole :]
        return base64.b64decode(body[turn : turn + whole] + (tail + "=" * (4 - len(tail)) if len(tail) > 1 else ""))

    def key_at(self, place: int) -> tuple[str, int] | None:
        """Kind and end of the key whose characters start at this place of the text."""
        if len(self.body) < self.least:
            return None
        k = bisect_right(self.starts, place) - 1
        at = self.before[k] + place - self.starts[k]
        if (turn := at % self.chars) not in self.decoded:
            self.decoded[turn] = self.decode(turn), {}
        data, seen = self.decoded[turn]
        key = key_in(data, (at - turn) // self.chars * self.octets, seen)
        if key is None or (most := -(-self.chars * key[1] // self.octets)) < self.least:
            return None
        k = bisect_left(self.before, at + most) - 1
        end = self.starts[k] + at + most - self.before[k]
        while end < len(self.text) and self.text[end] == "=" and most % self.chars:
            end, most = end + 1, most + 1
        return key[0], end


class HexRegion(Region):
    """Hex digits from a place on, over what parts the bytes of a dump."""

    run, gap, chars, octets, least = HEX_RUN, HEX_GAP, 2, 1, 2 * MIN_HEX_KEY

    def decode(self, turn: int) -> bytes:
        return bytes.fromhex(self.body[turn : turn + (len(self.body) - turn) // 2 * 2])


def armoured(text: str) -> list[tuple[int, int]]:
    """Spans of armoured private keys: each END mark with the BEGIN mark right before it, so that no text is read twice."""
    found, begin = [], None
    for mark in MARK.finditer(text):
        if mark[1] == "BEGIN":
            begin = mark
        elif begin and begin[2] == mark[2] and "PRIVATE KEY" in mark[2]:
            body = text[begin.end() : mark.start()]
            data = armoured_bytes(body) if ARMOURED.fullmatch(body) else None
            if data and (key_kind(data) or ":" in body and len(data) >= 64):
                found.append((begin.start(), mark.end()))
            begin = None
    return found


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of signed tokens; each run of base64url characters is looked at once, from its first mark of a header."""
    found, at = [], 0
    while (start := text.find("eyJ", at)) >= 0:
        at = URL_RUN.match(text, start).end()
        if text[at : at + 1] == "." and (body := URL_RUN.match(text, at + 1)) and text[body.end() : body.end() + 1] == ".":
            last = URL_RUN.match(text, body.end() + 1)
            end = last.end() if last else body.end() + 1
            if is_signed_token(text[start:end]):
                found.append((start, end))
                at = end
    return found


def scan(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, end exclusive, by start and kind."""
    found: list[tuple[str, int, int]] = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    taken = armoured(text) if "-----BEGIN " in text else []
    found += [("pem_key", *span) for span in taken]
    taken_from = [a for a, _ in taken]
    is_taken = lambda place: (k := bisect_right(taken_from, place)) > 0 and place < taken[k - 1][1]
    found += [("signed_token", *span) for span in signed_tokens(text)]
    for start, kind in ((KEY_START, Region), (HEX_START, HexRegion)):
        at, region = 0, None
        while m := start.search(text, at):
            at = m.start() + 1
            if is_taken(m.start()):
                continue
            if region is None or m.start() >= region.end:
                region = kind(text, m.start())
            if key := region.key_at(m.start()):
                found.append((key[0], m.start(), key[1]))
                at = key[1]
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in code points by start, then kind in the order of KINDS.

    A null text counts as empty and has no spans; an empty table gives an empty result. Rows are independent, so
    that repeated rows and other columns do not matter; whole texts are scanned, whatever their length.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, ARROW_SPANS)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of the text replaced by mark, and n_chars, if there, counted anew.

    Overlapping spans become one mark. All rows and columns stay; a null text stays null.
    """
    ship(docs.sparkSession)
    names = docs.columns

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for _, start, end in scan(text):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean, na_action="ignore")

    text = cleaned(F.col("text"))
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
