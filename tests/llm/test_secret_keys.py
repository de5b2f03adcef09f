"""Keys that the secret scan confirms in base64 and hex, against keys built field by field here."""

import base64
import hashlib
import random
import time

import pytest

from docketlens.llm import secrets


def der(tag: int, body: bytes) -> bytes:
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + size + body


def number(n: int, k: int) -> bytes:
    return der(2, b"\x5a" + hashlib.shake_256(bytes([k])).digest(n - 1))


def rsa(primes: int = 2) -> bytes:
    """An RSA private key with so many primes; those beyond two come as triples in a last sequence."""
    version = der(2, bytes([primes > 2]))
    others = b"".join(der(0x30, b"".join(number(32, 9 + 3 * p + i) for i in range(3))) for p in range(primes - 2))
    return der(0x30, version + b"".join(number(64, k) for k in range(8)) + (der(0x30, others) if others else b""))


field = lambda b: len(b).to_bytes(4, "big") + b
SSH = b"openssh-key-v1\x00" + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(b"k" * 51) + field(b"p" * 136)
CURVE = der(0x30, der(2, b"\x01") + der(4, bytes(range(32))))
CERTIFICATE = der(0x30, der(0x30, number(20, 1) + der(0x30, number(9, 2))) + der(0x30, der(6, b"\x2a\x86\x48")) + der(3, bytes(64)))
KEYS = {"rsa": ("der_key", rsa()), "primes": ("der_key", rsa(5)), "many primes": ("der_key", rsa(30)), "curve": ("der_key", CURVE), "ssh": ("ssh_key", SSH)}


def found(text: str) -> list[tuple[str, int, int]]:
    return [s for s in secrets.scan(text) if s[0] not in secrets.BASE_KINDS]


@pytest.mark.parametrize("name", KEYS)
def test_base64_keys_with_any_blanks_before_a_break(name):
    kind, key = KEYS[name]
    body = base64.b64encode(key).decode()
    for join in ("\n", " " * 30 + "\n", "\\n\"" + " " * 12 + "+\n\t'", "\\\n"):
        wrapped = join.join(body[i : i + 64] for i in range(0, len(body), 64))
        assert found(f"see {wrapped}\n\nend") == [(kind, 4, 4 + len(wrapped))], join


@pytest.mark.parametrize("name", KEYS)
def test_hex_keys_in_runs_and_dumps(name):
    """Plain and upper-case hex, wrapped, by colons, blanks and commas, with prefixes, and with bytes before and after."""
    kind, key = KEYS[name]
    digits, pairs = key.hex(), [f"{b:02x}" for b in key]
    rows = [pairs[i : i + 15] for i in range(0, len(pairs), 15)]
    forms = [
        digits,
        digits.upper(),
        "\n".join(digits[i : i + 64] for i in range(0, len(digits), 64)),
        "\\n".join(digits[i : i + 61] for i in range(0, len(digits), 61)),
        "\"\n    \"".join(digits[i : i + 76] for i in range(0, len(digits), 76)),
        ":".join(pairs),
        ":\n    ".join(":".join(r) for r in rows),
        " ".join(pairs),
        ", 0x".join(pairs),
        ",\n  ".join(", ".join("0x" + p for p in r) for r in rows)[2:],
        "\\x".join(pairs),
    ]
    for form in forms:
        for before, after in (("", ""), ("see ", " end"), ("00ff", "beef"), ("a", "7"), ("dead beef 0x", "\n")):
            assert found(before + form + after) == [(kind, len(before), len(before) + len(form))], (form[:40], before)


def test_what_is_no_key():
    """A certificate, keys cut short or with one length changed, further primes of two numbers, and hex at random."""
    half = der(0x30, der(2, b"\x01") + b"".join(number(64, k) for k in range(8)) + der(0x30, der(0x30, number(32, 1) + number(32, 2))))
    changed = bytearray(rsa(4))
    changed[3] ^= 1
    for data in (CERTIFICATE, half, bytes(changed), rsa(3)[:-1], CURVE[:-1], SSH[:-1]):
        assert found(data.hex()) == [] and found(":".join(f"{b:02x}" for b in data)) == []
        assert found(base64.b64encode(data).decode()) == []
    rnd = random.Random(7)
    assert found(" ".join(rnd.randbytes(rnd.randint(1, 40)).hex() for _ in range(20_000))) == []


def test_several_keys_of_one_dump():
    text = " ".join(k.hex() for _, k in KEYS.values())
    assert [s[0] for s in found(text)] == [kind for kind, _ in KEYS.values()]
    assert [text[a:b] for _, a, b in found(text)] == [k.hex() for _, k in KEYS.values()]


NESTED = b"".join(b"\x30\x82\xff\xff" + der(2, b"\x01") for _ in range(9_000))


@pytest.mark.parametrize("piece", ["3082", "30 82 ", "30:82:04:a4:02:01:00:", "6f70656e737368", "6f70656e7373682d6b65792d763100", "\\", "30" + "\\" * 9, "MIIEpAIBAAKCAQEA" + " " * 50, "0x", "30\n", rsa(9)[:-1].hex(), NESTED.hex()])
def test_odd_hex_takes_linear_time(piece):
    began = time.perf_counter()
    secrets.scan(piece * max(1, 500_000 // len(piece)))
    assert time.perf_counter() - began < 20
