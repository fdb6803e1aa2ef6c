"""FLAC columns: what they cost, and parts against plain computations."""

import hashlib
import random
import time

import numpy as np
import pytest

from tamarack.llm import media_columns


def make_texts(size):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    out = []
    while size > 0:
        text = " ".join(rng.choice(words) for _ in range(rng.randint(50, 1000))).encode()
        out.append(text + bytes(-len(text) % media_columns.PAD))
        size -= len(text)
    return out


def test_cost_of_coding():
    """CPU time of coding 3 MB both ways, in turns of a plain loop (1 ms or so): 391 to 473 a MB before, 100 to 159 since."""
    payloads = make_texts(3_000_000)
    mb = sum(map(len, payloads)) / 1e6
    found = []
    for _ in range(4):
        units = []
        for _ in range(15):
            began = time.thread_time()
            sum(range(50_000))
            units.append(time.thread_time() - began)
        began = time.thread_time()
        read = media_columns.decode(media_columns.encode(payloads))
        measured = [media_columns.features(d.samples[0]) for d in read]
        found.append((time.thread_time() - began) / np.median(units) / mb)
        assert [d.pcm for d in read] == payloads and len(measured) == len(payloads)
    assert min(found) < 250, found


def test_stored_form_stays():
    """The streams are those of the encoder before: the digest was taken with it."""
    rng = random.Random(3)
    payloads = [*make_texts(50_000), bytes(64), b"a" * 64, bytes(rng.randrange(256) for _ in range(3000)), b"\x00\xff" * 700, b"\x80" * 900 + b"\xff" * 3 + b"\x80" * 2000, b"abc", b"x"]
    payloads.append((np.cumsum(np.cumsum(np.random.default_rng(1).integers(-1, 2, 5000))) % 256).astype(np.uint8).tobytes())
    streams = media_columns.encode(payloads)
    assert hashlib.sha256(b"".join(streams)).hexdigest() == "61fe53a022e03dae0954d9ac43119bd3c2c32ff2e292fa31af7619a86385a831"
    assert [d.pcm for d in media_columns.decode(streams)] == payloads


def crc_of(data, width, poly):
    state = 0
    for byte in data:
        state ^= byte << (width - 8)
        for _ in range(8):
            state = (state << 1 ^ (poly if state >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
    return state


def test_crc_of_stretches():
    data = np.random.default_rng(2).integers(0, 256, 9000).astype(np.uint8)
    length = np.array([1, 2, 3, 4, 5, 8, 9, 63, 64, 65, 1023, 1024, 1025, 9000, 0, 7, 16])
    begin = np.minimum(np.arange(len(length)) * 311, 9000 - length)
    assert media_columns.crc16(data, begin, length).tolist() == [crc_of(data[b : b + n].tobytes(), 16, 0x8005) for b, n in zip(begin, length, strict=True)]


def test_counted_bits_of_rice_codes():
    u = np.random.default_rng(4).integers(0, 4097, (5, 77)).astype(np.uint16)
    assert media_columns._rice_bits(u).tolist() == [[sum((int(v) >> k) + k + 1 for v in row) for k in range(8)] for row in u]


@pytest.mark.parametrize("parameter", [0, 3, 14, 22, 25, 29, 30])
def test_codes_beyond_a_window(parameter):
    """Long quotients and wide remainders, at each offset within a byte."""
    rng = random.Random(parameter)
    want = [(rng.choice([0, 1, 5, 31, 32, 33, 64, 100]), rng.getrandbits(parameter)) for _ in range(200)]
    bits = "".join("0" * q + "1" + (format(r, f"0{parameter}b") if parameter else "") for q, r in want)
    data = np.frombuffer(int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big") + bytes(16), np.uint8)
    words, pos, low = media_columns._words(data), np.zeros(1, np.int64), np.full(1, parameter, np.int64)
    got = []
    for _ in want:
        code, pos = media_columns._rice_step(words, pos, low)
        got.append(int(code[0]))
    assert got == [q << parameter | r for q, r in want] and int(pos[0]) == len(bits)
