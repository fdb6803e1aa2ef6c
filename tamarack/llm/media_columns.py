"""FLAC media columns: frames of Rice-coded residuals of linear predictors, decoded many at a time.

``encode`` writes mono FLAC streams of 8-bit samples: a STREAMINFO block with the MD5 of the samples, a
SEEKTABLE, and frames with constant, verbatim, fixed or linear-predictor (LPC) subframes. ``decode`` reads
these and ordinary streams: several channels and their pairings, up to 24 bits, wasted bits, Rice
partitions and escapes. Both work on the frames of a whole batch at once: the serial part, from one
sample or one code to the next, is one loop of array steps over all frames, so Python never loops
over samples; whatever does not depend on the one before goes over whole matrices. The decoder checks
each header's CRC-8, each frame's CRC-16 and the stream's MD5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, RATE, PAD = 1024, 8000, 64
#: Weights (the sum is 64) of the one linear predictor that the encoder tries beside the fixed ones.
LPC, LPC_SHIFT = (22, 14, 16, 12), 6
#: Samples decoded at a time inside a task: the more frames step together, the less a step costs each of them.
GROUP = 1 << 21
#: Samples encoded, or bytes checked, at a time: their matrices should stay in the CPU's cache.
PART = 1 << 18
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(width: int, poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        table = np.where(table >> (width - 1) & 1, (table << 1) ^ poly, table << 1) & ((1 << width) - 1)
    return table


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_PAIRS = np.arange(1 << 16)
#: Item i takes a remainder of CRC-16 past 2^i words of 16 bits.
_PAST = [(((_CRC16[_PAIRS >> 8] << 8) & 0xFFFF) ^ _CRC16[(_CRC16[_PAIRS >> 8] >> 8) ^ (_PAIRS & 0xFF)]).astype(np.uint16)]


def crc16(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-16 of each stretch of ``data``: neighbouring words of all stretches fold into one until one is left.

    Zeros before a stretch leave its CRC as it is, so each is widened to a power of two.
    """
    out = np.zeros(len(begin), np.uint16)
    if not len(begin):
        return out
    level = np.frexp(np.maximum(length - 1, 1) // 2)[1]  # 2^level words hold the stretch
    most = 2 << int(level.max())
    padded = np.concatenate([np.zeros(most, np.uint8), data])
    while len(_PAST) <= level.max():
        _PAST.append(_PAST[-1][_PAST[-1]])
    for n in np.unique(level):
        wide, same = 2 << int(n), np.flatnonzero(level == n)
        rows = np.lib.stride_tricks.sliding_window_view(padded, wide)
        for at in np.array_split(same, -(-len(same) * wide // PART)):
            block = rows[begin[at] + length[at] + (most - wide)]
            block *= np.arange(wide, dtype=np.int32) >= (wide - length[at]).astype(np.int32)[:, None]
            words = block.view(">u2").astype(np.uint16)
            for past in _PAST[: int(n)]:
                words = past[words[:, 0::2]] ^ words[:, 1::2]
            out[at] = _PAST[0][words[:, 0]]
    return out


def _utf8(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(2 * lead + 1) & 0xFF) | n, *reversed(tail)])


def _plans(x: np.ndarray) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Order, subframe kind and further bits of each predictor, and what it leaves of rows of samples past its warm-up."""
    left, size = x, x.shape[1]
    for order in range(min(len(_FIXED), size)):
        yield order, (0b001000 | order) << 1, b"", left
        left = left[:, 1:] - left[:, :-1]
    if size > len(LPC):
        # precision 8 bits (7 as stored), shift, then the weights, all as bits
        bits = f"{7:04b}{LPC_SHIFT:05b}" + "".join(f"{w & 0xFF:08b}" for w in LPC)
        k = len(LPC)
        guess = sum(w * x[:, k - 1 - j : size - 1 - j] for j, w in enumerate(LPC))
        yield k, (0b100000 | k - 1) << 1, bits.encode(), x[:, k:] - (guess >> LPC_SHIFT)


def _rice_bits(u: np.ndarray) -> np.ndarray:
    """The bits that each row takes as Rice codes of parameter 0 to 7: a column for each."""
    count, n = u.shape
    low = np.zeros((count, -(-n // 8) * 8), np.uint8)
    low[:, :n] = u  # bits 0 to 7
    words, rest = low.view(np.uint64), u.sum(1, dtype=np.int64)
    bits = np.empty((count, 8), np.int64)
    for k in range(8):
        bits[:, k] = (rest >> k) + (k + 1) * n
        if k < 7:  # rest: the sum without the bits below k + 1
            rest -= np.bitwise_count(words & np.uint64(0x0101010101010101 << k)).sum(1, dtype=np.int64) << k
    return bits


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (bytes are samples + 128). Payloads must not be empty."""
    rows, numbers, firsts = [], [], []
    for p in payloads:
        x = np.frombuffer(p, np.uint8)
        firsts.append(len(rows))
        rows += [x[j : j + BLOCK] for j in range(0, len(x), BLOCK)]
        numbers += range(len(rows) - firsts[-1])
    firsts.append(len(rows))
    sizes = np.array([len(r) for r in rows])
    frames: list[bytes] = [b""] * len(rows)
    for size in np.unique(sizes)[::-1]:  # rows of one length make a matrix; the last of a stream is the shortest
        at = np.flatnonzero(sizes == size)
        for part in np.array_split(at, max(1, len(at) * int(size) // PART)):
            coded = _encode_rows(np.stack([rows[i] for i in part]).astype(np.int16) - 128, [numbers[i] for i in part])
            for i, frame in zip(part.tolist(), coded, strict=True):
                frames[i] = frame
    long = np.array([len(f) for f in frames])
    sums = crc16(np.frombuffer(b"".join(frames), np.uint8), np.cumsum(long) - long, long).astype(">u2").tobytes()
    frames = [f + sums[2 * i : 2 * i + 2] for i, f in enumerate(frames)]
    return [_stream(p, frames[a:b]) for p, a, b in zip(payloads, firsts, firsts[1:], strict=False)]


def _encode_rows(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """The frames, without their CRC-16, of rows of samples (16 bits hold all that 8-bit samples leave)."""
    count, size = x.shape
    plans, costs = [], []
    for order, kind, extra, r in _plans(x):
        u = ((r << 1) ^ (r >> 15)).view(np.uint16)  # 0, -1, 1, -2, ... as 0, 1, 2, 3, ...
        plans.append((order, kind, extra, u))
        costs.append(_rice_bits(u) + (8 * order + len(extra)))
    cost = np.concatenate(costs, axis=1)
    best = cost.argmin(1)
    choice, ks = best >> 3, best & 7
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (cost.min(1) + 16 >= 8 * size)
    heads = [_header(n, size) for n in numbers]
    out: list[bytes] = [b""] * count
    for i in np.flatnonzero(constant):
        out[i] = heads[i] + b"\x00" + x[i, :1].astype(np.int8).tobytes()
    for i in np.flatnonzero(verbatim):
        out[i] = heads[i] + b"\x02" + x[i].astype(np.int8).tobytes()
    for p, (order, kind, extra, left) in enumerate(plans):
        at = np.flatnonzero((choice == p) & ~constant & ~verbatim)
        if not len(at):
            continue
        fixed = 8 + 8 * order + len(extra) + 2 + 4 + 4  # kind, warm-up, predictor, Rice method, order, parameter
        front = np.zeros((len(at), fixed), np.uint8)
        front[:, :8] = np.unpackbits(np.array([kind], np.uint8))
        if order:
            front[:, 8 : 8 + 8 * order] = np.unpackbits(x[at, :order].astype(np.int8).view(np.uint8), axis=1)
        if extra:
            front[:, 8 + 8 * order : fixed - 10] = np.frombuffer(extra, np.uint8) - 48
        front[:, fixed - 4 :] = (ks[at][:, None] >> np.arange(3, -1, -1)) & 1
        packed, base = _rice_write(left[at].astype(np.int32), ks[at].astype(np.int32)[:, None], front)
        for j, i in enumerate(at.tolist()):
            out[i] = heads[i] + packed[base[j] : base[j + 1]]
    return out


def _rice_write(u: np.ndarray, k: np.ndarray, front: np.ndarray) -> tuple[bytes, list[int]]:
    """The bits of ``front`` and the Rice codes of each row, in whole bytes; the places where rows begin, and the end."""
    ends = np.cumsum((u >> k) + (k + 1), axis=1, dtype=np.int32) + front.shape[1]
    base = np.concatenate([[0], np.cumsum(-(-ends[:, -1].astype(np.int64) // 8))])
    ends = ends + base[:-1, None] * 8
    # a code's one and the bits after it, at most 8, are moved to their place in the 32 bits where they end; bits of
    # different codes never meet, so that sums join them (below 2^40: exact), and what exceeds 32 bits belongs before
    code = ((u & ((1 << k) - 1)) | (1 << k)).astype(np.int64) << (-ends & 31)
    words = np.bincount(((ends - 1) >> 5).ravel(), code.ravel(), int(base[-1]) // 4 + 1).astype(np.int64)
    words[:-1] += words[1:] >> 32
    packed = words.astype(np.uint32).astype(">u4").view(np.uint8)
    head = np.packbits(front, axis=1)
    packed[base[:-1, None] + np.arange(head.shape[1])] |= head
    return packed.tobytes(), base.tolist()


@lru_cache(1 << 12)
def _header(number: int, size: int) -> bytes:
    """Sync, fixed block size, 16-bit size and rate from STREAMINFO, mono, 8 bits, number, CRC-8."""
    head = bytes([0xFF, 0xF8, 0x70, 0x02]) + _utf8(number) + (size - 1).to_bytes(2, "big")
    return head + bytes([_crc8(head)])


_CRC8_LIST = _CRC8.tolist()


def _crc8(data: bytes) -> int:
    state = 0
    for b in data:
        state = _CRC8_LIST[state ^ b]
    return state


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    info = (RATE << 44) | (0 << 41) | (7 << 36) | len(payload)
    head = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    streaminfo = head + info.to_bytes(8, "big") + hashlib.md5(signed).digest()
    seek = np.empty(len(sizes), [("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
    seek["sample"] = np.arange(len(sizes)) * BLOCK
    seek["byte"] = np.cumsum([0, *sizes[:-1]])
    seek["n"] = np.minimum(BLOCK, len(payload) - np.arange(len(sizes)) * BLOCK)
    points = seek.tobytes()
    blocks = b"\x00" + len(streaminfo).to_bytes(3, "big") + streaminfo + b"\x83" + len(points).to_bytes(3, "big") + points
    return b"fLaC" + blocks + b"".join(frames)


@dataclass
class Decoded:
    """PCM bytes as in WAV files, (sample offset, byte offset, samples) of each frame, and the samples by channel.

    Up to 8 bits PCM is unsigned bytes, beyond little-endian signed values of whole bytes; channels alternate.
    """

    pcm: bytes
    frames: list[tuple[int, int, int]]
    samples: np.ndarray
    rate: int
    bits: int


@dataclass
class _Info:
    """What STREAMINFO says, and where the first frame begins."""

    first: int
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes


@dataclass
class _Frame:
    """A frame's header: where frame and body begin, and (later) where the frame ends."""

    begin: int
    body: int
    size: int
    channels: int
    bits: int
    pairing: int
    number: int
    variable: bool
    end: int = 0


def decode(streams: list[bytes]) -> list[Decoded]:
    """The samples of FLAC streams: 1 to 8 channels of 4 to 24 bits, with or without a SEEKTABLE.

    Frames are found by their sync code and header CRC-8, and end where the CRC-16 holds. Raises ValueError
    where a checksum or the format does not hold.
    """
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    infos, ranges, frames, of, shift = [], [], [], [], 0
    for i, s in enumerate(streams):
        infos.append(_metadata(s))
        ranges.append((shift + infos[i].first, shift + len(s)))
        shift += len(s)
    for i, own in enumerate(_find_frames(data, ranges, infos)):
        frames += own
        of += [i] * len(own)
    decoded: list[np.ndarray] = []
    start = 0
    while start < len(frames):  # as many frames at a time as hold about GROUP samples
        last = size = 0
        while start + last < len(frames) and (not last or size + frames[start + last].size * frames[start + last].channels <= GROUP):
            size += frames[start + last].size * frames[start + last].channels
            last += 1
        decoded += _decode_frames(data, frames[start : start + last])
        start += last
    found, first, shift = [], 0, 0
    for i, info in enumerate(infos):
        last = first
        while last < len(of) and of[last] == i:
            last += 1
        samples = np.concatenate(decoded[first:last], axis=1) if last > first else np.zeros((info.channels, 0), np.int32)
        if info.total and samples.shape[1] != info.total:
            raise ValueError("a stream has not as many samples as it says")
        if any(info.md5) and hashlib.md5(_pcm(samples, info.bits, signed=True)).digest() != info.md5:
            raise ValueError("a stream's MD5 does not hold")
        points, before = [], 0
        for f in frames[first:last]:
            points.append((before, f.begin - shift - info.first, f.size))
            before += f.size
        found.append(Decoded(_pcm(samples, info.bits, signed=info.bits > 8), points, samples, info.rate, info.bits))
        first, shift = last, shift + len(streams[i])
    return found


def _pcm(samples: np.ndarray, bits: int, signed: bool) -> bytes:
    width = -(-bits // 8)
    flat = samples.T.ravel()
    if not signed:
        flat = flat + (1 << bits - 1)
    if width == 1:
        return flat.astype(np.uint8).tobytes()
    return np.ascontiguousarray(flat.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def _metadata(s: bytes) -> _Info:
    if s[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info = 4, False, b""
    while not last:
        if at + 4 > len(s):
            raise ValueError("the metadata is cut off")
        last, kind, n = bool(s[at] & 0x80), s[at] & 0x7F, int.from_bytes(s[at + 1 : at + 4], "big")
        if kind == 0:
            info = s[at + 4 : at + 4 + n]
        at += 4 + n
    if len(info) != 34:
        raise ValueError("a stream without STREAMINFO")
    packed = int.from_bytes(info[10:18], "big")
    found = _Info(at, packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), info[18:34])
    if not 4 <= found.bits <= 24:
        raise ValueError("only samples of 4 to 24 bits are read")
    return found


#: Fixed values of the format: block sizes and sample sizes by their codes in a frame's header.
_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {8 + i: 256 << i for i in range(8)}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


def _header_at(head: bytes, begin: int, info: _Info) -> _Frame | None:
    """The frame header at the start of ``head`` (its place is ``begin``), if there is one whose CRC-8 holds."""
    size_code, rate_code, pairing, bits_code = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    if size_code == 0 or rate_code == 15 or pairing > 10 or bits_code in (3, 7) or head[3] & 1:
        return None
    lead, at = head[4], 5
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if lead >= 0x80 and (more < 1 or more > 6):
        return None
    number = lead if not more else lead & (0x3F >> more)
    for _ in range(more):
        number, at = number << 6 | head[at] & 0x3F, at + 1
    size = _SIZES.get(size_code, 0)
    if size_code in (6, 7):
        n = size_code - 5
        size, at = int.from_bytes(head[at : at + n], "big") + 1, at + n
    at += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if _crc8(head[:at]) != head[at]:
        return None
    channels = pairing + 1 if pairing < 8 else 2
    return _Frame(begin, begin + at + 1, size, channels, _BITS.get(bits_code, info.bits), pairing, number, bool(head[1] & 1))


def _find_frames(data: np.ndarray, ranges: list[tuple[int, int]], infos: list[_Info]) -> list[list[_Frame]]:
    """The frames of each stream, end to end between the two places of its range."""
    last = max((end for _, end in ranges), default=0)
    syncs = np.flatnonzero((data[: max(0, last - 1)] == 0xFF) & (data[1:last] & 0xFE == 0xF8))
    heads: list[list[_Frame]] = []
    for (first, end), info in zip(ranges, infos, strict=True):
        own = syncs[np.searchsorted(syncs, first) : np.searchsorted(syncs, end - 1)]
        heads.append([h for at in own.tolist() if (h := _header_at(data[at : at + 18].tobytes(), at, info))])
        if first < end and (not heads[-1] or heads[-1][0].begin != first):
            raise ValueError("no frame where one must begin")
    begin = np.array([h.begin for own in heads for h in own], np.int64)
    ends = np.array([e for own, (_, end) in zip(heads, ranges, strict=True) for e in [*(h.begin for h in own[1:]), *([end] if own else [])]], np.int64)
    good = crc16(data, begin, ends - begin) == 0  # the CRC of a frame with its own CRC is 0
    found, base = [], 0
    for own, info in zip(heads, infos, strict=True):
        frames, i, before = [], 0, 0
        while i < len(own):
            j, holds = i, good[base + i]
            while not holds:  # what looked like a header was within the frame
                j += 1
                if j == len(own):
                    raise ValueError("a frame's CRC-16 does not hold")
                holds = crc16(data, begin[base + i : base + i + 1], ends[base + j : base + j + 1] - begin[base + i])[0] == 0
            frame, frame.end = own[i], int(ends[base + j])
            expected = before if frame.variable else len(frames)
            if frame.channels != info.channels or frame.bits != info.bits or frame.number != expected:
                raise ValueError("a frame differs from its stream, or is out of place")
            frames.append(frame)
            before += frame.size
            i = j + 1
        found.append(frames)
        base += len(own)
    return found


def _words(data: np.ndarray) -> np.ndarray:
    """The 64 bits that follow each byte offset."""
    return np.ndarray(len(data) - 7, ">i8", np.ascontiguousarray(data), strides=(1,)).astype(np.int64)


def _take(words: np.ndarray, bit: np.ndarray, n) -> np.ndarray:
    """The next ``n`` (up to 32, one number or one each) bits as numbers."""
    window = words.take(bit >> 3, mode="clip") << (bit & 7)
    return (window.view(np.uint64) >> (64 - np.asarray(n)).astype(np.uint64)).view(np.int64)


def _signed(value: np.ndarray, n) -> np.ndarray:
    half = np.int64(1) << (np.maximum(n, 1) - 1)
    return (value ^ half) - half


def _decode_frames(data: np.ndarray, frames: list[_Frame]) -> list[np.ndarray]:
    """The samples (channels x size) of each frame: one channel after the other, all frames at once."""
    size = np.array([f.size for f in frames], np.int64)
    channels = np.array([f.channels for f in frames])
    pairing = np.array([f.pairing for f in frames])
    begin = frames[0].begin
    own = data[begin : frames[-1].end + 16]
    words = _words(own)
    bit = np.array([f.body - begin for f in frames], np.int64) * 8
    bits = np.array([f.bits for f in frames], np.int64)
    out: list[list[np.ndarray]] = [[] for _ in frames]
    for c in range(int(channels.max())):
        at = np.flatnonzero(channels > c)
        side = ((pairing[at] == 9) & (c == 0)) | (((pairing[at] == 8) | (pairing[at] == 10)) & (c == 1))
        x, bit[at] = _subframes(own, words, bit[at], bits[at] + side, size[at])
        for i, row in zip(at, x, strict=True):
            out[i].append(row[: size[i]])
    if (-(-bit // 8) != np.array([f.end - begin for f in frames]) - 2).any():
        raise ValueError("a frame does not end where its samples do")
    return [_unpaired(np.stack(rows), f.pairing) if len(rows) > 1 else rows[0][None] for rows, f in zip(out, frames, strict=True)]


def _unpaired(x: np.ndarray, pairing: int) -> np.ndarray:
    """Left and right from left and side (8), side and right (9), middle and side (10)."""
    if pairing == 8:
        x[1] = x[0] - x[1]
    elif pairing == 9:
        x[0] = x[0] + x[1]
    elif pairing == 10:
        middle = x[0] * 2 + (x[1] & 1)
        x = np.stack([(middle + x[1]) >> 1, (middle - x[1]) >> 1])
    return x


def _subframes(data: np.ndarray, words: np.ndarray, bit: np.ndarray, bits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of samples of one subframe each, and where these end."""
    head, bit = _take(words, bit, 8), bit + 8
    kind, wasted = head >> 1, head & 1
    if (head >> 7).any():
        raise ValueError("a subframe does not begin with a zero")
    counted = np.flatnonzero(wasted)
    while len(counted):  # zeros up to a one
        counted = counted[_take(words, bit[counted], 1) == 0]
        wasted[counted] += 1
        bit[counted] += 1
    bit = bit + (wasted > 0)
    bits = bits - wasted
    x = np.zeros((len(bit), int(size.max())), np.int64 if int(bits.max()) > 9 else np.int32)
    at = np.flatnonzero(kind == 0)
    x[at] = _signed(_take(words, bit[at], bits[at]), bits[at])[:, None]
    bit[at] += bits[at]
    for i in np.flatnonzero(kind == 1):
        n, b = int(size[i]), int(bits[i])
        begin = int(bit[i])
        raw = np.unpackbits(data[begin >> 3 : (begin + n * b + 7) >> 3])[begin & 7 : (begin & 7) + n * b].reshape(n, b)
        x[i, :n] = _signed(raw @ (1 << np.arange(b - 1, -1, -1, dtype=np.int64)), b)
        bit[i] += n * b
    at = np.flatnonzero(kind > 1)
    if len(at):
        part, bit[at] = _predicted(words, bit[at], kind[at], bits[at], size[at], x.dtype)
        x[at, : part.shape[1]] = part
    return (x << wasted[:, None].astype(x.dtype) if wasted.any() else x), bit


def _predicted(words: np.ndarray, bit: np.ndarray, kind: np.ndarray, bits: np.ndarray, size: np.ndarray, number) -> tuple[np.ndarray, np.ndarray]:
    """Rows of samples of fixed or LPC subframes, and where these end."""
    lpc = kind >= 32
    order = np.where(lpc, (kind & 31) + 1, kind & 7)
    if (~lpc & ((kind < 8) | (kind > 12))).any() or (order > size).any():
        raise ValueError("a subframe is of a reserved kind")
    by = np.lexsort((order, lpc, -size))
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    bit, lpc, order, size, bits = bit[by], lpc[by], order[by], size[by], bits[by]
    # a row for each time, a column for each subframe: all of them step forward together
    x = np.zeros((int(size.max()), len(bit)), number)
    for j in range(int(order.max())):
        at = np.flatnonzero(order > j)
        x[j, at] = _signed(_take(words, bit[at] + bits[at] * j, bits[at]), bits[at])
    bit = bit + bits * order
    at = np.flatnonzero(lpc)
    weights = np.zeros((int(order[at].max(initial=1)), len(at)), np.int64)
    if len(at):
        precision, down = _take(words, bit[at], 4) + 1, _take(words, bit[at] + 4, 5)
        if (precision > 15).any() or (down > 15).any():
            raise ValueError("a predictor's precision or shift is reserved")
        for j in range(len(weights)):
            on = order[at] > j
            weights[j, on] = _signed(_take(words, bit[at[on]] + 9 + precision[on] * j, precision[on]), precision[on])
        bit[at] += 9 + precision * order[at]
    bit = _residual_codes(words, bit, order, size, x)
    for p in range(1, len(_FIXED)):  # the residual is a difference of this order: sums undo it
        own = np.flatnonzero(~lpc & (order == p))
        if len(own):
            part = x[:, own]
            for _ in range(p):
                part[:p] = np.diff(part[:p], axis=0, prepend=part.dtype.type(0))
            for _ in range(p):
                np.cumsum(part, axis=0, out=part)
            x[:, own] = part
    if len(at):
        x[:, at] = _extrapolated(x[:, at], weights.astype(number), down.astype(number), order[at], size[at])
    return np.ascontiguousarray(x.T)[back], bit[back]


def _extrapolated(x: np.ndarray, weights: np.ndarray, down: np.ndarray, order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Samples from residuals (from row order[i] of column i) and linear predictors: one row after the other."""
    most, live = len(weights), len(order)
    back = np.ascontiguousarray(weights[::-1])
    for t in range(int(order.min()), int(size[0])):
        while size[live - 1] <= t:
            live -= 1
        m = min(most, t)
        guess = np.einsum("jl,jl->l", back[most - m :, :live], x[t - m : t, :live])
        guess >>= down[:live]
        if t < most:
            guess[order[:live] > t] = 0  # still warm-up
        x[t, :live] += guess
    return x


def _residual_codes(words: np.ndarray, bit: np.ndarray, order: np.ndarray, size: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Fill column i of ``x`` from row order[i] with the numbers of its Rice codes, in partitions; returns where they end."""
    method, depth = _take(words, bit, 2), _take(words, bit + 2, 4)
    if (method > 1).any() or (size % (1 << depth)).any() or ((size >> depth) < order).any():
        raise ValueError("a residual is of a reserved kind")
    width = 4 + method
    counts = size - order
    by = np.argsort(-counts, kind="stable")
    pos, n, wide = (bit + 6)[by].astype(np.int64), counts[by], width[by]
    low, raw = np.zeros(len(by), np.int64), np.full(len(by), -1)
    # the codes at which partitions begin: the first one is shorter by the predictor's warm-up
    own = np.repeat(np.arange(len(by)), 1 << depth[by])
    nth = np.arange(len(own)) - np.repeat(np.cumsum(1 << depth[by]) - (1 << depth[by]), 1 << depth[by])
    when = np.maximum(nth * (size >> depth)[by][own] - order[by][own], 0)
    in_order = np.lexsort((nth, when))
    own, when = own[in_order], when[in_order]
    codes = np.zeros((int(n[0]) if len(n) else 0, len(by)), x.dtype)
    live, next_start, escapes = len(pos), 0, False

    def begin(step: int, next_start: int) -> int:
        while next_start < len(when) and when[next_start] <= step:
            last = next_start + int(np.searchsorted(when[next_start:], when[next_start], side="right"))
            at = own[next_start:last]
            next_start = last
            for one in _once(at):
                low[one], pos[one] = _take(words, pos[one], wide[one]), pos[one] + wide[one]
                escaped = one[low[one] == (1 << wide[one]) - 1]
                raw[one] = -1
                raw[escaped], pos[escaped] = _take(words, pos[escaped], 5), pos[escaped] + 5
        return next_start

    for step in range(len(codes)):
        if next_start < len(when) and when[next_start] <= step:
            next_start = begin(step, next_start)
            escapes = bool((raw >= 0).any())
        while n[live - 1] <= step:
            live -= 1
        if escapes:
            at = np.flatnonzero(raw[:live] >= 0)
            value = np.where(raw[at] > 0, _signed(_take(words, pos[at], np.maximum(raw[at], 1)), raw[at]), 0)
            codes[step, at] = np.where(value < 0, -2 * value - 1, 2 * value)
            pos[at] += raw[at]
            rest = np.flatnonzero(raw[:live] < 0)
            codes[step, rest], pos[rest] = _rice_step(words, pos[rest], low[rest])
        else:
            codes[step, :live], pos[:live] = _rice_step(words, pos[:live], low[:live])
    begin(int(size.max()) + 1, next_start)  # empty partitions at the end
    codes = (codes >> 1) ^ -(codes & 1)
    for p in np.unique(order):
        own = np.flatnonzero(order[by] == p)
        x[p : p + len(codes), by[own]] = codes[: len(x) - p, own]
    end = np.empty_like(pos)
    end[by] = pos
    return end


def _once(at: np.ndarray):
    """``at`` in parts without repeats: partitions of one frame that begin together come one after the other."""
    while len(at):
        _, first = np.unique(at, return_index=True)
        yield at[np.sort(first)]
        at = np.delete(at, first)


def _rice_step(words: np.ndarray, pos: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One code of parameter ``low`` at each place, and the places after them."""
    window = words.take(pos >> 3, mode="clip") << (pos & 7)  # 57 bits at least
    top = (window.view(np.uint64) >> np.uint64(32)).view(np.int64)
    q = 1054 - (top.astype(np.float64).view(np.int64) >> 52)  # zeros before the first one, by the exponent
    rest = (window << (q + 1)).view(np.uint64) >> (64 - low).view(np.uint64)
    rest = rest.view(np.int64)
    again = np.flatnonzero((top == 0) | (q + low > 56)) if low.max(initial=0) > 24 or not top.all() else ()
    if len(again):  # a quotient of 32 or more, or bits beyond the window
        far = again[top[again] == 0]
        q[far] = 0
        while len(far):
            q[far] += 32
            if (pos[far] + q[far] >> 3 >= len(words)).any():
                raise ValueError("a code does not end")
            more = _take(words, pos[far] + q[far], 32)
            q[far[more > 0]] += 31 - (np.frexp(more[more > 0].astype(np.float64))[1] - 1)
            far = far[more == 0]
        rest[again] = _take(words, pos[again] + q[again] + 1, low[again])
    return (q << low) | rest, pos + (q + 1 + low)


def features(samples: np.ndarray) -> tuple[int, int, int, float]:
    """Energy (sum of squares), zero crossings, peak and entropy (bits a sample) of one channel's samples."""
    low, high = int(samples.min(initial=0)), int(samples.max(initial=0))
    if high - low <= max(len(samples), 1 << 8):
        count = np.bincount(samples - low)
        value = np.flatnonzero(count)
        count, value = count[value], value + low
    else:
        value, count = np.unique(samples.astype(np.int64), return_counts=True)
    above = samples[samples != 0] > 0
    share = count / max(1, len(samples))
    return int((value * value * count).sum()), int(np.count_nonzero(above[1:] != above[:-1])), max(high, -low), float(round(-(share * np.log2(share)).sum() + 0.0, 6))


def flac_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, media, pcm, blocks, features): each text's UTF-8 bytes, padded, as a FLAC stream and read back.

    The payload is the text's bytes with zeros up to a positive multiple of PAD (null: as empty). media:
    the stored stream; pcm: the payload decoded from it; blocks: array<struct<sample, byte, n>>, the
    seekable offsets of its frames; features: struct<energy, crossings, peak, entropy> of the samples
    decoded. Equal texts give equal columns; rows are independent, so ties, repeated rows and ids and
    other columns do not matter; long texts are coded whole, a bounded number of samples at a
    time; an empty table stays empty. No shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    block = pa.list_(pa.struct([("sample", pa.int64()), ("byte", pa.int64()), ("n", pa.int32())]))

    measure = pa.struct([("energy", pa.int64()), ("crossings", pa.int64()), ("peak", pa.int32()), ("entropy", pa.float64())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = [t or b"" for t in whole.column("text").cast(pa.large_binary()).to_pylist()]
            first = size = 0
            for last in range(1, len(texts) + 1):
                size += len(texts[last - 1])
                if size < GROUP and last < len(texts):
                    continue
                payloads = [t + bytes(-len(t) % PAD or (0 if t else PAD)) for t in texts[first:last]]
                media = encode(payloads)
                read = decode(media)
                points = [[{"sample": a, "byte": b, "n": n} for a, b, n in d.frames] for d in read]
                measured = [dict(zip(measure.names, features(d.samples[0]), strict=True)) for d in read]
                columns = [whole.column("doc_id").slice(first, last - first), pa.array(media, pa.binary()), pa.array([d.pcm for d in read], pa.binary()), pa.array(points, block), pa.array(measured, measure)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "media", "pcm", "blocks", "features"])
                first, size = last, 0

    return docs.select("doc_id", "text").mapInArrow(store, f"doc_id {kind}, media binary, pcm binary, blocks array<struct<sample: long, byte: long, n: int>>, features struct<energy: long, crossings: long, peak: int, entropy: double>")


def op8_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the text's own length rides along as part of the key, as a text may itself end in zeros
    sized = docs.select(F.struct("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).alias("doc_id"), "text")
    stored = flac_columns(sized).withColumnRenamed("doc_id", "key")
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{c}="), F.col(f"features.{c}").cast("string")) for c in ("energy", "crossings", "peak", "entropy")))
    return stored.select(
        "key.doc_id",
        F.col("key.n").alias("n_bytes"),
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pcm, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
