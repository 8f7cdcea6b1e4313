"""FLAC: encoding bytes as 8-bit samples, and decoding streams to PCM with seekable sample offsets.

The decoder handles mono and stereo (independent, left/side, side/right, mid/side) streams of 4 to 24 bits:
constant, verbatim, fixed and linear-prediction subframes, Rice residuals of both parameter sizes with
escapes and partitions. It verifies the header CRC-8 and frame CRC-16 of every frame, and the MD5 of the
samples. Bit strings are decoded for many subframes at once: unary codes end at the next set bit,
so a table of next set bits lets one step of numpy advance every subframe by one sample.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Scratch, map_arrow

#: Samples of a frame that the encoder writes.
FRAME = 4096
#: Bytes of streams that are coded at once; a longer stream goes in runs of frames, so memory does not grow with it.
BATCH_BYTES = 1 << 20
#: Encoded texts are padded to a multiple of this many bytes.
UNIT = 64
SAMPLE_RATE = 8000
#: Parts of the documents whose media are stored one after the other.
ROUNDS = 4
#: Bytes of a stream that are decoded as one part at least.
LEAST_PART = 2048
#: Bytes of a seek point: sample, byte offset from the first frame, samples of the frame.
SEEK_POINT = 18


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


_CRC8 = _crc_table(0x07, 8).tolist()
_CRC16 = _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    out = 0
    for b in data:
        out = _CRC8[out ^ b]
    return out


class _Crc16:
    """CRC-16 of many byte ranges at once: the contribution of each byte depends only on its distance from the end."""

    def __init__(self):
        self.tables = np.zeros((0, 256), np.uint16)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts
        longest = int(sizes.max(initial=0))
        if longest > len(self.tables):
            rows = [_CRC16] if not len(self.tables) else [*self.tables.astype(np.int64)]
            while len(rows) < longest:
                rows.append((rows[-1] << 8 & 0xFFFF) ^ _CRC16[rows[-1] >> 8])
            self.tables = np.array(rows, np.uint16)
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        contributions = self.tables[np.repeat(sizes, sizes) - 1 - at, data[np.repeat(starts, sizes) + at]]
        return np.bitwise_xor.reduceat(contributions, first) if len(sizes) else np.zeros(0, np.uint16)


_crc16 = _Crc16()


def _utf8_number(n: int) -> bytes:
    """A frame number in FLAC's extension of UTF-8 to 36 bits."""
    if n < 128:
        return bytes((n,))
    tail = 1
    while n >= 1 << (6 * tail + (6 - tail if tail < 6 else 0)):
        tail += 1
    lead = (0xFF << (7 - tail)) & 0xFF | n >> (6 * tail)
    return bytes((lead, *(0x80 | n >> (6 * k) & 0x3F for k in range(tail - 1, -1, -1))))


def _bit_fields(size: int, fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """``size`` bytes with values of given widths (up to 32) at given bits; fields do not overlap, so sums are unions."""
    words = np.zeros(size // 4 + 3)
    for at, width, value in fields:
        wide = value.astype(np.uint64) << (64 - (at & 31) - width).astype(np.uint64)
        word = at >> 5
        for k, half in enumerate((wide >> np.uint64(32), wide & np.uint64(0xFFFFFFFF))):
            words += np.bincount(word + k, half, len(words))
    return words.astype(">u4").view(np.uint8)[:size].copy()


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a FLAC stream of one channel with 8-bit samples (bytes less 128), FRAME samples a frame, the last the rest."""
    made: list[list[bytes]] = [[] for _ in payloads]
    run: list[tuple[int, int, bytes]] = []

    def close() -> None:
        for (p, _, _), frame in zip(run, _encode_frames([(number, part) for _, number, part in run]), strict=True):
            made[p].append(frame)
        run.clear()

    for p, data in enumerate(payloads):
        for at in range(0, len(data), FRAME):
            run.append((p, at // FRAME, data[at : at + FRAME]))
            if len(run) * FRAME >= BATCH_BYTES:
                close()
    close()
    out = []
    for payload, frames in zip(payloads, made, strict=True):
        seeks, at = [], 0
        for i, frame in enumerate(frames):
            seeks.append((FRAME * i).to_bytes(8, "big") + at.to_bytes(8, "big") + min(FRAME, len(payload) - FRAME * i).to_bytes(2, "big"))
            at += len(frame)
        out.append(b"".join((_stream_head(payload, b"".join(seeks)), *frames)))
    return out


def _encode_frames(parts: list[tuple[int, bytes]]) -> list[bytes]:
    """The frames of (frame number, samples) pairs.

    Each takes the fixed predictor (order 0 to 2) with the least sum of magnitudes and the Rice parameter of its mean,
    or is verbatim where that is no longer.
    """
    lengths = [len(part) for _, part in parts]
    n = np.array(lengths, np.int64)
    starts = np.cumsum(n) - n
    x = np.frombuffer(b"".join(part for _, part in parts), np.uint8).astype(np.int32) - 128
    within = np.arange(len(x)) - np.repeat(starts, n)
    residuals = [x]
    for order in (1, 2):
        d = residuals[-1] - np.concatenate(([0], residuals[-1][:-1]))
        residuals.append(np.where(within >= order, d, 0))
    if len(n):
        sums = np.stack([np.add.reduceat(np.abs(r), starts) for r in residuals]) + np.array([[0], [128], [256]])
        sums[:, n < 3] = np.array([[0], [1], [1]])
    else:
        sums = np.zeros((3, 0))
    order = sums.argmin(axis=0)
    residual = np.choose(np.repeat(order, n), residuals)
    coded = (residual << 1) ^ (residual >> 31)
    warm = within < np.repeat(order, n)
    mean = np.add.reduceat(np.where(warm, 0, coded), starts) / np.maximum(n - order, 1) if len(n) else np.zeros(0)
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.7 + 0.3)), 0, 14).astype(np.int64)
    each_k = np.repeat(k, n)
    quotient = coded >> each_k
    bits = np.where(warm, 8, quotient + 1 + each_k)
    total = np.add.reduceat(bits, starts) if len(n) else np.zeros(0, np.int64)
    verbatim = (total + 10 >= 8 * n) | (n <= 4)
    # One bit string for all subframes; each begins at a byte, after room for its frame header.
    headers = []
    for (number, _), size, o, v in zip(parts, lengths, order.tolist(), verbatim.tolist(), strict=True):
        head = bytes((0xFF, 0xF8, (0x70 if size != FRAME else 0xC0) | 0x04, 0x02)) + _utf8_number(number) + ((size - 1).to_bytes(2, "big") if size != FRAME else b"")
        headers.append(head + bytes((crc8(head), 0x02 if v else (0x08 | o) << 1)))
    rice = ~verbatim
    body_bits = np.where(verbatim, 8 * n, total + 10)
    body_bytes = -(-body_bits // 8)
    head_sizes = np.array([len(h) for h in headers], np.int64)
    frame_sizes = head_sizes + body_bytes + 2
    frame_starts = np.cumsum(frame_sizes) - frame_sizes
    body_starts = frame_starts + head_sizes
    size = int(frame_sizes.sum())
    # Samples begin after warm-up samples (8 bits each, before the 10 bits of coding method, partition order and parameter).
    in_rice = np.repeat(rice, n)
    place = np.repeat(body_starts * 8 - (np.cumsum(total) - total), n) + (np.cumsum(bits) - bits)
    coded_here = in_rice & ~warm
    pick = slice(None) if coded_here.all() else np.flatnonzero(coded_here)
    kk = each_k[pick]
    fields = [(place[pick] + quotient[pick] + 10, kk + 1, (1 << kk) | coded[pick] & ((1 << kk) - 1))]
    pick = np.flatnonzero(in_rice & warm)
    fields.append((place[pick], np.full(len(pick), 8), x[pick] & 0xFF))
    fields.append(((body_starts * 8 + 8 * order + 6)[rice], np.full(int(rice.sum()), 4), k[rice]))
    data = _bit_fields(size, fields)
    pick = np.flatnonzero(~in_rice)
    data[np.repeat(body_starts, n)[pick] + within[pick]] = (x[pick] & 0xFF).astype(np.uint8)
    for start, head in zip(frame_starts.tolist(), headers, strict=True):
        data[start : start + len(head)] = np.frombuffer(head, np.uint8)
    ends = frame_starts + frame_sizes - 2
    crc = _crc16(data, frame_starts, ends)
    data[ends], data[ends + 1] = (crc >> 8).astype(np.uint8), (crc & 0xFF).astype(np.uint8)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(frame_starts.tolist(), (frame_starts + frame_sizes).tolist(), strict=True)]


def _stream_head(payload: bytes, seeks: bytes) -> bytes:
    """STREAMINFO and, for streams of several frames, a SEEKTABLE with every frame."""
    md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes(), usedforsecurity=False).digest()
    packed = SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = FRAME.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + md5
    several = len(seeks) > SEEK_POINT
    head = b"fLaC" + bytes((0 if several else 0x80,)) + len(info).to_bytes(3, "big") + info
    return head + (b"\x83" + len(seeks).to_bytes(3, "big") + seeks if several else b"")


@dataclass
class Info:
    """STREAMINFO and where the frames begin."""

    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    frames_at: int
    seeks: list[int]


def read_info(data: bytes) -> Info:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, seeks = 4, None, []
    while True:
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            body = data[at + 4 : at + 4 + size]
            packed = int.from_bytes(body[10:18], "big")
            info = Info(packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), body[18:34], 0, [])
        if kind == 3:
            table = data[at + 4 : at + 4 + size]
            points = (table[i : i + SEEK_POINT] for i in range(0, size, SEEK_POINT))
            seeks = [int.from_bytes(p[8:16], "big") for p in points if p[:8] != b"\xff" * 8]
        at += 4 + size
        if last:
            break
    if info is None:
        raise ValueError("no STREAMINFO")
    info.frames_at, info.seeks = at, [s for s in seeks if at + s < len(data)]
    return info


_RATES = {4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000, 1: 88200, 2: 176400, 3: 192000}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


@dataclass
class _Frame:
    samples: int
    assignment: int
    bits: int
    body: int


def _frame_header(data: bytes, at: int, info: Info) -> _Frame:
    if data[at] != 0xFF or data[at + 1] & 0xFC != 0xF8:
        raise ValueError(f"no frame sync at byte {at}")
    size_code, rate_code, assignment, bits_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    p = at + 4
    lead = data[p]
    p += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if size_code == 1:
        samples = 192
    elif size_code <= 5:
        samples = 576 << (size_code - 2)
    elif size_code in (6, 7):
        wide = size_code - 5
        samples = int.from_bytes(data[p : p + wide], "big") + 1
        p += wide
    else:
        samples = 256 << (size_code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(data[at:p]) != data[p]:
        raise ValueError(f"header checksum of the frame at byte {at} is wrong")
    return _Frame(samples, assignment, _BITS.get(bits_code, info.bits), p + 1)


_FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


class _Lane:
    """A part of a stream between seek points (or all of it) being decoded: its place, and the frame and channel it is in."""

    def __init__(self, data: bytes, info: Info, offset: int):
        self.data, self.info, self.offset, self.at, self.end = data, info, offset, 0, len(data)
        self.frame: _Frame | None = None
        self.frame_at = self.bit = 0
        self.channels: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []

    def bits(self, n: int) -> int:
        """The next ``n`` bits of the stream as an unsigned number."""
        first, last = self.bit >> 3, (self.bit + n + 7) >> 3
        word = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.bit - n)
        self.bit += n
        return word & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.bits(n)
        return v - (1 << n) if n and v >> (n - 1) else v


def _signed_bits(lane: _Lane, count: int, width: int) -> np.ndarray:
    """``count`` signed numbers of ``width`` bits each."""
    if width == 8 and lane.bit % 8 == 0:
        out = np.frombuffer(lane.data, np.int8, count, lane.bit >> 3).astype(np.int64)
        lane.bit += 8 * count
        return out
    return np.array([lane.signed(width) for _ in range(count)], np.int64)


@dataclass
class _Rice:
    """A subframe whose residual is still to be decoded."""

    lane: _Lane
    order: int
    coefficients: tuple[int, ...]
    shift: int
    wasted: int
    warm: np.ndarray
    n: int
    parameter_bits: int = 4
    partitions: int = 1


def _open_subframe(lane: _Lane) -> np.ndarray | _Rice:
    """Decodes the header of the next subframe; returns its samples, or what its residual needs."""
    frame = lane.frame
    side = {8: 1, 9: 0, 10: 1}.get(frame.assignment)
    width = frame.bits + (side == len(lane.channels))
    kind = lane.bits(8)
    wasted = 0
    if kind & 1:
        wasted = 1
        while not lane.bits(1):
            wasted += 1
    width, kind = width - wasted, kind >> 1
    if kind == 0:
        return np.full(frame.samples, lane.signed(width), np.int64) << wasted
    if kind == 1:
        return _signed_bits(lane, frame.samples, width) << wasted
    if 8 <= kind <= 12:
        order = kind - 8
        warm = _signed_bits(lane, order, width)
        coefficients, shift = _FIXED[order], 0
    elif kind >= 32:
        order = kind - 31
        warm = _signed_bits(lane, order, width)
        precision = lane.bits(4) + 1
        shift = lane.signed(5)
        coefficients = tuple(lane.signed(precision) for _ in range(order))
    else:
        raise ValueError(f"reserved subframe type {kind}")
    method = lane.bits(2)
    if method > 1:
        raise ValueError("reserved residual coding")
    return _Rice(lane, order, coefficients, shift, wasted, warm, frame.samples, 4 + method, 1 << lane.bits(4))


def _residuals(open_: list[_Rice], bits: "_Bits") -> list[np.ndarray]:
    """The residuals of many subframes, a partition of each at a time, a sample of each at a step."""
    out = [np.zeros(s.n - s.order, np.int64) for s in open_]
    done = [0] * len(open_)
    for part in range(max(s.partitions for s in open_)):
        lanes, counts, k = [], [], []
        for i, s in enumerate(open_):
            if part >= s.partitions:
                continue
            count = s.n // s.partitions - (s.order if part == 0 else 0)
            parameter = s.lane.bits(s.parameter_bits)
            if parameter == (1 << s.parameter_bits) - 1:
                width = s.lane.bits(5)
                out[i][done[i] : done[i] + count] = _signed_bits(s.lane, count, width) if width else 0
                done[i] += count
            elif count:
                lanes.append(i)
                counts.append(count)
                k.append(parameter)
        if not lanes:
            continue
        order = np.argsort(-np.array(counts), kind="stable")
        lanes, counts, k = np.array(lanes)[order], np.array(counts)[order], np.array(k)[order]
        begin = np.array([8 * open_[i].lane.offset + open_[i].lane.bit for i in lanes.tolist()])
        ends = bits.unary_ends(begin, counts, k)
        inside = np.arange(len(ends)) < counts[:, None]
        place = ends.T[inside].astype(np.int64)
        each_k = np.repeat(k, counts)
        first = np.cumsum(counts) - counts
        before = np.empty_like(place)
        before[1:] = place[:-1] + each_k[1:] + 1
        before[first] = begin
        coded = (place - before) << each_k | bits.fields(place + 1, each_k)
        values = (coded >> 1) ^ -(coded & 1)
        for j, (i, count, a) in enumerate(zip(lanes.tolist(), counts.tolist(), first.tolist(), strict=True)):
            out[i][done[i] : done[i] + count] = values[a : a + count]
            done[i] += count
            open_[i].lane.bit = int(place[a + count - 1] + k[j] + 1) - 8 * open_[i].lane.offset
    return out


class _Bits:
    """Random access to a bit string: numbers at given bits, and the ends of unary codes."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data + bytes(8), np.uint8)
        bits = np.unpackbits(raw)
        self.ones = np.concatenate((np.flatnonzero(bits), [len(bits)])).astype(np.int32)
        # Set bits before each place: the number of the first one at or after it.
        self.rank = np.cumsum(bits, dtype=np.int32) - bits
        wide = raw[:-7].astype(np.uint64)
        for i in range(1, 8):
            wide = wide << np.uint64(8) | raw[i : len(raw) - 7 + i]
        self.wide = wide

    def fields(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Unsigned numbers of up to 32 bits."""
        word = self.wide[at >> 3] << (at & 7).astype(np.uint64)
        return np.where(width > 0, word >> (64 - np.maximum(width, 1)).astype(np.uint64), 0).astype(np.int64)

    def unary_ends(self, begin: np.ndarray, counts: np.ndarray, k: np.ndarray) -> np.ndarray:
        """ends[t, j]: the set bit that ends the unary part of code t of lane j; ``counts`` descends."""
        steps = int(counts.max())
        ends = np.zeros((steps, len(begin)), np.int32)
        live = np.searchsorted(-counts, -np.arange(steps), side="left").tolist()
        skip = (k + 1).astype(np.int32)
        at, rank, ones, last = begin.astype(np.int32), self.rank, self.ones, len(self.rank) - 1
        for t in range(steps):
            n = live[t]
            if n < len(at):
                at, skip = at[:n], skip[:n]
            end = ones[rank[at]]
            ends[t, :n] = end
            at = np.minimum(end + skip, last)
        return ends


def _predict(open_: list[_Rice], residuals: list[np.ndarray]) -> list[np.ndarray]:
    """Samples from residuals: fixed orders by running sums, linear prediction for many subframes in step."""
    out: list[np.ndarray | None] = [None] * len(open_)
    linear = []
    for i, (s, r) in enumerate(zip(open_, residuals, strict=True)):
        if s.shift == 0 and s.order <= 4 and s.coefficients == _FIXED[s.order]:
            level = r
            for order in range(s.order, 0, -1):
                start = np.diff(s.warm, order - 1)[-1] if order > 1 else s.warm[-1]
                level = np.cumsum(np.concatenate(([start], level)))[1:]
            out[i] = np.concatenate((s.warm, level)) << s.wasted
        else:
            linear.append(i)
    if linear:
        longest, deepest = max(open_[i].n for i in linear), max(open_[i].order for i in linear)
        x = np.zeros((longest + deepest, len(linear)), np.int64)
        weights = np.zeros((deepest, len(linear)), np.int64)
        e = np.zeros((longest, len(linear)), np.int64)
        order = np.array([open_[i].order for i in linear])
        shift = np.array([open_[i].shift for i in linear])
        for j, i in enumerate(linear):
            s = open_[i]
            weights[: s.order, j] = s.coefficients
            e[s.order : s.n, j] = residuals[i]
            x[deepest : deepest + s.order, j] = s.warm
        for t in range(longest):
            predicted = (weights * x[deepest + t - 1 - np.arange(deepest)]).sum(axis=0) >> shift
            x[deepest + t] = np.where(t < order, x[deepest + t], predicted + e[t])
        for j, i in enumerate(linear):
            out[i] = x[deepest : deepest + open_[i].n, j] << open_[i].wasted
    return out


def _stereo(channels: list[np.ndarray], assignment: int) -> list[np.ndarray]:
    if assignment < 8:
        return channels
    a, b = channels
    if assignment == 8:
        return [a, a - b]
    if assignment == 9:
        return [a + b, b]
    mid = a << 1 | b & 1
    return [(mid + b) >> 1, (mid - b) >> 1]


def _decode_run(parts: list[tuple[bytes, Info]]) -> list[list[np.ndarray]]:
    """The blocks of samples of parts of streams, each of whole frames; raises for a wrong checksum."""
    joined = b"".join(data for data, _ in parts)
    bits = _Bits(joined)
    lanes, offset = [], 0
    for data, info in parts:
        lanes.append(_Lane(data, info, offset))
        offset += len(data)
    frames: list[tuple[int, int]] = []
    active = [x for x in lanes if x.at < x.end]
    while active:
        open_: list[_Rice] = []
        for lane in active:
            if lane.frame is None:
                lane.frame, lane.frame_at, lane.channels = _frame_header(lane.data, lane.at, lane.info), lane.at, []
                lane.bit = 8 * lane.frame.body
            got = _open_subframe(lane)
            if isinstance(got, _Rice):
                open_.append(got)
            else:
                lane.channels.append(got)
        for s, samples in zip(open_, _predict(open_, _residuals(open_, bits)) if open_ else [], strict=True):
            s.lane.channels.append(samples)
        for lane in active:
            wanted = 2 if lane.frame.assignment >= 8 else lane.frame.assignment + 1
            if len(lane.channels) == wanted:
                end = (lane.bit + 7) >> 3
                frames.append((lane.offset + lane.frame_at, lane.offset + end))
                lane.blocks.append(np.stack(_stereo(lane.channels, lane.frame.assignment), axis=1))
                lane.at, lane.frame = end + 2, None
        active = [x for x in active if x.frame or x.at < x.end]
    data = np.frombuffer(joined, np.uint8)
    starts, ends = (np.array([f[i] for f in frames], np.int64) for i in (0, 1))
    if len(frames) and ((data[ends].astype(np.int64) << 8 | data[ends + 1]) != _crc16(data, starts, ends)).any():
        raise ValueError("a frame checksum is wrong")
    return [lane.blocks for lane in lanes]


def _pcm(block: np.ndarray, info: Info) -> bytes:
    """Interleaved little-endian samples in as few whole bytes as they need."""
    return block.astype("<i4").reshape(-1, 1).view(np.uint8)[:, : (info.bits + 7) // 8].tobytes()


def decode_blocks(streams: list[bytes]) -> Iterator[tuple[int, Info, list[np.ndarray], bool]]:
    """(number of the stream, STREAMINFO, blocks of samples of shape (n, channels), whether they are its last), in order.

    Streams with seek points are decoded in runs of about BATCH_BYTES between them. Raises ValueError for a wrong
    checksum or sample count, and for reserved codes.
    """
    run: list[tuple[int, bytes, Info, bool]] = []
    count, digest = 0, hashlib.md5(usedforsecurity=False)

    def close() -> Iterator[tuple[int, Info, list[np.ndarray], bool]]:
        nonlocal count, digest
        for (number, _, info, last), blocks in zip(run, _decode_run([(data, info) for _, data, info, _ in run]), strict=True):
            count += sum(map(len, blocks))
            if any(info.md5):
                for block in blocks:
                    digest.update(_pcm(block, info))
            if last:
                if info.samples and count != info.samples:
                    raise ValueError("a stream has another number of samples than it says")
                if any(info.md5) and digest.digest() != info.md5:
                    raise ValueError("the samples have another MD5 than the stream says")
                count, digest = 0, hashlib.md5(usedforsecurity=False)
            yield number, info, blocks, last
        run.clear()

    size = 0
    for number, stream in enumerate(streams):
        info = read_info(stream)
        starts = sorted({info.frames_at, *(info.frames_at + s for s in info.seeks)})
        # Parts are runs of frames: seek points closer than the least part are passed over.
        cuts = [starts[0]]
        for s in starts[1:]:
            if s - cuts[-1] >= LEAST_PART:
                cuts.append(s)
        for a, b in zip(cuts, [*cuts[1:], len(stream)], strict=True):
            run.append((number, stream[a:b], info, b == len(stream)))
            size += b - a
            if size >= BATCH_BYTES:
                yield from close()
                size = 0
    yield from close()


def decode_streams(streams: list[bytes]) -> list[tuple[Info, list[np.ndarray]]]:
    """For each stream its STREAMINFO and all its blocks."""
    out: list[tuple[Info, list[np.ndarray]]] = []
    for number, info, blocks, _ in decode_blocks(streams):
        if number == len(out):
            out.append((info, []))
        out[number][1].extend(blocks)
    return out


def padded(text: str | None) -> bytes:
    """UTF-8 bytes of the text (null: none) and zeros up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _batched(batches: Iterator[pa.RecordBatch], column: int, size) -> Iterator[tuple[list, list]]:
    """(ids, values) in runs of about BATCH_BYTES."""
    ids, values, total = [], [], 0
    for batch in batches:
        numbers = batch.column(0)
        for i in range(batch.num_rows):
            value = batch.column(column)[i].as_py()
            ids.append(numbers[i].as_py())
            values.append(value)
            total += size(value)
            if total >= BATCH_BYTES:
                yield ids, values
                ids, values, total = [], [], 0
    if ids:
        yield ids, values


def texts_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id, n_bytes, media): the padded UTF-8 bytes of each text as a FLAC stream; other columns are dropped.

    Null and empty texts give UNIT zero bytes. Equal texts have equal media; repeated rows stay.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, texts in _batched(batches, 1, lambda t: len(t or "")):
            for i, t, media in zip(ids, texts, encode_streams([padded(t) for t in texts]), strict=True):
                yield {"_id": i, "n_bytes": len((t or "").encode()), "media": media}

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_arrow(narrow, rows, f"_id {kind}, n_bytes bigint, media binary", 200, heavy="media").withColumnRenamed("_id", id_col)


class _Digest:
    """What is gathered over a stream's blocks while they pass: payload size and digests, and the feature."""

    def __init__(self):
        self.payload, self.tail, self.size = hashlib.sha256(), b"", 0
        self.energy = self.crossings = self.peak = 0
        self.sign: bool | None = None

    def add(self, block: np.ndarray) -> None:
        x = block[:, 0].astype(np.int64)
        raw = (x + 128).astype(np.uint8).tobytes()
        self.payload.update(raw)
        self.tail = (self.tail + raw)[-UNIT:]
        self.size += len(raw)
        sign = x >= 0
        self.crossings += int(np.count_nonzero(np.diff(sign))) + (self.sign is not None and self.sign != bool(sign[0]))
        self.sign = bool(sign[-1])
        self.energy += int((x * x).sum())
        self.peak = max(self.peak, int(np.abs(x).max()))

    def row(self, media: bytes) -> dict:
        return {"payload_bytes": self.size, "payload_sha256": self.payload.hexdigest(), "tail_crc32": zlib.crc32(self.tail), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": f"{self.energy}:{self.crossings}:{self.peak}"}


_DIGEST = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
_BLOCK = "block bigint, sample_offset bigint, n_samples bigint, sample_rate bigint, channels bigint, bits bigint, pcm binary"


def media_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", digests: bool = False) -> DataFrame:
    """Returns (id, block, sample_offset, n_samples, sample_rate, channels, bits, pcm): a row per FLAC frame.

    ``pcm`` holds interleaved little-endian samples in as few whole bytes as they need; a reader seeks to
    the last block with ``sample_offset`` at or before the wanted sample. With ``digests``, the last block of each
    stream has a struct ``digest`` of the whole (of the first channel, as 8-bit samples): payload size, SHA-256 and the
    CRC-32 of its last UNIT bytes, the stream's size and SHA-256, and the feature "energy:crossings:peak" in integers
    (the sum of squares, the sign changes, the largest magnitude). Null media and streams without samples give no
    rows; a damaged stream raises. Repeated rows stay; other columns, whatever their names, are dropped.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, streams in _batched(batches, 1, len):
            offset, place, digest = 0, 0, _Digest()
            for number, info, blocks, last in decode_blocks(streams):
                for i, block in enumerate(blocks):
                    row = {"_id": ids[number], "block": place, "sample_offset": offset, "n_samples": len(block), "sample_rate": info.rate, "channels": info.channels, "bits": info.bits, "pcm": _pcm(block, info)}
                    if digests:
                        digest.add(block)
                        row["digest"] = digest.row(streams[number]) if last and i == len(blocks) - 1 else None
                    yield row
                    offset, place = offset + len(block), place + 1
                if last:
                    offset, place, digest = 0, 0, _Digest()

    narrow = media.where(F.col(media_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(media_col).alias("_media"))
    columns = f"_id {kind}, {_BLOCK}" + (f", digest struct<{_DIGEST.replace(' ', ':').replace(',:', ',')}>" if digests else "")
    return map_arrow(narrow, rows, columns, 500, heavy="pcm").withColumnRenamed("_id", id_col)


def media_digests(media: DataFrame, id_col: str = "doc_id", scratch: Scratch | None = None, name: str = "blocks") -> DataFrame:
    """(id, n_bytes, then the blocks' digests) of media of ``texts_to_media``, a row per stream.

    With ``scratch`` the PCM blocks are written there as ``name``, and the digests read from what was written.
    """
    keyed = media.select(F.struct(F.col(id_col).alias("id"), "n_bytes").alias("_key"), "media")
    blocks = media_blocks(keyed, "_key", "media", digests=True)
    blocks = scratch.keep(blocks, name) if scratch else blocks
    return blocks.where("digest IS NOT NULL").select(F.col("_key.id").alias(id_col), F.col("_key.n_bytes").alias("n_bytes"), "digest.*")


def store_media(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as FLAC, reads the stored streams back into stored PCM blocks, and returns their ``media_digests``.

    Media are hardly smaller than the texts, so they lie in scratch storage for one of ``rounds`` parts of the
    documents at a time (by a hash of text and id; together the parts are all documents). Null and empty texts
    give UNIT zero bytes; equal texts have equal values, repeated rows and null ids stay. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "flac")
    parts = []
    for r in range(rounds):
        mine = docs.where(F.pmod(F.xxhash64(F.col(text_col), F.col(id_col)), F.lit(rounds)) == r)
        media = scratch.keep(texts_to_media(mine, id_col, text_col), f"media{r}")
        parts.append(scratch.keep(media_digests(media, id_col, scratch, f"blocks{r}"), f"digests{r}"))
        scratch.drop(f"media{r}", f"blocks{r}")
    return reduce(DataFrame.unionByName, parts)
