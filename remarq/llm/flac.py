"""Operator 8: FLAC media columns, encoded and decoded with numpy, many frames at a time.

A byte payload becomes a mono FLAC stream of 8-bit samples (byte - 128) in frames of 576 samples: a constant, verbatim, fixed
linear predictor (orders 0 to 2) or LPC subframe (order ``LPC_ORDER``, fitted to the frame's autocorrelation) with Rice residuals in one partition, whichever is shortest. A seek table names the
sample and byte offset of every frame, or of every so many in a very long stream, so any sample range is read from the frames around it, and
frames decode side by side: each step takes the next residual of every frame in a slice. Where the table is thin or there is none, the frames in between are walked
from one end to the next. Decoding
covers constant, verbatim, fixed (orders 0 to 4) and LPC subframes, any partition order and escaped partitions of both Rice
methods; it verifies each frame's header CRC-8 and CRC-16, and the stream's MD5. Other profiles (stereo, other block or sample sizes, wasted bits) are
refused with an error.

Media are written one behind the other into files, with a table of their places, and read back by range; or they are a column. ``pcm_blocks`` decodes them to rows of PCM bytes with the offset of their first sample, to be written as a
table; ``read_samples`` takes a range from the blocks that hold it.

Defined cases: a null or empty text is one frame of padding; equal texts give equal streams; repeated rows stay
repeated; a very long text is encoded and decoded in slices of frames, though its bytes are held whole by the task; empty tables give empty results; other columns are left out whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_folder, open_fs, stored
from .columns import column
from .storage import new_file

FRAME = 576
PAD = 255
RATE = 8000
#: Frames that are worked on at once: bounds memory, whatever the texts' lengths.
SLICE = 4096
#: Text bytes taken together.
BATCH_BYTES = 2 << 20
MOST_ORDER = 2
MOST_K = 8
#: Order of LPC subframes, bits of a quantised coefficient, and their shift.
LPC_ORDER, PRECISION, SHIFT = 6, 10, 8
#: Samples of a PCM block: a whole number of frames.
PCM_BLOCK = FRAME * 2048
#: Bytes of a media file from which a new one begins.
CONTAINER_BYTES = 64 << 20
#: A seek point, as the format has it.
POINT = [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]


def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    values = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        values = np.where(values & top, (values << 1) ^ poly, values << 1) & mask
    return values.astype(np.uint16)


CRC8 = _crc_table(8, 0x07)
CRC16 = _crc_table(16, 0x8005)
#: CRC-16 of two bytes at once, by the state combined with them.
CRC16_WORD = (CRC16[(CRC16[np.arange(1 << 16) >> 8].astype(np.uint32) >> 8) ^ (np.arange(1 << 16) & 255)].astype(np.uint32) ^ ((CRC16[np.arange(1 << 16) >> 8].astype(np.uint32) << 8) & 0xFFFF)).astype(np.uint16)
#: Leading zeros of 16 bits.
ZEROS = (16 - np.ceil(np.log2(np.arange(1 << 16) + 1.0))).astype(np.uint32)


def _crc16(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of many ranges, a word of each at a time, longest ranges first so that those at work stay in front."""
    order = np.argsort(begin - end, kind="stable")
    at, size = begin[order], (end - begin)[order]
    crc = np.zeros(len(at), np.uint16)
    words = size // 2
    wide = (data[:-1].astype(np.uint16) << 8) | data[1:]
    live = len(at)
    for i in range(int(words.max()) if len(at) else 0):
        while live and words[live - 1] <= i:
            live -= 1
        crc[:live] = CRC16_WORD[crc[:live] ^ wide[at[:live] + 2 * i]]
    odd = np.flatnonzero(size & 1)
    crc[odd] = (crc[odd] << 8) ^ CRC16[(crc[odd] >> 8) ^ data[at[odd] + size[odd] - 1]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF << (8 - size)) & 0xFF | n >> (6 * (size - 1)), *tail])


def _heads(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame headers with their CRC-8, padded to 16 bytes, and their lengths."""
    fixed = b"\xff\xf8\x24\x02"  # fixed block size; 576 samples at 8 kHz; mono, 8 bits
    heads, lengths = np.zeros((len(numbers), 16), np.uint8), np.zeros(len(numbers), np.int64)
    distinct, place = np.unique(numbers, return_inverse=True)
    rows, sizes = np.zeros((len(distinct), 16), np.uint8), np.zeros(len(distinct), np.int64)
    for i, n in enumerate(distinct.tolist()):
        head = fixed + _coded_number(n)
        crc = 0
        for b in head:
            crc = int(CRC8[crc ^ b])
        rows[i, : len(head) + 1] = np.frombuffer(head + bytes([crc]), np.uint8)
        sizes[i] = len(head) + 1
    heads[:], lengths[:] = rows[place], sizes[place]
    return heads, lengths


def _rice_cost(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals folded to whole numbers, the better of two Rice parameters near their mean, and the bits that they take."""
    u = ((r << 1) ^ (r >> 31)).astype(np.uint16)
    mean = u.mean(axis=1, dtype=np.float32)
    guess = np.clip(np.floor(np.log2(np.maximum(1.0, mean * 0.6931))), 0, MOST_K - 1).astype(np.uint16)
    sizes = [u.shape[1] * (k.astype(np.int64) + 1) + (u >> k[:, None]).sum(axis=1, dtype=np.int64) for k in (guess, guess + 1)]
    return u, np.where(sizes[1] < sizes[0], guess + 1, guess).astype(np.uint16), np.minimum(*sizes)


def lpc(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of each frame (the one for the sample before comes first), and the residuals that they leave."""
    x = samples.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", x[:, lag:], x[:, : x.shape[1] - lag]) for lag in range(LPC_ORDER + 1)], axis=1).astype(np.float64)
    error, a = r[:, 0] + 1e-9, np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):  # Levinson and Durbin's recursion, all frames together
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = 1 << (PRECISION - 1)
    q = np.clip(np.rint(a * (1 << SHIFT)), -most, most - 1).astype(np.int32)
    y = samples.astype(np.int32)
    guess = sum(q[:, j : j + 1] * y[:, LPC_ORDER - 1 - j : y.shape[1] - 1 - j] for j in range(LPC_ORDER)) >> SHIFT
    return q, y[:, LPC_ORDER:] - guess


def _put(out: np.ndarray, at: np.ndarray, value: np.ndarray, size: int) -> None:
    """Adds values of up to 16 bits at bit positions of a buffer that is zero there; no two in one call touch the same byte."""
    shifted = (value & ((1 << size) - 1)) << (24 - (at & 7) - size)
    for i in range(3):
        out[(at >> 3) + i] |= ((shifted >> (16 - 8 * i)) & 255).astype(np.uint8)


def _put_rice(out: np.ndarray, start: np.ndarray, u: np.ndarray, k: np.ndarray) -> None:
    """Rice codes of each row, one behind the other from the row's bit position."""
    k = k[:, None]
    q = u >> k
    size = q + 1 + k
    bit = (np.cumsum(size, axis=1) - size + start[:, None] + q).ravel()  # of the one that ends the unary part
    value = ((1 << k) | (u & ((1 << k) - 1))).ravel()
    byte = bit >> 3
    shifted = value << (16 - (bit & 7) - (np.broadcast_to(k, u.shape).ravel() + 1))
    for part, where in ((shifted >> 8, byte), (shifted & 255, byte + 1)):
        runs = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
        out[where[runs]] += np.add.reduceat(part, runs).astype(np.uint8)


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples as int8 rows of a frame each -> the frames' bytes one after another, and each frame's end."""
    n_frames = len(samples)
    x = samples.astype(np.int32)
    coefficients, left = lpc(samples)
    #: For each kind its order, folded residuals and parameters, and the bits of its subframe behind the first byte.
    kinds, cost = [], []
    for order in range(MOST_ORDER + 1):
        u, k, bits = _rice_cost(np.diff(x, n=order, axis=1))
        kinds.append((order, u, k))
        cost.append(8 * order + 10 + bits)
    wild = (np.abs(left) >= 1 << 15).any(axis=1)
    u, k, bits = _rice_cost(np.where(wild[:, None], 0, left))
    kinds.append((LPC_ORDER, u, k))
    cost.append(np.where(wild, 1 << 40, 8 * LPC_ORDER + 9 + LPC_ORDER * PRECISION + 10 + bits))
    cost = np.array(cost)
    best = cost.argmin(axis=0)
    bits = cost[best, np.arange(n_frames)]
    constant = (samples == samples[:, :1]).all(axis=1)
    verbatim = (bits >= 8 * FRAME) & ~constant
    body = np.where(constant, 2, np.where(verbatim, 1 + FRAME, 1 + (bits + 7) // 8))
    heads, head_sizes = _heads(numbers)
    ends = np.cumsum(head_sizes + body + 2)
    begin = ends - (head_sizes + body + 2)
    out = np.zeros(int(ends[-1]) + 3 if n_frames else 3, np.uint8)
    for i in range(int(head_sizes.max()) if n_frames else 0):
        some = np.flatnonzero(head_sizes > i)
        out[begin[some] + i] = heads[some, i]
    at = begin + head_sizes
    raw = samples.view(np.uint8)
    own = np.flatnonzero(constant)
    out[at[own]], out[at[own] + 1] = 0, raw[own, 0]
    own = np.flatnonzero(verbatim)
    out[at[own]] = 2
    out[(at[own] + 1)[:, None] + np.arange(FRAME)] = raw[own]
    for kind, (order, u, k) in enumerate(kinds):
        own = np.flatnonzero((best == kind) & ~constant & ~verbatim)
        if not len(own):
            continue
        linear = kind == len(kinds) - 1
        out[at[own]] = (31 + order if linear else 8 | order) << 1
        for i in range(order):
            out[at[own] + 1 + i] = raw[own, i]
        params = (at[own] + 1 + order) * 8
        if linear:
            _put(out, params, np.full(len(own), PRECISION - 1), 4)
            _put(out, params + 4, np.full(len(own), SHIFT), 5)
            for j in range(order):
                _put(out, params + 9 + j * PRECISION, coefficients[own, j].astype(np.int64), PRECISION)
            params = params + 9 + order * PRECISION
        k = k[own].astype(np.int64)
        _put(out, params + 6, k, 4)  # behind the method and the partition order, both zero
        _put_rice(out, params + 10, u[own].astype(np.int64), k)
    crc = _crc16(out, begin, ends - 2)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 255
    return out[:-3], ends


class _Bits:
    """Readers at many bit positions of one buffer, moved together."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.words = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]

    def window(self, pos: np.ndarray) -> np.ndarray:
        """The 25 bits and more from each position, at the top of 32."""
        return self.words[pos >> 3] << (pos & 7).astype(np.uint32)

    def take(self, pos: np.ndarray, n: int) -> np.ndarray:
        """``n`` bits, 16 at most, at each position; moves the positions."""
        if n == 0:
            return np.zeros(len(pos), np.int64)
        value = (self.window(pos) >> np.uint32(32 - n)).astype(np.int64)
        pos += n
        return value

    def unary(self, pos: np.ndarray) -> np.ndarray:
        """Zeros before the next one; moves behind the one."""
        q = ZEROS[self.window(pos) >> np.uint32(16)]
        if (q == 16).any():
            total, here = q.copy(), pos + q
            open_ = np.flatnonzero(q == 16)
            while len(open_):
                more = ZEROS[self.window(here[open_]) >> np.uint32(16)]
                total[open_] += more
                here[open_] += more
                open_ = open_[more == 16]
            q = total
        pos += q + np.uint32(1)
        return q


def _signed(values: np.ndarray, bits: int) -> np.ndarray:
    return np.where(values >> (bits - 1) & 1, values - (1 << bits), values)


def _residuals(bits: _Bits, pos: np.ndarray, n: int, order: int) -> np.ndarray:
    """Rice residuals of frames at ``pos`` as rows of a sample each; moves the positions."""
    method = bits.take(pos, 2)
    parts = bits.take(pos, 4)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    out = np.zeros((n - order, len(pos)), np.int32)
    for wide in (0, 1):
        for p in np.unique(parts[method == wide]).tolist():
            own = np.flatnonzero((method == wide) & (parts == p))
            here = pos[own]
            length, escape = n >> p, (15, 31)[wide]
            for part in range(1 << p):
                k = bits.take(here, 4 + wide)
                begin, end = max(order, part * length) - order, (part + 1) * length - order
                raw = np.flatnonzero(k == escape)
                if len(raw):
                    where = here[raw]
                    size = bits.take(where, 5)
                    for b in np.unique(size).tolist():
                        same = np.flatnonzero(size == b)
                        there = where[same]
                        for i in range(begin, end):
                            out[i, own[raw[same]]] = _signed(bits.take(there, b), b) if b else 0
                        where[same] = there
                    here[raw] = where
                rice = np.flatnonzero(k != escape)
                if len(rice):
                    where = here[rice]
                    out[begin:end, own[rice]] = _rice(bits, where, k[rice].astype(np.uint32), end - begin)
                    here[rice] = where
            pos[own] = here
    return out


def _rice(bits: _Bits, pos: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    """``n`` Rice codes of every reader with parameters ``k``."""
    words = bits.words
    folded = np.empty((n, len(pos)), np.uint32)
    step, one, half = (k + 1).astype(np.int64), np.uint32(1), np.uint32(31) - k
    if k.max() > 8:
        for i in range(n):
            q = bits.unary(pos)
            low = (bits.window(pos) >> one) >> half
            pos += k
            folded[i] = (q << k) | low
    else:
        for i in range(n):
            w = words[pos >> 3] << (pos & 7).astype(np.uint32)
            q = ZEROS[w >> np.uint32(16)]
            if q.max() > 15:
                q = bits.unary(pos)
                low = (bits.window(pos) >> one) >> half
                pos += k
            else:
                low = ((w << (q + one)) >> one) >> half
                pos += q + step
            folded[i] = (q << k) | low
    return (folded >> 1).astype(np.int32) ^ -(folded & 1).astype(np.int32)


def decode_frames(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of 576 8-bit mono samples that begin at the offsets -> samples as int8 rows, and the frames' ends. Damage is an error."""
    n_frames = len(begin)
    out = np.zeros((n_frames, FRAME), np.int8)
    if not n_frames:
        return out, begin
    padded = np.concatenate([data, np.zeros(32, np.uint8)])
    if (padded[begin] != 0xFF).any() or (padded[begin + 1] != 0xF8).any() or (padded[begin + 2] >> 4 != 2).any() or (padded[begin + 3] != 2).any():
        raise ValueError("no frame of this profile")
    lead = padded[begin + 4].astype(np.int64)
    number = np.where(lead < 0x80, 1, np.minimum(7, 8 - np.ceil(np.log2(256.0 - lead)).astype(np.int64)))
    at = begin + 4 + number
    crc = np.zeros(n_frames, np.uint8)
    for i in range(int(number.max()) + 4):
        live = i < number + 4
        crc[live] = CRC8[crc[live] ^ padded[begin[live] + i]]
    if (crc != padded[at]).any():
        raise ValueError("damaged frame header")
    kind = padded[at + 1] >> 1
    if (padded[at + 1] & 0x81).any():
        raise ValueError("wasted bits are not of this profile")
    body = at + 2
    ends = np.zeros(n_frames, np.int64)
    bits = _Bits(data)
    for t in np.unique(kind).tolist():
        own = np.flatnonzero(kind == t)
        if t == 0:
            out[own] = padded[body[own]].view(np.int8)[:, None]
            ends[own] = body[own] + 1
        elif t == 1:
            out[own] = padded[body[own][:, None] + np.arange(FRAME)].view(np.int8)
            ends[own] = body[own] + FRAME
        elif 8 <= t <= 12 or t >= 32:
            order = t - 8 if t < 32 else t - 31
            x = np.zeros((FRAME, len(own)), np.int32)
            for i in range(order):
                x[i] = padded[body[own] + i].view(np.int8)
            pos = (body[own] + order) * 8
            if t >= 32:
                precision = bits.take(pos, 4) + 1
                shift = _signed(bits.take(pos, 5), 5)
                coefficients = np.zeros((order, len(own)), np.int64)
                for b in np.unique(precision).tolist():
                    same = np.flatnonzero(precision == b)
                    there = pos[same]
                    for i in range(order):
                        coefficients[i, same] = _signed(bits.take(there, b), b)
                    pos[same] = there
                r = _residuals(bits, pos, FRAME, order)
                for i in range(order, FRAME):
                    x[i] = r[i - order] + (np.einsum("ij,ij->j", coefficients, x[i - order : i][::-1]) >> shift)
            else:
                r = _residuals(bits, pos, FRAME, order)
                for level in range(order, 0, -1):  # sums from the highest difference down
                    head = np.diff(x[:order], n=level - 1, axis=0)[order - level : order - level + 1] if level > 1 else x[order - 1 : order]
                    r = np.cumsum(np.concatenate([head, r]), axis=0, dtype=np.int32)[1:]
                x[order:] = r
            out[own] = x.T
            ends[own] = (pos + 7) >> 3
        else:
            raise ValueError("reserved subframe")
    if (((padded[ends].astype(np.uint16) << 8) | padded[ends + 1]) != _crc16(padded, begin, ends)).any():
        raise ValueError("damaged frame")
    return out, ends + 2


# --- streams ---------------------------------------------------------------------------------


def stream(frames: bytes, ends: np.ndarray, pcm: bytes) -> bytes:
    """A FLAC stream of encoded frames: STREAMINFO, a seek table with every frame, the frames."""
    sizes = np.diff(np.concatenate([[0], ends]))
    fields = (RATE << 44) | (0 << 41) | (7 << 36) | len(pcm)
    info = struct.pack(">HH", FRAME, FRAME) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + fields.to_bytes(8, "big") + hashlib.md5(pcm).digest()
    points = np.zeros(len(ends), POINT)
    points["sample"], points["offset"], points["n"] = np.arange(len(ends)) * FRAME, ends - sizes, FRAME
    table = points.tobytes()
    if len(table) >= 1 << 24:  # a metadata block has 24 bits of length: then every so many frames
        table = points[:: -(-len(table) // ((1 << 24) - 18))].tobytes()
    return b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + frames


class Stream:
    """A stream's frame offsets and checks, parsed from its metadata."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, points = 4, None
        while True:
            kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + size]
            if kind & 127 == 0:
                self.n_samples, self.md5 = int.from_bytes(block[10:18], "big") & ((1 << 36) - 1), block[18:34]
            elif kind & 127 == 3:
                points = np.frombuffer(block, POINT)
            at += 4 + size
            if kind & 128:
                break
        n_frames = -(-self.n_samples // FRAME)
        if points is None:
            points = np.zeros(0, POINT)
        points = points[points["sample"] < self.n_samples]  # without placeholders
        samples, offsets = points["sample"].astype(np.int64), points["offset"].astype(np.int64) + at
        if not len(samples) or samples[0]:
            samples, offsets = np.concatenate([[0], samples]), np.concatenate([[at], offsets])
        self.samples, self.offsets = (samples, offsets) if len(samples) == n_frames else walked(data, samples // FRAME, offsets, n_frames)

    def read(self, data: bytes, start: int, end: int) -> bytes:
        """Payload bytes ``start`` to ``end``, from the frames that hold them and no others."""
        first = int(np.searchsorted(self.samples, start, side="right")) - 1
        last = int(np.searchsorted(self.samples, end, side="left"))
        offsets = self.offsets[first:last]
        limit = self.offsets[last] if last < len(self.offsets) else len(data)
        part = np.frombuffer(data, np.uint8)[offsets[0] : limit]
        samples, _ = decode_frames(part, offsets - offsets[0])
        skip = start - int(self.samples[first])
        return (samples.view(np.uint8) ^ 128).tobytes()[skip : skip + end - start]


def walked(data: bytes, frames: np.ndarray, offsets: np.ndarray, n_frames: int) -> tuple[np.ndarray, np.ndarray]:
    """First samples and offsets of all frames, found from some of them: each step takes the next frame behind every known one."""
    found = np.full(n_frames, -1, np.int64)
    raw = np.frombuffer(data, np.uint8)
    stop = np.append(frames[1:], n_frames)
    while len(frames):
        found[frames] = offsets
        _, ends = decode_frames(raw, offsets)
        more = frames + 1 < stop
        frames, stop, offsets = frames[more] + 1, stop[more], ends[more]
    return np.arange(n_frames) * FRAME, found


def encode_payloads(texts: list[bytes]) -> list[bytes]:
    """The streams of padded texts."""
    n_frames = np.array([max(1, -(-len(t) // FRAME)) for t in texts])
    ends = np.cumsum(n_frames)
    numbers = np.arange(int(ends[-1])) - np.repeat(ends - n_frames, n_frames)
    padded = b"".join(t + bytes([PAD]) * (int(n) * FRAME - len(t)) for t, n in zip(texts, n_frames, strict=True))
    samples = (np.frombuffer(padded, np.uint8) ^ 128).view(np.int8).reshape(-1, FRAME)
    data, stops = [], []
    for i in range(0, len(samples), SLICE):
        encoded, own = encode_frames(samples[i : i + SLICE], numbers[i : i + SLICE])
        stops.append(own + sum(map(len, data)))
        data.append(encoded.tobytes())
    whole, stop = b"".join(data), np.concatenate(stops)
    out, pcm = [], samples.tobytes()
    for e, n in zip(ends.tolist(), n_frames.tolist(), strict=True):
        b = e - n
        base = int(stop[b - 1]) if b else 0
        out.append(stream(whole[base : int(stop[e - 1])], stop[b:e] - base, pcm[b * FRAME : e * FRAME]))
    return out


def decode_payloads(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams, checked against their checksums."""
    parsed = [Stream(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    begin = np.concatenate([s.offsets + b for s, b in zip(parsed, base, strict=False)])
    data = np.frombuffer(b"".join(streams), np.uint8)
    parts = []
    for i in range(0, len(begin), SLICE):
        own = begin[i : i + SLICE]
        limit = begin[i + SLICE] if i + SLICE < len(begin) else len(data)
        parts.append(decode_frames(data[own[0] : limit], own - own[0])[0])
    samples = np.concatenate(parts)
    out, at = [], 0
    for s in parsed:
        n = -(-s.n_samples // FRAME)
        pcm = samples[at : at + n]
        if hashlib.md5(pcm).digest() != s.md5:
            raise ValueError("damaged stream")
        out.append((pcm.view(np.uint8) ^ 128).tobytes()[: s.n_samples])
        at += n
    return out


# --- Spark -----------------------------------------------------------------------------------


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


#: Columns of described media besides doc_id.
DESCRIBED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(ids: pa.Array, sizes: pa.Array, media: list[bytes]) -> pa.RecordBatch:
    payloads = decode_payloads(media)
    rows = [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)) for p, m in zip(payloads, media, strict=True)]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([ids, sizes, *columns], names=["doc_id", *(c.split()[0] for c in DESCRIBED.split(", "))])


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Groups of texts in UTF-8 of a bounded size, with their begin and end."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    for a, b in _groups([max(FRAME, n) for n in pa.compute.binary_length(texts).to_pylist()], BATCH_BYTES):
        yield a, b, texts.slice(a, b - a).to_pylist()


def to_media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes of the text in UTF-8, and its FLAC stream as a binary column ``media``; one pass, no shuffle."""
    chosen = df.select(column(key).alias("doc_id"), column(text).alias("t"))
    kind = chosen.schema[0].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b, own in _texts(part.column(1)):
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array([len(t) for t in own], pa.int64()), pa.array(encode_payloads(own), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return chosen.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Reads a ``media`` column back and describes it: sizes and digests of payload and stream, and a feature string:
    frames, mean, mean square and sign changes of the samples."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in _groups(pa.compute.binary_length(part.column(2)).to_pylist(), BATCH_BYTES):
                yield _described(part.column(0).slice(a, b - a), part.column(1).slice(a, b - a), part.column(2).slice(a, b - a).to_pylist())

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, {DESCRIBED}")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, first_sample, n_samples, pcm (unsigned 8-bit): the decoded media in blocks of ``PCM_BLOCK`` samples, to be written as a table."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in _groups(pa.compute.binary_length(part.column(1)).to_pylist(), BATCH_BYTES):
                ids = part.column(0).slice(a, b - a)
                for i, payload in enumerate(decode_payloads(part.column(1).slice(a, b - a).to_pylist())):
                    starts = range(0, len(payload), PCM_BLOCK)
                    blocks = [payload[s : s + PCM_BLOCK] for s in starts]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([ids.slice(i, 1)] * len(blocks)), pa.array(starts, pa.int64()), pa.array(map(len, blocks), pa.int64()), pa.array(blocks, pa.binary())], names=["doc_id", "first_sample", "n_samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, first_sample long, n_samples long, pcm binary")


def read_samples(blocks: DataFrame, key, start: int, end: int) -> bytes:
    """Samples ``start`` to ``end`` of one document, from the blocks that hold them: both conditions reach the table's scan."""
    rows = blocks.where((F.col("doc_id") == key) & (F.col("first_sample") < end) & (F.col("first_sample") >= start - start % PCM_BLOCK)).select("first_sample", "pcm").distinct().orderBy("first_sample").collect()
    skip = start - rows[0]["first_sample"] if rows else 0
    return b"".join(bytes(r["pcm"]) for r in rows)[skip : skip + end - start]


def _containers(parts: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[str, pa.Array, pa.Array, list[int]]]:
    """Writes media one behind the other into files of ``CONTAINER_BYTES`` or a little more: each closed file's URI, its ids, sizes of texts, and the media's ends."""
    groups = ((part.column(0).slice(a, b - a), own) for part in parts for a, b, own in _texts(part.column(1)))
    group = next(groups, None)
    while group is not None:
        ids, sizes, ends = [], [], [0]
        with new_file(folder, "media.flac") as (out, uri):
            while group is not None and ends[-1] < CONTAINER_BYTES:
                for media in encode_payloads(group[1]):
                    out.write(media)
                    ends.append(ends[-1] + len(media))
                ids.append(group[0])
                sizes += map(len, group[1])
                group = next(groups, None)
        yield uri, pa.concat_arrays(ids), pa.array(sizes, pa.int64()), ends


def write_media(df: DataFrame, folder: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Media files in ``folder``, and a table, already stored, of where each document's media is: doc_id, n_bytes, uri, offset, length."""
    chosen = df.select(column(key).alias("doc_id"), column(text).alias("t"))
    kind = chosen.schema[0].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri, ids, sizes, ends in _containers(parts, folder):
            starts = np.array(ends)
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array([uri] * len(ids)), pa.array(starts[:-1]), pa.array(np.diff(starts))], names=["doc_id", "n_bytes", "uri", "offset", "length"])

    return stored(chosen.mapInArrow(run, f"doc_id {kind}, n_bytes long, uri string, offset long, length long"), "media-index")


def read_media(index: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media`` by range reads of the files that ``index`` names."""
    kind = index.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, (uri, offset, length) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                files, path = open_fs(uri)
                with files.open_input_file(path) as file:
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(i, 1), part.column(1).slice(i, 1), pa.array([file.read_at(length, offset)], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return index.select("doc_id", "n_bytes", "uri", "offset", "length").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def round_trip(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of :func:`from_media` for media that were stored: each task writes files to the shared folder, closes them, reads
    them back from there, and removes them. Together the media of plain text are larger than their texts, which is why they do not stay."""
    folder = fresh_folder(df.sparkSession, "media")
    chosen = df.select(column(key).alias("doc_id"), column(text).alias("t"))
    kind = chosen.schema[0].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri, ids, sizes, ends in _containers(parts, folder):
            files, path = open_fs(uri)
            with files.open_input_file(path) as file:
                for a, b in _groups(np.diff(ends).tolist(), BATCH_BYTES):
                    data = file.read_at(ends[b] - ends[a], ends[a])
                    own = [data[ends[i] - ends[a] : ends[i + 1] - ends[a]] for i in range(a, b)]
                    yield _described(ids.slice(a, b - a), sizes.slice(a, b - a), own)
            files.delete_file(path)

    return chosen.mapInArrow(run, f"doc_id {kind}, {DESCRIBED}")


def feature(payload: bytes) -> str:
    x = (np.frombuffer(payload, np.uint8) ^ 128).view(np.int8)
    positive = x >= 0
    changes = int(np.count_nonzero(positive[1:] != positive[:-1]))
    squares = x.astype(np.int16)
    return f"frames={len(x) // FRAME} mean={x.mean(dtype=np.float64):.6f} square={np.square(squares).mean(dtype=np.float64):.6f} changes={changes}"
