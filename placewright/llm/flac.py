"""Media columns: lossless audio frames of 8-bit samples, written and read back.

``encode`` makes a FLAC stream (one channel, 8 bits, frames of BLOCK samples): each frame is predicted by a fixed
polynomial or by a linear predictor from its autocorrelation, whichever needs fewest bits, residuals go out as Rice
codes in one partition, and a frame that would grow is stored verbatim. ``decode`` reads any such stream: it finds the
frames, checks the header's CRC-8 and the frame's CRC-16, decodes Rice residuals, runs the predictors and compares the
MD5 of the samples with the stream's. Streams of more than SEEK frames hold a table of seek points: ``samples_at`` decodes
a stretch of samples from the last point before it on, and long streams are read back in pieces cut at these points, so a
task's memory doesn't grow with a text. ``pcm_blocks`` gives each frame's samples with their offset.

All frames of a batch are worked on side by side: a Rice code's place depends on the one before, but frames don't
depend on each other, so each step of the loop takes one sample of every frame.

Defined results: a null text counts as empty; payloads are padded by zero bytes to a positive multiple of 64; equal
texts give equal rows; a stream whose checksums fail, or whose seek points miss its frames, raises an error. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.bpe import utf8

#: Samples of a frame. Shorter frames cost more headers, longer ones more steps.
BLOCK = 1024
SAMPLE_RATE = 8000
#: Order and precision of the linear predictor that is tried.
LPC_ORDER, LPC_BITS = 4, 10
#: Frames from one seek point to the next. A stream with no more has no table, as its only point is the first frame.
SEEK = 32
#: Payload bytes worked on at once.
GROUP = 1_500_000


def crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, dtype=np.int64)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def crcs(data: np.ndarray, first: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Checksums of many stretches of one byte array, a byte of each at a step."""
    order = np.argsort(first - end, kind="stable")  # longest first
    at, sizes = first[order], (end - first)[order]
    wide = len(table) and int(table.max()) > 255
    crc = np.zeros(len(order), dtype=np.int64)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -step, side="left"))
        own = crc[:m]
        b = data[at[:m] + step]
        crc[:m] = table[(own >> 8) ^ b] ^ ((own << 8) & 0xFFFF) if wide else table[own ^ b]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def utf8_number(n: int) -> bytes:
    """A frame number in the variable-length code that is used for it."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + 6 - more):
        more += 1
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | (n >> (6 * more)), *(0x80 | ((n >> (6 * i)) & 0x3F) for i in range(more - 1, -1, -1))])


def predictors(x: np.ndarray) -> np.ndarray:
    """Quantised linear predictors of each row, by Levinson's recursion on the autocorrelation."""
    n = x.shape[1]
    r = np.stack([(x[:, lag:] * x[:, : n - lag]).sum(axis=1) for lag in range(LPC_ORDER + 1)], axis=1)
    error = r[:, 0] * 1.0001 + 1e-9
    a = np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    limit = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.round(a * (1 << (LPC_BITS - 2))), -limit - 1, limit).astype(np.int64)


def residuals(x: np.ndarray) -> list[tuple[int, np.ndarray | None, np.ndarray]]:
    """Candidate predictions of rows of samples: (order, coefficients, residuals after the first ``order`` samples)."""
    out = [(0, None, x)]
    if x.shape[1] > 2:
        one = np.diff(x, axis=1)
        out += [(1, None, one), (2, None, np.diff(one, axis=1))]
    if x.shape[1] > 4 * LPC_ORDER:
        c = predictors(x.astype(float))
        n = x.shape[1]
        guess = sum(c[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : n - 1 - j] for j in range(LPC_ORDER))
        out.append((LPC_ORDER, c, x[:, LPC_ORDER:] - (guess >> (LPC_BITS - 2))))
    return out


def bit_array(fields: list[tuple[int, int]]) -> np.ndarray:
    text = "".join(format(value & ((1 << width) - 1), f"0{width}b") for value, width in fields if width)
    return np.frombuffer(text.encode(), dtype=np.uint8) - 48


def encode_frames(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of rows of samples of one length."""
    rows, n = x.shape
    best_bits = np.full(rows, 8 * n, dtype=np.int64)  # verbatim
    best = np.full(rows, -1)
    best_k = np.zeros(rows, dtype=np.int64)
    tried = residuals(x)
    folded = []
    for i, (order, coefficients, e) in enumerate(tried):
        u = np.where(e < 0, -2 * e - 1, 2 * e)
        folded.append(u)
        for k in range(1, 8):
            bits = (u >> k).sum(axis=1) + (k + 1) * u.shape[1] + 10 + 8 * order + (9 + LPC_BITS * order if coefficients is not None else 0)
            better = bits < best_bits
            best_bits, best, best_k = np.where(better, bits, best_bits), np.where(better, i, best), np.where(better, k, best_k)
    out = []
    for row in range(rows):
        number = utf8_number(numbers[row])
        # sync, fixed block size; block size in 16 bits after the number, rate from the stream; one channel, 8 bits
        head = b"\xff\xf8" + bytes([0x70, 0x02]) + number + struct.pack(">H", n - 1)
        c8 = 0
        for b in head:
            c8 = int(CRC8[c8 ^ b])
        if best[row] < 0:
            body = bytes([0x02]) + (x[row].astype(np.int8)).tobytes()
        else:
            order, coefficients, _ = tried[best[row]]
            k, u = int(best_k[row]), folded[best[row]][row]
            kind = 0x20 | (order - 1) if coefficients is not None else 0x08 | order
            fields = [(0, 1), (kind, 6), (0, 1), *((int(s), 8) for s in x[row, :order])]
            if coefficients is not None:
                fields += [(LPC_BITS - 1, 4), (LPC_BITS - 2, 5), *((int(c), LPC_BITS) for c in coefficients[row])]
            start = bit_array([*fields, (0, 2), (0, 4), (k, 4)])
            q = u >> k
            ends = np.cumsum(q + 1 + k)
            bits = np.zeros(len(start) + int(ends[-1]), dtype=np.uint8)
            bits[: len(start)] = start
            stop = len(start) + ends - k - 1
            bits[stop] = 1
            for j in range(k):
                bits[stop + 1 + j] = (u >> (k - 1 - j)) & 1
            body = np.packbits(bits).tobytes()
        out.append(head + bytes([c8]) + body)
    return out


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload (bytes as samples, less 128)."""
    where: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for f in range(-(-len(p) // BLOCK)):
            where.setdefault(min(BLOCK, len(p) - f * BLOCK), []).append((i, f))
    frames: list[list[bytes]] = [[b""] * -(-len(p) // BLOCK) for p in payloads]
    rows = GROUP // BLOCK
    for n, own in [(n, every[i : i + rows]) for n, every in where.items() for i in range(0, len(every), rows)]:
        x = np.frombuffer(b"".join(payloads[i][f * BLOCK : f * BLOCK + n] for i, f in own), dtype=np.uint8).reshape(-1, n).astype(np.int64) - 128
        for (i, f), made in zip(own, encode_frames(x, [f for _, f in own]), strict=True):
            frames[i][f] = made
    flat = [f for own in frames for f in own]
    data = np.frombuffer(b"".join(flat), dtype=np.uint8)
    ends = np.cumsum([len(f) for f in flat])
    sums = iter(crcs(data, ends - [len(f) for f in flat], ends, CRC16).tolist())
    out = []
    for p, own in zip(payloads, frames, strict=True):
        body = [f + struct.pack(">H", next(sums)) for f in own]
        sizes = [len(b) for b in body]
        samples = (np.frombuffer(p, dtype=np.uint8) ^ 0x80).tobytes()
        least = BLOCK if len(p) >= BLOCK else max(16, len(p))
        info = struct.pack(">HH", least, max(least, BLOCK)) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += ((SAMPLE_RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big") + hashlib.md5(samples).digest()
        table = seek_table(sizes, len(p)) if len(sizes) > SEEK else b""
        out.append(b"fLaC" + bytes([0x00 if table else 0x80]) + len(info).to_bytes(3, "big") + info + table + b"".join(body))
    return out


def seek_table(sizes: list[int], total: int) -> bytes:
    """The last metadata block: first sample, byte offset and number of samples of every SEEK-th frame."""
    offsets = [0, *accumulate(sizes)]
    points = b"".join(struct.pack(">QQH", f * BLOCK, offsets[f], min(BLOCK, total - f * BLOCK)) for f in range(0, len(sizes), SEEK))
    return bytes([0x83]) + len(points).to_bytes(3, "big") + points


def metadata(stream: bytes) -> tuple[dict[int, bytes], int]:
    """The metadata blocks by kind, and where the first frame starts."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    found, at, last = {}, 4, False
    while not last:
        if len(stream) < at + 4:
            raise ValueError("no frame where the first one should be")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        found[kind] = stream[at + 4 : at + 4 + size]
        at += 4 + size
    if len(found.get(0, b"")) != 34:
        raise ValueError("no stream information")
    return found, at


def pieces(stream: bytes, most: int) -> list[tuple[int, bytes]]:
    """The stream cut at seek points into streams of about ``most`` bytes, each with its first sample."""
    meta, start = metadata(stream)
    if 3 not in meta:
        return [(0, stream)]
    kept = [(0, 0)]
    for sample, offset, _ in struct.iter_unpack(">QQH", meta[3]):
        if sample == (1 << 64) - 1:  # an empty place of the table
            continue
        head = Frames.header(stream[start + offset : start + offset + 24], 0)
        if head is None or head[0] * BLOCK != sample:
            raise ValueError("a seek point is not at its frame")
        if offset - kept[-1][1] >= most:
            kept.append((sample, offset))
    ends = [offset for _, offset in kept[1:]] + [len(stream) - start]
    head = b"fLaC\x80" + len(meta[0]).to_bytes(3, "big") + meta[0]
    return [(sample, head + stream[start + offset : start + end]) for (sample, offset), end in zip(kept, ends, strict=True)]


def samples_at(stream: bytes, first: int, count: int) -> bytes:
    """Payload bytes from ``first`` on, ``count`` of them or up to the end, decoded from the last seek point before them."""
    cut = pieces(stream, 1)
    starts = [sample for sample, _ in cut]
    low = max(bisect_right(starts, first) - 1, 0)
    frames = Frames([piece for _, piece in cut[low : max(bisect_left(starts, first + count), low + 1)]])
    own = np.concatenate(frames.samples)[first - starts[low] :][:count]
    return (own.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()


class Frames:
    """All frames of some streams, decoded side by side."""

    def __init__(self, streams: list[bytes], careful: frozenset[int] = frozenset()):
        self.data = np.frombuffer(b"".join(streams) + bytes(8), dtype=np.uint8)
        self.stream: list[int] = []
        self.totals, self.md5 = [], []
        starts, ends, base = [], [], 0
        for i, s in enumerate(streams):
            meta, at = metadata(s)
            self.totals.append(int.from_bytes(meta[0][10:18], "big") & ((1 << 36) - 1))
            self.md5.append(meta[0][18:34])
            own = [base + x for x in (self.split(s, at, careful=True) if i in careful else self.split(s, at))]
            starts += own[:-1]
            ends += own[1:]
            self.stream += [i] * (len(own) - 1)
            base += len(s)
        self.start, self.end = np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)
        wrong = np.flatnonzero(crcs(self.data, self.start, self.end, CRC16))  # over data and sum: 0 if right
        if len(wrong):
            again = frozenset(self.stream[x] for x in wrong.tolist())
            if again <= careful:
                raise ValueError("a frame's CRC-16 differs")
            self.__init__(streams, careful | again)
            return
        self.decode()

    @staticmethod
    def header(s: bytes, at: int) -> tuple[int, int, int] | None:
        """(frame number, block size, length) of the header at ``at``, if there is one with a right CRC-8."""
        if s[at : at + 2] != b"\xff\xf8" or len(s) < at + 8:
            return None
        lead = s[at + 4]
        more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
        number = lead if not more else lead & (0x3F >> more)
        for b in s[at + 5 : at + 5 + more]:
            number = number << 6 | b & 0x3F
        end = at + 5 + more
        code = s[at + 2] >> 4
        if code == 7:
            size, end = int.from_bytes(s[end : end + 2], "big") + 1, end + 2
        elif code == 6:
            size, end = s[end] + 1, end + 1
        elif code in (2, 3, 4, 5):
            size = 576 << (code - 2)
        elif code >= 8:
            size = 256 << (code - 8)
        else:
            size = 192
        c = 0
        for b in s[at:end]:
            c = int(CRC8[c ^ b])
        return (number, size, end + 1 - at) if end < len(s) and c == s[end] else None

    def split(self, s: bytes, at: int, careful: bool = False) -> list[int]:
        """Starts of the frames, and the end. A frame starts at a sync code with a right header and the next number;
        if ``careful``, only where the bytes before it end in their CRC-16 (data can look like a header)."""
        own = [at]
        head = self.header(s, at)
        if head is None:
            raise ValueError("no frame where the first one should be")
        first = head[0]  # pieces of a stream start at later frames
        at += head[2]
        while (at := s.find(b"\xff\xf8", at)) >= 0:
            head = self.header(s, at)
            if head and head[0] == first + len(own) and not (careful and self.crc16(s[own[-1] : at])):
                own.append(at)
                at += head[2]
            else:
                at += 1
        return [*own, len(s)]

    @staticmethod
    def crc16(data: bytes) -> int:
        c = 0
        for b in data:
            c = int(CRC16[(c >> 8) ^ b]) ^ ((c << 8) & 0xFFFF)
        return c

    def decode(self) -> None:
        m = len(self.start)
        raw = self.data.tobytes()
        self.size = np.zeros(m, dtype=np.int64)
        self.samples: list[np.ndarray] = [np.zeros(0, np.int64)] * m
        lanes = []
        for i in range(m):
            _, n, length = self.header(raw[self.start[i] : self.start[i] + 24], 0)
            self.size[i] = n
            body = int(self.start[i]) + length
            kind = raw[body] >> 1
            if kind == 0:  # constant
                self.samples[i] = np.full(n, np.frombuffer(raw[body + 1 : body + 2], np.int8)[0], dtype=np.int64)
            elif kind == 1:  # verbatim
                self.samples[i] = np.frombuffer(raw[body + 1 : body + 1 + n], dtype=np.int8).astype(np.int64)
            elif 8 <= kind <= 12:
                lanes.append((i, n, kind - 8, (body + 1) * 8, None))
            elif kind >= 32:
                lanes.append((i, n, kind - 31, (body + 1) * 8, ()))
            else:
                raise ValueError("a reserved kind of subframe")
        if lanes:
            self._residual(raw, sorted(lanes, key=lambda lane: -lane[1]))

    def _residual(self, raw: bytes, lanes: list[tuple]) -> None:
        number = lambda at, width: int.from_bytes(raw[at >> 3 : (at + width + 7) >> 3], "big") >> (-(at + width) & 7) & ((1 << width) - 1)
        signed = lambda v, width: v - (1 << width) if v >> (width - 1) else v
        m, widest = len(lanes), lanes[0][1]
        out = np.zeros((widest, m), dtype=np.int64)  # sample by frame: each step writes a row
        position, k, orders, sizes = (np.zeros(m, dtype=np.int64) for _ in range(4))
        models: dict[tuple[int, bool], list[int]] = {}
        coefficients, shifts = np.zeros((m, 32), dtype=np.int64), np.zeros(m, dtype=np.int64)
        for j, (_, n, order, at, linear) in enumerate(lanes):
            for s in range(order):
                out[s, j] = signed(number(at, 8), 8)
                at += 8
            if linear is not None:
                width = number(at, 4) + 1
                shifts[j] = signed(number(at + 4, 5), 5)
                at += 9
                for c in range(order):
                    coefficients[j, c] = signed(number(at, width), width)
                    at += width
            if number(at, 6):
                raise ValueError("Rice codes in more than one partition, or with wide parameters")
            k[j] = number(at + 6, 4)
            position[j], orders[j], sizes[j] = at + 10, order, n
            models.setdefault((order, linear is not None), []).append(j)
        # The next set bit from every bit on.
        bits = np.unpackbits(self.data)
        places = np.where(bits, np.arange(len(bits)), len(bits)).astype(np.int32)
        after = np.minimum.accumulate(places[::-1])[::-1]
        window = self.data.astype(np.int64)
        window = (window[:-2] << 16) | (window[1:-1] << 8) | window[2:]  # 24 bits from each byte on
        mask = (np.int64(1) << k) - 1
        for step in range(int(orders.min()), widest):
            now = int(np.searchsorted(-sizes, -step, side="left"))
            at = position[:now]
            own = orders[:now] <= step
            stop = after[at].astype(np.int64)
            first = stop + 1
            low = (window[first >> 3] >> (24 - (first & 7) - k[:now])) & mask[:now]
            u = ((stop - at) << k[:now]) | low
            e = (u >> 1) ^ -(u & 1)
            row = out[step]
            row[:now] = np.where(own, e, row[:now])
            position[:now] = np.where(own, first + k[:now], at)
        for (order, linear), own in models.items():
            columns = np.array(own)
            part = out[:, columns]
            if linear:
                c, shift = coefficients[columns, :order].T, shifts[columns]
                for step in range(order, widest):
                    part[step] += (c * part[step - order : step][::-1]).sum(axis=0) >> shift
            else:
                part = undo_differences(part, order)
            out[:, columns] = part
        for j, (i, n, *_) in enumerate(lanes):
            self.samples[i] = out[:n, j]

    def payloads(self) -> list[bytes]:
        """The bytes of each stream, after comparing lengths and MD5."""
        parts: list[list[np.ndarray]] = [[] for _ in self.totals]
        for i, s in zip(self.stream, self.samples, strict=True):
            parts[i].append(s)
        out = []
        for own, total, md5 in zip(parts, self.totals, self.md5, strict=True):
            samples = np.concatenate(own).astype(np.int8)
            if len(samples) != total or hashlib.md5(samples.tobytes()).digest() != md5:
                raise ValueError("the samples are not the stream's")
            out.append((samples.view(np.uint8) ^ 0x80).tobytes())
        return out


def undo_differences(part: np.ndarray, order: int) -> np.ndarray:
    """Samples from the first ``order`` of them and the ``order``-th differences after."""
    if order == 0:
        return part
    heads = [part[:order]]
    for _ in range(order - 1):
        heads.append(np.diff(heads[-1], axis=0))
    rest = part[order:]
    for p in range(order - 1, -1, -1):  # heads[p]: the known p-th differences; the last of them goes on
        rest = heads[p][-1] + np.cumsum(rest, axis=0)
    return np.concatenate([part[:order], rest])


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


def grouped(items, size=len):
    """Lists of items of about GROUP bytes."""
    held, total = [], 0
    for item in items:
        held.append(item)
        total += size(item)
        if total > GROUP:
            yield held
            held, total = [], 0
    if held:
        yield held


def decoded(streams: list[bytes]):
    """``(row, samples of its next frames)``: all streams in order, long ones in several steps."""
    cut = ((row, piece) for row, stream in enumerate(streams) for _, piece in pieces(stream, GROUP))
    for group in grouped(cut, lambda item: len(item[1])):
        frames = Frames([piece for _, piece in group])
        for i, own in groupby(zip(frames.stream, frames.samples, strict=True), lambda pair: pair[0]):
            yield group[i][0], [samples for _, samples in own]


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text as a FLAC stream."""

    def run(batches):
        for batch in batches:
            at = 0
            for texts in grouped(utf8(batch.column("text"))):
                media = encode_all([padded(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """``doc_id, block, sample_offset, n_samples, pcm`` (signed bytes) of every frame of ``doc_id, media``."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            last, block, offset = None, 0, 0
            for row, own in decoded(batch.column("media").to_pylist()):
                block, offset = (block, offset) if row == last else (0, 0)
                sizes = [len(x) for x in own]
                offsets = list(accumulate(sizes, initial=offset))
                columns = ([ids[row]] * len(own), range(block, block + len(own)), offsets[:-1], sizes, [x.astype(np.int8).tobytes() for x in own])
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "block", "sample_offset", "n_samples", "pcm"])
                last, block, offset = row, block + len(own), offsets[-1]

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block int, sample_offset long, n_samples int, pcm binary")


class Digest:
    """What is told of one stream, from its samples in order: energy, zero crossings and peak among it, and the number of frames."""

    def __init__(self) -> None:
        self.sha, self.md5, self.tail, self.below = hashlib.sha256(), hashlib.md5(), b"", None
        self.size = self.frames = self.energy = self.crossings = self.peak = 0

    def add(self, own: list[np.ndarray]) -> None:
        x = np.concatenate(own)
        signed = x.astype(np.int8)
        payload = (signed.view(np.uint8) ^ 0x80).tobytes()
        self.sha.update(payload)
        self.md5.update(signed.tobytes())
        self.tail = (self.tail + payload[-64:])[-64:]
        below = x < 0
        self.crossings += int((below[1:] != below[:-1]).sum()) + int(self.below is not None and self.below != below[0])
        self.below = below[-1]
        self.energy += int((x * x).sum())
        self.peak = max(self.peak, int(np.abs(x).max()))
        self.size += len(x)
        self.frames += len(own)

    def row(self, stream: bytes) -> tuple:
        info = metadata(stream)[0][0]
        if self.size != int.from_bytes(info[10:18], "big") & ((1 << 36) - 1) or self.md5.digest() != info[18:34]:
            raise ValueError("the samples are not the stream's")
        feature = f"frames={self.frames};energy={self.energy};crossings={self.crossings};peak={self.peak}"
        return self.size, self.sha.hexdigest(), zlib.crc32(self.tail), len(stream), hashlib.sha256(stream).hexdigest(), feature


def read_back(media: DataFrame) -> DataFrame:
    """Digests and features of ``doc_id, n_bytes, media``, from the decoded samples."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            streams = batch.column("media").to_pylist()
            digests = [Digest() for _ in streams]
            for row, own in decoded(streams):
                digests[row].add(own)
            if streams:
                columns = list(zip(*(d.row(s) for d, s in zip(digests, streams, strict=True)), strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
