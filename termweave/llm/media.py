"""Media columns: AVI motion-JPEG, written losslessly, parsed through its RIFF index, decoded and cut into clips.

A payload of 8-bit samples is stored as gray frames of WIDTH samples a line and LINES lines (the last frame may have
fewer), each a JPEG of the lossless process (SOF3, left neighbour as predictor, one restart interval a line), so that decoding
gives the very bytes. Frames of the baseline process (SOF0, the usual content of such files) are decoded too. Lines of
many frames are coded and decoded side by side in numpy, one sample of each at a step.

Shots: frames are compared by the histograms of their samples; a frame starts a new shot if its difference from the
one before is at least LEAST_CUT and above the mean of the shot so far by ADAPT standard deviations. Each shot is a clip with times.

Cases: null and empty texts are one line of blanks; texts of any length are stored whole, frame by frame; equal
texts have equal media; repeated rows stay repeated; media that is null, no AVI, or has a frame that cannot be decoded, has no clips
and a null payload, whatever its neighbours are; frames without code tables use the standard ones; of several streams the first
video stream is read; an empty table gives no rows; other columns play no part, whatever they are called.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.tokenizing import by_bytes
from termweave.plans.shared import ship

WIDTH, LINES, RATE = 192, 64, 25
BINS, LEAST_CUT, ADAPT = 32, 0.12, 3.0
#: Lengths of the codes of the categories 0 to 8 of differences.
CODE_LENGTHS = (4, 4, 3, 3, 3, 4, 4, 2, 5)
# The standard code tables of motion-JPEG frames without their own: how many codes of each length, and the
# symbols in order; from where ``rest`` is set, the remaining symbols follow in ascending order.
_STANDARD_DC = {0: [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], 1: [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]}
_STANDARD_AC = {
    0: ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    1: ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}
#: Bytes of texts or files that a worker holds at once, about; a longer one is held alone.
HELD_BYTES = 8 << 20
#: Lines that are coded side by side at most.
SIDE_BY_SIDE = 16384
#: The order in which the process lists the 64 coefficients of a block, along its diagonals.
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8) if (k // 8 + k % 8) % 2 else -(k // 8)))


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical codes (code, length) by symbol from how many there are of each length."""
    out, code, at = {}, 0, 0
    for length, many in enumerate(counts, 1):
        for s in symbols[at : at + many]:
            out[s] = (code, length)
            code += 1
        at, code = at + many, code << 1
    return out


def _standard_tables() -> dict[int, dict[int, tuple[int, int]]]:
    out = {k: _codes(counts, list(range(12))) for k, counts in _STANDARD_DC.items()}
    for k, (counts, text) in _STANDARD_AC.items():
        first = [int(x, 16) for x in text.split()]
        every = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]
        out[0x10 | k] = _codes(counts, first + sorted(set(every).difference(first)))
    return out


def _table() -> tuple[list[int], list[int]]:
    symbols = sorted(range(9), key=lambda s: (CODE_LENGTHS[s], s))
    return [CODE_LENGTHS.count(n) for n in range(1, 17)], symbols


def _lookup(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each 16 bits that follow."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in codes.items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)], length[code << (16 - n) : (code + 1) << (16 - n)] = s, n
    return symbol, length


_DIFF = np.arange(-255, 256)
_CATEGORY = np.array([int(abs(d)).bit_length() for d in _DIFF])
_CODE = np.array([_codes(*_table())[c] for c in range(9)])
_LENGTH = (_CODE[_CATEGORY, 1] + _CATEGORY).astype(np.int32)
_VALUE = ((_CODE[_CATEGORY, 0] << _CATEGORY) | np.where(_DIFF > 0, _DIFF, (_DIFF - 1) & ((1 << _CATEGORY) - 1))).astype(np.int32)


def _header(lines: int) -> bytes:
    counts, symbols = _table()
    dht = b"\x00" + bytes(counts) + bytes(symbols)
    return b"".join((b"\xff\xd8\xff\xc4", struct.pack(">H", 2 + len(dht)), dht, b"\xff\xc3", struct.pack(">HBHHB3B", 11, 8, lines, WIDTH, 1, 1, 0x11, 0), b"\xff\xdd", struct.pack(">HH", 4, WIDTH), b"\xff\xda", struct.pack(">HB2B3B", 8, 1, 1, 0x00, 1, 0, 0)))


def encode_lines(lines: np.ndarray, last: np.ndarray, turn: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded lines, each with the marker that follows it (a restart, or the image's end where last); where each starts."""
    x = lines.astype(np.int32)
    d = np.diff(x, axis=1, prepend=128) + 255
    length, value = _LENGTH[d], _VALUE[d]
    upto = np.cumsum(length, axis=1)
    size = (upto[:, -1] + 7) >> 3
    begin = np.cumsum(size) - size
    bit = (begin[:, None] * 8 + upto - length).ravel()
    at, word = bit >> 3, value.ravel() << (24 - length.ravel() - (bit & 7))
    n = int(size.sum()) + 3
    raw = np.bincount(at, word >> 16, n) + np.bincount(at + 1, (word >> 8) & 255, n) + np.bincount(at + 2, word & 255, n)
    raw = raw[:-3].astype(np.uint8)
    raw[begin + size - 1] |= ((1 << (-upto[:, -1] & 7)) - 1).astype(np.uint8)  # the last byte is filled with ones
    full = raw == 255
    line = np.repeat(np.arange(len(lines)), size)
    place = np.arange(len(raw)) + np.cumsum(full) - full + 2 * line
    out = np.zeros(len(raw) + int(full.sum()) + 2 * len(lines), np.uint8)  # a zero follows each byte of ones
    out[place] = raw
    ends = np.append(place[begin[1:]], len(out)) - 2
    out[ends], out[ends + 1] = 255, np.where(last, 0xD9, 0xD0 + turn % 8)
    return out.tobytes(), np.append(place[begin], len(out))


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(frames: list[bytes], height: int) -> bytes:
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    index, at, body = [], 4, [b"movi"]
    for f in frames:
        body.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _chunks(media: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks in a range; lists have the name of their kind, and start behind it."""
    while at + 8 <= min(end, len(media)):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST":
            yield b"LIST" + media[at + 8 : at + 12], at + 12, size - 4
        else:
            yield name, at + 8, size
        at += 8 + size + (size & 1)


def _walk(media: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Chunks of a list of frames, and of the clusters in it."""
    for name, start, size in _chunks(media, at, end):
        if name == b"LISTrec ":
            yield from _walk(media, start, start + size)
        else:
            yield name, start, size


def read_avi(media: bytes) -> tuple[list[bytes], float]:
    """Frames of the first video stream through the index (or, without one, by walking the list), and frames a second."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, stream, streams, movi, index = float(RATE), None, 0, None, None
    for name, start, size in _chunks(media, 12, len(media)):
        if name == b"LISThdrl":
            for inner, a, n in _chunks(media, start, start + size):
                if inner == b"avih":
                    rate = 1e6 / (struct.unpack_from("<I", media, a)[0] or 1e6 / RATE)
                elif inner == b"LISTstrl":
                    head = next((b for kind, b, _ in _chunks(media, a, a + n) if kind == b"strh"), None)
                    if stream is None and head is not None and media[head : head + 4] == b"vids":
                        stream = streams
                        scale, per = struct.unpack_from("<II", media, head + 20)
                        rate = per / scale if scale and per else rate
                    streams += 1
        elif name == b"LISTmovi" and movi is None:
            movi = (start, start + size)
        elif name == b"idx1" and index is None:
            index = (start, min(start + size, len(media)))
    if movi is None:
        raise ValueError("an AVI file without frames")
    wanted = tuple(b"%02d" % (stream or 0) + kind for kind in (b"dc", b"db"))
    if index is None:
        return [media[a : a + n] for name, a, n in _walk(media, *movi) if name in wanted], rate
    frames, base = [], movi[0] - 4
    entries = [(name, at, n) for name, _, at, n in struct.iter_unpack("<4sIII", media[index[0] : index[0] + (index[1] - index[0]) // 16 * 16]) if name in wanted]
    if entries and media[base + entries[0][1] : base + entries[0][1] + 4] != entries[0][0]:
        base = 0  # offsets from the file's start
    for name, at, n in entries:
        if media[base + at : base + at + 4] != name:
            raise ValueError("an index that does not fit its file")
        frames.append(media[base + at + 8 : base + at + 8 + n])
    return frames, rate


def _segments(jpeg: bytes) -> dict:
    """What a frame's headers say, and its entropy-coded part; a frame that has none raises."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    out: dict = {"tables": {}, "quant": {}, "restart": 0}
    at = 2
    while True:
        if jpeg[at] != 0xFF:
            raise ValueError("a broken frame")
        mark, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if mark == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                out["tables"][body[0]] = _codes(counts, list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif mark == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(float)
                body = body[1 + n :]
        elif mark in (0xC0, 0xC1, 0xC3):
            out["process"], out["lines"], out["width"] = mark, *struct.unpack_from(">HH", body, 1)
            out["parts"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif mark == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            out["scan"] = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            out["predictor"] = body[1 + 2 * body[0]]
            out["data"] = at + 2 + size
            return out
        at += 2 + size


def _decode_side_by_side(streams: np.ndarray, starts: np.ndarray, count: int, codes: dict[int, tuple[int, int]]) -> np.ndarray:
    """Differences of count samples in each line; streams without stuffing, starts in bytes."""
    symbols, lengths = _lookup(codes)
    pad = np.concatenate((streams, np.zeros(8, np.uint8))).astype(np.uint64)
    window = np.zeros(len(streams) + 1, np.uint64)
    for k in range(8):
        window |= pad[k : k + len(window)] << np.uint64(56 - 8 * k)
    offset = np.array([0] + [1 - (1 << s) for s in range(1, 17)])
    half = np.array([0] + [1 << (s - 1) for s in range(1, 17)])
    bit, out = starts.astype(np.int64) * 8, np.empty((count, len(starts)), np.int32)
    for k in range(count):
        w = window[bit >> 3] << (bit & 7).astype(np.uint64)
        code = (w >> np.uint64(48)).astype(np.int64)
        s, n = symbols[code], lengths[code]
        extra = ((w << n.astype(np.uint64)) >> (63 - s).astype(np.uint64) >> np.uint64(1)).astype(np.int64)
        out[k] = np.where(extra < half[s], extra + offset[s], extra)
        bit += n + s
    return out.T


def decode_lossless(frames: list[bytes]) -> list[np.ndarray]:
    """Samples (lines x width) of frames of the lossless process with one part, predictor 1 and restarts at each line's end."""
    heads = [_segments(f) for f in frames]
    out: list[np.ndarray] = [None] * len(frames)  # type: ignore[list-item]
    alike: dict[tuple, list[int]] = {}
    for k, h in enumerate(heads):
        if h["process"] != 0xC3 or h["predictor"] != 1 or len(h["parts"]) != 1 or h["restart"] != h["width"]:
            raise ValueError("a lossless frame of another kind")
        codes = h["tables"][h["scan"][h["parts"][0][0]] >> 4]
        alike.setdefault((h["width"], tuple(sorted(codes.items()))), []).append(k)
    for (width, codes), own in alike.items():
        data = np.frombuffer(b"".join(frames[k][heads[k]["data"] :] for k in own), np.uint8)
        after = np.append(data[1:], 0)
        ones = data == 255
        marks = np.flatnonzero(ones & ((after & 0xF8 == 0xD0) | (after == 0xD9)))
        keep = np.ones(len(data), bool)
        keep[np.flatnonzero(ones & (after == 0)) + 1] = False  # stuffed zeros; markers stay, at the lines' ends
        moved = np.cumsum(keep) - 1
        starts = moved[np.append(0, marks[:-1] + 2)]
        lines = _decode_side_by_side(data[keep], starts, width, dict(codes))
        samples = ((np.cumsum(lines, axis=1) + 128) & 255).astype(np.uint8)
        at = 0
        for k in own:
            out[k] = samples[at : at + heads[k]["lines"]]
            at += heads[k]["lines"]
    return out


def decode_baseline(jpeg: bytes) -> np.ndarray:
    """Brightness (lines x width) of a frame of the baseline process."""
    h = _segments(jpeg)
    raw = jpeg[h["data"] :]
    tables = {k: _lookup(v) for k, v in (_standard_tables() | h["tables"]).items()}
    tall, wide = max(p[2] for p in h["parts"]), max(p[1] for p in h["parts"])
    down, across = -(-h["lines"] // (8 * tall)), -(-h["width"] // (8 * wide))
    first = h["parts"][0]
    plane = np.zeros((down * first[2] * 8, across * first[1] * 8))
    cos = np.array([[(np.sqrt(0.125) if not u else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
    chunks, at = [], 0
    while True:  # restart intervals, without stuffing
        k = at
        while not (raw[k] == 255 and raw[k + 1] != 0):  # the end of the data, before the marker, raises
            k += 1
        chunks.append(raw[at:k].replace(b"\xff\x00", b"\xff"))
        at = k + 2
        if raw[k + 1] & 0xF8 != 0xD0:
            break
    units, unit = down * across, 0
    for chunk in chunks:
        bits, have, pos = int.from_bytes(chunk + b"\xff" * 8, "big"), 8 * len(chunk) + 64, 0
        peek = lambda n: (bits >> (have - pos - n)) & ((1 << n) - 1)  # noqa: E731, B023
        before = dict.fromkeys((p[0] for p in h["parts"]), 0)
        for _ in range(min(h["restart"] or units, units - unit)):
            for name, hor, ver, q in h["parts"]:
                spec = h["scan"][name]
                for v in range(ver):
                    for u in range(hor):
                        block, k = np.zeros(64), 0
                        while k < 64:
                            symbols, lengths = tables[0x10 | (spec & 15) if k else spec >> 4]
                            code = peek(16)
                            if not lengths[code] or pos > have:
                                raise ValueError("broken data in a frame")
                            s, pos = int(symbols[code]), pos + int(lengths[code])
                            run, size = (s >> 4, s & 15) if k else (0, s)
                            if k and not size:
                                if run != 15:
                                    break
                                k += 16
                                continue
                            k += run
                            if k > 63:
                                raise ValueError("broken data in a frame")
                            got = peek(size) if size else 0
                            pos += size
                            value = got if not size or got >> (size - 1) else got + 1 - (1 << size)
                            if not k:
                                value = before[name] = before[name] + value
                            block[ZIGZAG[k]] = value * h["quant"][q][k]
                            k += 1
                        if name == first[0]:
                            y, x = (unit // across * ver + v) * 8, (unit % across * hor + u) * 8
                            plane[y : y + 8, x : x + 8] = cos @ block.reshape(8, 8) @ cos.T + 128
            unit += 1
    return np.clip(np.rint(plane[: h["lines"], : h["width"]]), 0, 255).astype(np.uint8)


def decode(frames: list[bytes]) -> list[np.ndarray]:
    """Samples of each frame, whichever process it is of."""
    kinds = [_segments(f)["process"] for f in frames]
    plain = iter(decode_lossless([f for f, k in zip(frames, kinds) if k == 0xC3]))
    return [next(plain) if k == 0xC3 else decode_baseline(f) for f, k in zip(frames, kinds)]


#: What a file that breaks the format can raise while it is parsed or decoded.
BROKEN = (ValueError, KeyError, IndexError, TypeError, OverflowError, StopIteration, struct.error)


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """First frame and the one behind the last of each shot."""
    if not frames:
        return []
    shades = [np.bincount(f.ravel() >> 3, minlength=BINS) / f.size for f in frames]
    cuts, run = [0], []
    for k in range(1, len(frames)):
        d = round(float(np.abs(shades[k] - shades[k - 1]).sum()) / 2, 9)
        if d >= LEAST_CUT and (not run or d > np.mean(run) + ADAPT * np.std(run)):
            cuts.append(k)
            run = []
        else:
            run.append(d)
    return list(zip(cuts, [*cuts[1:], len(frames)]))


def to_avi(payloads: list[bytes]) -> list[bytes]:
    """AVI files of payloads, whose sizes are positive multiples of WIDTH."""
    out: list[bytes] = []
    at = 0
    while at < len(payloads):
        end, total = at, 0
        while end < len(payloads) and (end == at or total + len(payloads[end]) <= SIDE_BY_SIDE * WIDTH):
            total += len(payloads[end])
            end += 1
        own = payloads[at:end]
        n = np.array([len(p) // WIDTH for p in own])
        lines = np.frombuffer(b"".join(own), np.uint8).reshape(-1, WIDTH)
        within = np.arange(len(lines)) - np.repeat(np.cumsum(n) - n, n)
        last = (within % LINES == LINES - 1) | (within == np.repeat(n, n) - 1)
        parts, first = [], 0
        for a in range(0, len(lines), SIDE_BY_SIDE):
            parts.append(encode_lines(lines[a : a + SIDE_BY_SIDE], last[a : a + SIDE_BY_SIDE], within[a : a + SIDE_BY_SIDE] % LINES))
        where = np.concatenate([p[1][:-1] + b for p, b in zip(parts, np.cumsum([0] + [len(p[0]) for p in parts[:-1]]))] + [[sum(len(p[0]) for p in parts)]])
        data = b"".join(p[0] for p in parts)
        for many in n.tolist():
            frames = []
            for a in range(first, first + many, LINES):
                b = min(a + LINES, first + many)
                frames.append(_header(b - a) + data[where[a] : where[b]])
            out.append(write_avi(frames, min(many, LINES)))
            first += many
        at = end
    return out


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text, filled with blanks to whole lines, as an AVI file."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, HELD_BYTES):
                texts = [t or b"" for t in part.column(1).to_pylist()]
                media = to_avi([t + b" " * (-len(t) % WIDTH if t else WIDTH) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, "id long, n_bytes long, media binary")


def _parsed(media: bytes | None) -> tuple[list[bytes], float] | None:
    try:
        return read_avi(media or b"")
    except BROKEN:
        return None


def _decoded_alone(parsed: tuple[list[bytes], float] | None) -> list[np.ndarray] | None:
    try:
        return None if parsed is None else decode(parsed[0])
    except BROKEN:
        return None


def _decoded(media: list[bytes | None]) -> Iterator[tuple[bytes | None, list[np.ndarray], float]]:
    """Per file its samples as bytes, its frames and their rate; frames of neighbouring files are decoded together."""
    at = 0
    while at < len(media):
        end, total = at, 0
        while end < len(media) and (end == at or total + len(media[end] or b"") <= SIDE_BY_SIDE * WIDTH):
            total += len(media[end] or b"")
            end += 1
        files = [_parsed(m) for m in media[at:end]]
        try:
            frames = iter(decode([f for x in files if x for f in x[0]]))
            done = [[next(frames) for _ in x[0]] if x else None for x in files]
        except BROKEN:  # one of them is broken: each by itself
            done = [_decoded_alone(x) for x in files]
        for x, own in zip(files, done):
            yield (None if own is None else b"".join(f.tobytes() for f in own)), own or [], x[1] if x else 0.0
        at = end


def clips(stored: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, clip, first_frame, frames, start_s, end_s): a row for each shot of each file."""
    ship(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 1, HELD_BYTES)):
            rows = []
            for i, (_, frames, rate) in zip(batch.column(0).to_pylist(), _decoded(batch.column(1).to_pylist())):
                rows += [{"id": i, "clip": k, "first_frame": a, "frames": b - a, "start_s": a / rate, "end_s": b / rate} for k, (a, b) in enumerate(shots(frames))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    return stored.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("m")).mapInArrow(run, "id long, clip int, first_frame int, frames int, start_s double, end_s double")


def digests(stored: DataFrame) -> DataFrame:
    """store()'s rows with digests of what is read back, and the shots as a text."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 2, HELD_BYTES)):
            media = batch.column(2).to_pylist()
            cols: list[list] = [[] for _ in range(6)]
            for m, (payload, frames, _) in zip(media, _decoded(media)):
                found = shots(frames)
                stored = (len(m), hashlib.sha256(m).hexdigest()) if m is not None else (None, None)
                if payload is None:
                    row = (None, None, None, *stored, None)
                else:
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, f"{len(frames)} frames, {len(found)} shots at " + " ".join(str(a) for a, _ in found))
                for c, v in zip(cols, row):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, types)]], names=[x.split()[0] for x in schema.split(", ")])

    return stored.mapInArrow(run, schema)


def op6_media(spark, sf_dir: str) -> DataFrame:
    return digests(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
