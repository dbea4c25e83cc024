"""Media columns: AVI files of motion-JPEG frames, read through their RIFF index and cut into timed clips.

`clips` decodes each frame of a binary column (baseline JPEG, intra frames only), compares histograms of neighbouring frames
and starts a new clip where the difference stands out from its surroundings. `store`/`load` keep bytes losslessly in such a
file: a 24 x 24 frame has nine 8 x 8 blocks, so 576 coefficients, and a coefficient of magnitude category 8 carries exactly
one byte in its extra bits. The format's unit of storage is thus the quantised coefficient, which no transform rounds.

Defined results: null text counts as empty; a null or broken file has no clips; a file in several RIFF chunks is read through to
its end; equal texts and files, repeated rows among them, have equal results; of equally large differences the first frame
begins the clip; very long texts make one file of many frames, which one task holds; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

SIDE, UNIT, FPS, BINS, AROUND = 24, 576, 25, 16, 12
BLOCK = 2048
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


ONE_CODE = bytes([1] + [0] * 15 + [8])
HEAD = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0") + _segment(0xC4, b"\0" + ONE_CODE + b"\x10" + ONE_CODE) + _segment(0xDA, b"\1\1\0\0\x3f\0")
TAIL = b"\xff\xd9"


def _pack(units: np.ndarray) -> np.ndarray:
    """(frames, 576) bytes to (frames, 648): each byte behind its one-bit Huffman code 0."""
    u = units.reshape(len(units), 72, 8)
    out = np.empty((len(units), 72, 9), np.uint8)
    out[:, :, 0] = u[:, :, 0] >> 1
    for j in range(1, 8):
        out[:, :, j] = (u[:, :, j - 1] << np.uint8(8 - j)) | (u[:, :, j] >> np.uint8(j + 1))
    out[:, :, 8] = u[:, :, 7]
    return out.reshape(len(units), 648)


def _unpack(packed: np.ndarray) -> np.ndarray | None:
    o = packed.reshape(len(packed), 72, 9)
    out = np.empty((len(packed), 72, 8), np.uint8)
    for j in range(8):
        if ((o[:, :, j] >> np.uint8(7 - j)) & 1).any():
            return None
        out[:, :, j] = ((o[:, :, j] & np.uint8((1 << (7 - j)) - 1)) << np.uint8(j + 1) if j < 7 else 0) | (o[:, :, j + 1] >> np.uint8(7 - j))
    return out.reshape(len(packed), UNIT)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    n, most = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, fps, 0, n, most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    index, at, movi = [], 4, [b"movi"]
    for frame in frames:
        movi.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movi[-1])
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """Frames in the order of the index (of the movi list where there is no index) and frames a second."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frames, fps, found, begin = [], float(FPS), False, 0
    # files above 1 GB go on in further RIFF chunks, of the form AVIX and without an old index
    while begin + 12 <= len(data) and data[begin : begin + 4] == b"RIFF" and data[begin + 8 : begin + 12] in (b"AVI ", b"AVIX"):
        size = struct.unpack_from("<I", data, begin + 4)[0]
        stop = min(begin + 8 + size, len(data)) if size else len(data)
        movi, index = None, None
        for name, at, end in _chunks(data, begin + 12, stop):
            kind = data[at : at + 4]
            if name == b"LIST" and kind == b"movi":
                movi, found = (at, end), True
            elif name == b"LIST" and kind == b"hdrl" and data[at + 4 : at + 8] == b"avih":
                fps = 1e6 / max(1, struct.unpack_from("<I", data, at + 12)[0])
            elif name == b"idx1":
                index = data[at:end]
        if movi is not None and index:
            for name, _, offset, length in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
                if name[2:] in (b"dc", b"db"):
                    frames.append(data[movi[0] + offset + 8 : movi[0] + offset + 8 + length])
        elif movi is not None:
            frames += _listed(data, movi[0] + 4, movi[1])
        begin = stop + (stop - begin) % 2
    if not found:
        raise ValueError("no movi list")
    return frames, fps


def _chunks(data: bytes, at: int, stop: int):
    """(name, begin, end) of the chunks between two places."""
    while at + 8 <= stop:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(at + 8 + size, stop)
        at += 8 + size + size % 2


def _listed(data: bytes, at: int, stop: int) -> list[bytes]:
    """Frames of a movi list in its own order, those in rec lists too."""
    out = []
    for name, begin, end in _chunks(data, at, stop):
        if name[2:] in (b"dc", b"db"):
            out.append(data[begin:end])
        elif name == b"LIST" and data[begin : begin + 4] == b"rec ":
            out += _listed(data, begin + 4, end)
    return out


def store(payload: bytes) -> bytes:
    """Bytes, a multiple of 576, as an AVI file."""
    return avi(_frames(np.frombuffer(payload, np.uint8).reshape(-1, UNIT)), SIDE, SIDE)


def _frames(units: np.ndarray) -> list[bytes]:
    out = []
    for at in range(0, len(units), BLOCK):
        packed = _pack(units[at : at + BLOCK]).tobytes()
        out += [HEAD + packed[i : i + 648].replace(b"\xff", b"\xff\0") + TAIL for i in range(0, len(packed), 648)]
    return out


def _scan(frame: bytes):
    """The tables of a baseline frame and its entropy-coded bytes."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quant, huff, parts, shape, restart, at = {}, {}, [], None, 0, 2
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.float32)
                i += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts, table, code, k = body[i + 1 : i + 17], {}, 0, i + 17
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                huff[body[i]] = table
                i = k
        elif marker == 0xC0 or marker == 0xC1:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            shape = (height, width)
            parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            for i in range(body[0]):
                for part in parts:
                    if part[0] == body[1 + 2 * i]:
                        part[4:] = body[2 + 2 * i] >> 4, 16 | (body[2 + 2 * i] & 15)
            return quant, huff, parts, shape, restart, frame[at:]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("only baseline frames are decoded")


def coefficients(frame: bytes):
    """Quantised coefficients of the first component in zigzag order, (blocks down, blocks across, 64), its table and shape."""
    quant, huff, parts, (height, width), restart, data = _scan(frame)
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    if len(parts) == 1:
        parts[0][1] = parts[0][2] = most_h = most_v = 1
        across, down = -(-width // 8), -(-height // 8)
    out = np.zeros((down * parts[0][2], across * parts[0][1], 64), np.int32)
    bits, have, at, last = 0, 0, 0, [0] * len(parts)

    def fill():
        nonlocal bits, have, at
        byte = data[at] if at < len(data) else 0
        if byte == 255 and at + 1 < len(data):
            if data[at + 1] == 0:
                at += 1
            else:  # a marker: the data end here
                at -= 1
                byte = 0
        at += 1
        bits, have = (bits << 8 | byte) & 0xFFFFFFFFFF, have + 8

    def take(n):
        nonlocal have
        while have < n:
            fill()
        have -= n
        return bits >> have & ((1 << n) - 1)

    def symbol(table):
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("bad code")

    def value(size):
        if not size:
            return 0
        v = take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1

    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            have, last = 0, [0] * len(parts)
            at = data.find(b"\xff", at)
            while at >= 0 and not 0xD0 <= data[at + 1] <= 0xD7:
                at = data.find(b"\xff", at + 1)
            at += 2
        for c, (_, h, v, _, dc, ac) in enumerate(parts):
            for block in range(h * v):
                row = np.zeros(64, np.int32)
                last[c] += value(symbol(huff[dc]))
                row[0], k = last[c], 1
                while k < 64:
                    run, size = divmod(symbol(huff[ac]), 16)
                    if size == 0:
                        if run < 15:
                            break
                        k += 16
                        continue
                    k += run
                    row[k] = value(size)
                    k += 1
                if c == 0:
                    out[mcu // across * v + block // h, mcu % across * h + block % h] = row
    return out, quant[parts[0][3]], (height, width)


def _inverse() -> np.ndarray:
    """Zigzag coefficients to the 64 samples of a block, as one matrix."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG].astype(np.float32)


INVERSE = _inverse()


def samples(levels: np.ndarray, quant: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((levels * quant).reshape(-1, 64).astype(np.float32) @ INVERSE + np.float32(128)), 0, 255).astype(np.uint8).reshape(levels.shape)


def _stored_units(frames: list[bytes]) -> np.ndarray | None:
    """All bytes of frames in the layout of `store`, else None."""
    n, m = len(HEAD), len(TAIL)
    body = []
    for f in frames:
        if not f.startswith(HEAD) or not f.endswith(TAIL):
            return None
        packed = f[n:-m].replace(b"\xff\0", b"\xff")
        if len(packed) != 648:
            return None
        body.append(packed)
    return _unpack(np.frombuffer(b"".join(body), np.uint8).reshape(-1, 648)) if body else None


def _levels(units: np.ndarray) -> np.ndarray:
    """Coefficients that stored bytes stand for: (frames, 9, 64), the first of a block as a difference to the one before."""
    v = units.astype(np.int32)
    v = np.where(v >= 128, v, v - 255).reshape(len(units), 9, 64)
    v[:, :, 0] = np.cumsum(v[:, :, 0], axis=1)
    return v


def load(data: bytes) -> bytes:
    """The bytes that `store` kept."""
    frames, _ = read_avi(data)
    out = []
    for at in range(0, len(frames), BLOCK):
        units = _stored_units(frames[at : at + BLOCK])
        if units is None:
            raise ValueError("not written by store()")
        out.append(units.tobytes())
    return b"".join(out)


def _unit_histograms(units: np.ndarray) -> np.ndarray:
    pixels = samples(_levels(units), np.ones(64, np.float32)).reshape(len(units), -1)
    cell = (pixels >> 4).astype(np.int32) + np.arange(len(units), dtype=np.int32)[:, None] * BINS
    return np.bincount(cell.ravel(), minlength=len(units) * BINS).reshape(-1, BINS) / UNIT


def histograms(frames: list[bytes]) -> np.ndarray:
    """A histogram of sample values for each frame, as shares."""
    out = []
    for at in range(0, len(frames), BLOCK):
        part = frames[at : at + BLOCK]
        units = _stored_units(part)
        if units is not None:
            out.append(_unit_histograms(units))
        else:
            for frame in part:
                levels, quant, (height, width) = coefficients(frame)
                pixels = samples(levels, quant).reshape(*levels.shape[:2], 8, 8).transpose(0, 2, 1, 3).reshape(levels.shape[0] * 8, -1)
                out.append(np.bincount((pixels[:height, :width] >> 4).ravel(), minlength=BINS)[None] / (height * width))
    return np.concatenate(out) if out else np.zeros((0, BINS))


def shots(shares: np.ndarray, least: float = 0.25, deviations: float = 3.0) -> np.ndarray:
    """First frames of shots: histogram differences over `least` that stand out from the AROUND differences on either side."""
    if len(shares) < 2:
        return np.zeros(min(1, len(shares)), np.int64)
    d = np.abs(np.diff(shares, axis=0)).sum(axis=1)
    s, q = (np.concatenate(([0], np.cumsum(x))) for x in (d, d * d))
    lo, hi = np.maximum(np.arange(len(d)) - AROUND, 0), np.minimum(np.arange(len(d)) + AROUND + 1, len(d))
    n = np.maximum(hi - lo - 1, 1)
    mean = (s[hi] - s[lo] - d) / n
    spread = np.sqrt(np.maximum((q[hi] - q[lo] - d * d) / n - mean * mean, 0))
    return np.concatenate(([0], np.flatnonzero(d > np.maximum(least, mean + deviations * spread)) + 1))


def _clip_rows(batches):
    schema = pa.schema([("id", pa.int64()), ("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())])
    for batch in batches:
        out = []
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = data.as_py()
            try:
                frames, fps = read_avi(data or b"")
                first = shots(histograms(frames))
            except (ValueError, IndexError, KeyError, struct.error):
                continue
            for k, (a, b) in enumerate(zip(first, [*first[1:], len(frames)], strict=True)):
                out.append((i, k, float(a) / fps, float(b) / fps, int(b - a)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def clips(files: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each clip of each file: id, clip, start_s, end_s, frames."""
    return files.select(F.col(key).cast("long").alias("id"), F.col(column).alias("data")).mapInArrow(_clip_rows, "id long, clip int, start_s double, end_s double, frames int")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    for batch in batches:
        docs = batch.column(0).to_pylist()
        # numpy works on the frames of many texts at once; files are written and read text by text
        for at, end, data, starts in text_slices(batch):
            size = np.diff(starts)
            count = np.maximum(-(-size // UNIT), 1)
            first = np.concatenate(([0], np.cumsum(count)))
            payload = np.full(int(first[-1]) * UNIT, 255, np.uint8)
            payload[np.arange(len(data)) + np.repeat(first[:-1] * UNIT - starts[:-1], size)] = data
            written = _frames(payload.reshape(-1, UNIT))
            files = [avi(written[a:b], SIDE, SIDE) for a, b in zip(first[:-1], first[1:], strict=True)]
            read = [f for media in files for f in read_avi(media)[0]]
            units = np.concatenate([_stored_units(read[a : a + BLOCK]) for a in range(0, len(read), BLOCK)])
            shares = np.concatenate([_unit_histograms(units[a : a + BLOCK]) for a in range(0, len(units), BLOCK)])
            out = []
            for i, media in enumerate(files):
                a, b = int(first[i]), int(first[i + 1])
                back, own = units[a:b].tobytes(), shares[a:b]
                cuts = shots(own)
                seen = "-".join(map(str, np.rint(own.mean(axis=0) * 1000).astype(int).tolist()))
                feature = f"frames={b - a};clips={len(cuts)};cuts={'-'.join(map(str, cuts.tolist()))};histogram={seen}"
                out.append((docs[at + i], int(size[i]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def text_media(docs: DataFrame) -> DataFrame:
    """Every text stored as an AVI file and read back: sizes, digests and features of the stored form."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digest, DIGEST)
