"""Motion-JPEG in AVI: texts or bytes to a media column and back, with shot detection.

A payload byte is one quantised DCT coefficient of size category 8, whose eight amplitude bits are the byte itself, so a
baseline JPEG keeps it without loss. The Huffman tables hold 8-bit codes only; every block is a restart interval. Frames of that profile are read as arrays;
those of other files are decoded by their own tables, for their luminance.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, documents, text_steps

BLOCK = 64
SIDE = 32
PER_FRAME = (SIDE // 8) ** 2
FPS = 25
BINS = 16
#: An exact product in float32 needs |coefficient| * 64 * max basis < 2**24.
SCALE = 1 << 11

# fixed values: zigzag order of JPEG, by diagonals
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


def _basis() -> np.ndarray:
    """Row k: the 8x8 pixels of the k-th coefficient in zigzag order, times SCALE, as whole numbers."""
    n = np.arange(8)
    one = np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16) * np.where(n == 0, np.sqrt(1 / 8), 0.5)[:, None]
    two = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(two[ZIGZAG] * SCALE).astype(np.float32)


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _table(kind: int, symbols: bytes) -> bytes:
    """A Huffman table in which every code has 8 bits."""
    return bytes([kind]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + symbols


HEADER = b"".join([
    b"\xff\xd8",
    _marker(0xDB, b"\x00" + b"\x01" * 64),
    _marker(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)),
    _marker(0xC4, _table(0x00, b"\x08\x00")),
    _marker(0xC4, _table(0x10, b"\x08\x00")),
    _marker(0xDD, struct.pack(">H", 1)),
    _marker(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
])
STRIDE = 2 * BLOCK + 2
FRAME_BYTES = len(HEADER) + PER_FRAME * STRIDE
PAD_BLOCK = b"\x01\x01"


def _ends() -> np.ndarray:
    marks = np.full((PER_FRAME, 2), 0xFF, np.uint8)
    marks[:, 1] = 0xD0 + np.arange(PER_FRAME) % 8
    marks[-1, 1] = 0xD9
    return marks


ENDS = _ends()


def _full_frames(payload: np.ndarray) -> np.ndarray:
    """One row for each '00dc' chunk; payload has no byte 255 and fills the frames."""
    n = len(payload) // (BLOCK * PER_FRAME)
    size = FRAME_BYTES + FRAME_BYTES % 2
    out = np.zeros((n, 8 + size), np.uint8)
    out[:, : 8 + len(HEADER)] = np.frombuffer(b"00dc" + struct.pack("<I", FRAME_BYTES) + HEADER, np.uint8)
    scan = out[:, 8 + len(HEADER) : 8 + FRAME_BYTES].reshape(n, PER_FRAME, STRIDE)
    scan[:, :, 1 : 2 * BLOCK : 2] = payload.reshape(n, PER_FRAME, BLOCK)
    scan[:, :, 2 * BLOCK :] = ENDS
    return out


def _any_frame(payload: bytes) -> bytes:
    """A '00dc' chunk of at most PER_FRAME blocks of any bytes; missing blocks are empty ones."""
    parts = [HEADER]
    for k in range(PER_FRAME):
        own = payload[k * BLOCK : (k + 1) * BLOCK]
        coded = bytearray(2 * len(own))
        coded[1::2] = own
        parts += [bytes(coded).replace(b"\xff", b"\xff\x00") if own else PAD_BLOCK, ENDS[k].tobytes()]
    frame = b"".join(parts)
    return b"00dc" + struct.pack("<I", len(frame)) + frame + b"\0" * (len(frame) % 2)


def _avi(chunks: list[bytes]) -> bytes:
    """The file of one stream; `chunks` are runs of '00dc' chunks."""
    movi = b"movi" + b"".join(chunks)
    at, index, largest = 4, [], 0
    for run in chunks:
        p = 0
        while p < len(run):
            n = struct.unpack_from("<I", run, p + 4)[0]
            index.append((at + p, n))
            largest, p = max(largest, n), p + 8 + n + n % 2
        at += len(run)
    n = len(index)
    idx = np.zeros((n, 4), "<u4")
    idx[:, 0], idx[:, 1], idx[:, 2:] = int.from_bytes(b"00dc", "little"), 0x10, index
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    box = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    strl = box(b"LIST", b"strl" + box(b"strh", strh) + box(b"strf", strf))
    hdrl = box(b"LIST", b"hdrl" + box(b"avih", avih) + strl)
    return box(b"RIFF", b"AVI " + hdrl + box(b"LIST", movi) + box(b"idx1", idx.tobytes()))


def encode_avi(payload: bytes) -> bytes:
    """An AVI file that holds the payload, followed by bytes 0 up to a positive multiple of 64."""
    payload = payload + b"\0" * (-len(payload) % BLOCK if payload else BLOCK)
    span, chunks = BLOCK * PER_FRAME, []
    whole = len(payload) // span * span
    if b"\xff" in payload:
        whole = 0
    if whole:
        chunks.append(_full_frames(np.frombuffer(payload, np.uint8, whole)).tobytes())
    chunks += [_any_frame(payload[p : p + span]) for p in range(whole, len(payload), span)]
    return _avi(chunks)


def _boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, n = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        yield kind, at + 8, at + 8 + n
        at += 8 + n + n % 2


def _index(media: bytes) -> tuple[np.ndarray, int]:
    """(start and size of each frame, from idx1; microseconds a frame)."""
    data, step, movi, found, streams = memoryview(media), 1_000_000 // FPS, None, None, []
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    for kind, a, b in _boxes(data, 12, len(media)):
        if kind == b"LIST" and media[a : a + 4] == b"hdrl":
            for k, x, z in _boxes(data, a + 4, b):
                if k == b"avih":
                    step = struct.unpack_from("<I", data, x)[0]
                elif k == b"LIST" and media[x : x + 4] == b"strl":
                    streams += [media[y : y + 4] for c, y, _ in _boxes(data, x + 4, z) if c == b"strh"]
        elif kind == b"LIST" and media[a : a + 4] == b"movi":
            movi = a
        elif kind == b"idx1":
            found = np.frombuffer(media, "<u4", (b - a) // 4, a).reshape(-1, 4)
    if movi is None or found is None:
        raise ValueError("no movi list or no index")
    number = b"%02d" % (streams.index(b"vids") if b"vids" in streams else 0)
    found = found[np.isin(found[:, 0], [int.from_bytes(number + kind, "little") for kind in (b"dc", b"db")])]
    # places count from the movi list, in some files from the start
    start = 0 if len(found) and media[found[0, 2] : found[0, 2] + 4] == found[0, :1].tobytes() else movi
    return np.stack([found[:, 2].astype(np.int64) + start + 8, found[:, 3].astype(np.int64)], 1), step


def _frame_payload(frame: bytes) -> bytes:
    """The payload of one frame, by its markers; empty blocks at the end hold none."""
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    out = []
    for own in re.split(rb"\xff[\xd0-\xd7]", frame[at:-2]):
        if own != PAD_BLOCK:
            own = own.replace(b"\xff\x00", b"\xff")
            if len(own) != 2 * BLOCK or any(own[::2]):
                raise ValueError("not a block of this profile")
            out.append(own[1::2])
    return b"".join(out)


def decode_avi(media: bytes) -> tuple[bytes, int, int]:
    """(payload, frames, microseconds a frame), read through the file's index."""
    frames, step = _index(media)
    out, k, n = [], 0, len(frames)
    gap = FRAME_BYTES + FRAME_BYTES % 2 + 8
    plain = (frames[:, 1] == FRAME_BYTES) & (frames[:, 0] == frames[0, 0] + gap * np.arange(n)) if n else np.zeros(0, bool)
    run = int(np.argmin(plain)) if n and not plain.all() else n
    if run:
        own = np.frombuffer(media, np.uint8, run * gap - (gap - FRAME_BYTES), frames[0, 0])
        own = np.lib.stride_tricks.as_strided(own, (run, FRAME_BYTES), (gap, 1))
        scan = own[:, len(HEADER) :].reshape(run, PER_FRAME, STRIDE)
        heads = (own[:, : len(HEADER)] == np.frombuffer(HEADER, np.uint8)).all()
        if heads and (scan[:, :, 2 * BLOCK :] == ENDS).all() and not scan[:, :, : 2 * BLOCK : 2].any():
            out.append(scan[:, :, 1 : 2 * BLOCK : 2].tobytes())
            k = run
    out += [_frame_payload(media[a : a + m]) for a, m in frames[k:]]
    return b"".join(out), n, step


class _Bits:
    """Bits of a run of entropy-coded bytes, stuffing already taken out; ones follow the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\xff" * 12, 0, 8 * len(data) + 64

    def take(self, n: int) -> int:
        byte, bit = divmod(self.at, 8)
        self.at += n
        if self.at > self.end:
            raise ValueError("the scan ends early")
        return (int.from_bytes(self.data[byte : byte + 4], "big") >> (32 - bit - n)) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def amount(self, n: int) -> int:
        """The signed number of size category n."""
        x = self.take(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


def _huffman(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    """(class and place, {(bits, code): symbol}) of the tables in a DHT segment."""
    while body:
        kind, counts, body = body[0], body[1:17], body[17:]
        table, code, at = {}, 0, 0
        for bits, n in enumerate(counts, 1):
            for _ in range(n):
                table[bits, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        body = body[at:]
        yield kind, table


def standard_tables() -> dict[int, dict[tuple[int, int], int]]:
    """The Huffman tables of the JPEG standard's examples, which motion-JPEG frames leave out."""
    # fixed values: numbers of codes by length, and the symbols that come out of order
    lengths = {
        0x00: "00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00", 0x01: "00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00",
        0x10: "00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d", 0x11: "00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77",
    }
    first = {
        0x10: "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
        0x11: "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
    }
    out: dict[int, dict[tuple[int, int], int]] = {}
    for kind, counts in lengths.items():
        every = range(12) if kind < 0x10 else [0x00, 0xF0, *(16 * run + size for run in range(16) for size in range(1, 11))]
        head = list(bytes.fromhex(first.get(kind, "")))
        out.update(_huffman(bytes([kind]) + bytes.fromhex(counts) + bytes(head + sorted(set(every) - set(head)))))
    return out


def decode_jpeg(data: bytes) -> np.ndarray:
    """Luminance (height, width) of a baseline JPEG frame: DQT, SOF0 or SOF1, DHT (else the standard's tables), DRI and one interleaved scan. Raises ValueError for another coding."""
    quant, codes, parts, restart, at = {}, standard_tables(), [], 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            while body:
                size = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if size == 128 else np.uint8, 64, 1).astype(np.float64)
                body = body[1 + size :]
        elif kind in (0xC0, 0xC1):
            bits, height, width, n_parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("not 8 bits a sample")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n_parts)]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif kind == 0xC4:
            codes.update(_huffman(body))
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            picks = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            break
    if not parts or set(picks) != {p[0] for p in parts}:
        raise ValueError("not one interleaved scan")
    end = data.rfind(b"\xff\xd9")
    runs = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", data[at : end if end > at else len(data)])]
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:  # a scan of one component has a block at a time, whatever its factors
        parts, across, down = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    wide, high = -(-width // (8 * across)), -(-height // (8 * down))
    first_h, first_v = parts[0][1], parts[0][2]
    blocks = np.zeros((high * first_v, wide * first_h, 64))
    bits, before = None, {}
    for unit in range(wide * high):
        if restart and unit % restart == 0 or bits is None:
            k = unit // restart if restart else 0
            if k >= len(runs):
                raise ValueError("a restart interval is missing")
            bits, before = _Bits(runs[k]), dict.fromkeys(picks, 0)
        for part, h, v, _ in parts:
            dc, ac = codes[picks[part] >> 4], codes[16 | picks[part] & 15]
            for k in range(h * v):
                own = np.zeros(64)
                before[part] += bits.amount(bits.symbol(dc))
                own[0], place = before[part], 1
                while place < 64:
                    symbol = bits.symbol(ac)
                    if symbol & 15 == 0:
                        if symbol != 0xF0:
                            break
                        place += 16
                        continue
                    place += symbol >> 4
                    if place > 63:
                        raise ValueError("too many coefficients")
                    own[place] = bits.amount(symbol & 15)
                    place += 1
                if part == parts[0][0]:
                    blocks[unit // wide * v + k // h, unit % wide * h + k % h] = own
    pixels = np.clip(np.floor(blocks * quant[parts[0][3]] @ _basis().astype(np.float64) / SCALE + 128.5), 0, 255)
    rows, cols = blocks.shape[:2]
    image = pixels.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
    # a component that is sampled less than others is as wide as its share
    return image[: -(-height * first_v // down), : -(-width * first_h // across)].astype(np.uint8)


def luminance_histograms(media: bytes) -> tuple[np.ndarray, int]:
    """(counts of luminance by frame, microseconds a frame) of any AVI file of baseline JPEG frames, read through its index. A frame of no bytes repeats the one before it."""
    frames, step = _index(media)
    out: list[np.ndarray] = []
    for a, n in frames.tolist():
        if n or not out:
            out.append(np.bincount((decode_jpeg(media[a : a + n]).astype(np.int64) * BINS // 256).ravel(), minlength=BINS))
        else:
            out.append(out[-1])
    return np.array(out).reshape(-1, BINS), step


def histograms(payload: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Counts of luminance by frame: coefficients, inverse DCT, level shift, clamp. The whole-number basis keeps float32 exact."""
    blocks = payload.reshape(-1, BLOCK)
    coefficients = blocks.astype(np.float32)
    coefficients[blocks < 128] -= 255
    pixels = np.clip(np.floor(coefficients @ basis / SCALE + 128.5), 0, 255).astype(np.int64)
    frame = np.arange(len(blocks))[:, None] // PER_FRAME
    n = -(-len(blocks) // PER_FRAME)
    return np.bincount((frame * BINS + pixels * BINS // 256).ravel(), minlength=n * BINS).reshape(n, BINS)


def shots(counts: np.ndarray, reach: int = 4, factor: float = 1.5, floor: float = 0.05) -> list[int]:
    """First frames of the shots: a cut is where the histogram difference exceeds the mean of its neighbourhood by `factor`
    standard deviations and is above `floor`."""
    share = counts / counts.sum(1, keepdims=True)
    diff = np.abs(np.diff(share, axis=0)).sum(1) / 2
    n = len(diff)
    if not n:
        return [0]
    sums, squares = np.append(0, np.cumsum(diff)), np.append(0, np.cumsum(diff * diff))
    lo, hi = np.maximum(np.arange(n) - reach, 0), np.minimum(np.arange(n) + reach + 1, n)
    mean = (sums[hi] - sums[lo]) / (hi - lo)
    spread = np.sqrt(np.maximum((squares[hi] - squares[lo]) / (hi - lo) - mean * mean, 0))
    return [0, *(np.flatnonzero((diff > mean + factor * spread) & (diff > floor)) + 1).tolist()]


def _writing(key: str):
    """From batches (key, text) to batches (key, n_bytes, media), in steps of bounded bytes."""

    def write(batches):
        for batch in batches:
            for rows, texts in text_steps(batch, "text"):
                at, data = buffers(texts)
                raw = data.tobytes()
                media = [encode_avi(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(np.diff(at)), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return write


def _texts(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long"), F.col(column).cast("string").alias("text"))


def to_avi(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes as an AVI file; a null text counts as empty."""
    return _texts(df, column, key).mapInArrow(_writing(key), f"{key} long, n_bytes long, media binary")


def through_avi(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """read_avi of to_avi, with each step's files read back in the task that wrote them."""
    write, (read, schema) = _writing(key), _reading(key)
    return _texts(df, column, key).mapInArrow(lambda batches: read(write(batches)), schema)


#: What reading a damaged file raises.
DAMAGED = (ValueError, IndexError, KeyError, struct.error)


def read_avi(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of (key, n_bytes, media): what the files hold and the clips found in them, as
    (key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, frames, clips array<struct<start_s, end_s>>).

    A file of another encoder has frames and clips, but no payload. A null or damaged one has no frames and no clips (frames 0), a null one no size and digest either.
    Progressive frames count as damaged."""
    return df.mapInArrow(*_reading(key))


def _reading(key: str):
    """(from batches (key, n_bytes, media) to those of read_avi, their schema)."""
    schema = f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, clips array<struct<start_s: double, end_s: double>>"
    clip = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), clip]
    names = [x.split()[0] for x in re.split(r", (?![^<]*>)", schema)]

    def read(batches):
        basis = _basis()
        for batch in batches:
            rows = []
            for key_, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                media = media.as_py()
                payload, counts, step = _contents(media, basis)
                frames = len(counts)
                times = [round(x * step / 1e6, 6) for x in [*shots(counts), frames]] if frames else []
                clips = [{"start_s": a, "end_s": b} for a, b in zip(times, times[1:], strict=False)]
                held = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) if payload else (None, None, None)
                whole = (len(media), hashlib.sha256(media).hexdigest()) if media is not None else (None, None)
                rows.append((key_, n, *held, *whole, frames, clips))
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return read, schema


def _contents(media: bytes | None, basis: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """(payload, histograms by frame, microseconds a frame)."""
    none = np.zeros((0, BINS), np.int64)
    if media is None:
        return b"", none, 0
    try:
        payload, _, step = decode_avi(media)
        return payload, histograms(np.frombuffer(payload, np.uint8), basis), step
    except DAMAGED:
        pass  # not of the profile written here
    try:
        return b"", *luminance_histograms(media)
    except DAMAGED:
        return b"", none, 0


def clip_rows(read: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each clip: (key, clip, start_s, end_s)."""
    return read.select(key, F.posexplode("clips").alias("clip", "at")).select(key, "clip", "at.start_s", "at.end_s")


def op8_media(spark, sf_dir):
    """Every text of documents through an AVI file and back.

    Null and empty texts give one block of zeros; equal texts give equal values; repeated rows and rows without a doc_id stay; a very long text is one file. An empty table gives
    no rows; columns other than doc_id and text are not read. Cuts that tie in their difference are each a cut.
    """
    feature = F.concat(
        F.lit("frames="), F.col("frames"), F.lit(";clips="),
        F.concat_ws(",", F.transform("clips", lambda c: F.concat(F.format_string("%.2f", c["start_s"]), F.lit("-"), F.format_string("%.2f", c["end_s"])))),
    )
    read = through_avi(documents(spark, sf_dir))
    return read.withColumn("feature", feature).drop("clips", "frames")


QUERIES = {"op8_media": op8_media}
