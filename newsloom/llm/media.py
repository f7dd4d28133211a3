"""Media columns: motion-JPEG in AVI containers.

A payload of bytes is stored losslessly as 8-bit grey samples. Each sample is the value of one
8 x 8 block of a baseline JPEG frame, whose only coefficient then is its first: with that
quantised by 8 it decodes to the sample exactly. Reading parses the RIFF chunks and the index,
decodes the intra frames and cuts them into shots where the difference of neighbouring
histograms stands out from those just before.

The writer's Huffman codes are as much shorter as a difference has more bits, so that each block
takes 16 bits and no byte is 255; the reader decodes such frames in bulk and any other baseline
grey frame symbol by symbol.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, narrow, read

#: Samples of a frame (8 x 8 blocks), frames a second, bins of a histogram.
FRAME, RATE, BINS = 64, 25, 16
#: Differences before a cut that it is measured against, standard deviations above them, least.
BEFORE, ABOVE, FLOOR = 8, 2.0, 0.25
#: Places of the coefficients in their order: diagonals, upwards and downwards in turn.
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))


def canonical(lengths: list[int], values: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> value of a JPEG Huffman table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(lengths, 1):
        for value in values[at : at + n]:
            out[length, code] = value
            code += 1
        at, code = at + n, code << 1
    return out


#: A difference of c bits has a code of 10 - c bits; the end of a block has 6 zeros.
FIRST = ([0, *[1] * 9, *[0] * 6], bytes(range(8, -1, -1)))
REST = ([*[0] * 5, 1, *[0] * 10], b"\0")


@lru_cache(maxsize=1)
def words() -> np.ndarray:
    """The 16 bits of a block by its difference plus 255."""
    codes = {value: code for (_, code), value in canonical(*FIRST).items()}
    out = []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        out.append((codes[size] << size | (d if d > 0 else d + (1 << size) - 1)) << 6)
    return np.array(out, ">u2")


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=1)
def frame_head() -> bytes:
    """A frame's bytes before its blocks."""
    return (
        b"\xff\xd8"
        + segment(0xDB, b"\0" + bytes([8, *[1] * 63]))
        + segment(0xC0, struct.pack(">BHHB", 8, 64, 64, 1) + b"\x01\x11\x00")
        + segment(0xC4, b"\x00" + bytes(FIRST[0]) + FIRST[1])
        + segment(0xC4, b"\x10" + bytes(REST[0]) + REST[1])
        + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def padded(payload: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of a frame's samples."""
    return payload + bytes(-len(payload) % FRAME if payload else FRAME)


def encode(payload: bytes) -> bytes:
    """The AVI file of a payload whose size is a positive multiple of 64 (a RIFF file has room
    for about 900 MB of it)."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME).astype(np.int16)
    n = len(samples)
    steps = np.diff(samples, axis=1, prepend=np.int16(128))
    head, tail = frame_head(), b"\xff\xd9"
    size = len(head) + 2 * FRAME + len(tail)
    lead = b"00dc" + struct.pack("<I", size) + head
    frames = np.empty((n, len(lead) + 2 * FRAME + len(tail) + size % 2), np.uint8)
    frames[:] = np.frombuffer(lead + bytes(2 * FRAME) + tail + bytes(size % 2), np.uint8)
    frames[:, len(lead) : len(lead) + 2 * FRAME] = words()[steps + 255].view(np.uint8)
    whole = frames.shape[1]
    index = np.empty((n, 4), "<u4")
    index[:] = (int.from_bytes(b"00dc", "little"), 0x10, 0, size)
    index[:, 2] = 4 + whole * np.arange(n)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, size, 0, 0, 0, 0, 64, 64)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, 64, 64, 1, 8, b"MJPG", 4096, 0, 0, 0, 0)
    main = struct.pack("<14I", 1_000_000 // RATE, size * RATE, 0, 0x10, n, 0, 1, size, 64, 64, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", bitmap)))
    body = header + chunk(b"LIST", b"movi" + frames.tobytes()) + chunk(b"idx1", index.tobytes())
    return chunk(b"RIFF", b"AVI " + body)


def chunks(data: bytes, at: int, end: int):
    """(name, where its body begins, its size) of the chunks in a range."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def frame_places(data: bytes) -> np.ndarray:
    """(begin, size) of the video frames that the index names."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movie, index = None, np.empty((0, 4), "<u4")
    for name, at, size in chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        if name == b"LIST" and data[at : at + 4] == b"movi":
            movie = at
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", size // 16 * 4, at).reshape(-1, 4)
    kinds = np.ascontiguousarray(index[:, 0]).view("S4")
    index = index[np.char.endswith(kinds, b"dc") | np.char.endswith(kinds, b"db")].astype(np.int64)
    return np.stack([index[:, 2] + movie + 8, index[:, 3]], 1) if movie is not None else np.empty((0, 2), np.int64)


@dataclass
class Frame:
    """The parsed segments of a baseline grey JPEG."""

    width: int
    height: int
    quants: dict
    tables: dict
    tables_of_scan: tuple[int, int]
    quant: int
    restart: int
    begin: int


def parse(jpeg: bytes) -> Frame:
    quants, tables, at, restart = {}, {}, 2, 0
    while True:
        marker, size = struct.unpack_from(">xBH", jpeg, at)
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                lengths = list(body[1:17])
                n = sum(lengths)
                tables[body[0]] = canonical(lengths, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            precision, height, width, parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("only 8-bit grey frames are read")
            quant = body[8]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            return Frame(width, height, quants, tables, (body[2] >> 4, 16 | body[2] & 15), quant, restart, at)
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline frames are read")


def cosines() -> np.ndarray:
    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    return np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)


def decode(jpeg: bytes) -> np.ndarray:
    """The pixels of a baseline grey frame, symbol by symbol."""
    f = parse(jpeg)
    data = jpeg[f.begin : jpeg.rindex(b"\xff\xd9")]
    parts = [p.replace(b"\xff\x00", b"\xff") for p in _between_restarts(data)]
    across, down = -(-f.width // 8), -(-f.height // 8)
    out, basis, k = np.zeros((down * 8, across * 8)), cosines(), 0
    for part in parts:
        bits, at, last = int.from_bytes(part, "big"), 0, 0
        total = 8 * len(part)

        def take(n, bits=bits, total=total):
            nonlocal at
            at += n
            return bits >> total - at & (1 << n) - 1 if n else 0

        def symbol(table):
            code = 0
            for length in range(1, 17):
                code = code << 1 | take(1)
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("a code that the table doesn't have")

        for _ in range(f.restart or across * down):
            if k == across * down:
                break
            z = np.zeros(64)
            size = symbol(f.tables[f.tables_of_scan[0]])
            last += _signed(take(size), size)
            z[0], i = last, 1
            while i < 64:
                run, size = divmod(symbol(f.tables[f.tables_of_scan[1]]), 16)
                if not size and run < 15:
                    break
                i += run
                z[i] = _signed(take(size), size)
                i += 1
            block = np.zeros(64)
            block[ZIGZAG] = z * f.quants[f.quant]
            y, x = divmod(k, across)
            out[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = basis @ block.reshape(8, 8) @ basis.T
            k += 1
    return np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)[: f.height, : f.width]


def _between_restarts(data: bytes) -> list[bytes]:
    parts, begin, at = [], 0, data.find(b"\xff")
    while at >= 0:
        if at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[begin:at])
            begin = at + 2
        at = data.find(b"\xff", at + 2)
    return [*parts, data[begin:]]


def _signed(value: int, size: int) -> int:
    return value if not size or value >> size - 1 else value - (1 << size) + 1


@lru_cache(maxsize=1)
def steps_by_word() -> np.ndarray:
    out = np.full(1024, 999, np.int16)
    out[words() >> 6] = np.arange(-255, 256)
    return out


def samples(data: bytes) -> np.ndarray:
    """A row of samples for each frame of an AVI file (the mean of each block of 8 x 8 pixels)."""
    places = frame_places(data)
    head = frame_head()
    size = len(head) + 2 * FRAME + 2
    if len(places) and (places[:, 1] == size).all() and places[:, 0].max() + size <= len(data):
        stored = np.frombuffer(data, np.uint8)
        step = int(places[1, 0] - places[0, 0]) if len(places) > 1 else size
        if (np.diff(places[:, 0]) == step).all() and step >= size:
            shape, strides = (len(places), size), (step, 1)
            frames = np.lib.stride_tricks.as_strided(stored[int(places[0, 0]) :], shape, strides, writeable=False)
        else:
            frames = stored[places[:, :1] + np.arange(size)]
        if (frames[:, : len(head)] == np.frombuffer(head, np.uint8)).all():
            coded = np.ascontiguousarray(frames[:, len(head) : -2]).view(">u2")
            found = steps_by_word()[coded >> 6]
            if not (coded & 63).any() and not (found == 999).any():
                return (np.cumsum(found, axis=1, dtype=np.int32) + 128).astype(np.uint8)
    rows = []
    for at, n in places.tolist():
        pixels = decode(data[at : at + n])
        h, w = pixels.shape[0] // 8, pixels.shape[1] // 8
        means = pixels[: 8 * h, : 8 * w].reshape(h, 8, w, 8).mean(axis=(1, 3))
        rows.append(np.rint(means).astype(np.uint8).ravel())
    return np.stack(rows) if rows else np.empty((0, FRAME), np.uint8)


def cuts(frames: np.ndarray) -> list[int]:
    """Frames that begin a new shot: their histogram differs from the one before by more than
    the differences just before do, their mean plus ABOVE standard deviations, and by FLOOR."""
    n = len(frames)
    if n < 2:
        return []
    bins = (np.arange(n)[:, None] * BINS + (frames >> 4)).ravel()
    counts = np.bincount(bins, minlength=n * BINS).reshape(n, BINS)
    d = np.abs(np.diff(counts, axis=0)).sum(axis=1) / (2 * frames.shape[1])
    sums, squares = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    at = np.arange(len(d))
    begin = np.maximum(at - BEFORE, 0)
    m = np.maximum(at - begin, 1)
    mean = (sums[at] - sums[begin]) / m
    spread = np.sqrt(np.maximum((squares[at] - squares[begin]) / m - mean * mean, 0))
    return (np.flatnonzero(d > np.maximum(mean + ABOVE * spread, FLOOR) + 1e-9) + 1).tolist()


def _rows(df: DataFrame, id: str, text: str, schema: str, names: list[str], give) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch):
            found = [(i, *x) for i, t in enumerate(batch.column("text").to_pylist()) for x in give((t or "").encode())]
            columns = list(zip(*found, strict=True)) or [()] * (len(names) + 1)
            arrays = [pa.array(c) if c else pa.nulls(0) for c in columns[1:]]
            ids = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", *names])

        return step

    rows = narrow(df, doc_id=id, text=text)
    return arrow_map(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}", rows=256)


def store(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, media``: each text's payload as an AVI file. Null texts count as empty; null ids
    stay null; equal texts have equal files, repeated rows each theirs; an empty table gives none.
    A RIFF file's sizes have 32 bits: a text of more than about 900 MB raises an error. Other
    columns, whatever their names, are not read."""
    return _rows(df, id, text, "media binary", ["media"], lambda raw: [(encode(padded(raw)),)])


def clips(df: DataFrame, id: str = "doc_id", media: str = "media") -> DataFrame:
    """``doc_id, clip, begin_s, end_s, frames, level``: the timed shots of each AVI file, with
    their mean sample. A null file has none."""

    def make():
        def step(batch: pa.RecordBatch):
            ids, rows = [], []
            for i, data in enumerate(batch.column("media").to_pylist()):
                frames = samples(data) if data is not None else np.empty((0, FRAME), np.uint8)
                marks = [0, *cuts(frames), len(frames)] if len(frames) else []
                for k, (a, b) in enumerate(zip(marks, marks[1:], strict=False)):
                    ids.append(i)
                    rows.append((k, a / RATE, b / RATE, b - a, float(frames[a:b].mean())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(ids, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                names=["doc_id", "clip", "begin_s", "end_s", "frames", "level"],
            )

        return step

    rows = narrow(df, doc_id=id, media=media)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, make, f"doc_id {kind}, clip int, begin_s double, end_s double, frames long, level double", rows=64)


def described(raw: bytes) -> tuple:
    """Sizes and digests of a text's bytes, of what is stored, and of what is read back: the
    payload's size and digest, the CRC of its last 64 bytes, and its frames, shots, cuts and mean
    sample. An empty text is one frame of zeros; equal texts give equal values."""
    stored = encode(padded(raw))
    frames = samples(stored)
    back = frames.tobytes()
    marks = cuts(frames)
    feature = f"frames={len(frames)};shots={len(marks) + 1};cuts={','.join(map(str, marks))};level={frames.mean():.3f}"
    return (
        len(raw), len(back), sha256(back).hexdigest(), crc32(back[-64:]), len(stored), sha256(stored).hexdigest(), feature
    )


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored as motion-JPEG, read back and cut into shots; nulls, repeated rows
    and an empty table as :func:`store` has them."""
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]
    return _rows(read(spark, sf_dir, "documents"), "doc_id", "text", schema, names, lambda raw: [described(raw)])
