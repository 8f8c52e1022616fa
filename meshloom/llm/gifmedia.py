"""Media columns: GIF.

Writing: bytes become 24 x 24 frames of indices into a palette of 256 different colours, one frame per FRAME
bytes.  Each frame is LZW-compressed with a growing dictionary.  A frame that repeats half or more of the
canvas before it is stored as the band of rows that differ, with the transparent index where it repeats
(byte 192, which UTF-8 never has); frames leave the canvas as it is (disposal 1).

Reading is general: blocks and extensions are parsed, LZW codes decoded with their dictionaries, interlaced rows put back, local and global palettes applied, and frames composed under
their disposal method and transparent colour.  Samples and colour histograms come from the frames as shown.

Defined results: null text is empty; every payload has one frame at least (padding fills it);
ids may be null or repeat; a damaged image raises an error; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE = 24
FRAME = SIDE * SIDE
DELAY = 4  # hundredths of a second
#: Bins of the colour histogram: four levels each of red, green and blue.
BINS = 64
CLEAR_INDEX = 192
_SLOTS = 1024
#: Bytes of samples that are compressed or decoded at once.
CHUNK = 1 << 20

_I = np.arange(256, dtype=np.uint32)
#: Colours as 0xRRGGBB; the writer's palette has three bits of the index in red, three in green, two in blue.
PALETTE = (_I & 0xE0) << 16 | (_I << 3 & 0xE0) << 8 | (_I << 6 & 0xC0)


def samples(shown: np.ndarray) -> np.ndarray:
    """The indices that have the writer's colours."""
    return ((shown >> 16 & 0xE0) | (shown >> 11 & 0x1C) | (shown >> 6 & 0x03)).astype(np.uint8)


def lzw_streams(rows: list[bytes]) -> list[bytes]:
    """LZW code streams of rows of eight-bit symbols, all rows in step.  Rows have up to FRAME symbols, so no
    dictionary fills up: each is an open-addressing table of _SLOTS slots."""
    n = len(rows)
    size = np.array([len(x) for x in rows])
    order = np.argsort(-size, kind="stable")  # longest first, so the rows that go on are the first ones
    size = size[order]
    pixels = np.zeros((n, int(size[0])), np.int32)
    pixels[np.arange(pixels.shape[1]) < size[:, None]] = np.frombuffer(b"".join(rows[k] for k in order.tolist()), np.uint8)
    pixels = np.ascontiguousarray(pixels.T)
    going = np.searchsorted(-size, -np.arange(pixels.shape[0]), "left")  # rows with a symbol at each place
    keys, values = np.zeros(n * _SLOTS, np.int32), np.zeros(n * _SLOTS, np.int16)
    table = np.arange(n) * _SLOTS
    codes = np.zeros(n * (pixels.shape[0] + 3), np.uint16)
    line = np.arange(n) * (pixels.shape[0] + 3)
    codes[line] = 256
    made = np.ones(n, np.int64)
    word = pixels[0].copy()
    for t in range(1, pixels.shape[0]):
        m = int(going[t])
        symbol = pixels[t, :m]
        key = (word[:m] << 8 | symbol) + 1
        at = table[:m] + ((key * np.int32(40503) >> 5) & (_SLOTS - 1))
        have = keys[at]
        new = have == 0
        off = np.flatnonzero((have != key) & ~new)
        while len(off):
            at[off] = table[off] + ((at[off] + 1) & (_SLOTS - 1))
            have[off] = keys[at[off]]
            off = off[(have[off] != key[off]) & (have[off] != 0)]
        miss = np.flatnonzero(have == 0)
        longer = values[at]
        # Rows that know no such string put out the code of the last one they had.
        k, spot, count = key[miss], at[miss], made[miss]
        keys[spot], values[spot] = k, 257 + count
        codes[line[miss] + count] = (k - 1) >> 8
        made[miss] = count + 1
        longer = longer.astype(np.int32)
        longer[miss] = symbol[miss]
        word[:m] = longer
    codes[line + made], codes[line + made + 1] = word, 257
    codes, size = codes.reshape(n, -1)[:, : int(made.max()) + 2], made + 2
    # The code at place i is read with 256 + i strings known; it has one bit more from each power of two on.
    place = np.arange(codes.shape[1])
    bits = np.floor(np.log2(256 + place)).astype(int) + 1
    ends = np.cumsum(bits)
    code_of = np.repeat(place, bits)
    bit_of = (np.arange(ends[-1]) - (ends - bits)[code_of]).astype(np.uint16)
    packed = np.packbits(((codes[:, code_of] >> bit_of) & 1).astype(np.uint8), axis=1, bitorder="little")
    out: list[bytes] = [b""] * n
    for to, x, k in zip(order.tolist(), packed, (-(-ends[size - 1] // 8)).tolist(), strict=True):
        out[to] = x[:k].tobytes()
    return out


def write_gifs(payloads: list[np.ndarray]) -> list[bytes]:
    """GIFs whose frames' samples, in order, are the payloads (each a multiple of FRAME bytes)."""
    counts = [len(x) // FRAME for x in payloads]
    owner = np.repeat(np.arange(len(payloads)), counts)
    frames = np.concatenate(payloads).reshape(-1, FRAME)
    same = np.zeros(frames.shape, bool)
    same[1:] = (frames[1:] == frames[:-1]) & (owner[1:] == owner[:-1])[:, None]
    part = same.mean(axis=1) >= 0.5
    new = (~same).reshape(-1, SIDE, SIDE).any(axis=2)  # rows that differ from the canvas
    top = np.where(part & new.any(axis=1), new.argmax(axis=1), 0)
    end = np.where(part, np.where(new.any(axis=1), SIDE - new[:, ::-1].argmax(axis=1), 1), SIDE)
    stored = np.where(same & part[:, None], np.uint8(CLEAR_INDEX), frames)
    column = np.arange(FRAME)
    stored = np.take_along_axis(stored, np.minimum(column + (top * SIDE)[:, None], FRAME - 1), axis=1)
    size = (end - top) * SIDE
    rows = [x[:k].tobytes() for x, k in zip(stored, size.tolist(), strict=True)]
    streams = [x for k in range(0, len(rows), CHUNK // FRAME) for x in lzw_streams(rows[k : k + CHUNK // FRAME])]
    colours = PALETTE.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()
    start = b"GIF89a" + bytes([SIDE, 0, SIDE, 0, 0xF7, 0, 0]) + colours + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    out, k = [], 0
    for count in counts:
        image = [start]
        for clear, a, z, stream in zip(part[k : k + count].tolist(), top[k : k + count].tolist(), end[k : k + count].tolist(), streams[k : k + count], strict=True):
            image.append(bytes([0x21, 0xF9, 4, 4 | clear, DELAY, 0, CLEAR_INDEX if clear else 0, 0, 0x2C, 0, 0, a, 0, SIDE, 0, z - a, 0, 0, 8]))
            for s in range(0, len(stream), 255):
                block = stream[s : s + 255]
                image += [bytes([len(block)]), block]
            image.append(b"\0")
        out.append(b"".join([*image, b"\x3b"]))
        k += count
    return out


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    interlaced: bool
    palette: np.ndarray
    min_code: int
    stream: bytes
    indices: np.ndarray | None = None


@dataclass
class Image:
    width: int
    height: int
    background: int
    palette: np.ndarray | None
    frames: list[Frame]


def parse_gif(raw: bytes) -> Image:
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height = int.from_bytes(raw[6:8], "little"), int.from_bytes(raw[8:10], "little")
    flags, at, palette = raw[10], 13, None

    def table(flags: int, at: int) -> tuple[np.ndarray, int]:
        size = 3 * (2 << (flags & 7))
        rgb = np.frombuffer(raw, np.uint8, size, at).reshape(-1, 3).astype(np.uint32)
        return rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2], at + size

    if flags & 0x80:
        palette, at = table(flags, at)
    image = Image(width, height, raw[11], palette, [])
    delay = disposal = 0
    clear = None
    while True:
        kind = raw[at]
        if kind == 0x3B:
            return image
        if kind == 0x21:
            if raw[at + 1] == 0xF9:
                f = raw[at + 3]
                delay, disposal, clear = int.from_bytes(raw[at + 4 : at + 6], "little"), f >> 2 & 7, raw[at + 6] if f & 1 else None
            at += 2
            while size := raw[at]:
                at += size + 1
            at += 1
        elif kind == 0x2C:
            left, top, w, h = (int.from_bytes(raw[k : k + 2], "little") for k in range(at + 1, at + 9, 2))
            f, at, own = raw[at + 9], at + 10, palette
            if f & 0x80:
                own, at = table(f, at)
            if own is None:
                raise ValueError("no palette")
            code, at, parts = raw[at], at + 1, []
            while size := raw[at]:
                parts.append(raw[at + 1 : at + 1 + size])
                at += size + 1
            at += 1
            image.frames.append(Frame(left, top, w, h, delay, disposal, clear, bool(f & 0x40), own, code, b"".join(parts)))
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError(f"unknown block {kind:#x}")


def _windows(streams: list[bytes]) -> list[np.ndarray]:
    """The 24 bits from each byte on, of each stream."""
    raw = np.frombuffer(b"".join([*streams, b"\0\0"]), np.uint8).astype(np.int32)
    window = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    ends = np.cumsum([len(x) for x in streams]).tolist()
    return [window[e - len(x) : e] for x, e in zip(streams, ends, strict=True)]


_STEPS = {width: width * np.arange(4097) for width in range(2, 13)}


def lzw(window: np.ndarray, min_code: int, pixels: int) -> np.ndarray:
    """Indices of any LZW code stream, given as its windows.

    String k of the dictionary is what code k since the last clear put out and one index more, so the
    dictionary is the list of the codes' places in the output.  Codes of one width are cut out of the stream together."""
    clear = 1 << min_code
    first = clear + 2
    bit, end = 0, 8 * len(window)
    out, n, at, width = bytearray(), 0, [], min_code + 1
    put = out.append
    if end and window[0] & (2 * clear - 1) == clear:
        bit = width
    while n < pixels:
        left = (1 << width) - first - len(at) + 1 if width < 12 else 4096  # codes until they get a bit more
        place = _STEPS[width][: min(left, (end - bit) // width)] + bit
        codes = window[place >> 3] >> (place & 7) & ((1 << width) - 1)
        special = np.flatnonzero(codes | 1 == clear + 1)
        some = codes[: special[0]] if len(special) else codes
        try:
            for code in some.tolist():
                at.append(n)
                if code < clear:
                    put(code)
                    n += 1
                else:
                    a, z = at[code - first], at[code - first + 1] + 1
                    if z <= n:
                        out += out[a:z]
                    else:  # the string that this code itself completes
                        out += out[a:n]
                        put(out[a])
                    n += z - a
        except IndexError:
            raise ValueError("damaged code stream") from None
        if len(special):
            if codes[special[0]] != clear:
                break
            bit += width * (int(special[0]) + 1)
            at, width = [], min_code + 1
        elif len(codes) < left:
            break
        else:
            bit += width * left
            width = min(12, width + 1)
    if n < pixels:
        raise ValueError("code stream ends early")
    return np.frombuffer(out, np.uint8)[:pixels]


def decode_frames(image: Image) -> None:
    """Fills in every frame's indices, rows in order."""
    for f, window in zip(image.frames, _windows([f.stream for f in image.frames]), strict=True):
        rows = lzw(window, f.min_code, f.width * f.height).reshape(f.height, f.width)
        if f.interlaced:
            order = np.concatenate([np.arange(s, f.height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            back = np.empty_like(rows)
            back[order] = rows
            rows = back
        f.indices = rows


def compose(image: Image) -> Iterator[np.ndarray]:
    """The canvas as shown with each frame: height x width colours 0xRRGGBB."""
    canvas = np.zeros((image.height, image.width), np.uint32)
    if image.palette is not None and image.background < len(image.palette):
        canvas[:] = image.palette[image.background]
    blank = canvas.copy()
    for f in image.frames:
        before = canvas.copy() if f.disposal == 3 else None
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        seen = f.indices[: area.shape[0], : area.shape[1]]
        colour = f.palette.take(seen, mode="clip")
        if f.transparent is None:
            area[:] = colour
        else:
            np.copyto(area, colour, where=seen != f.transparent)
        yield canvas.copy()
        if f.disposal == 2:
            area[:] = blank[f.top : f.top + f.height, f.left : f.left + f.width]
        elif f.disposal == 3:
            canvas = before


@dataclass
class Shown:
    """The frames of an image as shown: colours, start and duration in hundredths of a second, histogram."""

    colours: np.ndarray
    start: np.ndarray
    delay: np.ndarray
    histogram: np.ndarray


def shown_frames(image: Image) -> Shown:
    """Of a decoded image; histograms count the shown pixels by BINS joint ranges of red, green and blue."""
    colours = np.array(list(compose(image)), np.uint32).reshape(len(image.frames), image.height, image.width)
    delay = np.array([f.delay for f in image.frames], np.int64)
    level = (colours >> 18 & 0x30) | (colours >> 12 & 0x0C) | (colours >> 6 & 0x03)
    level = level.reshape(len(colours), -1) + BINS * np.arange(len(colours), dtype=np.uint32)[:, None]
    histogram = np.bincount(level.ravel(), minlength=BINS * len(colours)).reshape(-1, BINS)
    return Shown(colours, np.cumsum(delay) - delay, delay, histogram)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, filled with 255 to whole frames, as a GIF."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, payloads, held = [], [], [], 0

            def out() -> pa.RecordBatch:
                own = batch.column(0).take(pa.array(rows, pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays([own, pa.array(sizes, pa.int64()), pa.array(write_gifs(payloads), pa.binary())], [id_col, "n_bytes", "media"])  # noqa: B023

            for k, text in enumerate(batch.column(1)):
                raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                payload = np.full(max(1, -(-len(raw) // FRAME)) * FRAME, 255, np.uint8)
                payload[: len(raw)] = raw
                rows.append(k)
                sizes.append(len(raw))
                payloads.append(payload)
                held += len(payload)
                if held > CHUNK:
                    yield out()
                    rows, sizes, payloads, held = [], [], [], 0
            if rows:
                yield out()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def _images(column: pa.Array) -> Iterator[tuple[int, bytes, Image]]:
    """(row, stored bytes, decoded image) of each cell that isn't null."""
    for k, cell in enumerate(column):
        if cell.is_valid:
            raw = cell.as_buffer().to_pybytes()
            image = parse_gif(raw)
            decode_frames(image)
            yield k, raw, image


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of rows (id, n_bytes, media): digests of the samples as shown and of the media, and the feature: frames,
    hundredths of a second shown, and the colour histogram over all frames."""
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], [[] for _ in kinds]
            for k, raw, image in _images(batch.column(2)):
                shown = shown_frames(image)
                payload = samples(shown.colours).tobytes()
                feature = f"{len(shown.delay)} {int(shown.delay.sum())} " + ",".join(map(str, shown.histogram.sum(axis=0).tolist()))
                rows.append(k)
                for to, x in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature), strict=True):
                    to.append(x)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], names)

    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def frames(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of rows (id, media): a row per frame: (id, frame, start_cs, delay_cs, width, height, rgb, histogram),
    rgb the composed canvas and histogram its colour counts; null media give no rows."""
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "frame", "start_cs", "delay_cs", "width", "height", "rgb", "histogram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, _, image in _images(batch.column(1)):
                shown, n = shown_frames(image), len(image.frames)
                rgb = shown.colours.astype(">u4").view(np.uint8).reshape(n, -1, 4)[:, :, 1:].reshape(n, -1)
                own = batch.column(0).take(pa.array([k] * n, pa.int64()))
                size = [pa.array([x] * n, pa.int32()) for x in (image.width, image.height)]
                yield pa.RecordBatch.from_arrays([own, pa.array(range(n), pa.int32()), pa.array(shown.start), pa.array(shown.delay, pa.int32()), *size, pa.array([x.tobytes() for x in rgb], pa.binary()), pa.array(shown.histogram.tolist(), pa.list_(pa.int64()))], names)

    return media.select(id_col, "media").mapInArrow(run, f"`{id_col}` {kind}, frame int, start_cs long, delay_cs int, width int, height int, rgb binary, histogram array<long>")
