"""Media columns: GIF streams decoded to timed frames with colour histograms, and bytes stored as GIF.

Decoding follows the GIF89a layout: blocks, LZW code streams, global and local palettes, interlacing,
transparency and the disposal rules (leave, clear to background, restore the one before). LZW is decoded
with array operations: the width of the k-th code after a clear code depends on k alone, so a stretch
between clear codes is cut into codes at once; a code's output is a copy of earlier output, one byte
longer than the code it extends; lengths and sources are then resolved by pointer doubling.

Storing puts bytes as 8-bit samples into frames of ``WIDTH`` times up to ``ROWS`` samples, compressed by LZW. The
shared palette has 8 levels of red and green and 4 of blue; every other frame has its own, in reverse order. Disposal goes
through leave, clear and restore, and from the second frame on sample 0 is transparent. None of that touches the
samples: reading them back gives the bytes again.

Cases: null and empty texts are stored as 64 zero samples. Equal bytes give equal files. Broken or
truncated streams raise ``ValueError`` in ``decode``; the frame table gives no row for a null or broken
file but one with ``error`` set. Long texts become many frames, handled one after the other. Null ids
and repeated rows stay; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

WIDTH = 64
ROWS = 256
DELAY = 4  # hundredths of a second
CLEAR, END = 256, 257
_FULL = 4096

_COLOURS = bytes(v for i in range(256) for v in (i & 0xE0, i << 3 & 0xE0, i << 6 & 0xC0))
_REVERSED = bytes(v for i in reversed(range(256)) for v in _COLOURS[3 * i : 3 * i + 3])


def _widths(n: int, small: int) -> np.ndarray:
    """Bits of the k-th code after a clear code, if codes below ``small`` + 2 are given."""
    size = small + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(12, np.floor(np.log2(size)).astype(np.int64) + 1)


_W8 = _widths(_FULL, 256)


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples: a clear code first, one whenever the table is nearly full, and the end code."""
    codes: list[int] = []
    lengths: list[int] = []
    emit = codes.append
    table: dict[int, int] = {}
    get = table.get
    after, begun = 258, 0
    it = iter(data)
    now = next(it)
    for b in it:
        key = now << 8 | b
        code = get(key)
        if code is not None:
            now = code
        else:
            emit(now)
            table[key] = after
            now = b
            after += 1
            if after == 4095:
                emit(CLEAR)
                lengths.append(len(codes) - begun)
                begun = len(codes)
                table.clear()
                after = 258
    emit(now)
    emit(END)
    lengths.append(len(codes) - begun)
    width = np.concatenate([[9], *(_W8[:n] for n in lengths)])
    value = np.array([CLEAR, *codes], np.int64)
    at = np.cumsum(width) - width
    shifted = value << (at & 7)
    byte, n = at >> 3, int((at[-1] + width[-1] + 7) >> 3)
    out = sum(np.bincount(byte + i, weights=(shifted >> (8 * i)) & 255, minlength=n + 3) for i in range(3))
    return out[:n].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, bits: int, expected: int) -> np.ndarray:
    """The samples of a code stream with ``bits`` bits a sample; ``expected`` samples at most."""
    clear = 1 << bits
    raw = np.concatenate((np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8))).astype(np.int64)
    total = 8 * len(stream)
    parts: list[np.ndarray] = []
    base = got = 0
    while got < expected and base < total:
        window = _FULL
        while True:
            width = _W8[:window] if bits == 8 and window <= _FULL else _widths(window, clear)
            at = base + np.cumsum(width) - width
            fits = int(np.searchsorted(at + width, total, "right"))
            at, width = at[:fits], width[:fits]
            byte = at >> 3
            codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7)) & ((1 << width) - 1)
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stops) or fits < window:
                break
            window *= 2
        last = int(stops[0]) if len(stops) else fits
        if last:
            parts.append(_stretch(codes[:last], clear))
            got += len(parts[-1])
        if not len(stops) or codes[last] == clear + 1:
            break
        base = int(at[last] + width[last])
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return out[:expected]


def _stretch(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of the codes between two clear codes."""
    n = len(codes)
    literal = codes < clear
    of = np.where(literal, -1, codes - clear - 2)
    if np.any(of >= np.arange(n)):
        raise ValueError("an LZW code before its entry")
    length = np.ones(n, np.int64)
    up = of.copy()
    while True:  # a code's length is one and that of the code it extends
        far = np.flatnonzero(up >= 0)
        if not len(far):
            break
        to = up[far]
        add, nxt = length[to], up[to]
        length[far] += add
        up[far] = nxt
    start = np.cumsum(length) - length
    size = int(start[-1] + length[-1])
    first = np.where(literal, start, start[np.maximum(of, 0)])
    place = np.arange(size)
    source = place + np.repeat(first - start, length)
    value = np.zeros(size, np.uint8)
    value[start[literal]] = codes[literal]
    while True:  # follow copies of copies down to literals
        nxt = source[source]
        if np.array_equal(nxt, source):
            return value[source]
        source = nxt


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def store(payload: bytes) -> bytes:
    """A GIF whose frames' samples are ``payload``, which has a positive multiple of WIDTH bytes."""
    frame = WIDTH * ROWS
    height = min(ROWS, len(payload) // WIDTH)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), _COLOURS]
    for k, i in enumerate(range(0, len(payload), frame)):
        part = payload[i : i + frame]
        own = k % 2
        out += [b"\x21\xf9\x04", struct.pack("<BHB", (1 + k % 3) << 2 | (k > 0), DELAY, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0x87 if own else 0), _REVERSED if own else b"", b"\x08", _blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    index: int
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int  # -1: none
    samples: np.ndarray
    canvas: np.ndarray  # height x width x RGB, as it is shown


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, one after the other, composed on the canvas. ``canvas`` is valid until the next frame."""
    try:
        yield from _decode(data)
    except (struct.error, IndexError) as e:
        raise ValueError("a truncated GIF") from e


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, packed, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    shared = None
    if packed & 0x80:
        n = 2 << (packed & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 3), np.uint8)
    delay, disposal, transparent, index = 0, 0, -1, 0
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            if data[at] == 0xF9:
                flags, delay, clear = struct.unpack_from("<BHB", data, at + 2)
                disposal, transparent = (flags >> 2) & 7, clear if flags & 1 else -1
            _, at = _joined(data, at + 1)
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            palette = shared
            if flags & 0x80:
                n = 2 << (flags & 7)
                palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            if palette is None:
                raise ValueError("a frame without a palette")
            bits = data[at]
            stream, at = _joined(data, at + 1)
            flat = lzw_decode(stream, bits, w * h)
            if len(flat) < w * h:
                raise ValueError("a truncated frame")
            samples = flat.reshape(h, w)
            if flags & 0x40:
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
                plain = np.empty_like(samples)
                plain[order] = samples
                samples = plain
            before = canvas.copy() if disposal == 3 else None
            region = canvas[top : top + h, left : left + w]
            seen = samples[: region.shape[0], : region.shape[1]]
            colours = palette[np.minimum(seen, len(palette) - 1)]
            if transparent >= 0:
                solid = seen != transparent
                region[solid] = colours[solid]
            else:
                region[:] = colours
            yield Frame(index, left, top, w, h, delay, disposal, transparent, samples, canvas)
            if disposal == 2:
                region[:] = shared[background] if shared is not None and background < len(shared) and transparent < 0 else 0
            elif before is not None:
                canvas = before
            delay, disposal, transparent, index = 0, 0, -1, index + 1
        else:
            raise ValueError("an unknown block")


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    """The sub-blocks from ``at`` on, joined, and the place after them."""
    out = []
    while n := data[at]:
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(out), at + 1


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels by colour: 4 levels each of red, green and blue, 64 bins."""
    c = canvas >> 6
    return np.bincount(((c[..., 0] << 4) | (c[..., 1] << 2) | c[..., 2]).ravel(), minlength=64)


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's bytes with zeros up to a positive multiple of 64, and how many bytes are the text's."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH), len(raw)


def read_back(media: bytes) -> tuple[bytes, list[dict]]:
    """The samples of all frames, and for each its time, disposal and colour histogram as it is shown, by the bins that it uses."""
    parts, frames = [], []
    for f in decode(media):
        parts.append(f.samples.tobytes())
        bins = histogram(f.canvas)
        used = np.flatnonzero(bins)
        frames.append({"index": f.index, "delay": f.delay, "disposal": f.disposal, "bins": used.tolist(), "pixels": bins[used].tolist()})
    return b"".join(parts), frames


def feature_of(frames: list[dict]) -> str:
    """Frames, total delay, and the histograms' sum."""
    total = np.zeros(64, np.int64)
    for f in frames:
        total[f["bins"]] += f["pixels"]
    return f"frames={len(frames)};delay={sum(f['delay'] for f in frames)};" + ",".join(f"{i}:{total[i]}" for i in np.flatnonzero(total))


def _make_stored() -> Callable:
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames")

    def one(text: str | None) -> tuple:
        payload, n = padded(text)
        media = store(payload)
        back, frames = read_back(media)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(frames), frames

    def work(texts: list) -> dict:
        rows = [one(t) for t in texts]
        return {name: [r[i] for r in rows] for i, name in enumerate(names)}

    return work


def stored_digests(docs: DataFrame) -> DataFrame:
    """Each text stored as GIF, read back, and described; see ``padded`` and ``read_back``."""
    added = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<index:int,delay:int,disposal:int,bins:array<int>,pixels:array<bigint>>>"
    return map_columns(docs, ["doc_id", "text"], added, _make_stored)


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): each text as a GIF."""
    return map_columns(docs, ["doc_id", "text"], "media binary", lambda: lambda texts: {"media": [store(padded(t)[0]) for t in texts]})


def frame_table(media: DataFrame) -> DataFrame:
    """(doc_id, media) to a row for each frame: index, box, delay, disposal, transparent and the 64 histogram bins."""
    kind = "array<struct<index:int,left:int,top:int,width:int,height:int,delay:int,disposal:int,transparent:int,histogram:array<bigint>>>"

    def one(data: bytes | None) -> tuple[list, str | None]:
        if data is None:
            return [], "null"
        try:
            return [{"index": f.index, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "delay": f.delay, "disposal": f.disposal, "transparent": f.transparent, "histogram": histogram(f.canvas).tolist()} for f in decode(data)], None
        except ValueError as e:
            return [], str(e)

    def make() -> Callable:
        def work(rows: list) -> dict:
            got = [one(r) for r in rows]
            return {"frames": [g[0] for g in got], "error": [g[1] for g in got]}

        return work

    return map_columns(media, ["doc_id", "media"], f"frames {kind}, error string", make).select("doc_id", "error", F.explode_outer("frames").alias("f")).select("doc_id", "error", "f.*")
