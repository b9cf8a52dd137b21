"""Operator 1: media columns of baseline JPEG.

`decode` parses the markers of a binary column's JPEG images, Huffman-decodes the scans and reconstructs the luminance thumbnail
from the DC coefficients alone (one pixel for each 8 x 8 block), all in numpy. Restart intervals are independent, so the intervals
of all images of a batch that share tables are decoded side by side, one symbol of each at a time; an image without restart
markers is one such lane.

`store_texts` makes such a column from texts. The UTF-8 bytes, padded with zeros to a positive multiple of 64, are 8-bit samples: each byte is
one flat 8 x 8 block, 64 blocks wide, every row of blocks a restart interval. With a DC quantiser of 8 a flat block of value v has the
DC coefficient v - 128, so the DC-only thumbnail is the payload, without loss. A frame holds at most FRAME_ROWS rows of blocks;
longer texts are several frames in a row, as in motion JPEG, so no text is too long for the format's dimensions.

Defined results: null and empty texts are stored as 64 zero bytes; a null, empty, damaged, progressive or arithmetic-coded media
value has null dimensions and thumbnail and the reason in `error`. Equal texts have equal media. Columns named like a result are replaced.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import slices, utf8

WIDTH = 64
FRAME_ROWS = 4096
_CHUNK = 1 << 18
#: A marker other than a stuffed zero, a restart or a fill byte.
_SCAN_END = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")

#: The typical luminance DC table of the JPEG standard (codes of each length from 1 to 16; the categories in order).
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
#: The AC table of flat blocks holds one code: end of block, as 0.
AC_LENGTHS = (1, *[0] * 15)
AC_SYMBOLS = (0,)


# ---- writing ------------------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _codes(lengths: tuple, symbols: tuple) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, bits): canonical Huffman codes."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out[symbols[at]] = (code, bits)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255 to 255: the bits of the whole flat block (difference, end of block) and their number."""
    codes, value, bits = _codes(DC_LENGTHS, DC_SYMBOLS), np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        extra = d if d > 0 else d + (1 << size) - 1
        value[d + 255] = ((code << size) | (extra if size else 0)) << 1
        bits[d + 255] = n + size + 1
    return value, bits


_VALUE, _BITS = _block_codes()


def _scan(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes (before stuffing) of rows of flat blocks, each padded to whole bytes with ones; first byte of each row."""
    v = rows.astype(np.int64) - 128
    d = np.diff(v, axis=1, prepend=0) + 255
    value, bits = _VALUE[d], _BITS[d]
    total = bits.sum(axis=1)
    size = -(-total // 8)
    start = np.concatenate([[0], np.cumsum(size)])
    at = (8 * start[:-1, None] + np.cumsum(bits, axis=1) - bits).ravel()
    bits, word = bits.ravel(), value.ravel()
    word = word << (24 - (at & 7) - bits)
    byte, n = at >> 3, int(start[-1]) + 2
    out = np.bincount(byte, word >> 16, n) + np.bincount(byte + 1, (word >> 8) & 255, n) + np.bincount(byte + 2, word & 255, n)
    out = out[:-2].astype(np.uint8)
    out[start[1:] - 1] |= ((1 << (8 * size - total)) - 1).astype(np.uint8)
    return out, start


def _stuffed(raw: np.ndarray, start: np.ndarray) -> list[bytes]:
    """Bytes of each row with a zero after every 0xFF."""
    wide = np.repeat(raw, 1 + (raw == 0xFF))
    at = np.concatenate([[0], np.cumsum(1 + (raw == 0xFF))])
    if len(wide) > len(raw):
        wide[at[1:][raw == 0xFF] - 1] = 0
    data, cut = wide.tobytes(), at[start]
    return [data[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _head(rows: int) -> bytes:
    tables = bytes([0x00, *DC_LENGTHS, *DC_SYMBOLS]) + bytes([0x10, *AC_LENGTHS, *AC_SYMBOLS])
    return (
        b"\xff\xd8" + _segment(0xDB, bytes([0, *[8] * 64])) + _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * rows, 8 * WIDTH, 1, 1, 0x11, 0))
        + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", WIDTH)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


_RST = [bytes([0xFF, 0xD0 + i]) for i in range(8)]


def padded(text: str | None) -> bytes:
    raw = utf8(text)
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """JPEG frames of payloads, whose lengths are positive multiples of 64; a long payload is encoded frame by frame."""
    pieces = [(i, p[lo : lo + FRAME_ROWS * WIDTH]) for i, p in enumerate(payloads) for lo in range(0, len(p), FRAME_ROWS * WIDTH)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for a, b in slices([len(p) for _, p in pieces], _CHUNK):
        raw, start = _scan(np.frombuffer(b"".join(p for _, p in pieces[a:b]), np.uint8).reshape(-1, WIDTH))
        rows, at = _stuffed(raw, start), 0
        for i, p in pieces[a:b]:
            own = rows[at : at + len(p) // WIDTH]
            at += len(own)
            marked = b"".join(x for j, row in enumerate(own[:-1]) for x in (row, _RST[j % 8]))
            out[i].append(_head(len(own)) + marked + own[-1] + b"\xff\xd9")
    return [b"".join(x) for x in out]


# ---- reading ------------------------------------------------------------------------------------------------------------------


class Broken(ValueError):
    """Not a baseline JPEG that can be read."""


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    dc_step: dict[int, int] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)  # (component numbers, (dc table, ac table) of each, restart interval, entropy bytes)
    end: int = 0

    def luma_blocks(self) -> tuple[int, int]:
        """Thumbnail's width and height."""
        _, h, v, _ = self.components[0]
        hm, vm = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-(-(-self.width * h // hm)) // 8), -(-(-(-self.height * v // vm)) // 8)


def parse(data: bytes, at: int = 0) -> Frame:
    """The frame that starts at `at`: markers, tables and the entropy-coded bytes of its scans."""
    if data[at : at + 2] != b"\xff\xd8":
        raise Broken("no start of image")
    f, tables, interval, at = Frame(), {}, 0, at + 2
    raw = np.frombuffer(data, np.uint8)
    while True:
        if at + 2 > len(data):
            raise Broken("no end of image")
        if data[at] != 0xFF:
            raise Broken("no marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            f.end = at + 2
            if not f.components or not f.scans:
                raise Broken("no scan")
            return f
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        if at + 4 > len(data):
            raise Broken("cut short")
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise Broken("cut short")
        at += 2 + size
        try:
            if marker == 0xDB:
                i = 0
                while i < len(body):
                    wide, n = body[i] >> 4, body[i] & 15
                    f.dc_step[n] = struct.unpack_from(">H", body, i + 1)[0] if wide else body[i + 1]
                    i += 129 if wide else 65
            elif marker in (0xC0, 0xC1):
                bits, f.height, f.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not f.width or not f.height or not n:
                    raise Broken("not 8 bits a sample or no size")
                f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if any(not c[1] or not c[2] for c in f.components):
                    raise Broken("no sampling factor")
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise Broken("not baseline")
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    n = sum(body[i + 1 : i + 17])
                    tables[body[i]] = body[i + 1 : i + 17 + n]
                    i += 17 + n
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                ids = {c[0]: k for k, c in enumerate(f.components)}
                which = [ids[body[1 + 2 * i]] for i in range(body[0])]
                pairs = [(tables[body[2 + 2 * i] >> 4], tables[16 + (body[2 + 2 * i] & 15)]) for i in range(body[0])]
                end = _SCAN_END.search(data, at)
                if end is None:
                    raise Broken("scan without end")
                f.scans.append((which, pairs, interval, raw[at : end.start()]))
                at = end.start()
        except (struct.error, IndexError, KeyError) as e:
            raise Broken("damaged segment") from e


def _lut(table: bytes) -> np.ndarray:
    """For every 16 bits: code length * 256 + symbol (0: no code)."""
    out, code, at = np.zeros(1 << 16, np.uint16), 0, 16
    for bits in range(1, 17):
        for _ in range(table[bits - 1]):
            lo = code << (16 - bits)
            if at >= len(table) or lo >= 1 << 16:
                raise Broken("damaged Huffman table")
            out[lo : lo + (1 << (16 - bits))] = bits << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@dataclass
class Lane:
    """One restart interval: where its bits are, how many units it has, which image and unit comes first."""

    image: int
    data: np.ndarray
    units: int
    first: int


def _intervals(scan: np.ndarray) -> list[np.ndarray]:
    """Entropy-coded bytes between restart markers, stuffing removed."""
    at = np.flatnonzero(scan[:-1] == 0xFF) if len(scan) else np.zeros(0, np.int64)
    nxt = scan[at + 1]
    keep = np.ones(len(scan), bool)
    rst = at[(nxt >= 0xD0) & (nxt <= 0xD7)]
    keep[at[nxt == 0] + 1] = False
    keep[rst] = keep[rst + 1] = False
    run = np.concatenate([[0], np.cumsum(keep)])
    cut = np.concatenate([[0], run[rst], [run[-1]]])
    data = scan[keep]
    return [data[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _decode_lanes(lanes: list[Lane], order: list[tuple[int, bytes, bytes]], luma: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lanes side by side. order: (component, dc table, ac table) of each block of a unit.

    Returns the DC values of component `luma`, one row of blocks after another for each lane; each lane's first place; lanes that failed."""
    kinds = list(dict.fromkeys([t for o in order for t in o[1:]]))
    luts = np.concatenate([_lut(t) for t in kinds])
    dc = np.array([kinds.index(o[1]) for o in order]) << 16
    ac = np.array([kinds.index(o[2]) for o in order]) << 16
    comp = np.array([o[0] for o in order])
    n_comp, per_unit = int(comp.max()) + 1, int((comp == luma).sum())
    buf = np.concatenate([x for lane in lanes for x in (lane.data, np.zeros(8, np.uint8))]).astype(np.uint32)
    word = buf[:-3] << np.uint32(24) | buf[1:-2] << np.uint32(16) | buf[2:-1] << np.uint32(8) | buf[3:]
    size = np.array([len(x.data) for x in lanes], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size + 8)])[:-1]
    units = np.array([x.units for x in lanes], dtype=np.int64)
    place = np.concatenate([[0], np.cumsum(units * per_unit)])
    out = np.zeros(int(place[-1]), dtype=np.int32)
    bad = np.zeros(len(lanes), bool)
    live = np.flatnonzero(units > 0)
    bp, last, to = start[live] * 8, (start[live] + size[live]) * 8, place[:-1][live].copy()
    left, block, k = units[live], np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    pred = np.zeros((n_comp, len(live)), dtype=np.int32)
    one = len(order) == 1
    while len(live):
        first = k == 0
        table = (dc[0] if one else dc[block]) if first.all() else (ac[0] if one else ac[block]) if not first.any() else np.where(first, dc[block], ac[block])
        got = luts[((word[bp >> 3] >> (16 - (bp & 7)).astype(np.uint32)) & np.uint32(0xFFFF)) + table].astype(np.int64)
        symbol, bits = got & 255, got >> 8
        wrong = bits == 0
        bp = bp + bits
        if first.any() or symbol.any():
            s = symbol & 15
            wrong |= s > 15 - 4 * first
            more = (word[np.minimum(bp >> 3, len(word) - 1)].astype(np.int64) >> (32 - (bp & 7) - s)) & ((1 << s) - 1)
            bp = bp + s
            if first.any():
                diff = np.where((s == 0) | (more >> np.maximum(s - 1, 0) > 0), more, more - (1 << s) + 1).astype(np.int32)
                at = np.flatnonzero(first)
                c = comp[block[at]]
                pred[c, at] += diff[at]
                is_luma = c == luma
                out[to[at[is_luma]]] = pred[luma, at[is_luma]]
                to[at[is_luma]] += 1
            k = np.where(first, 1, np.where(symbol == 0, 64, k + (symbol >> 4) + 1))
        else:
            k = np.full(len(live), 64)
        wrong |= bp > last
        if wrong.any():
            bad[live[wrong]] = True
        over = k >= 64
        if over.any():
            k = np.where(over, 0, k)
            block = block + over
            full = block == len(order)
            block = np.where(full, 0, block)
            left = left - full
        stay = (left > 0) & ~wrong
        if not stay.all():
            live, bp, last, to, left, block, k, pred = live[stay], bp[stay], last[stay], to[stay], left[stay], block[stay], k[stay], pred[:, stay]
    return out, place, bad


def thumbnails(media: list[bytes | None]) -> list[list[tuple[int, int, np.ndarray]] | str]:
    """For each value its frames' width, height and DC-only luminance thumbnail, or why it can't be read.

    Frames are decoded in slices of about _CHUNK bytes, so of a long value only its own bytes and its thumbnail are held whole."""
    out: list = [[] for _ in media]
    held: list[tuple[int, Frame]] = []
    size = 0

    def done() -> None:
        nonlocal held, size
        for i, got in _decode_frames(held):
            if isinstance(got, str):
                out[i] = got
            elif not isinstance(out[i], str):
                out[i].append(got)
        held, size = [], 0

    for i, data in enumerate(media):
        at = 0
        try:
            if not data:
                raise Broken("no data")
            while at < len(data):
                f = parse(data, at)
                held.append((i, f))
                size += f.end - at
                at = f.end
                if size > _CHUNK:
                    done()
        except Broken as e:
            held = [x for x in held if x[0] != i]
            out[i] = str(e)
    done()
    return out


def _decode_frames(frames: list[tuple[int, Frame]]) -> Iterator[tuple[int, tuple[int, int, np.ndarray] | str]]:
    """(value number, frame) -> (value number, width, height and thumbnail, or why not), in order."""
    why: dict[int, str] = {}
    groups: dict[tuple, list[Lane]] = {}
    layout: dict[int, tuple[int, int, tuple]] = {}
    for n, (i, f) in enumerate(frames):
        scan = next((s for s in f.scans if 0 in s[0]), None)
        if scan is None:
            why[i] = "no luminance"
            continue
        which, pairs, interval, data = scan
        hm, vm = max(c[1] for c in f.components), max(c[2] for c in f.components)
        if len(which) == 1:  # a scan of its own: units are single blocks
            wide, high = f.luma_blocks()
            h, v, order = 1, 1, ((0, *pairs[0]),)
        else:
            wide, high = -(-f.width // (8 * hm)), -(-f.height // (8 * vm))
            h, v = f.components[0][1:3]
            order = tuple((c, *p) for c, p in zip(which, pairs) for _ in range(f.components[c][1] * f.components[c][2]))
        units, step = wide * high, interval or wide * high
        parts = _intervals(data)
        if len(parts) < -(-units // step):
            why[i] = "missing intervals"
            continue
        layout[n] = (wide, high, (h, v))
        groups.setdefault(order, []).extend(Lane(n, p, min(step, units - j * step), j * step) for j, p in enumerate(parts[: -(-units // step)]))
    found: dict[int, np.ndarray] = {n: np.zeros(w * hi * h * v, np.int32) for n, (w, hi, (h, v)) in layout.items()}
    for order, lanes in groups.items():
        try:
            values, place, bad = _decode_lanes(lanes, list(order), 0)
        except Broken as e:
            for lane in lanes:
                why[frames[lane.image][0]] = str(e)
            continue
        for lane in np.flatnonzero(bad):
            why[frames[lanes[lane].image][0]] = "damaged scan"
        lo = 0
        while lo < len(lanes):  # an image's lanes follow each other
            hi = lo
            while hi < len(lanes) and lanes[hi].image == lanes[lo].image:
                hi += 1
            found[lanes[lo].image][:] = values[place[lo] : place[hi]]
            lo = hi
    yield from why.items()
    for n, (i, f) in enumerate(frames):
        if i in why:
            continue
        wide, high, (h, v) = layout[n]
        grid = found[n].reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
        w, t = f.luma_blocks()
        step = f.dc_step.get(f.components[0][3], 0)
        yield i, (f.width, f.height, np.clip((grid[:t, :w] * step + 4 >> 3) + 128, 0, 255).astype(np.uint8))


def _boxes(size: int, n: int) -> np.ndarray:
    return np.minimum(np.arange(n) * size // n, size - 1)


def hashes(pixels: np.ndarray) -> tuple[str, str]:
    """Average hash and difference hash of a thumbnail, 16 hexadecimal digits each."""
    def shrunk(w: int) -> np.ndarray:
        rows = np.add.reduceat(pixels.astype(np.int64), _boxes(pixels.shape[0], 8), axis=0)
        return np.add.reduceat(rows, _boxes(pixels.shape[1], w), axis=1)

    a, d = shrunk(8), shrunk(9)
    return np.packbits(a > a.mean()).tobytes().hex(), np.packbits(d[:, 1:] > d[:, :-1]).tobytes().hex()


# ---- columns ------------------------------------------------------------------------------------------------------------------


def store_texts(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with binary column `media`: the texts' payloads as JPEG."""

    @F.pandas_udf("binary")
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[bytes] = []
            for lo, hi in slices([len(t or "") for t in texts], _CHUNK):
                out += encode_payloads([padded(t) for t in texts[lo:hi]])
            yield pd.Series(out, dtype=object)

    return df.withColumn(media, stored(F.col(text)))


DECODED = "width int, height int, frames int, thumb_width int, thumb_height int, thumbnail binary, ahash string, dhash string, error string"


def decode(df: DataFrame, media: str = "media", into: str = "image") -> DataFrame:
    """df with struct column `into`: dimensions, DC-only thumbnail and its hashes. Frames of equal width stand on each other."""

    @F.pandas_udf(DECODED)
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            rows = []
            for lo, hi in slices([len(v) if v is not None else 0 for v in values], _CHUNK):
                for got in thumbnails([None if v is None else bytes(v) for v in values[lo:hi]]):
                    if isinstance(got, str):
                        rows.append((None, None, None, None, None, None, None, None, got))
                    elif len({w for w, _, _ in got}) > 1:
                        rows.append((None, None, len(got), None, None, None, None, None, "frames of different widths"))
                    else:
                        pixels = np.concatenate([p for _, _, p in got]) if len(got) > 1 else got[0][2]
                        rows.append((got[0][0], sum(h for _, h, _ in got), len(got), pixels.shape[1], pixels.shape[0], pixels.tobytes(), *hashes(pixels), None))
            out = pd.DataFrame(rows, columns=["width", "height", "frames", "thumb_width", "thumb_height", "thumbnail", "ahash", "dhash", "error"])
            yield out.astype({c: "Int32" for c in ("width", "height", "frames", "thumb_width", "thumb_height")})

    return df.withColumn(into, decoded(F.col(media)))


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores whole texts as media, decodes the stored bytes, and returns checksums of what was read back."""
    d = decode(store_texts(docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))))
    payload = F.col("image.thumbnail")
    dims = F.concat_ws("x", "image.width", "image.height")
    return d.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.concat_ws(":", dims, "image.ahash", "image.dhash").alias("feature"),
    )
