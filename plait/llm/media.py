"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over the bytes; a validator for each format
then walks its structure and tells how long the file is, or that this is none. What validates at offset 0 is the type,
whatever was declared; what validates further in is embedded media, which can be carved.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm import common

RATE = 8000


class Scanned(bytes):
    """Bytes that remember where a mark stands next, so that many hits before one mark, or before none, cost one search."""

    def next(self, mark: bytes, at: int) -> int:
        seen = self.__dict__.setdefault("seen", {})
        asked, found = seen.get(mark, (at + 1, -1))
        if not (asked <= at and (found < 0 or at <= found)):
            found = self.find(mark, at)
            seen[mark] = (at, found)
        return found


def wav(payload: bytes) -> bytes:
    """8-bit mono PCM: each byte is a sample, so any bytes are stored as they are."""
    pad = b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad


def _wav(d: bytes, at: int) -> int | None:
    if d[at + 8 : at + 12] != b"WAVE" or at + 12 > len(d):
        return None
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    if end > len(d):
        return None
    seen, i = set(), at + 12
    while i + 8 <= end:
        kind, n = d[i : i + 4], struct.unpack_from("<I", d, i + 4)[0]
        seen.add(kind)
        i += 8 + n + (n & 1)
    return end - at if i == end and {b"fmt ", b"data"} <= seen else None


def _png(d: bytes, at: int) -> int | None:
    i, first = at + 8, True
    while i + 12 <= len(d):
        n = struct.unpack_from(">I", d, i)[0]
        if i + 12 + n > len(d) or first and (d[i + 4 : i + 8] != b"IHDR" or n != 13):
            return None
        if zlib.crc32(d[i + 4 : i + 8 + n]) != struct.unpack_from(">I", d, i + 8 + n)[0]:
            return None
        i, first, kind = i + 12 + n, False, d[i + 4 : i + 8]
        if kind == b"IEND":
            return i - at
    return None


def _gif(d: bytes, at: int) -> int | None:
    i = at + 13
    if i > len(d):
        return None
    if d[at + 10] & 128:
        i += 3 << (d[at + 10] & 7) + 1
    while i < len(d):
        kind = d[i]
        if kind == 0x3B:
            return i + 1 - at
        if kind == 0x2C and i + 10 < len(d):
            flags = d[i + 9]
            i += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        elif kind == 0x21:
            i += 2
        else:
            return None
        while i < len(d) and d[i]:
            i += d[i] + 1
        i += 1
    return None


def _jpeg(d: Scanned, at: int) -> int | None:
    if d.next(b"\xff\xd9", at) < 0:
        return None
    i, scans = at + 2, 0
    while i + 4 <= len(d) and d[i] == 0xFF:
        kind = d[i + 1]
        if not 0xC0 <= kind <= 0xFE or kind == 0xD9:
            return None
        i += 2 + struct.unpack_from(">H", d, i + 2)[0]
        if kind == 0xDA:
            while (i := d.find(b"\xff", i)) >= 0 and i + 1 < len(d):
                if d[i + 1] == 0xD9:
                    return i + 2 - at
                if d[i + 1] and not 0xD0 <= d[i + 1] <= 0xD7:
                    break
                i += 2
            scans += 1
            if i < 0:
                return None
    return None


def _bmp(d: bytes, at: int) -> int | None:
    if at + 30 > len(d):
        return None
    n, zero, start, head, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", d, at + 2)
    if zero or head not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or w <= 0 or at + n > len(d):
        return None
    return n if start + (w * bits + 31) // 32 * 4 * abs(h) <= n else None


def _pdf(d: Scanned, at: int) -> int | None:
    """Up to the last end mark before another file begins, as a changed file has several."""
    if not d[at + 5 : at + 6].isdigit() or d[at + 6 : at + 7] != b".":
        return None
    other, i, length = d.next(b"%PDF-", at + 5), at, None
    while (end := d.next(b"%%EOF", i)) >= 0 and (other < 0 or end < other):
        if 0 <= d.next(b"startxref", i) < end:
            length = end + 5 - at
        i = end + 5
    return length


def _zip(d: Scanned, at: int) -> int | None:
    end = d.next(b"PK\5\6", at)
    if end < 0 or end + 22 > len(d):
        return None
    size, start, note = struct.unpack_from("<IIH", d, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(d) else None


def _gzip(d: bytes, at: int) -> int | None:
    z = zlib.decompressobj(31)
    try:
        for i in range(at, len(d), 1 << 16):
            rest = d[i : i + (1 << 16)]
            while rest and not z.eof:  # never more than a megabyte at once
                z.decompress(rest, 1 << 20)
                rest = z.unconsumed_tail
            if z.eof:
                return min(i + (1 << 16), len(d)) - len(z.unused_data) - at
    except zlib.error:
        pass
    return None


def _ogg(d: bytes, at: int) -> int | None:
    i = at
    while d[i : i + 5] == b"OggS\0" and i + 27 <= len(d):
        n = d[i + 26]
        body = 27 + n + sum(d[i + 27 : i + 27 + n])
        if i + body > len(d):
            return None
        last, i = d[i + 5] & 4, i + body
        if last:
            return i - at
    return None


#: The magic bytes of each format.
MAGIC: dict[bytes, tuple[str, Callable[[bytes, int], int | None]]] = {
    b"RIFF": ("wav", _wav),
    b"\x89PNG\r\n\x1a\n": ("png", _png),
    b"GIF87a": ("gif", _gif),
    b"GIF89a": ("gif", _gif),
    b"\xff\xd8\xff": ("jpeg", _jpeg),
    b"BM": ("bmp", _bmp),
    b"%PDF-": ("pdf", _pdf),
    b"PK\3\4": ("zip", _zip),
    b"\x1f\x8b\x08": ("gzip", _gzip),
    b"OggS": ("ogg", _ogg),
}
DECLARED = ("wav", "png", "pdf", "bin")
_automaton = None


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every file that validates, none within another that is not at offset 0."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for magic in MAGIC:
            _automaton.add_word(magic.decode("latin-1"), magic)
        _automaton.make_automaton()
    data = Scanned(data)
    found, free = [], 1
    for last, magic in _automaton.iter(data.decode("latin-1")):
        at = last + 1 - len(magic)
        if at and at < free:
            continue
        kind, valid = MAGIC[magic]
        n = valid(data, at)
        if n:
            found.append((at, n, kind))
            free = at + n if at else free
    return found


def samples(data: bytes) -> bytes:
    """The samples of a WAV file as this module writes them, found by walking its chunks."""
    i = 12
    while data[i : i + 4] != b"data":
        n = struct.unpack_from("<I", data, i + 4)[0]
        i += 8 + n + (n & 1)
    return data[i + 8 : i + 8 + struct.unpack_from("<I", data, i + 4)[0]]


def encode(docs: DataFrame, unit: int = 576) -> DataFrame:
    """doc_id, n_bytes, declared, media: each text's UTF-8, padded with bytes 255 to a positive multiple of unit, as WAV.

    The declared type is often wrong, as in the wild; it depends on the text alone.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            padded = [t + b"\xff" * (max(unit, -(-len(t) // unit) * unit) - len(t)) for t in texts]
            declared = [DECLARED[zlib.crc32(t) % len(DECLARED)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(declared), pa.array([wav(p) for p in padded], pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(one, "doc_id long, n_bytes long, declared string, media binary")


def features(media: DataFrame) -> DataFrame:
    """Sniffs media(doc_id, n_bytes, declared, media) and describes what the bytes are; null media have nulls."""
    import hashlib

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, declared, data in zip(*(c.to_pylist() for c in batch.columns)):
                if data is None:
                    rows.append((doc, n, *[None] * 6))
                    continue
                found = sniff(data)
                kind = next((k for at, _, k in found if at == 0), "bin")
                payload = samples(data) if kind == "wav" else data
                level = np.frombuffer(payload, np.uint8)
                high = level >= 128
                carved = ",".join(f"{k}@{at}+{m}" for at, m, k in found if at)
                feature = f"type={kind};declared={declared};corrected={int(kind != declared)};samples={len(payload)};sum={int(level.sum(dtype=np.int64))};crossings={int(np.count_nonzero(high[1:] != high[:-1]))};carved={carved}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names)

    return media.mapInArrow(one, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def carve(media: DataFrame) -> DataFrame:
    """doc_id, offset, type, media: the embedded files of media(doc_id, media, ...)."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, at, k, d[at : at + n]) for doc, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for at, n, k in sniff(d or b"") if at]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["doc_id", "offset", "type", "media"])

    return media.select("doc_id", "media").mapInArrow(one, "doc_id long, offset long, type string, media binary")


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text of docs(doc_id, text, ...) as media, reads that back, sniffs it and computes features.

    Null texts count as empty and hold one unit of padding. Equal texts get equal values; every row gets a row. Other
    columns are ignored. An empty table gives no rows.
    """
    common.arrow_batches(docs.sparkSession)
    return features(common.written(encode(docs), "media"))
