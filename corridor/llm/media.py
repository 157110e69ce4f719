"""Media columns: what binary values really are, found by their signatures.

An Aho-Corasick automaton finds every known magic byte string of a value in one pass.  A format validator then reads
the structure from there (chunk lengths and checksums, block chains, end marks) and either confirms a length or
rejects the place, so magic bytes within text or compressed data do not count.  What is confirmed at offset 0
corrects the declared type; what is confirmed further on can be carved out.

``stored_texts`` keeps texts as 8-bit samples of a WAVE file and reads them back through the same sniffer.
Null values are no media: type null, no parts; empty ones keep their declared type.  Equal values give equal results, rows
come back as often as given, and a null id is carried like any other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytehash import buffers
from .common import free


def _png(b: bytes, at: int) -> int:
    p = at + 8
    first = True
    while p + 12 <= len(b):
        n = int.from_bytes(b[p : p + 4], "big")
        kind = b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if b[at : at + 6] not in (b"GIF87a", b"GIF89a") or at + 13 > len(b):
        return 0
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x2C:
            if p + 10 > len(b):
                return 0
            p += 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0)
        elif b[p] == 0x21:
            p += 2
        else:
            return 0
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return 0
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at
        n = int.from_bytes(b[p + 2 : p + 4], "big")
        if not 0xC0 <= kind <= 0xFE or n < 2:
            return 0
        p += 2 + n
        if kind == 0xDA:  # entropy-coded data up to the next real marker
            while p + 1 < len(b) and not (b[p] == 0xFF and b[p + 1] != 0 and not 0xD0 <= b[p + 1] <= 0xD7):
                p = b.find(b"\xff", p + 1)
                if p < 0:
                    return 0
    return p + 2 - at if b[p : p + 2] == b"\xff\xd9" else 0


def _riff(b: bytes, at: int) -> int:
    n = int.from_bytes(b[at + 4 : at + 8], "little") + 8
    if n < 12 or at + n > len(b):
        return 0
    p, end = at + 12, at + n
    while p + 8 <= end:  # chunks must fill the form exactly
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        if not all(32 <= c < 127 for c in b[p : p + 4]):
            return 0
        p += 8 + size + (size & 1)
    return n if p == end else 0


def _form(name: bytes) -> Callable[[bytes, int], int]:
    return lambda b, at: _riff(b, at) if b[at + 8 : at + 12] == name else 0


def _gzip(b: bytes, at: int) -> int:
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return 0
    d = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not d.eof:  # in pieces of bounded size either way: the content is not kept
            todo = b[p : p + 65536]
            p += 65536
            while todo and not d.eof:
                d.decompress(todo, 1 << 20)
                todo = d.unconsumed_tail
    except zlib.error:
        return 0
    return min(p, len(b)) - len(d.unused_data) - at if d.eof else 0


_directories: list = [b"", {}]


def _zip(b: bytes, at: int) -> int:
    """By the end record whose directory, counted back from it, puts the archive's beginning here."""
    if _directories[0] is not b:  # all end records of a value are read once
        found: dict[int, int] = {}
        end = b.find(b"PK\x05\x06")
        while end >= 0:
            if end + 22 <= len(b):
                size, start, note = struct.unpack("<IIH", b[end + 12 : end + 22])
                begin = end - size - start
                if begin >= 0 and b[end - size : end - size + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(b):
                    found.setdefault(begin, end + 22 + note)
            end = b.find(b"PK\x05\x06", end + 4)
        _directories[:] = b, found
    return _directories[1].get(at, at) - at


def _pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return 0
    limit = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, limit if limit > 0 else len(b))
    return end + 5 - at if end > 0 and b.find(b"startxref", at, end) > 0 else 0


def _crc_table(width: int, poly: int) -> list[int]:
    out = []
    for k in range(256):
        k <<= width - 8
        for _ in range(8):
            k = (k << 1 ^ poly if k >> (width - 1) else k << 1) & ((1 << width) - 1)
        out.append(k)
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def _flac_frame(b: bytes, p: int) -> int:
    """Length of a frame header whose checksum is right; 0: none."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 3] & 1:
        return 0
    size, rate = b[p + 2] >> 4, b[p + 2] & 15
    if not size or rate == 15 or b[p + 3] >> 4 > 10:
        return 0
    lead = b[p + 4]  # the frame's number, coded like a character
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1 if 0xC0 <= lead < 0xFF else -1
    if more < 0:
        return 0
    n = 5 + more + {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p + n >= len(b):
        return 0
    crc = 0
    for c in b[p : p + n]:
        crc = _CRC8[crc ^ c]
    return n + 1 if crc == b[p + n] else 0


def _flac(b: bytes, at: int) -> int:
    """Metadata blocks, then frames: each ends where its checksum comes out and the next header is right, or, with nothing
    that follows, where the checksum comes out first beyond the least frame size."""
    p, least = at + 4, 0
    while p + 4 <= len(b):
        last, kind, n = b[p] & 0x80, b[p] & 0x7F, int.from_bytes(b[p + 1 : p + 4], "big")
        if p == at + 4 and (kind != 0 or n != 34) or p + 4 + n > len(b):
            return 0
        if p == at + 4:
            least = int.from_bytes(b[p + 8 : p + 11], "big")
        p += 4 + n
        if last:
            break
    end = 0
    while h := _flac_frame(b, p):
        crc, first, after = 0, 0, 0
        for k in range(p, len(b)):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[k]]
            if not crc and k >= p + h + 2 and k + 1 - p >= least:
                first = first or k + 1
                if _flac_frame(b, k + 1):
                    after = k + 1
                    break
        end = after or first
        if not after:
            break
        p = after
    return end - at if end else 0


def _ogg(b: bytes, at: int) -> int:
    p = at
    while b[p : p + 5] == b"OggS\x00" and p + 27 <= len(b):
        n = b[p + 26]
        size = 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + size > len(b):
            return 0
        page = (b[p : p + 22] + bytes(4) + b[p + 26 : p + size]).translate(_REVERSED)
        crc = zlib.crc32(page, 0xFFFFFFFF) ^ 0xFFFFFFFF  # begun with zeros, on mirrored bits
        if int(f"{crc:032b}"[::-1], 2) != int.from_bytes(b[p + 22 : p + 26], "little"):
            return 0
        p += size
        if b[p - size + 5] & 4:
            return p - at
    return 0


#: Boxes that lie side by side at the top of such a file (fixed names of the format).
_TOP = {b"ftyp", b"moov", b"mdat", b"moof", b"meta", b"free", b"skip", b"wide", b"uuid", b"sidx", b"styp", b"mfra", b"pdin"}


def _boxes(b: bytes, at: int) -> int:
    """Boxes of an ISO base media file from 'ftyp' on; media or a table of it must be among them."""
    p, seen = at, set()
    while p + 8 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if kind not in _TOP or (p == at) != (kind == b"ftyp"):
            break
        if n == 1 and p + 16 <= len(b):
            n = int.from_bytes(b[p + 8 : p + 16], "big")
        if n < 8 or p + n > len(b) or (kind == b"ftyp" and (n < 16 or n % 4)):
            return 0
        seen.add(kind)
        p += n
    return p - at if b"ftyp" in seen and seen & {b"moov", b"mdat", b"moof", b"meta"} else 0


#: Fixed values of MPEG audio layer III: kilobits a second by version 1 and 2, samples a second of version 1.
_RATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_HERTZ = (44100, 48000, 32000)


def _mp3_frames(b: bytes, p: int) -> tuple[int, int]:
    """End and number of the layer III frames that follow each other."""
    n = 0
    while p + 4 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xE6 == 0xE2:
        version, rate, hertz = b[p + 1] >> 3 & 3, b[p + 2] >> 4, b[p + 2] >> 2 & 3
        if version == 1 or rate in (0, 15) or hertz == 3:
            break
        one = version == 3
        size = (144 if one else 72) * _RATES[1 if one else 2][rate] * 1000 // (_HERTZ[hertz] // (1 if one else 2 if version == 2 else 4)) + (b[p + 2] >> 1 & 1)
        if p + size > len(b):
            break
        p, n = p + size, n + 1
    return p, n


def _mp3(b: bytes, at: int) -> int:
    end, n = _mp3_frames(b, at)
    return end - at if n >= 4 else 0  # a sync word alone says little


def _id3(b: bytes, at: int) -> int:
    if at + 10 > len(b) or not 2 <= b[at + 3] <= 4 or any(c > 127 for c in b[at + 6 : at + 10]):
        return 0
    n = 0
    for c in b[at + 6 : at + 10]:
        n = n << 7 | c
    end, frames = _mp3_frames(b, at + 10 + n + (10 if b[at + 5] & 0x10 else 0))
    return end - at if frames else 0


def _number(b: bytes, p: int, mark: bool) -> tuple[int, int]:
    """A variable-length number (with its length mark or without) and its bytes; (-1, 0): none, -1: unknown size."""
    if p >= len(b) or not b[p]:
        return -1, 0
    n = 9 - b[p].bit_length()
    if p + n > len(b):
        return -1, 0
    v = int.from_bytes(b[p : p + n], "big")
    if mark:
        return v, n
    v &= (1 << 7 * n) - 1
    return (-1 if v == (1 << 7 * n) - 1 else v), n


def _matroska(name: bytes) -> Callable[[bytes, int], int]:
    def check(b: bytes, at: int) -> int:
        size, n = _number(b, at + 4, False)
        p, kind = at + 4 + n, b""
        end = p + size
        if size < 0 or end > len(b):
            return 0
        while p < end:
            key, k = _number(b, p, True)
            length, m = _number(b, p + k, False)
            if not k or not m or length < 0 or p + k + m + length > end:
                return 0
            if key == 0x4282:
                kind = b[p + k + m : p + k + m + length].rstrip(b"\0")
            p += k + m + length
        if kind != name or b[p : p + 4] != b"\x18\x53\x80\x67":
            return 0
        size, n = _number(b, p + 4, False)
        stop = p + 4 + n + size
        return stop - at if n and size > 0 and stop <= len(b) else 0

    return check


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, spare, start, head = struct.unpack("<IIII", b[at + 2 : at + 18])
    planes, bits = struct.unpack("<HH", b[at + 26 : at + 30] if head != 12 else b[at + 22 : at + 26])
    ok = not spare and head in (12, 40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return size if ok and 14 + head <= start <= size and at + size <= len(b) else 0


def _tiff(b: bytes, at: int) -> int:
    """Directories, values and strips or tiles; the length is where the last of them ends."""
    order = "little" if b[at : at + 2] == b"II" else "big"
    num = lambda p, n: int.from_bytes(b[p : p + n], order)
    width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    p, end, met = at + num(at + 4, 4), at + 8, set()
    while p != at:
        n = num(p, 2)
        if p in met or p < at + 8 or not n or p + 6 + 12 * n > len(b):
            return 0
        met.add(p)
        end, last, parts = max(end, p + 6 + 12 * n), 0, {}
        for k in range(p + 2, p + 2 + 12 * n, 12):
            tag, kind, count = num(k, 2), num(k + 2, 2), num(k + 4, 4)
            if tag <= last or kind not in width:
                return 0
            size, where, last = width[kind] * count, k + 8, tag
            if size > 4:
                where = at + num(k + 8, 4)
                if where + size > len(b):
                    return 0
                end = max(end, where + size)
            if tag in (273, 279, 324, 325):
                parts[tag] = [num(where + width[kind] * i, width[kind]) for i in range(count)]
        for offsets, sizes in ((273, 279), (324, 325)):
            for x, y in zip(parts.get(offsets, ()), parts.get(sizes, ()), strict=False):
                if at + x + y > len(b):
                    return 0
                end = max(end, at + x + y)
        p = at + num(p + 2 + 12 * n, 4)
    return end - at if met else 0


#: Magic bytes, media type, validator from where the format begins to its length (0: not that format).
FORMATS: list[tuple[bytes, str, Callable[[bytes, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF8", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _form(b"WAVE")),
    (b"RIFF", "image/webp", _form(b"WEBP")),
    (b"RIFF", "video/x-msvideo", _form(b"AVI ")),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"fLaC", "audio/flac", _flac),
    (b"OggS", "audio/ogg", _ogg),
    (b"ftyp", "video/mp4", _boxes),
    (b"ID3", "audio/mpeg", _id3),
    *[(bytes([0xFF, k]), "audio/mpeg", _mp3) for k in (0xE2, 0xE3, 0xF2, 0xF3, 0xFA, 0xFB)],
    (b"\x1a\x45\xdf\xa3", "video/x-matroska", _matroska(b"matroska")),
    (b"\x1a\x45\xdf\xa3", "video/webm", _matroska(b"webm")),
    (b"BM", "image/bmp", _bmp),
    (b"II*\0", "image/tiff", _tiff),
    (b"MM\0*", "image/tiff", _tiff),
]
#: Bytes of a format before its magic bytes.
BEFORE = {b"ftyp": 4}
_machine: list = []


def _automaton():
    if not _machine:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic in dict.fromkeys(m for m, _, _ in FORMATS):
            a.add_word(magic.decode("latin-1"), (len(magic) + BEFORE.get(magic, 0), [(t, v) for m, t, v in FORMATS if m == magic]))
        a.make_automaton()
        _machine.append(a)
    return _machine[0]


def sniff(value: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each confirmed medium in order; those inside a carved one are left out, but what
    begins the value is a container, so that its parts are looked into."""
    found, busy = [], 0
    for last, (size, kinds) in _automaton().iter(value.decode("latin-1")):
        at = last + 1 - size
        if at < max(busy, 0):
            continue
        for kind, check in kinds:
            if n := check(value, at):
                found.append((kind, at, n))
                busy = at + n if at else 0
                break
    return found


def sniffed(df: DataFrame, value_col: str, declared_col: str | None = None) -> DataFrame:
    """df with media_type (confirmed, else declared), media_length, type_corrected, and parts carved further on.

    Columns that exist already under these names are refused, whatever their case.
    """
    df = free(df, "media_type", "media_length", "type_corrected", "parts")
    at = df.columns.index(value_col)
    said = df.columns.index(declared_col) if declared_col else None
    part = T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
    new = [T.StructField("media_type", T.StringType()), T.StructField("media_length", T.LongType()), T.StructField("type_corrected", T.BooleanType()), T.StructField("parts", T.ArrayType(part))]
    schema = T.StructType([*df.schema.fields, *new])

    def run(batches):
        for batch in batches:
            kinds, sizes, fixed, parts = [], [], [], []
            declared = batch.column(said).to_pylist() if said is not None else [None] * batch.num_rows
            for v, d in zip(batch.column(at).to_pylist(), declared, strict=True):
                got = sniff(v) if v is not None else []
                own = got[0] if got and got[0][1] == 0 else None
                kinds.append(own[0] if own else d if v is not None else None)
                sizes.append(own[2] if own else None)
                fixed.append(bool(own) and own[0] != d)
                parts.append([{"type": t, "offset": o, "length": n} for t, o, n in got if o])
            kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(sizes, pa.int64()), pa.array(fixed, pa.bool_()), pa.array(parts, kind)], names=schema.names)

    return df.mapInArrow(run, schema)


def wave(samples: bytes, rate: int = 8000) -> bytes:
    """A WAVE file of unsigned 8-bit mono samples; their number must be even."""
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return b"RIFF" + struct.pack("<I", 4 + len(head) + 8 + len(samples)) + b"WAVE" + head + b"data" + struct.pack("<I", len(samples)) + samples


def samples(value: bytes) -> bytes:
    """The samples of a WAVE file."""
    p = 12
    while p + 8 <= len(value):
        n = int.from_bytes(value[p + 4 : p + 8], "little")
        if value[p : p + 4] == b"data":
            return value[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def stored(docs: DataFrame, block: int = 64, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded with zeros to a positive multiple of ``block``, as WAVE."""

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(1))
            size = np.diff(off)
            files = []
            for a, n in zip(off[:-1].tolist(), size.tolist(), strict=True):
                files.append(wave(data[a : a + n].tobytes() + bytes(block - n % block if n % block or not n else 0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame, tail: int = 64) -> DataFrame:
    """Digests of what ``stored`` keeps, from the stored bytes alone, by way of ``sniffed``."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for v, kind, size, fixed, parts in zip(*(batch.column(k).to_pylist() for k in ("media", "media_type", "media_length", "type_corrected", "parts")), strict=True):
                if kind != "audio/wav" or size != len(v):
                    raise ValueError("a stored value is not the WAVE file that was written")
                x = samples(v)
                level = np.frombuffer(x, np.uint8)
                feature = f"{kind};corrected={int(fixed)};rate=8000;low={level.min()};high={level.max()};zeros={int((level == 0).sum())};parts=" + ",".join(f"{p['type']}@{p['offset']}+{p['length']}" for p in parts)
                row = (len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-tail:]), len(v), hashlib.sha256(v).hexdigest(), feature)
                for k, y in zip(out, row, strict=True):
                    out[k].append(y)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]], names=["doc_id", "n_bytes", *out])

    return sniffed(media.withColumn("declared", F.lit("text/plain")), "media", "declared").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
