"""Media columns: Matroska files to packet tables (operator 3).

The container is a tree of EBML elements: a variable-length id, a
variable-length size, a body. ``parse`` walks one file once and gives its tracks,
packets (track, timestamp, byte range) and cue points; ``mux`` writes PCM frames.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partgraph.llm.common import documents, small_batches, utf8_column, with_text

# Element ids of the published Matroska specification (RFC 9559).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
DOC_TYPE, DOC_TYPE_VERSION, TIMESTAMP_SCALE = 0x4282, 0x4287, 0x2AD7B1
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

TOP_LEVEL = frozenset((SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS))
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Bytes of a frame; samples a second; frames in a block; blocks in a cluster.
FRAME, RATE, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 576, 8000, 8, 16


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp in ns, start, size, keyframe, cluster start)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    doc_type: str = ""
    #: Why the walk stopped before the end, or nothing.
    error: str | None = None


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, place after it) of a variable-length integer; an all-ones size is None (unknown)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"integer at byte {at} is cut off")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, ends_at: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, body start, body end) of the children in a range.

    A body of unknown size reaches to the end of its parent, or for a cluster to
    the next element of ``ends_at``, which ``parse`` finds by walking it.
    """
    while at < end:
        name, body = vint(data, at, keep_marker=True)
        size, body = vint(data, body)
        stop = end if size is None else body + size
        if stop > end:
            raise ValueError(f"element {name:X} at byte {at} goes beyond its parent")
        if size is None and ends_at and name == CLUSTER:
            stop = body
            while stop < end:
                inner, b = vint(data, stop, keep_marker=True)
                if inner in ends_at:
                    break
                length, b = vint(data, b)
                stop = end if length is None else min(b + length, end)
        yield name, at, body, stop
        at = stop


def unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, size) of the frames of a block's body."""
    if kind == NO_LACING:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError(f"fixed lacing at byte {at} does not divide")
        return [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at = vint(data, at)
        sizes.append(size or 0)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            more, at = vint(data, at)
            more = (1 << 7 * width) - 1 if more is None else more
            sizes.append(sizes[-1] + more - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace sizes at byte {at} exceed the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _track(data: bytes, a: int, b: int) -> dict:
    t: dict = {}
    for name, _, x, y in elements(data, a, b):
        if name in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            t[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "frame_ns"}[name]] = unsigned(data, x, y)
        elif name == CODEC_ID:
            t["codec"] = data[x:y].rstrip(b"\0").decode("ascii", "replace")
        elif name == AUDIO:
            for inner, _, p, q in elements(data, x, y):
                if inner in (CHANNELS, BIT_DEPTH):
                    t["channels" if inner == CHANNELS else "bits"] = unsigned(data, p, q)
                elif inner == SAMPLING_FREQUENCY:
                    t["rate"] = float(np.frombuffer(data[p:q], ">f4" if q - p == 4 else ">f8")[0])
    return t


def _block(m: Media, data: bytes, a: int, b: int, base: int, scale: int, cluster: int, key: bool | None) -> None:
    track, at = vint(data, a)
    if at + 3 > b:
        raise ValueError(f"block at byte {a} is cut off")
    ticks, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    time = (base + ticks) * scale
    step = m.tracks.get(track or 0, {}).get("frame_ns", 0)
    is_key = bool(flags & 0x80) if key is None else key
    for i, (start, size) in enumerate(laced(data, at + 3, b, flags >> 1 & 3)):
        m.packets.append((track or 0, time + i * step, start, size, is_key, cluster))


def parse(data: bytes) -> Media:
    """Tracks, packets and cues of one file.

    Damage ends the walk: what was read before it stays and ``error`` says where
    it was. An empty file has no packets and the error "no EBML header".
    """
    m, scale = Media(), 1_000_000
    try:
        for name, _, a, b in elements(data, 0, len(data)):
            if name == EBML:
                for inner, _, x, y in elements(data, a, b):
                    if inner == DOC_TYPE:
                        m.doc_type = data[x:y].decode("ascii", "replace")
            elif name == SEGMENT:
                for top, place, x, y in elements(data, a, b, TOP_LEVEL):
                    if top == INFO:
                        for inner, _, p, q in elements(data, x, y):
                            scale = unsigned(data, p, q) if inner == TIMESTAMP_SCALE else scale
                    elif top == TRACKS:
                        for inner, _, p, q in elements(data, x, y):
                            if inner == TRACK_ENTRY:
                                t = _track(data, p, q)
                                m.tracks[t.get("number", 0)] = t
                    elif top == CLUSTER:
                        m.clusters.append(place)
                        base = 0
                        for inner, _, p, q in elements(data, x, y):
                            if inner == TIMESTAMP:
                                base = unsigned(data, p, q)
                            elif inner == SIMPLE_BLOCK:
                                _block(m, data, p, q, base, scale, place, None)
                            elif inner == BLOCK_GROUP:
                                parts = list(elements(data, p, q))
                                key = all(e[0] != REFERENCE for e in parts)
                                for e in parts:
                                    if e[0] == BLOCK:
                                        _block(m, data, e[2], e[3], base, scale, place, key)
                    elif top == CUES:
                        for point, _, p, q in elements(data, x, y):
                            if point != CUE_POINT:
                                continue
                            time = track = where = 0
                            for inner, _, r, s in elements(data, p, q):
                                if inner == CUE_TIME:
                                    time = unsigned(data, r, s)
                                elif inner == CUE_POSITIONS:
                                    for deep, _, u, v in elements(data, r, s):
                                        if deep == CUE_TRACK:
                                            track = unsigned(data, u, v)
                                        elif deep == CUE_CLUSTER:
                                            where = a + unsigned(data, u, v)
                            m.cues.append((time * scale, track, where))
        if not m.doc_type:
            m.error = "no EBML header"
    except (ValueError, IndexError) as e:
        m.error = str(e) or "cut off"
    return m


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _uint(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def element(name: int, *body: bytes) -> bytes:
    whole = b"".join(body)
    return _uint(name) + _size(len(whole)) + whole


def _lace_head(sizes: list[int], kind: int) -> bytes:
    if kind == NO_LACING:
        return b""
    head = bytes([len(sizes) - 1])
    if kind == XIPH:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == EBML_LACING and len(sizes) > 1:
        head += _size(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            width = 1
            while abs(n - before) > (1 << 7 * width - 1) - 2:
                width += 1
            head += (n - before + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return head


def mux(payload: bytes, frame: int = FRAME, rate: int = RATE, lacing: int = FIXED) -> bytes:
    """A Matroska audio file of 8-bit PCM samples; ``payload`` is a positive multiple of ``frame`` bytes."""
    frames = len(payload) // frame
    step = frame * 1_000_000_000 // rate
    head = element(EBML, element(DOC_TYPE, b"matroska"), element(DOC_TYPE_VERSION, b"\x04"))
    info = element(INFO, element(TIMESTAMP_SCALE, _uint(1_000_000)))
    audio = element(
        AUDIO,
        element(SAMPLING_FREQUENCY, np.array([rate], ">f8").tobytes()),
        element(CHANNELS, b"\x01"),
        element(BIT_DEPTH, b"\x08"),
    )
    entry = (element(TRACK_NUMBER, b"\x01"), element(TRACK_UID, b"\x01"), element(TRACK_TYPE, b"\x02"))
    entry += (element(CODEC_ID, b"A_PCM/INT/LIT"), element(DEFAULT_DURATION, _uint(step)), audio)
    parts = [info, element(TRACKS, element(TRACK_ENTRY, *entry))]
    at, cues = sum(map(len, parts)), []
    a_block = FRAMES_A_BLOCK if lacing else 1
    for c in range(0, frames, a_block * BLOCKS_A_CLUSTER):
        base = c * step // 1_000_000
        blocks = [element(TIMESTAMP, _uint(base))]
        for f in range(c, min(frames, c + a_block * BLOCKS_A_CLUSTER), a_block):
            n = min(a_block, frames - f)
            kind = lacing if n > 1 else NO_LACING
            header = b"\x81" + (f * step // 1_000_000 - base).to_bytes(2, "big") + bytes([0x80 | kind << 1])
            body = payload[f * frame : (f + n) * frame]
            blocks.append(element(SIMPLE_BLOCK, header, _lace_head([frame] * n, kind), body))
        parts.append(element(CLUSTER, *blocks))
        positions = element(CUE_POSITIONS, element(CUE_TRACK, b"\x01"), element(CUE_CLUSTER, _uint(at)))
        cues.append(element(CUE_POINT, element(CUE_TIME, _uint(base)), positions))
        at += len(parts[-1])
    return head + element(SEGMENT, *parts, element(CUES, *cues))


PACKET_SCHEMA = (
    "id long, track int, codec string, packet int, timestamp_ns long, start long, size long, "
    "keyframe boolean, cluster long, cue_ns long, error string"
)


def packets(media: DataFrame, key: str, column: str) -> DataFrame:
    """The packet table of a column of Matroska files: one row a packet.

    cluster is where the packet's cluster begins and cue_ns the time of the cue that
    points there for its track (the last one, if several do; null without one).
    ``key`` is a long, ``column`` binary; other columns are left out. A null or
    empty file, or one without packets, has one row with a null packet and the
    error. A damaged file keeps the packets before the damage, each with the
    error. Repeated rows repeat their packets; null keys stay null; no rows give no
    rows. A file is held whole, its packets are written 64 files at a time.
    """
    fields = PACKET_SCHEMA.split(", ")

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out: list[list] = [[] for _ in fields]
                keys = batch.column(0).slice(at, 64).to_pylist()
                for k, data in zip(keys, batch.column(1).slice(at, 64).to_pylist(), strict=True):
                    m = parse(data or b"")
                    cue = {(track, cluster): ns for ns, track, cluster in m.cues}
                    rows = [
                        (k, t, m.tracks.get(t, {}).get("codec"), i, ns, start, size, is_key, c, cue.get((t, c)), m.error)
                        for i, (t, ns, start, size, is_key, c) in enumerate(m.packets)
                    ]
                    for row in rows or [(k, *[None] * 9, m.error)]:
                        for values, v in zip(out, row, strict=True):
                            values.append(v)
                kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
                names = [f.split()[0] for f in fields]
                arrays = [pa.array(v, kinds[f.split()[1]]) for v, f in zip(out, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    small_batches(media.sparkSession)
    return media.select(F.col(key).cast("long"), F.col(column).cast("binary")).mapInArrow(read, PACKET_SCHEMA)


OP3_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def stored(raw: bytes) -> tuple:
    """The columns of operator 3 but doc_id: store, read back through the packet table, describe."""
    payload = raw + b"\xff" * ((-len(raw)) % FRAME or (0 if raw else FRAME))
    media = mux(payload)
    m = parse(media)
    view = memoryview(media)
    back = b"".join([view[start : start + size] for _, _, start, size, _, _ in m.packets])
    samples = np.frombuffer(back, np.uint8)
    track = m.tracks[1]
    length = m.packets[-1][1] + track["frame_ns"]
    crossings = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
    feature = (
        f"codec={track['codec']};rate={track['rate']:g};bits={track['bits']};packets={len(m.packets)};"
        f"clusters={len(m.clusters)};cues={len(m.cues)};ms={length // 1_000_000};"
        f"mean={samples.mean():.4f};std={samples.std():.4f};crossings={crossings}"
    )
    return (
        len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]),
        len(media), hashlib.sha256(media).hexdigest(), feature,
    )


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text stored as a Matroska file and read back; see ``stored``.

    Null and empty texts give one frame of 255s. Equal rows give equal rows; other
    columns of ``docs`` are left out; no rows give no rows. A row is worked on
    alone, so one very long text costs its own length only.
    """

    def work(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            data, offsets = utf8_column(batch.column(1))
            out = [stored(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * 7
            arrays = [pa.array(keys, pa.int64()), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in OP3_SCHEMA.split(", ")])

    return with_text(docs, "doc_id").mapInArrow(work, OP3_SCHEMA)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 3 over all documents."""
    return media_digests(documents(spark, sf_dir))
