"""Media columns in the Matroska container: writing, parsing into packet tables, and features of the samples.

A payload becomes one PCM track of 8-bit mono samples at 8 kHz in clusters of laced blocks, with cues. The parser
takes any stream of EBML elements, unknown sizes, the three lacings and block groups included.
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

from plumeria.llm.common import stored
from plumeria.llm.words import slices

#: Element ids of the format (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, MUXING_APP, WRITING_APP = 0x4282, 0x4D80, 0x5741
_MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
_TOP = {INFO, TRACKS, CLUSTER, CUES}
LACINGS = ("none", "xiph", "fixed", "ebml")

RATE = 8000
UNIT = 64
FRAME, FRAMES, BLOCKS = 512, 8, 8


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, in the least bytes or ``width``."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, content: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(content)) + content


def _unsigned(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], lacing: str) -> bytes:
    sizes = [len(x) for x in frames]
    head = bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml" and len(sizes) > 1:
        head += vint(sizes[0])
        for before, now in zip(sizes, sizes[1:-1], strict=False):
            width = next(n for n in range(1, 9) if abs(now - before) < (1 << 7 * n - 1) - 1)
            head += vint(now - before + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], lacing: str | None = None) -> bytes:
    """A SimpleBlock; without ``lacing``, the plainest that the frames allow."""
    if lacing is None:
        even = len({len(x) for x in frames}) == 1
        lacing = "none" if len(frames) == 1 else "fixed" if even else "xiph" if len(frames) % 2 else "ebml"
    flags = 0x80 | LACINGS.index(lacing) << 1
    body = frames[0] if lacing == "none" else _lace(frames, lacing)
    return element(SIMPLE_BLOCK, vint(track) + struct.pack(">hB", relative, flags) + body)


def write_media(payload: bytes, frame: int = FRAME, frames: int = FRAMES, blocks: int = BLOCKS) -> bytes:
    """A Matroska file whose only track holds ``payload`` as 8-bit samples."""
    audio = element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _unsigned(CHANNELS, 1) + _unsigned(BIT_DEPTH, 8)
    track = _unsigned(TRACK_NUMBER, 1) + _unsigned(TRACK_UID, 1) + _unsigned(TRACK_TYPE, 2)
    track += element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    info = _unsigned(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"plumeria") + element(WRITING_APP, b"plumeria")
    parts = [element(INFO, info), element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, parts)), []
    for begin in range(0, len(payload), frame * frames * blocks):
        body = [_unsigned(TIMESTAMP, begin * 1000 // RATE)]
        for start in range(begin, min(begin + frame * frames * blocks, len(payload)), frame * frames):
            held = payload[start : start + frame * frames]
            cut = [held[i : i + frame] for i in range(0, len(held), frame)]
            body.append(block(1, (start - begin) * 1000 // RATE, cut))
        parts.append(element(CLUSTER, b"".join(body)))
        where = _unsigned(CUE_TRACK, 1) + _unsigned(CUE_CLUSTER_POSITION, at)
        cues.append(element(CUE_POINT, _unsigned(CUE_TIME, begin * 1000 // RATE) + element(CUE_TRACK_POSITIONS, where)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(parts))


def _number(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, place after it, whether all its bits are set, which as a size means unknown)."""
    first = data[at]
    if not first:
        raise ValueError(f"not a variable-length integer at byte {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError(f"the stream ends within an integer at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    bare = value & (1 << 7 * width) - 1
    return value if keep_marker else bare, at + width, bare == (1 << 7 * width) - 1


def elements(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(id, element's begin, content's begin, content's end), masters before their content."""
    ends = [len(data) if end is None else end]
    unknown: list[bool] = [False]
    while True:
        while len(ends) > 1 and at >= ends[-1]:
            ends.pop()
            unknown.pop()
        if at >= ends[-1]:
            return
        begin = at
        kind, at, _ = _number(data, at, True)
        size, at, open_ = _number(data, at)
        if kind in _TOP and unknown[-1] and len(ends) > 2:  # ends a cluster of unknown size
            ends.pop()
            unknown.pop()
        to = ends[-1] if open_ else at + size
        if to > ends[-1]:
            raise ValueError(f"an element goes beyond its parent at byte {begin}")
        yield kind, begin, at, to
        if kind in _MASTERS:
            ends.append(to)
            unknown.append(open_)
        else:
            at = to


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, byte ranges of the frames) of a block's content."""
    track, at, _ = _number(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = LACINGS[flags >> 1 & 3]
    if lacing == "none":
        return track, relative, flags, [(at, end - at)]
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == "xiph":
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == "ebml" and count > 1:
        size, at, _ = _number(data, at)
        sizes.append(size)
        for _ in range(count - 2):
            before = at
            step, at, _ = _number(data, at)
            size += step - ((1 << 7 * (at - before) - 1) - 1)
            sizes.append(size)
    if lacing == "fixed":
        if (end - at) % count:
            raise ValueError("frames of a fixed lacing differ")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames go beyond their block")
    ranges = []
    for size in sizes:
        ranges.append((at, size))
        at += size
    return track, relative, flags, ranges


def parse(data: bytes) -> dict:
    """tracks, packets (track, timestamp in ns, begin, size, key frame, lacing, cluster) and cues of a file."""
    tracks: dict[int, dict] = {}
    packets: list[tuple] = []
    cues: list[tuple[int, int]] = []
    clusters: list[int] = []
    segment, scale, base, track, time = 0, 1_000_000, 0, {}, 0
    group, refers = 0, False
    for kind, begin, at, end in elements(data):
        if kind in (SIMPLE_BLOCK, BLOCK):
            number, relative, flags, ranges = _frames(data, at, end)
            stamp, known = (base + relative) * scale, tracks.get(number, {})
            lacing = LACINGS[flags >> 1 & 3]
            key = bool(flags & 0x80) if kind == SIMPLE_BLOCK else not refers
            for place, size in ranges:
                packets.append((number, stamp, place, size, key, lacing, len(clusters) - 1))
                if "bytes_a_second" in known:
                    stamp += size * 1_000_000_000 // known["bytes_a_second"]
        elif kind == BLOCK_GROUP:
            group, refers = len(packets), False
        elif kind == REFERENCE_BLOCK:  # the group's block is no key frame; it may stand before or after it
            refers = True
            packets[group:] = [(*x[:4], False, *x[5:]) for x in packets[group:]]
        elif kind == SEGMENT:
            segment = at
        elif kind == CLUSTER:
            clusters.append(begin - segment)
        elif kind == TIMESTAMP:
            base = int.from_bytes(data[at:end], "big")
        elif kind == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[at:end], "big")
        elif kind == TRACK_ENTRY:
            track = {"rate": 8000.0, "channels": 1}
        elif kind == TRACK_NUMBER:
            tracks[int.from_bytes(data[at:end], "big")] = track
        elif kind == CODEC_ID:
            track["codec"] = data[at:end].decode("ascii", "replace")
        elif kind == SAMPLING_FREQUENCY:
            track["rate"] = struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0]
        elif kind in (CHANNELS, BIT_DEPTH):
            track["channels" if kind == CHANNELS else "bits"] = int.from_bytes(data[at:end], "big")
            if "bits" in track:
                track["bytes_a_second"] = int(track["rate"]) * track["channels"] * track["bits"] // 8
        elif kind == CUE_TIME:
            time = int.from_bytes(data[at:end], "big") * scale
        elif kind == CUE_CLUSTER_POSITION:
            cues.append((time, int.from_bytes(data[at:end], "big")))
    return {"tracks": tracks, "packets": packets, "cues": cues, "clusters": clusters}


def feature(data: bytes, found: dict, samples: np.ndarray) -> str:
    """Counts of the container and sums over the samples, as text."""
    laced = [x[5] for x in found["packets"]]
    positions = set(found["clusters"])
    sound = all(place in positions for _, place in found["cues"])
    centred = samples.astype(np.int16) - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    parts = {
        "packets": len(laced), "clusters": len(positions), "cues": len(found["cues"]), "cued": int(sound),
        "ms": len(samples) * 1000 // RATE, **{x: laced.count(x) for x in LACINGS},
        "sum": int(samples.sum(dtype=np.int64)), "energy": int((centred.astype(np.int64) ** 2).sum()), "crossings": crossings,
    }
    return ";".join(f"{k}={v}" for k, v in parts.items())


def _stored_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
        media = [write_media(x + bytes(-len(x) % UNIT or UNIT * (not x))) for x in texts]
        columns = [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in slices(batches, 64):
        rows = []
        for data in batch.column(2).to_pylist():
            found = parse(data)
            payload = b"".join(data[at : at + size] for _, _, at, size, *_ in found["packets"])
            said = feature(data, found, np.frombuffer(payload, np.uint8))
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), said))
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[x.split()[0] for x in FEATURES.split(", ")])


PACKETS = (
    "doc_id long, packet long, track int, timestamp_ns long, offset long, size long, key_frame boolean, lacing string, "
    "cluster int"
)


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PACKETS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32()]
    for batch in slices(batches, 16):
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [(doc_id, i, *x) for i, x in enumerate(parse(data)["packets"])] if data else []
            for at in range(0, len(rows), 8192):
                columns = zip(*rows[at : at + 8192], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


def media_column(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a Matroska file, in a table of the shared folder.

    The payload is the text in UTF-8 and zero bytes up to a positive multiple of 64; a null text counts as empty and
    has 64 of them. The file depends on the text alone. Null and repeated doc_ids are kept, an empty table gives an
    empty one, and other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(_stored_media, "doc_id long, n_bytes long, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of every media file of ``media_column``, from the bytes as read back."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)


def packet_table(media: DataFrame, column: str = "media", doc_id: str = "doc_id") -> DataFrame:
    """One row for each packet of every file: track, timestamp, byte range, lacing; null files have none."""
    return media.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).alias("media")).mapInArrow(_packets, PACKETS)
