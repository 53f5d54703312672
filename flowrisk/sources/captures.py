"""Packet captures: classic PCAP and PCAPNG files to raw packets to decoded packets.

A file is cut into byte ranges that are read in parallel. Formats without a sync mark give no certain way into
their middle, so a large file is walked twice. First every range looks for a place that starts a chain of plausible
records, walks to its end and notes where it came out, how many packets it met and which interfaces it saw. A range
must begin where the one before came out; one that does not is walked again from there. Then all ranges know
their exact entry, their first packet's number and their interfaces, and their packets are read. Frames are decoded
batch-wise on one byte buffer with numpy.
"""

from __future__ import annotations

import io
import ipaddress
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowrisk.constants import (CLASSIC_MAGIC, IPV6_MAX_HEADER_BYTES, IPV6_MAX_HEADERS,
                                LINK_ETHERNET, LINK_RAW, LINK_SLL, MAX_RECORD_BYTES, PCAPNG_MAGIC)
from flowrisk.schema import PACKET
from flowrisk.session import stage

BATCH = 20_000
#: Bytes of a file that one task reads, and bytes it holds at a time.
RANGE, BLOCK = 128 << 20, 4 << 20
#: A place is taken for a record's start if so many records follow, none larger than this; bytes that are searched.
CHAIN, USUAL, SEARCH = 64, 1 << 18, 1 << 20
_SECTION_MARKS = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}


def _need(ok: bool, problem: str) -> None:
    if not ok:
        raise ValueError(f"capture: {problem}")


class _Input:
    """A file's bytes, of which one block is held."""

    def __init__(self, file, length: int):
        self.file, self.length, self.low, self.block = file, length, 0, b""

    def place(self, at: int, size: int) -> int | None:
        """Where the ``size`` bytes at ``at`` stand in ``block``; None if the file ends before."""
        here = at - self.low
        if here < 0 or here + size > len(self.block):
            if at + size > self.length:
                return None
            self.file.seek(at)
            self.low, self.block = at, self.file.read(min(max(size, BLOCK), self.length - at))
            here = 0
        return here

    def take(self, at: int, size: int) -> bytes | None:
        here = self.place(at, size)
        return None if here is None else self.block[here:here + size]


@dataclass
class _Walk:
    """Where a reader stands, and what it has learned of the file on its way."""

    data: _Input
    classic: bool = True
    order: str | None = None
    interfaces: list = field(default_factory=list)  # (link type, ticks a second)
    at: int = 0
    sections: int = 0

    @classmethod
    def begin(cls, data: _Input) -> _Walk:
        """At the start of a file, whose format is told by its first bytes."""
        mark = data.take(0, min(4, data.length))
        if mark == PCAPNG_MAGIC:
            return cls(data, False, _SECTION_MARKS.get(data.take(8, 4) or b""))
        _need(mark in CLASSIC_MAGIC, "neither classic PCAP nor PCAPNG")
        order, ticks = CLASSIC_MAGIC[mark]
        head = data.take(0, 24)
        _need(head is not None, "truncated file header")
        version = struct.unpack_from(order + "HH", head, 4)
        _need(version == (2, 4), f"unsupported version {version}")
        return cls(data, True, order, [(struct.unpack_from(order + "I", head, 20)[0], ticks)], 24)

    def packets(self, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(interface, ticks, start, size) of the packets whose records begin before ``end``."""
        step = self._record if self.classic else self._block
        end = min(end, self.data.length)
        while self.at < end:
            packet = step()
            if packet:
                yield packet

    def _record(self):
        data, at = self.data, self.at
        here = data.place(at, 16)
        _need(here is not None, "truncated packet header")
        seconds, fraction, size, _ = struct.unpack_from(self.order + "IIII", data.block, here)
        _need(size <= MAX_RECORD_BYTES, "packet too long")
        _need(at + 16 + size <= data.length, "truncated packet")
        self.at = at + 16 + size
        return 0, seconds * self.interfaces[0][1] + fraction, at + 16, size

    def _block(self):
        data, at = self.data, self.at
        _need(at + 12 <= data.length, "truncated block")
        here = data.place(at, 12)
        section = data.block[here:here + 4] == PCAPNG_MAGIC
        if section:
            self.order = _SECTION_MARKS.get(data.block[here + 8:here + 12])
            self.interfaces, self.sections = [], self.sections + 1
        _need(self.order is not None, "no valid section header")
        kind, size = struct.unpack_from(self.order + "II", data.block, here)
        _need(size >= (28 if section else 12) and size % 4 == 0 and size <= MAX_RECORD_BYTES
              and at + size <= data.length, "bad block length")
        tail = data.take(at + size - 4, 4) if size > BLOCK else None
        here = data.place(at, min(size, BLOCK))
        tail = tail or data.block[here + size - 4:here + size]
        _need(struct.unpack(self.order + "I", tail)[0] == size, "block lengths differ")
        self.at = at + size
        if section:
            return None
        body = size - 12
        if kind == 1:
            _need(body >= 8, "truncated interface block")
            content = data.take(at + 8, body)
            self.interfaces.append((struct.unpack_from(self.order + "H", content)[0],
                                    _resolution(content[8:], self.order)))
        elif kind == 6:
            _need(body >= 20, "truncated packet block")
            which, high, low, captured, _ = struct.unpack_from(self.order + "IIIII", data.block, here + 8)
            _need(captured <= body - 20, "truncated packet")
            return which, (high << 32) | low, at + 28, captured
        return None

    def enter(self, start: int) -> bool:
        """Stand at the first place from ``start`` on that looks like a record's; false if there is none."""
        data = self.data
        size = min(SEARCH + USUAL, data.length - start)
        held = data.take(start, size) if size > 0 else None
        if held is None:
            return False
        whole, orders = start + size == data.length, [self.order] if self.classic else ["<", ">"]
        for order in orders:
            at = _first_chain(held, order, self.classic, self.interfaces[0][1] if self.classic else 0, -start % 4, whole)
            if at is not None:
                self.at, self.order = start + at, order
                return True
        return False


def _first_chain(held: bytes, order: str, classic: bool, ticks: int, align: int, whole: bool) -> int | None:
    """The first place from which CHAIN plausible records follow, or fewer up to the end of what is held."""
    end, bad = len(held), set()
    head = struct.Struct(order + ("IIII" if classic else "II"))

    def step(at):
        """Where the next record would begin; None if this cannot be one."""
        if at + head.size > end:
            return None
        if classic:
            seconds, fraction, size, original = head.unpack_from(held, at)
            return at + 16 + size if seconds and fraction < ticks and size <= USUAL and size <= original else None
        kind, size = head.unpack_from(held, at)
        if size < 12 or size % 4 or size > USUAL:
            return None
        if at + size <= end and struct.unpack_from(order + "I", held, at + size - 4)[0] != size:
            return None
        return at + size

    for first in range(0 if classic else align, min(end, SEARCH), 1 if classic else 4):
        chain, at = [], first
        while at is not None and at not in bad and len(chain) < CHAIN and at < end:
            chain.append(at)
            at = step(at)
        if at is not None and at not in bad and (len(chain) >= (CHAIN if at < end else 4) or at == end and whole):
            return first
        bad.update(chain)
    return None


def _resolution(options: bytes, order: str) -> int:
    """Ticks per second of an interface: option 9, microseconds by default."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        _need(at + 4 + size <= len(options), "truncated option")
        if code == 9 and size:
            value = options[at + 4]
            return 2 ** (value & 0x7F) if value & 0x80 else 10 ** value
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def _raw_batches(file: str, walk: _Walk, end: int, first: int, max_packets: int | None) -> Iterator[pd.DataFrame]:
    """The packets whose records begin before ``end``; the first one has number ``first``."""
    rows = []
    if max_packets is None or first < max_packets:
        for number, (which, ticks, at, size) in enumerate(walk.packets(end), first):
            _need(which < len(walk.interfaces), f"no interface {which}")
            link, rate = walk.interfaces[which]
            rows.append((file, number, ticks * 1_000_000 // rate, link, walk.data.take(at, size)))
            if number + 1 == max_packets:
                break
            if len(rows) == BATCH:
                yield pd.DataFrame(rows, columns=PACKET.names)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=PACKET.names)


def _check_cap(max_packets: int | None) -> None:
    if max_packets is not None and max_packets <= 0:
        raise ValueError("max_packets must be positive")


def scan_captures(files: DataFrame, max_packets: int | None = None) -> DataFrame:
    """Raw packets of (path, content) rows, a file in one task; the cap counts every packet of a file."""
    _check_cap(max_packets)

    def scan(batches):
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                yield from _raw_batches(file, _Walk.begin(_Input(io.BytesIO(data), len(data))), len(data), 0, max_packets)

    return files.select("path", "content").mapInPandas(scan, PACKET)


def open_input(path: str):
    """A seekable file of any store that pyarrow reaches."""
    local = path.removeprefix("file:")
    if "://" in local and not path.startswith("file:"):
        store, name = arrow_fs.FileSystem.from_uri(path)
        return store.open_input_file(name)
    return arrow_fs.LocalFileSystem().open_input_file("/" + local.lstrip("/"))


def _can_open(path: str) -> bool:
    try:
        open_input(path).close()
        return True
    except (OSError, ValueError, ImportError):
        return False


_RANGES = ("file string, length long, first long, last long, entry long, `order` string, exit long, exit_order string, "
           "packets long, sections long, interfaces array<struct<link: int, ticks: string>>")


def walked(ranges: DataFrame) -> DataFrame:
    """Ranges with what a walk from ``entry`` met; without an entry it looks for one. ``exit`` is null if it failed."""

    def walk(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                entry = None if pd.isna(row.entry) else int(row.entry)
                with open_input(row.file) as file:
                    reader, exit_at, packets = _Walk.begin(_Input(file, row.length)), None, 0
                    found = []
                    if entry is not None:
                        reader.at, reader.order = entry, row.order or reader.order
                    elif row.first > 0 and not reader.enter(row.first):
                        reader.at = None
                    entry, order = reader.at, reader.order
                    if not reader.classic:
                        reader.interfaces = []
                    if entry is not None:
                        try:
                            packets = sum(1 for _ in reader.packets(row.last))
                            exit_at = reader.at
                        except ValueError:
                            pass  # told when the range is read, if it is
                        found = reader.interfaces if not reader.classic or row.first == 0 else []
                out.append((row.file, row.length, row.first, row.last, entry, order, exit_at, reader.order, packets,
                            reader.sections, [{"link": link, "ticks": str(ticks)} for link, ticks in found]))
            frame = pd.DataFrame(out, columns=["file", "length", "first", "last", "entry", "order", "exit", "exit_order",
                                               "packets", "sections", "interfaces"])
            yield frame.astype({"entry": "Int64", "exit": "Int64"})

    return _spread(ranges).mapInPandas(walk, _RANGES)


def _spread(ranges: DataFrame) -> DataFrame:
    """One task a range."""
    return ranges.repartition(int(min(max(ranges.count(), 1), 100_000)))


def indexed(ranges: DataFrame) -> DataFrame:
    """(file, length, last, entry, order, first_no, interfaces) of ranges that can be reached, with their exact entries.

    Walks every range at once, then again those that do not begin where the one before came out, until all do.
    """
    along = Window.partitionBy("file").orderBy("first")
    table = stage(walked(ranges.withColumns({"entry": F.lit(None).cast("long"), "order": F.lit(None).cast("string")})), "ranges")
    while True:
        came = table.withColumns({"_exit": F.lag("exit").over(along), "_order": F.lag("exit_order").over(along)})
        same = F.col("entry").eqNullSafe(F.col("_exit")) & F.col("order").eqNullSafe(F.col("_order"))
        wrong = F.col("_exit").isNotNull() & ~same
        came = stage(came.withColumn("_wrong", wrong), "ranges")
        again = came.where("_wrong").select("file", "length", "first", "last", F.col("_exit").alias("entry"), F.col("_order").alias("order"))
        if again.isEmpty():
            break
        table = stage(came.where("not _wrong").select(*table.columns).union(walked(again).select(*table.columns)), "ranges")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.collect_list(F.struct("sections", "interfaces")).over(before)
    none = F.expr("array()").cast("array<struct<link: int, ticks: string>>")
    known = F.aggregate("_seen", none, lambda held, r: F.when(r["sections"] > 0, r["interfaces"]).otherwise(F.concat(held, r["interfaces"])))
    rows = table.withColumns({"_seen": seen, "_lost": F.max(F.col("exit").isNull()).over(before),
                              "first_no": F.coalesce(F.sum("packets").over(before), F.lit(0))})
    return stage(rows.where("not coalesce(_lost, false) and entry < last")
                 .select("file", "length", "last", "entry", "order", "first_no", known.alias("interfaces")), "ranges")


def read_ranges(ranges: DataFrame, max_packets: int | None = None) -> DataFrame:
    """Raw packets of ranges (file, length, last, entry, order, first_no, interfaces); entry null: a whole file."""

    def scan(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                with open_input(row.file) as file:
                    walk = _Walk.begin(_Input(file, row.length))
                    if not pd.isna(row.entry) and row.entry > walk.at:
                        walk.at, walk.order = int(row.entry), row.order
                        walk.interfaces = [(r["link"], int(r["ticks"])) for r in row.interfaces]
                    yield from _raw_batches(row.file, walk, row.last, int(row.first_no), max_packets)

    return _spread(ranges).mapInPandas(scan, PACKET)


def read_captures(spark: SparkSession, path: str, max_packets: int | None = None, size: int = RANGE) -> DataFrame:
    """Raw packets of all capture files under ``path``, numbered along their file, read in ranges of ``size`` bytes.

    A store that Python cannot open is read file by file through Spark, up to its 2 GB a file.
    """
    _check_cap(max_packets)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    one = files.first()
    if one is None or not _can_open(one["file"]):
        return scan_captures(spark.read.format("binaryFile").load(path), max_packets)
    whole = files.where(F.col("length") <= size).select(
        "file", "length", F.col("length").alias("last"), F.lit(None).cast("long").alias("entry"), F.lit(None).cast("string").alias("order"),
        F.lit(0).cast("long").alias("first_no"), F.expr("array()").cast("array<struct<link: int, ticks: string>>").alias("interfaces"))
    cut = files.where(F.col("length") > size)
    if cut.isEmpty():
        return read_ranges(whole, max_packets)
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    cut = cut.select("file", "length", first.alias("first")).withColumn("last", F.least(F.col("first") + size, "length"))
    cut = indexed(cut)
    if max_packets is not None:
        cut = cut.where(F.col("first_no") < max_packets)
    return read_ranges(whole.union(cut), max_packets)


class _Bytes:
    """All frames of a batch in one array; positions may point past the end, they read as zero."""

    def __init__(self, frames):
        sizes = np.fromiter((len(f) for f in frames), np.int64, len(frames))
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.data = np.frombuffer(b"".join(frames) + b"\0", np.uint8)
        self.last = len(self.data) - 1

    def u8(self, at):
        return self.data[np.minimum(at, self.last)].astype(np.int64)

    def u16(self, at):
        return self.u8(at) << 8 | self.u8(at + 1)

    def u32(self, at):
        return self.u16(at) << 16 | self.u16(at + 2)


def _network_start(b: _Bytes, link: np.ndarray):
    """Where the IP packet starts and whether there is one."""
    known = np.isin(link, (LINK_ETHERNET, LINK_RAW, LINK_SLL))
    if not known.all():
        raise ValueError(f"unsupported link type {link[~known][0]}")
    size = b.end - b.start
    at, kind, ok = b.start.copy(), np.full(len(link), 0x0800), np.ones(len(link), bool)
    ether, cooked = link == LINK_ETHERNET, link == LINK_SLL
    ok &= ~(ether & (size < 14)) & ~(cooked & (size < 16))
    kind = np.where(ether, b.u16(b.start + 12), np.where(cooked, b.u16(b.start + 14), kind))
    at += np.where(ether, 14, np.where(cooked, 16, 0))
    while True:
        tagged = ok & ether & np.isin(kind, (0x8100, 0x88A8))
        if not tagged.any():
            break
        ok &= ~tagged | (at + 4 <= b.end)
        kind = np.where(tagged, b.u16(at + 2), kind)
        at = at + 4 * tagged
    return at, ok & np.isin(kind, (0x0800, 0x86DD)) & (at < b.end)


def _skip_extensions(b: _Bytes, at, total, following, walking):
    """Walk IPv6 extension headers. Returns the transport offset, its protocol, and which survive."""
    offset, headers = np.full(len(at), 40), np.zeros(len(at), int)
    fragmented, alive = np.zeros(len(at), bool), walking.copy()
    while True:
        todo = alive & ~np.isin(following, (6, 17))
        if not todo.any():
            return offset, following, alive
        here = at + offset
        options = todo & np.isin(following, (0, 43, 60, 135))
        fragment, auth = todo & (following == 44), todo & (following == 51)
        size = np.where(options, (b.u8(here + 1) + 1) * 8,
                        np.where(fragment, 8, (b.u8(here + 1) + 2) * 4))
        bad = todo & ~(options | fragment | auth)
        bad |= todo & (headers >= IPV6_MAX_HEADERS)
        bad |= options & (following == 0) & (offset != 40)
        bad |= todo & (offset + np.where(fragment, 8, 2) > total)
        bad |= fragment & (fragmented | (b.u16(here + 2) & 0xFFF8 != 0))
        bad |= auth & (size < 8)
        bad |= todo & ((offset + size > total) | (offset + size - 40 > IPV6_MAX_HEADER_BYTES))
        alive &= ~bad
        step = todo & ~bad
        following = np.where(step, b.u8(here), following)
        offset = offset + np.where(step, size, 0)
        headers = headers + step
        fragmented |= fragment


def decode_frames(frames, link) -> pd.DataFrame:
    """One row per frame; ``ok`` is false where there is no TCP or UDP header to read."""
    b = _Bytes(frames)
    at, ok = _network_start(b, np.asarray(link))
    size = b.end - at
    version = b.u8(at) >> 4
    four, six = ok & (version == 4), ok & (version == 6)
    ihl = (b.u8(at) & 15) * 4
    four &= (size >= 20) & (ihl >= 20) & (size >= ihl) & (b.u16(at + 6) & 0x1FFF == 0)
    six &= size >= 40
    total = np.minimum(np.where(four, b.u16(at + 2), 40 + b.u16(at + 4)), size)
    skipped, upper, six = _skip_extensions(b, at, total, b.u8(at + 6), six)
    proto = np.where(four, b.u8(at + 9), upper)
    offset = np.where(four, ihl, skipped)
    top, room = at + offset, total - offset
    tcp = (four | six) & (proto == 6) & (room >= 20)
    udp = (four | six) & (proto == 17) & (room >= 8)
    flags = np.where(tcp, b.u8(top + 13), 0)

    def six_text(shift):
        known, out = {}, np.full(len(at), None, object)
        for i in np.flatnonzero(six):
            raw = b.data[at[i] + shift:at[i] + shift + 16].tobytes()
            if raw not in known:
                known[raw] = str(ipaddress.IPv6Address(raw))
            out[i] = known[raw]
        return out

    return pd.DataFrame({
        "ok": tcp | udp, "version": version, "src4": b.u32(at + 12), "dst4": b.u32(at + 16),
        "src6": six_text(8), "dst6": six_text(24), "src_port": b.u16(top).astype(np.int32),
        "dst_port": b.u16(top + 2).astype(np.int32), "protocol": np.where(tcp, "TCP", "UDP"),
        "byte_count": total, "syn": (flags >> 1 & 1).astype(np.int32),
        "rst": (flags >> 2 & 1).astype(np.int32)})


_DECODED = ("version bigint, src4 bigint, dst4 bigint, src6 string, dst6 string, src_port int, "
            "dst_port int, protocol string, byte_count bigint, syn int, rst int")


def ipv4_text(number: str):
    return F.concat_ws(".", *[F.expr(f"(shiftright({number}, {s}) & 255)").cast("string")
                              for s in (24, 16, 8, 0)])


def decode_packets(raw: DataFrame, keep: list[str] = ("file", "pkt_no", "ts_us")) -> DataFrame:
    """Decoded packets; frames without a usable transport header are dropped."""
    keep = list(keep)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw.select(*keep).schema)

    def decode(batches):
        for batch in batches:
            if len(batch):
                out = decode_frames(list(batch["frame"]), batch["link_type"].to_numpy())
                for name in keep:
                    out[name] = batch[name].to_numpy()
                yield out[out["ok"]].drop(columns="ok")

    rows = raw.select(*keep, "link_type", "frame").mapInPandas(decode, f"{_DECODED}, {schema}")
    six = F.col("version") == 6
    return rows.select(
        *keep, F.when(six, F.col("src6")).otherwise(ipv4_text("src4")).alias("src_ip"),
        F.when(six, F.col("dst6")).otherwise(ipv4_text("dst4")).alias("dst_ip"),
        "src_port", "dst_port", "protocol", "byte_count", "syn", "rst")
