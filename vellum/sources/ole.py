"""The OLE2 container: sectors chained by a table, a directory, and small streams in a mini-stream."""

from __future__ import annotations

import struct

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FREE, END, FAT_SECTOR, DIFAT_SECTOR = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
SECTOR, MINI_CUTOFF = 512, 4096


class OleFile:
    """Streams by name, whatever the case."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an OLE2 file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff, first_mini = struct.unpack_from("<II", data, 56)
        difat, n_difat = struct.unpack_from("<II", data, 68)
        blocks = list(struct.unpack_from("<109I", data, 76))
        for _ in range(n_difat):
            if difat >= DIFAT_SECTOR:
                break
            part = struct.unpack(f"<{self.size // 4}I", self.sector(difat))
            blocks += part[:-1]
            difat = part[-1]
        self.fat: list[int] = []
        for b in [b for b in blocks if b < DIFAT_SECTOR][:n_fat]:
            self.fat += struct.unpack(f"<{self.size // 4}I", self.sector(b))
        self.entries: dict[str, tuple[int, int]] = {}
        folder, root = self.chain(first_dir), (END, 0)
        for at in range(0, len(folder) - 127, 128):
            length, kind = struct.unpack_from("<HB", folder, at + 64)
            start, size = struct.unpack_from("<II", folder, at + 116)
            if kind == 5:
                root = (start, size)
            elif kind == 2:
                self.entries[folder[at : at + max(0, length - 2)].decode("utf-16-le", "replace").lower()] = (start, size)
        mini = self.chain(first_mini) if first_mini < DIFAT_SECTOR else b""
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini)
        self.mini = self.chain(root[0])[: root[1]] if root[0] < DIFAT_SECTOR else b""

    def sector(self, n: int) -> bytes:
        part = self.data[(n + 1) * self.size : (n + 2) * self.size]
        return part.ljust(self.size, b"\0")

    def chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < DIFAT_SECTOR and n < len(self.fat) and n not in seen:
            seen.add(n)
            out.append(self.sector(n))
            n = self.fat[n]
        return b"".join(out)

    def names(self) -> list[str]:
        return list(self.entries)

    def stream(self, name: str) -> bytes | None:
        if name.lower() not in self.entries:
            return None
        n, size = self.entries[name.lower()]
        if size >= self.cutoff:
            return self.chain(n)[:size]
        out, seen = [], set()
        while n < DIFAT_SECTOR and n < len(self.mini_fat) and n not in seen:
            seen.add(n)
            out.append(self.mini[n * self.mini_size : (n + 1) * self.mini_size])
            n = self.mini_fat[n]
        return b"".join(out)[:size]


def write_ole(streams: dict[str, bytes]) -> bytes:
    """A container of the streams. Short ones are padded to the cutoff, so that all lie in ordinary sectors."""
    padded = {k: v.ljust(MINI_CUTOFF, b"\0") for k, v in sorted(streams.items(), key=lambda x: (len(x[0]), x[0].upper()))}
    n_dir = -(-(len(padded) + 1) // 4)
    n_data = sum(-(-len(v) // SECTOR) for v in padded.values())
    n_fat = 1
    while n_fat * 128 < n_fat + n_dir + n_data:
        n_fat += 1
    if n_fat > 109:
        raise ValueError("over 6.8 MB: more than the header's table holds")
    fat, at = [FAT_SECTOR] * n_fat, n_fat

    def take(n: int) -> int:
        nonlocal at
        fat.extend([*range(at + 1, at + n), END])
        at += n
        return at - n

    first_dir = take(n_dir)
    starts = {k: take(-(-len(v) // SECTOR)) for k, v in padded.items()}

    def entry(name: str, kind: int, start: int, size: int, right: int = FREE, child: int = FREE) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII16sIQQII", len(raw) if name else 0, kind, 1, FREE, right, child, b"", 0, 0, 0, start, size) + b"\0\0\0\0"

    names = list(padded)
    folder = entry("Root Entry", 5, END, 0, child=1 if names else FREE)
    for k, name in enumerate(names, 1):  # a chain to the right is a search tree in name order
        folder += entry(name, 2, starts[name], len(padded[name]), right=k + 1 if k < len(names) else FREE)
    folder = folder.ljust(n_dir * SECTOR, b"\0")
    fat += [FREE] * (n_fat * 128 - len(fat))
    difat = [*range(n_fat), *[FREE] * (109 - n_fat)]
    head = MAGIC + b"\0" * 16 + struct.pack("<HHHHH6sIIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, b"", 0, n_fat, first_dir, 0, MINI_CUTOFF, END, 0, END, 0, difat[0]) + struct.pack("<108I", *difat[1:])
    body = struct.pack(f"<{n_fat * 128}I", *fat) + folder + b"".join(v.ljust(-(-len(v) // SECTOR) * SECTOR, b"\0") for v in padded.values())
    return head + body


def summary(data: bytes | None) -> dict[int, str]:
    """Text properties of a summary stream by number: 2 title, 4 author, 6 comments."""
    out: dict[int, str] = {}
    if not data or len(data) < 48:
        return out
    try:
        (base,) = struct.unpack_from("<I", data, 44)
        (n,) = struct.unpack_from("<I", data, base + 4)
        page = 1252
        found = [struct.unpack_from("<II", data, base + 8 + 8 * k) for k in range(min(n, 200))]
        for number, at in found:
            kind = struct.unpack_from("<I", data, base + at)[0]
            if number == 1 and kind == 2:
                page = struct.unpack_from("<H", data, base + at + 4)[0]
        for number, at in found:
            kind, size = struct.unpack_from("<II", data, base + at)
            raw = data[base + at + 8 : base + at + 8 + size * (2 if kind == 31 else 1)]
            if kind in (30, 31):
                text = raw.decode("utf-16-le" if kind == 31 else "utf-8" if page == 65001 else "cp1252", "replace")
                out[number] = text.split("\0")[0].strip()
    except struct.error:
        pass
    return out


def summary_of(ole: OleFile, comments: bool = False) -> tuple[str, dict]:
    found = summary(ole.stream("\x05SummaryInformation"))
    meta = {"author": found[4]} if found.get(4) else {}
    if comments and found.get(6):
        meta["comments"] = found[6]
    return found.get(2, ""), meta


def write_summary(title: str, author: str = "") -> bytes:
    """A summary stream with title and author in UTF-8."""
    values = [(1, struct.pack("<Ihh", 2, -535, 0))]
    for number, text in ((2, title), (4, author)):
        if text:
            raw = text.encode() + b"\0"
            values.append((number, struct.pack("<II", 30, len(raw)) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")))
    at, index, body = 8 + 8 * len(values), b"", b""
    for number, raw in values:
        index += struct.pack("<II", number, at + len(body))
        body += raw
    part = struct.pack("<II", at + len(body), len(values)) + index + body
    return struct.pack("<HHI16sI", 0xFFFE, 0, 0x20105, b"", 1) + bytes.fromhex("e0859ff2f94f6810ab9108002b27b3d9") + struct.pack("<I", 48) + part
