"""Header layout of a block file: bytes to Header."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# Fixed values of the format: field type codes and file type codes.
ALPHA, DATE, SHORT, LONG, CURRENCY, NUMBER, LOGICAL = 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x09
MEMO, BLOB, FMT_MEMO, OLE, GRAPHIC = 0x0C, 0x0D, 0x0E, 0x0F, 0x10
TIME, TIMESTAMP, AUTOINC, BCD, BYTES = 0x14, 0x15, 0x16, 0x17, 0x18
TYPE_NAMES = {
    ALPHA: "Alpha", DATE: "Date", SHORT: "Short", LONG: "Long", CURRENCY: "Currency", NUMBER: "Number", LOGICAL: "Logical", MEMO: "MemoBLOb", BLOB: "BLOb",
    FMT_MEMO: "FmtMemoBLOb", OLE: "OLE", GRAPHIC: "Graphic", TIME: "Time", TIMESTAMP: "Timestamp", AUTOINC: "AutoInc", BCD: "BCD", BYTES: "Bytes",
}
INDEXED, PRIMARY_INDEX, PLAIN, SECONDARY_NONINC, SECONDARY_INC = 0, 1, 2, 3, 5
#: Bytes of the fixed header, of the extended one, of a block's head, and of a BCD field whatever its size byte says.
FIXED, EXTENDED, BLOCK_HEAD, BCD_WIDTH = 0x58, 32, 6, 17
#: The first encryption marker's value that sends one to the second, in the extended header.
SEE_EXTENDED = 0xFF00FF00


class TableError(ValueError):
    """A file that can't be read as a block table."""


@dataclass(frozen=True)
class Field:
    """A column: name, type code, size byte and where it lies in a record."""

    name: str
    code: int
    size: int
    offset: int

    @property
    def width(self) -> int:
        return BCD_WIDTH if self.code == BCD else self.size


@dataclass(frozen=True)
class Header:
    """What the header of a data or index file says."""

    record_size: int
    header_size: int
    file_type: int
    block_kib: int
    record_count: int
    file_blocks: int
    root: int
    levels: int
    version: int
    encryption: int
    code_page: int | None
    table_name: str
    fields: tuple[Field, ...] = field(default=())

    @property
    def block_size(self) -> int:
        return self.block_kib * 1024

    def block_at(self, block: int) -> int:
        """Where a block (from 0) begins, in 64-bit arithmetic."""
        return self.header_size + block * self.block_size


def header_length(head: bytes) -> int:
    """Bytes to read for the whole header, from its first four."""
    if len(head) < 4:
        raise TableError("the file is too short for a header")
    return struct.unpack_from("<H", head, 2)[0]


def parse(data: bytes) -> Header:
    """The header of a file, from its first header_length() bytes."""
    if len(data) < FIXED:
        raise TableError(f"the header is cut off after {len(data)} bytes")
    record_size, header_size, file_type, block_kib, record_count = struct.unpack_from("<HHBBi", data, 0)
    file_blocks, root, levels, n_fields = (struct.unpack_from(f, data, at)[0] for f, at in (("<H", 0x0C), ("<H", 0x1E), ("<B", 0x20), ("<h", 0x21)))
    encryption, version = struct.unpack_from("<I", data, 0x25)[0], data[0x39]
    at, code_page = FIXED, None
    try:
        if file_type in (INDEXED, PLAIN, SECONDARY_NONINC, SECONDARY_INC) and version >= 5:
            second, code_page = struct.unpack_from("<I", data, at + 4)[0], struct.unpack_from("<H", data, at + 18)[0]
            encryption = second if encryption in (0, SEE_EXTENDED) else encryption
            at += EXTENDED
        kinds = [(data[at + 2 * k], data[at + 2 * k + 1]) for k in range(n_fields)]
        at += 2 * n_fields
        if file_type == PRIMARY_INDEX:
            kinds += [(SHORT, 2)] * 3
        named = file_type in (INDEXED, PLAIN)
        at += 4 + 4 * n_fields * named
        width = 261 if version >= 0x0C else 79
        table_name = data[at : at + width].split(b"\0", 1)[0].decode("ascii", "replace")
        at += width
        names = []
        for k in range(len(kinds)):
            if named:
                end = data.index(b"\0", at)
                names.append(data[at:end].decode("utf-8", "replace"))
                at = end + 1
            else:
                names.append(f"k{k}" if k < n_fields else ("child_block", "x1", "x2")[k - n_fields])
    except (IndexError, ValueError, struct.error) as e:
        raise TableError(f"the header is cut off: {e}") from e
    fields, offset = [], 0
    for name, (code, size) in zip(names, kinds, strict=True):
        if code not in TYPE_NAMES:
            raise TableError(f"column {name} has the unknown type {code:#x}")
        f = Field(name, code, size, offset)
        fields.append(f)
        offset += f.width
    if offset > record_size:
        raise TableError(f"columns take {offset} bytes of a record of {record_size}")
    return Header(record_size, header_size, file_type, block_kib, record_count, file_blocks, root, levels, version, encryption, code_page, table_name, tuple(fields))
