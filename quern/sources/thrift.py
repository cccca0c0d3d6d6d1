"""The compact protocol of Thrift, read into plain Python values, and the layouts of a file's metadata."""

from __future__ import annotations

import struct
from dataclasses import dataclass


class Truncated(ValueError):
    """The bytes end before the structure does."""


@dataclass(frozen=True)
class Layout:
    """Names of a structure's fields by id, and the layouts or enumerations of those that have one."""

    fields: dict[int, tuple]

    def of(self, number: int) -> tuple:
        entry = self.fields.get(number, (None,))
        return entry if len(entry) == 2 else (entry[0], None)


class Names(tuple):
    """An enumeration; numbers without a name stay as text."""

    def name(self, number: int) -> str:
        return self[number] if 0 <= number < len(self) and self[number] else str(number)


class Reader:
    """Reads one structure after the other from bytes; ``at`` is behind the last."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Truncated(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def unsigned(self) -> int:
        value = shift = 0
        while True:
            byte = self.take(1)[0]
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7
            if shift > 70:
                raise ValueError("a variable-length integer is too long")

    def signed(self) -> int:
        value = self.unsigned()
        return value >> 1 ^ -(value & 1)

    def value(self, kind: int, layout, inline: bool):
        """One value; a structure's own booleans are in its field header (``inline``)."""
        match kind:
            case 1 | 2:
                return kind == 1 if inline else self.take(1)[0] == 1
            case 3:
                return int.from_bytes(self.take(1), "little", signed=True)
            case 4 | 5 | 6:
                number = self.signed()
                return layout.name(number) if isinstance(layout, Names) else number
            case 7:
                return struct.unpack("<d", self.take(8))[0]
            case 8:
                return bytes(self.take(self.unsigned()))
            case 9 | 10:
                return self.items(layout)
            case 11:
                return self.pairs()
            case 12:
                return self.structure(layout or Layout({}))
        raise ValueError(f"unknown type {kind}")

    def items(self, layout) -> list:
        head = self.take(1)[0]
        count = head >> 4
        if count == 15:
            count = self.unsigned()
        return [self.value(head & 15, layout, False) for _ in range(count)]

    def pairs(self) -> list[tuple]:
        count = self.unsigned()
        kinds = self.take(1)[0] if count else 0
        return [(self.value(kinds >> 4, None, False), self.value(kinds & 15, None, False)) for _ in range(count)]

    def structure(self, layout: Layout) -> dict:
        """The fields that the layout names; others are read over."""
        out, number = {}, 0
        while head := self.take(1)[0]:
            number = number + (head >> 4) if head >> 4 else self.signed()
            name, inner = layout.of(number)
            value = self.value(head & 15, inner, True)
            if name:
                out[name] = value
        return out


# The names and numbers of the file format's own specification.
PHYSICAL = Names(("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"))
REPETITION = Names(("REQUIRED", "OPTIONAL", "REPEATED"))
CONVERTED = Names(
    ("UTF8", "MAP", "MAP_KEY_VALUE", "LIST", "ENUM", "DECIMAL", "DATE", "TIME_MILLIS", "TIME_MICROS", "TIMESTAMP_MILLIS", "TIMESTAMP_MICROS")
    + ("UINT_8", "UINT_16", "UINT_32", "UINT_64", "INT_8", "INT_16", "INT_32", "INT_64", "JSON", "BSON", "INTERVAL")
)
ENCODING = Names(("PLAIN", "", "PLAIN_DICTIONARY", "RLE", "BIT_PACKED", "DELTA_BINARY_PACKED", "DELTA_LENGTH_BYTE_ARRAY", "DELTA_BYTE_ARRAY", "RLE_DICTIONARY", "BYTE_STREAM_SPLIT"))
CODEC = Names(("UNCOMPRESSED", "SNAPPY", "GZIP", "LZO", "BROTLI", "LZ4", "ZSTD", "LZ4_RAW"))
PAGE = Names(("DATA_PAGE", "INDEX_PAGE", "DICTIONARY_PAGE", "DATA_PAGE_V2"))

KEY_VALUE = Layout({1: ("key",), 2: ("value",)})
TIME_UNIT = Layout({1: ("MILLIS",), 2: ("MICROS",), 3: ("NANOS",)})
TIMED = Layout({1: ("is_adjusted_to_utc",), 2: ("unit", TIME_UNIT)})
LOGICAL = Layout(
    {
        1: ("STRING",),
        2: ("MAP",),
        3: ("LIST",),
        4: ("ENUM",),
        5: ("DECIMAL", Layout({1: ("scale",), 2: ("precision",)})),
        6: ("DATE",),
        7: ("TIME", TIMED),
        8: ("TIMESTAMP", TIMED),
        10: ("INTEGER", Layout({1: ("bit_width",), 2: ("is_signed",)})),
        11: ("UNKNOWN",),
        12: ("JSON",),
        13: ("BSON",),
        14: ("UUID",),
        15: ("FLOAT16",),
        16: ("VARIANT",),
        17: ("GEOMETRY",),
        18: ("GEOGRAPHY",),
    }
)
SCHEMA_ELEMENT = Layout(
    {
        1: ("type", PHYSICAL),
        2: ("type_length",),
        3: ("repetition_type", REPETITION),
        4: ("name",),
        5: ("num_children",),
        6: ("converted_type", CONVERTED),
        7: ("scale",),
        8: ("precision",),
        9: ("field_id",),
        10: ("logical_type", LOGICAL),
    }
)
STATISTICS = Layout({1: ("max",), 2: ("min",), 3: ("null_count",), 4: ("distinct_count",), 5: ("max_value",), 6: ("min_value",), 7: ("is_max_value_exact",), 8: ("is_min_value_exact",)})
ENCODING_STATS = Layout({1: ("page_type", PAGE), 2: ("encoding", ENCODING), 3: ("count",)})
COLUMN_META = Layout(
    {
        1: ("type", PHYSICAL),
        2: ("encodings", ENCODING),
        3: ("path_in_schema",),
        4: ("codec", CODEC),
        5: ("num_values",),
        6: ("total_uncompressed_size",),
        7: ("total_compressed_size",),
        8: ("key_value_metadata", KEY_VALUE),
        9: ("data_page_offset",),
        10: ("index_page_offset",),
        11: ("dictionary_page_offset",),
        12: ("statistics", STATISTICS),
        13: ("encoding_stats", ENCODING_STATS),
        14: ("bloom_filter_offset",),
        15: ("bloom_filter_length",),
    }
)
COLUMN_CRYPTO = Layout({1: ("footer_key",), 2: ("column_key", Layout({1: ("path_in_schema",), 2: ("key_metadata",)}))})
COLUMN_CHUNK = Layout(
    {
        1: ("file_path",),
        2: ("file_offset",),
        3: ("meta_data", COLUMN_META),
        4: ("offset_index_offset",),
        5: ("offset_index_length",),
        6: ("column_index_offset",),
        7: ("column_index_length",),
        8: ("crypto_metadata", COLUMN_CRYPTO),
        9: ("encrypted_column_metadata",),
    }
)
SORTING = Layout({1: ("column_idx",), 2: ("descending",), 3: ("nulls_first",)})
ROW_GROUP = Layout({1: ("columns", COLUMN_CHUNK), 2: ("total_byte_size",), 3: ("num_rows",), 4: ("sorting_columns", SORTING), 5: ("file_offset",), 6: ("total_compressed_size",), 7: ("ordinal",)})
AES = Layout({1: ("aad_prefix",), 2: ("aad_file_unique",), 3: ("supply_aad_prefix",)})
FILE_META = Layout(
    {
        1: ("version",),
        2: ("schema", SCHEMA_ELEMENT),
        3: ("num_rows",),
        4: ("row_groups", ROW_GROUP),
        5: ("key_value_metadata", KEY_VALUE),
        6: ("created_by",),
        7: ("column_orders", Layout({1: ("TYPE_ORDER",)})),
        8: ("encryption_algorithm", Layout({1: ("AES_GCM_V1", AES), 2: ("AES_GCM_CTR_V1", AES)})),
        9: ("footer_signing_key_metadata",),
    }
)
DATA_PAGE = Layout({1: ("num_values",), 2: ("encoding", ENCODING), 3: ("definition_level_encoding", ENCODING), 4: ("repetition_level_encoding", ENCODING), 5: ("statistics", STATISTICS)})
DATA_PAGE_V2 = Layout(
    {
        1: ("num_values",),
        2: ("num_nulls",),
        3: ("num_rows",),
        4: ("encoding", ENCODING),
        5: ("definition_levels_byte_length",),
        6: ("repetition_levels_byte_length",),
        7: ("is_compressed",),
        8: ("statistics", STATISTICS),
    }
)
DICTIONARY_PAGE = Layout({1: ("num_values",), 2: ("encoding", ENCODING), 3: ("is_sorted",)})
PAGE_HEADER = Layout(
    {
        1: ("type", PAGE),
        2: ("uncompressed_page_size",),
        3: ("compressed_page_size",),
        4: ("crc",),
        5: ("data_page", DATA_PAGE),
        6: ("index_page",),
        7: ("dictionary_page", DICTIONARY_PAGE),
        8: ("data_page_v2", DATA_PAGE_V2),
    }
)
