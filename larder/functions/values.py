"""How untidy values are read: digests, picture hashes, splits, names, addresses.

All are native column expressions; a null or unreadable value gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the three splits.
SPLIT_SPELLINGS = {
    "train": ("train", "training"),
    "valid": ("val", "valid", "validation"),
    "test": ("test", "testing"),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256_text(c: Column | str) -> Column:
    """The 64 lower-case hex digits that the value denotes, else null.

    Case, blanks, a leading ``sha256:`` and separators between the digits make
    no difference.
    """
    bare = F.regexp_replace(F.lower(_col(c)), r"^\s*(sha-?256\s*[:=\-]?|0x)", "")
    bare = F.regexp_replace(bare, r"[\s:\-_]", "")
    return F.when(bare.rlike(r"^[0-9a-f]{64}$"), bare)


def empty_file_sha256() -> Column:
    return F.sha2(F.lit(""), 256)


def phash_bits(c: Column | str) -> Column:
    """The 64 bits that a hex value denotes as BIGINT (same bits, signed).

    Leading zeros may be missing or in excess; a flat picture (all bits equal)
    counts as missing.
    """
    bare = F.regexp_replace(F.lower(F.regexp_replace(_col(c), r"\s", "")), r"^(0x|#)", "")
    digits = F.regexp_extract(bare, r"^0*([0-9a-f]{1,16})$", 1)
    digits = F.lpad(F.when(digits != "", digits), 16, "0")
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
    bits = F.shiftleft(high, 32).bitwiseOR(low)
    return F.when(bits.isNotNull() & ~bits.isin(0, -1), bits)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def read_split(c: Column | str) -> Column:
    """train, valid or test in whatever spelling, else null."""
    bare = F.regexp_replace(F.lower(_col(c)), r"[^a-z]", "")
    out = F.lit(None).cast("string")
    for split, spellings in SPLIT_SPELLINGS.items():
        out = F.when(bare.isin(*spellings), split).otherwise(out)
    return out


def split_of_folders(path: Column | str) -> Column:
    """The split named by a folder of the path (not the file name), else null."""
    parts = F.split(_col(path), r"[/\\]")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    splits = F.array_compact(F.transform(folders, read_split))
    return F.try_element_at(splits, F.lit(1))


def is_blank(c: Column | str) -> Column:
    return _col(c).isNull() | ~_col(c).rlike(r"\S")


def read_name(c: Column | str) -> Column:
    """Lower case, each run of other than ASCII letters and digits as one ``_``, none at the ends; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]+", "_"), r"^_|_$", "")
    return F.when(bare != "", bare)


def read_capture(source_group: Column | str, image_path: Column | str) -> Column:
    """The capture a picture belongs to: group (or path) without folders and ``.rf.`` suffix, read as a name."""
    raw = F.when(is_blank(source_group), _col(image_path)).otherwise(_col(source_group))
    base = F.regexp_extract(F.regexp_replace(raw, r"[/\\\s]+$", ""), r"(?s)([^/\\]*)$", 1)
    return read_name(F.regexp_replace(base, r"(?is)\.rf\..*$", ""))


def _unescape(c: Column) -> Column:
    """Percent-escapes read; ``+`` stays; what is no valid escape stays as written."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def read_image_url(c: Column | str) -> Column:
    """Host, path and parameter ``id`` of an address as one text, else null.

    Scheme, case of the host, port, other parameters, fragment and percent-escapes
    make no difference.  Blank addresses and stand-in pictures under ``/static/``
    denote nothing.
    """
    raw = F.regexp_replace(F.trim(F.regexp_replace(_col(c), r"^\s+|\s+$", "")), r"#.*$", "")
    rest = F.regexp_replace(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?:]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.when(path == "", "/").otherwise(_unescape(path))
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    ident = _unescape(F.regexp_extract(query, r"(?:^|&)(?:i|%69)(?:d|%64)=([^&]*)", 1))
    return F.when(~is_blank(raw) & (host != "") & ~path.startswith("/static/"), F.concat_ws("\n", host, path, ident))
