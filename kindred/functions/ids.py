"""Identifier clean-up as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The audio extensions that end an id, and the characters an id never keeps.
EXTENSIONS = ("mp3", "wav", "m4a", "aiff", "aif", "au", "flac", "ogg")
DROPPED = ";., "


def normalise(id_: Column, brackets: bool = False) -> Column:
    """Drop ``; . ,`` and blanks, with ``brackets`` also ``[ ]``."""
    return F.translate(id_, DROPPED + ("[]" if brackets else ""), "")


def unwrap_bytes(text: Column) -> Column:
    """``b'value'`` to ``value``; other text stays."""
    return F.regexp_replace(text, r"^\s*b'(.*)'\s*$", "$1")


def strip_prefixes(path: Column, prefixes: Sequence[str]) -> Column:
    """Remove every occurrence of the given storage prefixes."""
    return F.regexp_replace(path, "|".join(re.escape(p) for p in sorted(prefixes, key=len, reverse=True)), "")


def strip_path(path: Column) -> Column:
    """File name without its folders."""
    return F.regexp_replace(path, r"^.*/", "")


def strip_extension(path: Column) -> Column:
    """Path without the last extension; a leading dot of a name is not an extension."""
    return F.regexp_replace(path, r"([^/.][^/]*)\.[^./]*$", "$1")


def match_key(path: Column, strip: bool = True, lower: bool = False) -> Column:
    """The form in which ids from different files are compared."""
    key = strip_extension(strip_path(path)) if strip else path
    return F.lower(key) if lower else key


def class_from_path(path: Column, root: str = "music/", separator: str = "/") -> Column:
    """First folder below ``root``."""
    return F.split_part(F.replace(path, F.lit(root), F.lit("")), F.lit(separator), F.lit(1))
