"""Column functions for text: repair, trimming, tokens, display forms."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from both ends of a text, as a regex class body. Java's own
# trim and \s know ASCII blanks only.
BLANKS = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: what ends a line.
LINE_BREAK = r"\R|[\x1c-\x1e]"
# Marks of inclusive writing, dropped without leaving a gap.
MIDDOTS = "·•"
# Fixed value: a token is a run of two or more word characters. A Hangul syllable stands for two
# or three letters, so one alone is enough.
TOKEN = r"[\p{L}\p{N}_]{2,}|[\uac00-\ud7a3]"


@lru_cache(maxsize=1)
def _letter_map() -> tuple[str, str]:
    """Two arguments for ``translate``: accented letters to their base letter; middots and
    non-spacing marks, which have no partner in the second string, to nothing."""
    src, dst, drop = [], [], [MIDDOTS]
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        if unicodedata.category(c) == "Mn":
            drop.append(c)
        elif unicodedata.category(c)[0] in "LN" and c.lower() == c:
            base = [d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn"]
            if len(base) == 1 and base[0] != c:
                src.append(c)
                dst.append(base[0])
    return "".join(src + drop), "".join(dst)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def is_blank(col: Column) -> Column:
    return ~col.rlike(f"[^{BLANKS}]")


def unless_blank(col: Column) -> Column:
    """Array of the text, or an empty array for a blank one. Exploding it drops blank texts without
    computing an expensive ``col`` a second time in a filter below the projection."""
    return F.filter(F.array(col), lambda t: ~is_blank(t))


def lines(col: Column) -> Column:
    return F.split(col, LINE_BREAK)


def fold_letters(col: Column) -> Column:
    """Lower-case, without middots and accents; plain ASCII text skips the letter map."""
    low = F.lower(col)
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.translate(low, *_letter_map())).otherwise(low)


def tokenize(col: Column) -> Column:
    """Array of search tokens in text order."""
    return F.regexp_extract_all(fold_letters(col), F.lit(TOKEN), F.lit(0))


def token_text(col: Column) -> Column:
    """The tokens joined by one blank: compact to shuffle, cheap to split again."""
    return F.array_join(tokenize(col), " ")


def split_tokens(col: Column) -> Column:
    """Inverse of ``token_text``; empty text gives an empty array."""
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(col, " "))


def repair_encoding(col: Column) -> Column:
    """Undo UTF-8 text that was decoded as Latin-1 or Windows-1252.

    Only whole texts that become valid UTF-8 again are changed.
    """
    specials = "".join(
        bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
    )
    controls = "".join(
        chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
    )
    single = F.translate(col, specials, controls)
    suspicious = single.rlike(r"[\u00c2-\u00f4][\u0080-\u00bf]") & ~single.rlike(r"[^\u0000-\u00ff]")
    raw = F.encode(F.when(suspicious, single), "ISO-8859-1").cast("string")
    return F.when(suspicious & F.is_valid_utf8(raw), raw).otherwise(col)


def one_line(col: Column, length: int = 130) -> Column:
    """Display form: the first ``length`` characters on one line."""
    return F.regexp_replace(F.substring(col, 1, length), "\n", " ")


def or_unknown(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("?"))


def sentences(col: Column) -> Column:
    """Non-blank runs between end marks or line ends, stripped."""
    runs = F.transform(F.regexp_extract_all(col, F.lit(r"[^.!?\n]+"), F.lit(0)), strip)
    return F.filter(runs, lambda s: s != "")
