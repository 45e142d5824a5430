"""Text that a font decoded to the wrong plane: runs of rare glyphs found and shifted back, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The planes, the glyphs of the rare plane that ordinary text has, and the ligatures of the OT1 font encoding.
BASE = 0x5B00
COMMON = "子孔孕字存孙孝孟季孤孩孫"
OT1 = {0x0B: "ff", 0x0C: "fi", 0x0D: "fl", 0x0E: "ffi", 0x0F: "ffl"}

SPACE = r"\s\x{1C}-\x{1F}\x{85}\p{Z}"
RUN = rf"[\x{{5A00}}-\x{{5BFF}}{SPACE}]+"
OTHER = rf"[^\x{{5A00}}-\x{{5BFF}}{SPACE}]+"
RARE = r"[\x{5B00}-\x{5B7F}]"
PLAIN = "".join(map(chr, range(0x20, 0x7F)))
SHIFTED = "".join(chr(BASE + ord(c)) for c in PLAIN)


def garbled(run: Column) -> Column:
    """Whether a run of glyphs is noise: eight of them, four different, and at least half, and four, rare. Only a run with a glyph of the rare plane is looked at."""

    def noise(glyphs: Column) -> Column:
        rare = F.length(F.regexp_replace(glyphs, rf"[^\x{{5B00}}-\x{{5B7F}}]|[{COMMON}]", ""))
        n = F.length(glyphs)
        return (n >= 8) & F.get(F.transform(F.array(rare), lambda r: (r >= 4) & (2 * r >= n)), F.lit(0)) & (F.size(F.array_distinct(F.split(glyphs, ""))) >= 4)

    # The glyphs and their rare ones are bound once each.
    return run.rlike(RARE) & F.get(F.transform(F.array(F.regexp_replace(run, f"[{SPACE}]+", "")), noise), F.lit(0))


def pieces(text: Column) -> Column:
    """The text as runs of glyphs and white space, and what is between them."""
    return F.regexp_extract_all(text, F.lit(f"{RUN}|{OTHER}"), F.lit(0))


def is_garbled(text: Column) -> Column:
    return text.rlike(RARE) & F.exists(pieces(text), garbled)


def restored(text: Column) -> Column:
    """The text with its garbled runs shifted back; all else as it is, so a text without a rare glyph isn't cut into pieces."""

    def shifted(run: Column) -> Column:
        out = F.translate(run, SHIFTED, PLAIN)
        for code, letters in OT1.items():
            out = F.replace(out, F.lit(chr(BASE + code)), F.lit(letters))
        return out

    whole = F.array_join(F.transform(pieces(text), lambda p: F.when(garbled(p), shifted(p)).otherwise(p)), "")
    return F.when(text.rlike(RARE), whole).otherwise(text)
