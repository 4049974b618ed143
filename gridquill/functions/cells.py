"""Cell-level functions: colours, letters, values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard indexed palette
PALETTE = """
000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF 000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF
800000 008000 000080 808000 800080 008080 C0C0C0 808080 9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF
000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF 00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99
3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696 003366 339966 003300 333300 993300 993366 333399 333333
000000 FFFFFF
""".split()


def resolve_color(rgb: Column, indexed: Column, theme_rgb: Column) -> Column:
    """#RRGGBB of a colour given as (A)RGB, palette index or theme lookup; null if none is.
    The alpha pair is dropped; 00000000 is no colour."""
    palette = F.array(*(F.lit(x) for x in PALETTE))
    return (
        F.when(rgb.isNotNull() & (rgb != "00000000"), F.concat(F.lit("#"), F.upper(F.right(rgb, F.lit(6)))))
        .when(indexed.between(0, len(PALETTE) - 1), F.concat(F.lit("#"), F.get(palette, indexed)))
        .when(theme_rgb.isNotNull(), F.concat(F.lit("#"), F.upper(F.right(theme_rgb, F.lit(6)))))
    )


def dominant_color(runs: Column) -> Column:
    """Colour of the first run that has one."""
    return F.get(F.filter(runs, lambda r: r["color"].isNotNull()), F.lit(0))["color"]


def any_bold(runs: Column, font_bold: Column) -> Column:
    return F.coalesce(F.exists(runs, lambda r: r["bold"]), F.lit(False)) | F.coalesce(font_bold, F.lit(False))


def column_letter(col: Column) -> Column:
    """1 -> A, 27 -> AA, up to three letters."""
    n = col - 1
    a, b = F.floor((n - 26) / 676), F.floor((n - 702) / 676)
    letter = lambda x: F.char((F.lit(65) + x).cast("long"))
    two = F.concat(letter(F.floor((n - 26) / 26)), letter(F.pmod(n - 26, F.lit(26))))
    m = n - 702
    three = F.concat(letter(b), letter(F.pmod(F.floor(m / 26), F.lit(26))), letter(F.pmod(m, F.lit(26))))
    del a
    return F.when(n < 26, letter(n)).when(n < 702, two).otherwise(three)


def cell_text(runs: Column, plain: Column) -> Column:
    """Rich text: its runs joined as they are; a plain value: trimmed of blanks and line ends."""
    rich = F.array_join(F.transform(runs, lambda r: r["text"]), "")
    return F.when(F.size(runs) > 0, rich).otherwise(F.regexp_replace(plain, r"\A[\x{3000} \t\r\n]+|[\x{3000} \t\r\n]+\z", ""))
