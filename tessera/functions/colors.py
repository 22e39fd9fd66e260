"""Colours: names, hex codes, colour maps, and packed pixels.

A packed pixel is a BIGINT: red in the lowest byte, then green, blue and alpha.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = tuple[int, int, int]

#: The CSS names that are used most; any other colour can be given as hex or a triple.
NAMES: dict[str, str] = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00", "cyan": "#00ffff", "aqua": "#00ffff",
    "magenta": "#ff00ff", "fuchsia": "#ff00ff", "gray": "#808080", "grey": "#808080", "silver": "#c0c0c0", "maroon": "#800000", "olive": "#808000", "lime": "#00ff00",
    "teal": "#008080", "navy": "#000080", "purple": "#800080", "orange": "#ffa500", "pink": "#ffc0cb", "brown": "#a52a2a", "gold": "#ffd700", "indigo": "#4b0082",
    "violet": "#ee82ee", "lightblue": "#add8e6", "darkblue": "#00008b", "lightgreen": "#90ee90", "darkgreen": "#006400", "darkred": "#8b0000", "lightgray": "#d3d3d3",
    "lightgrey": "#d3d3d3", "darkgray": "#a9a9a9", "darkgrey": "#a9a9a9", "salmon": "#fa8072", "coral": "#ff7f50", "tomato": "#ff6347", "khaki": "#f0e68c", "crimson": "#dc143c",
    "turquoise": "#40e0d0", "skyblue": "#87ceeb", "steelblue": "#4682b4", "royalblue": "#4169e1", "orchid": "#da70d6", "plum": "#dda0dd", "tan": "#d2b48c", "chocolate": "#d2691e",
}
#: Colours for up to twenty categories, far apart in hue and lightness.
KEY: list[str] = [
    "#d62728", "#1f77b4", "#2ca02c", "#9467bd", "#ff7f0e", "#e6d72a", "#8c564b", "#e377c2", "#7f7f7f", "#17becf",
    "#98df8a", "#aec7e8", "#ffbb78", "#c5b0d5", "#c49c94", "#f7b6d2", "#bcbd22", "#393b79", "#637939", "#843c39",
]


def rgb(color: str | Sequence[int]) -> RGB:
    """Red, green and blue of a name, #rrggbb or triple."""
    if not isinstance(color, str):
        if len(color) != 3:
            raise ValueError("a colour triple has three numbers")
        return tuple(int(c) for c in color)  # type: ignore[return-value]
    code = NAMES.get(color.lower(), color)
    if not (len(code) == 7 and code[0] == "#"):
        raise ValueError(f"unknown colour {color!r}")
    return int(code[1:3], 16), int(code[3:5], 16), int(code[5:7], 16)


def color_map(colors: Sequence[str | Sequence[int]], start: float = 0.0, end: float = 1.0, reverse: bool = False) -> list[RGB]:
    """A slice of a colour map."""
    some = [rgb(c) for c in colors]
    some = some[::-1] if reverse else some
    return some[int(round(start * len(some))) : int(round(end * len(some)))]


def pack(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Four channels from 0 to 255 as one long; fractions are truncated."""
    byte = lambda c, s: F.shiftleft(c.cast("long").bitwiseAND(F.lit(255)), s)
    return byte(r, 0).bitwiseOR(byte(g, 8)).bitwiseOR(byte(b, 16)).bitwiseOR(byte(a, 24))


def channel(pixel: Column, n: int) -> Column:
    """Channel 0 to 3 (red, green, blue, alpha) as a long from 0 to 255."""
    return F.shiftrightunsigned(pixel, 8 * n).bitwiseAND(F.lit(255))
