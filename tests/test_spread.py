"""Spreading of images and its dynamic radius against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import spread

SHAPE = (12, 10)


def _image(n: int, seed: int) -> dict[tuple[int, int], int]:
    gen = np.random.default_rng(seed)
    out = {}
    for _ in range(n):
        r, g, b, a = (int(v) for v in gen.integers(0, 256, 4))
        out[int(gen.integers(0, SHAPE[0])), int(gen.integers(0, SHAPE[1]))] = r | g << 8 | b << 16 | (a if n % 2 else max(a, 1)) << 24
    return out


def _over(src: int, dst: int) -> int:
    s, d = ([(c >> 8 * n & 255) / 255.0 for n in range(4)] for c in (src, dst))
    alpha = s[3] + d[3] * (1 - s[3])
    mix = [(x * s[3] + y * d[3] * (1 - s[3])) / alpha if alpha else 0.0 for x, y in zip(s[:3], d[:3])]
    return sum(int(min(1.0, v) * 255) << 8 * n for n, v in enumerate([*mix, alpha]))


def _plain(pixels: dict[tuple[int, int], int], px: int, form: str) -> dict[tuple[int, int], int]:
    out: dict[tuple[int, int], int] = {}
    for (y, x), c in sorted(pixels.items()):
        if not c >> 24:
            continue
        for dy in range(-px, px + 1):
            for dx in range(-px, px + 1):
                if (form == "square" or (dy * dy + dx * dx) ** 0.5 <= px + 0.5) and 0 <= y + dy < SHAPE[0] and 0 <= x + dx < SHAPE[1]:
                    out[y + dy, x + dx] = _over(c, out.get((y + dy, x + dx), 0))
    return out


def _frame(spark, pixels):  # noqa: ANN001, ANN202
    return spark.createDataFrame([(y, x, c) for (y, x), c in pixels.items()], "py int, px int, rgba long").repartition(3)


def _same(got, want):  # noqa: ANN001, ANN202
    assert got.keys() == want.keys()
    # a channel may be one off where a product lands on a whole number
    for k in want:
        assert all(abs((got[k] >> 8 * n & 255) - (want[k] >> 8 * n & 255)) <= 1 for n in range(4)), k


@pytest.mark.parametrize("form", ["circle", "square"])
@pytest.mark.parametrize("px", [1, 2])
def test_image(spark, px, form):  # noqa: ANN001, ANN201
    pixels = _image(25, 3)
    got = {(r["py"], r["px"]): r["rgba"] for r in spread.spread(_frame(spark, pixels), SHAPE, px, form).collect()}
    _same(got, _plain(pixels, px, form))


@pytest.mark.parametrize("n", [2, 6, 24, 60])
@pytest.mark.parametrize("threshold", [0.2, 0.5, 1.0])
def test_dynamic_radius(spark, n, threshold):  # noqa: ANN001, ANN201
    pixels = _image(n, n)
    there = [k for k, c in pixels.items() if c >> 24]

    def near(radius: int) -> float:
        return sum(any(0 < max(abs(y - v), abs(x - u)) <= radius for v, u in there) for y, x in there) / len(there) if there else float("inf")

    px = next((r - 1 for r in range(1, 4) if near(2 * r) > threshold), 3)
    got = {(r["py"], r["px"]): r["rgba"] for r in spread.dynspread(_frame(spark, pixels), SHAPE, threshold).collect()}
    _same(got, _plain(pixels, px, "circle") if px else pixels)
