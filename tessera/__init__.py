"""Grid aggregation on Spark: glyphs to pixels, reductions per pixel, grids to images."""
