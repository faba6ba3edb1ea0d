"""Readers and writers: TIFF and GRIB data sources, histograms, summaries, test grids."""
