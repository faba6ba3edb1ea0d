"""Column functions: bit views, packing, whitening and error measures."""
