"""DataFrame operators over grids and distributions."""
