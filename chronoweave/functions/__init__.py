"""Column expressions: time parsing, geodesy, planar geometry, road profiles, edge intervals."""
