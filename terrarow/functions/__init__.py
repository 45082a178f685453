"""Column functions: grid and projection, geometry on arrays of points, text formats."""
