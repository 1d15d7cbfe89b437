"""Column-level helpers: types, missing values, names and small formulas."""
