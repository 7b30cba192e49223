"""Column -> Column expressions; everything here stays inside codegen."""
