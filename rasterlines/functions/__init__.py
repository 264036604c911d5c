"""Column expressions: everything of scalar or array size, without Python at run time."""
