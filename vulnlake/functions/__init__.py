"""Column-level functions: each takes and returns a ``Column`` built from
Spark's own expressions, so they stay inside whole-stage codegen."""
