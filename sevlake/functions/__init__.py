"""Column expressions.  Each function takes and returns a Column;
all of them are built-in Spark expressions and stay inside whole-stage codegen."""
