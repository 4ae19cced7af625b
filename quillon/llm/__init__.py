"""Training-data operators. The rest of the package doesn't import this subpackage; its queries are in `queries`, their SQL in `sql`."""
