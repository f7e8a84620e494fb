"""Writers: result tables, briefs, metrics, report documents, cache appends."""
