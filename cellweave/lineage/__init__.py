"""Cell-level lineage: relations as expressions, stored encodings, and path queries."""
