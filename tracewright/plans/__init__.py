"""Jobs made of operators: batch indexing, constraint mining and the registered queries."""
