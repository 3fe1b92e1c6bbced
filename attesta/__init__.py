"""Evidence analytics on Spark: text preparation, retrieval, quote checking, histories and event metrics as DataFrame operators."""
