"""Plain functions on one text or one document, which operators apply to Arrow batches."""
