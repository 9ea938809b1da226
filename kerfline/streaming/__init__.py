"""Incremental versions: windows and sessions over event time, a stateful segmenter, and a file ledger fed by batches."""
