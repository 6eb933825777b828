"""Training-data operators; nothing outside this subpackage imports it (the pipeline file aside)."""
